"""Endings, blanks, refusals, copies and languages at any length and any size of the table."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import languages, pair_defects, truncation
from textloom.llm.blank import blank, is_blank

WORDS = ("mill", "sea", "rope", "valley", "wind", "boats", "stone", "garden", "lamp", "river")


def essay(rng, n=40):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n // 8))


def kinds(spark, rows):
    return {r.rec_id: (r.ending, r.kind) for r in truncation.truncated(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()}


BLANKS = ["N/A" + " " * 250, "None" + "​" * 210, "<essay>" * 60, "—" * 500, " " * 1000, "<p>" + " " * 300 + "null</p>", "", None]


@pytest.mark.parametrize("text", BLANKS)
def test_blank_at_any_length(spark, text):
    assert is_blank(text)
    assert spark.createDataFrame([(text,)], "t string").select(blank(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["N/A is what they said" + " " * 300, "-" * 400 + " all that was left of the old mill", "<b>" * 100 + "a real text of the valley"])
def test_content_at_any_length(spark, text):
    assert not is_blank(text)
    assert not spark.createDataFrame([(text,)], "t string").select(blank(F.col("t"))).first()[0]


def test_blanks_after_a_cut_do_not_hide_it(spark):
    rng = random.Random(1)
    body = essay(rng)
    rows = [(1, body + " And then the", "s"), (2, body + " And then the" + " " * 450, "s"), (3, body + " And then the" + "\n " * 700, "s"), (4, body + " " * 450, "s"), (5, "[" + body.replace(".", ";") * 3 + "]", "s"), (6, body + "\n\n" + "-" * 600, "s")]
    got = kinds(spark, rows)
    assert [got[i][1] for i in range(1, 7)] == ["transfer"] * 3 + [None] * 3


def test_recurring_lines_do_not_depend_on_the_number_of_texts(spark):
    def rows(n):
        rng = random.Random(3)
        out = [(i, essay(rng, 24) + f" Number {i} ends here.", "s") for i in range(n)]
        out += [(n + i, essay(rng, 24) + f"\n\nSee also sheet {i} below", "s") for i in range(10)]
        long = "This text is part of the collection of the old mill and may be read by everyone who comes to the valley in the summer months"
        out += [(n + 20 + i, essay(rng, 24) + "\n\n" + long, "s") for i in range(4)]
        out += [(n + 30 + i, essay(rng, 24) + "\n\nBy contrast", "s") for i in range(4)] + [(n + 40 + i, essay(rng, 24) + f"\n\nBy contrast, the mill of year {i} stood still.", "s") for i in range(12)]
        return n, out

    for n, out in (rows(60), rows(6000)):
        got = kinds(spark, out)
        assert {got[n + i][1] for i in range(10)} == {None} and {got[n + 20 + i][1] for i in range(4)} == {None}
        assert None not in {got[n + 30 + i][1] for i in range(4)}


def test_edited_copies_of_a_cut_text_are_no_recurring_line(spark):
    rng = random.Random(4)
    body = essay(rng)
    rows = [(i, f"{WORDS[i]} first. " + body + "\n\nThe long road of", "s") for i in range(5)]
    assert None not in {k for _, k in kinds(spark, rows).values()}


def test_titles_are_no_cut_texts(spark):
    rng = random.Random(5)
    rows = [(i, "Of the mill" + " and sea" * (i % 7) + "s" * i, "titles") for i in range(60)] + [(100 + i, essay(rng), "essays") for i in range(60)] + [(200, essay(rng) + " and the", "essays")]
    got = kinds(spark, rows)
    assert {got[i] for i in range(60)} == {("open", None)} and got[200][1] == "transfer"


def test_cut_list_items(spark):
    rows = [(1, "Do this:\n- Open the gate.\n- Use act", "s"), (2, "Do this:\n- open the gate\n- close the gate", "s"), (3, "It was late.\n\n- Anna Miller", "s"), (4, "It was late.\n\n— The End", "s"), (5, "Do this:\n- Open the gate.\n- Me", "s")]
    got = kinds(spark, rows)
    assert [got[i][1] for i in range(1, 6)] == ["transfer", None, None, None, "transfer"]


@pytest.mark.parametrize(
    "text",
    [
        "I have now read your request twice and understand what you are after. I can't write this essay.",
        "Thank you. " * 30 + "My guidelines do not let me complete this task.",
        "Sorry, I can't help with that.",
    ],
)
def test_refusals_in_any_sentence(text):
    assert pair_defects.is_refusal(text)
    h, at = pair_defects.tokens.hash_texts([text])
    assert pair_defects.may_refuse(h, at).tolist() == [True]


@pytest.mark.parametrize(
    "text",
    [
        "It was a long year in the valley and the mill stood still. I can't help wondering about the wind.",
        "‘" + "I cannot write this essay, he said, and don’t ask me. " * 9 + "’ said the miller.",
        'Sorry, I can\'t help with that," said the miller. The wind was up.',
        '"I cannot help with this request," said the miller.',
    ],
)
def test_no_refusals(text):
    assert not pair_defects.is_refusal(text)


def test_a_question_inside_a_longer_answer(spark):
    question = "Write about the mill and the sea in the valley, with the wind on it and a rope for the boats."
    rng = random.Random(6)
    df = spark.createDataFrame([(1, question, "You asked: " + question + " " + essay(rng, 80)), (2, question, essay(rng, 80)), (3, question, question + " Now."), (4, question, essay(rng, 80) + " " + question + " And so the")], "rec_id long, input_prompt string, best_essay string")
    got = {(r.rec_id, r.defect) for r in pair_defects.pair_defects(df, fields=(("best_essay", "input_prompt"),)).collect()}
    assert got == {(1, "copy_inside"), (3, "copy"), (4, "truncated")}


TEXTS = {
    "en": "The miller of the valley watched the boats and thought about what the winter would bring to the people who lived there. ",
    "fr": "Le meunier de la vallée regardait les bateaux et pensait à ce que l'hiver apporterait aux gens qui vivaient là-bas. ",
    "it": "Il mugnaio della valle guardava le barche e pensava a quello che l'inverno avrebbe portato alla gente che viveva lì. ",
}


def test_language_profiles(spark):
    labels = {"en": ["en", "EN", "en-US", "eng"], "fr": ["fr", "fr-FR"], "it": ["it"]}
    rows = [(label, t * 3 + str(i)) for lang, t in TEXTS.items() for i, label in enumerate(labels[lang] * 3)] + [("en", TEXTS["it"] * 2), (None, "x"), ("", "y"), ("fr", None)]
    p = languages.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert p.names == ["en", "fr", "it"]
    own = [TEXTS["en"], TEXTS["fr"].replace("é", "e").replace("à", "a"), TEXTS["it"].upper(), "", None, "42", "Книги лежат на столе у окна.", TEXTS["en"] + "Yg5wkp2MbDdecSVtm9nXNcCwww9KHCc82Xv84K" * 300, TEXTS["en"] + TEXTS["fr"] * 3]
    assert p.languages(*p.scores(own)) == ["en", "fr", "it", None, None, None, "other_script", "en", "fr"]
    none = languages.learn(spark.createDataFrame([], "lang string, text string"))
    assert none.languages(*none.scores(["some text", None])) == [None, None]
    df = spark.createDataFrame([(i, TEXTS["en"], a) for i, a in enumerate((TEXTS["it"], TEXTS["en"] + "Indeed.", "Книги лежат на столе у окна.", TEXTS["fr"] * 2 + TEXTS["en"]))], "rec_id long, input_prompt string, best_essay string")
    for profiles, want in ((p, {0, 2, 3}), (none, {2})):
        got = pair_defects.pair_defects(df, fields=(("best_essay", "input_prompt"),), profiles=profiles).where("defect = 'other_language'").collect()
        assert {r.rec_id for r in got} >= want - ({2} if profiles is none else set()) and {r.rec_id for r in got} <= want
