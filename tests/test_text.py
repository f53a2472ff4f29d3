import hashlib

from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_strip_takes_all_python_blanks(spark):
    blanks = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, T.strip("t"), t=blanks + "a b" + blanks) == "a b"
    assert one(spark, T.word_count("t"), t=f"a{blanks}b\x85c") == 3
    assert one(spark, T.word_count("t"), t="") == 0


def test_clean_output(spark):
    body = "word " * 49 + "last"
    raw = f"Sure! Here is a piece on rope:\n\n{body} 😀 “quoted” – done…\n\n\n\nmore\n\nI hope this helps you.\n"
    cleaned = one(spark, T.clean_output("t", 50), t=raw)
    assert cleaned.startswith("word") and cleaned.endswith('"quoted" - done...\n\nmore')
    assert one(spark, T.clean_output("t", 50), t="too short") is None
    assert one(spark, T.clean_output("t", 1), t="ﬁne") == "fine"


def test_clean_title(spark):
    assert one(spark, T.clean_title("t"), t='  "Title: The  Mill" ') == "The  Mill"
    assert one(spark, T.clean_title("t"), t="subject: Ropes") == "Ropes"


def test_variants(spark):
    assert one(spark, T.variants("t"), t="Discuss The Role Of mills. Discuss it. What is rope?") == [
        "Explore The Role Of mills. Discuss it. What is rope?",
        "Discuss The Role Of mills. Discuss it. Tell me about rope?",
        "Discuss how mills. Discuss it. What is rope?",
    ]
    assert one(spark, T.variants("t"), t="nothing here") == []


def test_instruction_topic(spark):
    cases = {
        "explain tides": "the nature and implications of tides",
        "Describe a mill ": "a mill and its significance",
        "Compare ropes to chains": "the relative merits of ropes versus chains",
        "Should we sing": "whether we sing",
        "What is  rope": "rope and what it means",
        "What are ropes": "ropes and what it means",
        "Tell me": "Tell me",
        "": "",
    }
    for text, topic in cases.items():
        assert one(spark, T.instruction_topic("t"), t=text) == topic


def test_canonical_template(spark):
    assert one(spark, T.canonical_template("p", "t"), p="On mills and mills, <topic>", t=" mills ") == "On {topic} and {topic}, {topic}"
    assert one(spark, T.canonical_template("p", "t"), p="On Mills and mills", t="MILLS") == "On {topic} and mills"
    assert one(spark, T.canonical_template("p", "t"), p="none", t="") == "none"


def test_slots_and_full_text(spark):
    filled = T.fill_slots("p", F.lit("rope"), F.lit("calm"))
    assert one(spark, filled, p='{topic}: {"json": 1} {style_instructions}') == 'rope: {"json": 1} calm'
    assert one(spark, T.full_text(F.col("a"), F.col("b"), F.col("c")), a=" sys ", b="on {topic}", c="") == "sys\n\non <topic>"
    assert one(spark, T.compose(F.lit(" a "), F.lit(" b "), F.col("t")), t="  ") == "a\n\nb"


def test_fewshot_block(spark):
    df = spark.createDataFrame([(["  short ", "x" * 20],), ([],)], "e array<string>")
    block, empty = [r.x for r in df.select(T.fewshot_block(F.col("e"), 10).alias("x")).collect()]
    assert "--- Reference example 1 ---\nshort\n" in block and block.endswith("x" * 10 + "\n[... truncated ...]")
    assert empty == ""


def test_pair_row_id(spark):
    got = one(spark, T.pair_row_id(F.col("a"), F.col("b"), F.col("c")), a=" é ", b=None, c="x　")
    assert got == hashlib.sha256("é\n\nx".encode()).hexdigest()


def test_sentence_ratio(spark):
    assert one(spark, T.keyword_sentence_ratio("t", ("mill",)), t="A Mill. No! Windmills? End") == 0.5


def test_parse_triplet(spark):
    got = one(spark, T.parse_triplet("t"), t='{"system_prompt": " a ", "user_template": "b"}')
    assert (got.system_prompt, got.user_template, got.style_instructions) == ("a", "b", "")
    assert one(spark, T.parse_triplet("t"), t='{"system_prompt": ') is None
    got = one(spark, T.parse_triplet("t"), t="SYSTEM: be calm\nUSER: write\nSTYLE: plain")
    assert (got.system_prompt, got.user_template, got.style_instructions) == ("be calm", "write Topic: {topic}.", "plain")
    got = one(spark, T.parse_triplet("t"), t="on {topic}")
    assert (got.system_prompt, got.user_template) == ("You are a thoughtful writer.", "on {topic}")
