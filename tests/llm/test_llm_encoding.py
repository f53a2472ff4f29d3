"""Exact round trips of wrong decoding over many pages, also repeated; learned shares; verified repairs."""

import random

import numpy as np
import pytest

from textloom.llm import encoding as E

TEXTS = {
    "fr": ["L'élève préfère la forêt où l'été s'achève.", "Ça dépend du château près de l'église à côté.", "Le théâtre fermé là-bas répète l'œuvre du maître.", "Même ainsi, la vallée dépasse l'écluse à peine.", "Où va le garçon blessé, là où naît le fleuve ?"],
    "de": ["Die Mühle prägt das Dorf über viele Jahre.", "In Möhren heißt es, das Gespräch gehört der Großmutter.", "Für die Schüler wäre der Süden zu weiß.", "Übrigens hörte der Zöllner die Gebühren für Öfen.", "Ärgerlich, dass die Öfen außen kälter werden."],
    "es": ["El jardín sigue más allá del cañón según la niña.", "También el camión llegó después de la estación.", "¿Qué pasó aquí con el pingüino y el muñeco?", "La región perdió la búsqueda por pura intuición."],
    "pt": ["A ação não começou às vezes na estação.", "O irmão e o avô não têm razão à noite.", "A canção da região é uma lição às crianças."],
}
RNG = random.Random(3)
CLEAN = {lang: [" ".join(RNG.choices(t, k=4)) for _ in range(50)] for lang, t in TEXTS.items()}


@pytest.fixture(scope="module")
def table():
    import pyarrow as pa

    texts = [t for own in CLEAN.values() for t in own] * 4 + ["The mill by the sea is old and the boats are gone for the winter."] * 200
    rows = next(E._count(iter([pa.RecordBatch.from_pydict({"source": ["s"] * len(texts), "text": texts})]))).to_pandas()
    return E._log_bigrams(list(rows[rows.unit.isna()].itertuples()))


UTF8 = [("cp1252", 1), ("mac_roman", 1), ("cp437", 1), ("cp737", 1), ("cp775", 1), ("cp869", 1), ("iso8859_10", 1), ("koi8_r", 1), ("cp1251", 1), ("cp1256", 1), ("cp866", 1), ("cp1252", 2), ("cp1252", 3), ("cp1252", 6)]


@pytest.mark.parametrize("lang", list(TEXTS))
@pytest.mark.parametrize(("page", "times"), UTF8)
def test_utf8_read_as_another_page(table, page, times, lang):
    for text in CLEAN[lang][:6]:
        bad = text
        for _ in range(times):
            bad = E._decode(bad.encode(), page) or "�"
        if "�" in bad:
            pytest.skip("the page has no sign for a byte")
        got, damaged, verified = E.repair(bad, {}, table)
        assert damaged and verified and got == text


@pytest.mark.parametrize(("written", "read"), [("latin_1", "cp437"), ("latin_1", "mac_roman"), ("cp1252", "cp1251"), ("latin_1", "cp850"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("latin_1", "cp1253"), ("latin_1", "koi8_r")])
def test_single_byte_page_read_as_another(table, written, read):
    right = total = 0
    for lang in TEXTS:
        for text in CLEAN[lang][:10]:
            try:
                bad = text.encode(written).decode(read)
            except UnicodeError:
                continue
            got, damaged, verified = E.repair(bad, {}, table)
            total += 1
            right += got == text
            assert not damaged or verified or got != text
    assert total and right >= 0.85 * total


def test_learned_shares_decide(table):
    unit, letter = "Ã©", "é"
    text = "L'Ã©lÃ©ment de l'Ã©tÃ©."
    assert E.repair(text, {}, table)[0] == "L'élément de l'été."
    flat = np.full_like(table, E.FLOOR)
    assert E.repair(text, {unit: ({"": 1.0}, 50)}, flat) == (text, False, False)
    assert E.repair(text, {unit: ({letter: 1.0}, 50)}, flat)[0] == "L'élément de l'été."


def test_few_signs_of_other_alphabets(table):
    bad = CLEAN["fr"][0][:80].replace("é", "ť", 1)
    assert not E.repair("Dvořák and Łukasz went home.", {}, table)[1]
    known = {"ť": ({"": 0.01, "é": 0.99}, 40)}
    assert "ť" in E.repair(bad, {}, table)[0] and "ť" not in E.repair(bad, known, table)[0]


def test_unknown_units_are_learned_but_not_verified(table):
    import pandas as pd

    sign = "⌘"
    assert sign not in E.SIGNS
    places = [(E._side(a), E._side(b)) for t in CLEAN["fr"] for a, c, b in zip(t, t[1:], t[2:]) if c == "é"]
    options, prior = E.candidates(sign)
    assert len(options) > 50 and abs(prior.sum() - 1) < 1e-9
    own = pd.DataFrame([(sign, a, b, 1) for a, b in places], columns=["unit", "l", "r", "n"])
    assert max(E.learn(own, table), key=lambda r: r[2])[1] == "é"


@pytest.mark.parametrize("text", ["Un café à Łódź, naïve et Zoë.", "├── drafts └── notes", "Книги «Война и мир» и Λόγος", "5 µm, 3 × 4, 20 °C, § 4, ½", "déçu, aperçu, où, haïr, créée", "L·L, paral·lel", "🙂 fin 🙂"])
def test_natural_text_stays(table, text):
    assert E.repair(text, {}, table)[:2] == (text, False)
