"""Kernels against plain brute force."""

import random
import re

import numpy as np
import pytest

from textloom.llm import encoding, leaks, packing, pair_defects, segmentation, splits, tokens
from textloom.llm.blank import is_blank
from textloom.llm.fm_index import FMIndex, maximal_matches, merged_spans, suffix_array


def test_words_and_shingles():
    texts = ["One, two_three 4five!", "", None, "a b", "Ünï çode a b c"]
    h, at = tokens.hash_texts(texts)
    assert np.diff(at).tolist() == [4, 0, 0, 2, 5]
    sh, starts = tokens.shingles(h, at)
    assert np.diff(starts).tolist() == [2, 0, 0, 0, 3]
    again, _ = tokens.shingles(*tokens.hash_texts(["4FIVE one TWO three", "a b c"]))
    assert again[-1] == sh[-1] and len(np.intersect1d(again, sh)) == 2


def test_minhash_estimates_similarity():
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    other = base[:150] + [f"x{i}" for i in range(150)]
    sh, at = tokens.shingles(*tokens.hash_texts([" ".join(base), " ".join(other)]))
    m = tokens.minhashes(sh, at, 400)
    true = tokens.jaccard(np.unique(sh[at[0] : at[1]]), np.unique(sh[at[1] : at[2]]))
    assert abs((m[0] == m[1]).mean() - true) < 0.08


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 60))])
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("seed", range(8))
def test_maximal_matches(seed):
    rng = random.Random(seed)
    indexed = [[rng.randrange(4) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
    streamed = [[rng.randrange(5) for _ in range(rng.randrange(0, 25))] for _ in range(3)]
    flat = lambda xs: (np.array([v for x in xs for v in x], np.uint64), np.cumsum([0] + [len(x) for x in xs]))
    got = set(zip(*(a.tolist() for a in maximal_matches(FMIndex(*flat(indexed)), *flat(streamed), 3))))
    want = set()
    for i, a in enumerate(streamed):
        for j, b in enumerate(indexed):
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= 3:
                            want.add((i, x, j, y, n))
    assert got == want
    if want:
        stream, mine, text, _, length = (np.array(c) for c in zip(*sorted(want)))
        for s, t, covered, _, longest in zip(*merged_spans(stream, mine, text, length)):
            own = [w for w in want if (w[0], w[2]) == (s, t)]
            assert covered == len({p for w in own for p in range(w[1], w[1] + w[4])}) and longest == max(w[4] for w in own)


def brute_alignment(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = max(0, best[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -2), best[i - 1, j] - 2, best[i, j - 1] - 2)
    return int(best.max())


@pytest.mark.parametrize("seed", range(8))
def test_smith_waterman(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(2))
    score, matched, longest = leaks.smith_waterman(np.array(a, int), np.array(b, int))
    assert score == brute_alignment(a, b) and longest <= len(a)
    runs = [n for x in range(len(a)) for y in range(len(b)) for n in range(1, min(len(a) - x, len(b) - y) + 1) if a[x : x + n] == b[y : y + n]]
    assert longest == max(runs, default=0) and matched >= longest * (score > 0) * 0


def test_rare_seeds_cover_every_window():
    h, at = tokens.hash_texts([" ".join(f"w{i}" for i in range(40)), "short one"])
    counts = {int(x): i % 7 for i, x in enumerate(tokens.shingles(h, at, leaks.SEED)[0].view(np.int64))}
    seeds = leaks.rare_seeds(h, at, counts)
    for start in range(0, 40 - leaks.RUN + 1):
        assert any(start <= s <= start + leaks.RUN - leaks.SEED for s in seeds)


@pytest.mark.parametrize("seed", range(5))
def test_lcs(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 40))] for _ in range(2))
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    assert pair_defects.lcs_length(a, b) == t[-1, -1]


def test_refusals():
    yes = ["I'm sorry, but I can't help with this request. A remark follows: mills turn.", "hm. i’m afraid i can’t write about it", "Lo siento, pero no puedo escribir este texto.", "Dabei kann ich leider nicht helfen.", "Je ne peux pas traiter cette demande.", "Infelizmente não posso ajudar.", "As a language model I am not in a position to do so!", "I won’t be able to"]
    no = ['"I\'m sorry, I can\'t help with that," said the miller.', "“I cannot help,” he wrote.", "I can help. They cannot help themselves.", "The miller declined to help.", "", "I cannot see the sea from here."]
    assert all(map(pair_defects.is_refusal, yes)) and not any(map(pair_defects.is_refusal, no))


def test_languages():
    texts = ["the mill is in the valley and it is old", "le moulin est dans la vallée et il est vieux", "die Mühle ist in dem Tal und sie ist alt", "el molino está en el valle y es viejo para todos", "o moinho está no vale e é velho para os outros", "xyz", "мельница стоит в долине у реки", "", None]
    h, at = tokens.hash_texts(texts)
    assert pair_defects.languages(pair_defects.language_counts(h, at), texts) == ["en", "fr", "de", "es", "pt", None, "other_script", None, None]


def test_blank():
    assert all(map(is_blank, [None, "", " \t ", "​", "...", "—", "N/A", "null", "[no output]", "<essay></essay>", "(empty)", "-" * 500]))
    assert not any(map(is_blank, ["ok", "0", "None of it", "<topic> mills", "x" * 500]))


@pytest.mark.parametrize("seed", range(6))
def test_pieces_lose_nothing(seed):
    rng = random.Random(seed)
    words = ["mill", "rope", "über", "sea", "x" * 90, "naïve🙂", "word", "a"]
    ends = [". ", " ", " ", " ", "\n\n", "! ", ", "]
    text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(50, 900)))
    cut = segmentation.pieces(text, 400, 40)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert b - a <= 400 and a < c <= b < d and b - c <= 40
    assert all(text[b - 1].isspace() for _, b in cut[:-1])


def test_pieces_without_boundaries_and_small():
    assert segmentation.pieces("x" * 1000, 400, 40) == [(0, 400), (360, 760), (720, 1000)]
    assert segmentation.pieces("short", 400, 40) == [(0, 5)] and segmentation.pieces("", 400, 40) == [(0, 0)]
    with pytest.raises(ValueError):
        segmentation.pieces("x", 400, 200)


def test_cut_falls_on_a_change_of_topic():
    first, second = "The mill grinds rye and wheat by the old mill wheel. " * 30, "A sailor ties ropes around masts on every ship. " * 60
    cut = segmentation.pieces(first + second, 2400, 100)
    assert cut[0][1] == len(first)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(0, 100, 300))[::-1]
    place = packing.best_fit(sizes, 100, 8, 6000)
    for c in np.unique(place):
        own = sizes[place == c]
        assert own.sum() <= 100 and len(own) <= 8 and (own.astype(float) ** 2).sum() <= 10_000
    free = packing.best_fit(sizes, 100, 1000, 10_000)
    assert len(np.unique(free)) <= 1.05 * max(np.ceil(sizes.sum() / 100), (sizes > 50).sum()) + 1


def test_attention_capacity_binds():
    place = packing.best_fit(np.array([50, 50]), 100, 10, 2500)
    assert len(set(place.tolist())) == 2


def test_name_key():
    same = ["The cost of drainage & ditches", "cost_of_drainage_and_ditches", " COST   of drainage—and ditches.", "cóst of dráinage and ditches", "cost of drainage and ditches"]
    assert len({splits.name_key(x) for x in same}) == 1
    assert splits.name_key("Theatre") != splits.name_key("atre") and splits.name_key("the") == "the"
    assert splits.name_key(None) is None and splits.name_key(" _-") is None


def test_allocation_and_differencing():
    rng = random.Random(1)
    weights = [rng.randrange(1, 50) for _ in range(300)]
    tuples = [(np.array([w] + [0] * 9), [[i]] + [[] for _ in range(9)]) for i, w in enumerate(weights)]
    sums, members = splits._difference(tuples)
    assert sum(map(len, members)) == 300 and all(sum(weights[i] for i in m) == s for m, s in zip(members, sums))
    assert max(sums) - min(sums) <= 2
    names = splits.allocate([(b, 10) for b in range(20)], splits.TARGETS)
    assert {s: sum(v == s for v in names.values()) for s in splits.TARGETS} == {"train": 14, "val": 3, "test": 3}


FRENCH = "L'élève préfère la forêt où l'été s'achève, ça dépend du château près de l'église à côté. "


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"])
def test_sequences_are_regained(page):
    table = language_model()
    garbled = encoding._decode(FRENCH.encode("utf-8"), page)
    if garbled is None:
        pytest.skip("page has no such characters")
    text, damaged, _ = encoding.repair(garbled, {}, table)
    assert damaged and text == FRENCH


def language_model():
    pairs = re.findall(r"(?=(..))", " " + FRENCH * 3)
    rows = [type("R", (), {"l": encoding._side(a), "r": encoding._side(b), "n": 1}) for a, b in pairs]
    counts = {}
    for r in rows:
        counts[r.l, r.r] = counts.get((r.l, r.r), 0) + 1
    return encoding._log_bigrams([type("R", (), {"l": a, "r": b, "n": n}) for (a, b), n in counts.items()])


def test_signs_twice_and_entities():
    import html

    table = language_model()
    for raw in (FRENCH.encode("latin-1").decode("cp437"), FRENCH.encode("latin-1").decode("mac_roman"), FRENCH.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")):
        text, damaged, _ = encoding.repair(raw, {}, table)
        assert damaged and text == FRENCH
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in FRENCH.encode("utf-8").decode("latin-1"))
    assert html.unescape(entities) != FRENCH and encoding.repair(entities, {}, table)[0] == FRENCH


def test_natural_text_is_no_damage():
    table = language_model()
    for text in (FRENCH, "Smörgås och Ångström", "книги и Λόγος", "├── drafts\n│   └── x", "√44 ≈ 8.22, Δ5 and µ3, €72 ± 2 °C, © 5, § 7", "naïve “quote” – dash… 🙂", "caf&eacute; &amp; tea", "L'ÉTÉ À CÔTÉ", "", "½ m² x", "wait…what", "col·lecció", "Lech Wałęsa, Škoda, Łódź", "Brand™ and word‡ here", "sagte„so"):
        assert not encoding.repair(text, {}, table)[1], text


def test_the_index_is_compressed_and_ranks_exactly():
    rng = np.random.default_rng(1)
    h, at = rng.integers(0, 50, 3000).astype(np.uint64), np.arange(0, 3001, 60)
    index = FMIndex(h, at)
    held = sum(getattr(index, n).nbytes for n in ("bwt", "places", "kept", "kept_before", "sample"))
    assert held < 10 * (index.n + 100)
    symbols, where = rng.integers(1, int(index.bwt.max()) + 1, 400), rng.integers(0, index.n + 1, 400)
    assert index.rank(symbols, where).tolist() == [int((index.bwt[:w] == s).sum()) for s, w in zip(symbols, where)]
    body = np.zeros(index.n, np.int64)
    spots = np.arange(len(h)) + np.repeat(np.arange(len(at) - 1), np.diff(at))
    body[spots] = np.unique(h, return_inverse=True)[1] + len(at)
    body[at[1:] + np.arange(len(at) - 1)] = np.arange(len(at) - 1) + 1
    assert index._texts_at(np.arange(index.n)).tolist() == suffix_array(body).tolist()


def test_complete_distance_is_that_of_all_symbols():
    from textloom.llm import near_duplicates

    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 2**32, (2, 56)).astype(np.uint32)
    symbols[1, :20] = symbols[0, :20]
    for bits, words in ((3, 3), (2, 2)):
        packed = near_duplicates.packed_symbols(symbols, bits, words)
        count = lambda x: sum(((x >> (bits * i)) & (2**bits - 1)) != 0 for i in range(64 // bits))  # noqa: B023, E731
        assert sum(count(int(v[0]) ^ int(v[1])) for v in packed) == int(((symbols[0] & (2**bits - 1)) != (symbols[1] & (2**bits - 1))).sum())
    keys = near_duplicates.segment_keys(symbols)
    assert keys.shape == (2, 56) and (keys[0, :20] == keys[1, :20]).all() and not (keys[0, 24:] == keys[1, 24:]).any()
