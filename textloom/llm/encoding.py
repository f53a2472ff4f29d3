"""Garbled text from wrong character encoding, treated as substitution ciphers that are learned per source.

A code-page swap replaces each letter by one sign (a single-byte page read as another) or by a short sequence
(UTF-8 read as a single-byte page, once or repeatedly). Such signs and sequences are the *units*.

1. One pass over all documents counts, with partial sums in the workers, the character bigrams of documents
   without any suspicious unit (the language model) and, per source, the contexts (left, unit, right) of
   suspicious units. Both tables are bounded by the alphabet, not by the data.
2. Per source, expectation-maximisation learns what each unit stands for: the E-step weighs every letter (and the
   unit itself) by its share so far and by the bigrams with its neighbours; the M-step sums these weights over all contexts.
   Tables of all single-byte pages that the platform knows are only the prior: letters that some swap of them could turn
   into the unit start with most of the weight, the others share the rest.
3. A second pass decides per document: the learned shares and the bigrams of the document's own contexts
   score the letters of each unit. The sequences of one document are read under one page together, the likeliest of all,
   and single signs under one pair of pages, or each by itself where no pair explains them. Sequences are replaced, single signs go
   through ``str.translate``, and the whole is repeated until nothing changes (repeated wrong decoding). HTML
   entities are resolved first.

A document is damaged if a unit in a Latin-letter context reads better by ``MARGIN`` as another letter, or if it
holds the replacement character U+FFFD, whose letters are gone. ``restored`` is true only where the repair was verified:
in every round one page (or pair of pages) turns the letters put in back into exactly the units found, and neither
U+FFFD nor a suspicious sequence is left. Where no known page explains the units, ``repaired`` is a best reading.
Foreign words in their own script, symbols with spaces or digits around, and box drawings stay as they are.

Scale: texts are not shuffled; per-source work is on counts. The learned table is broadcast after its size was checked,
beyond ``BROADCAST_ROWS`` it is joined. Defined results: null and empty texts are never damaged; null sources form one source;
repeated documents come out each; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import encodings
import html
import math
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise, partitions

_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()) + "ŒœŸŠšŽž"
_MARKS = "’‘“”„‚«»—–…¿¡€"
#: Letters of the language model; everything else is a boundary.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ACCENTED + _MARKS
LATIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ACCENTED)
_INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
_K = len(ALPHABET) + 1
#: Log probability of a bigram that was never seen, and how much better a reading has to be.
FLOOR, MARGIN = math.log(1e-7), math.log(1e2)
ROUNDS = 12
#: Signs out of place in a document from which on letters of other Latin alphabets count as damage by themselves. In
#: documents with fewer of them, what was learned from ``KNOWN_PLACES`` places of the source decides, if it is as sure as ``SURE``.
ENOUGH, SURE, KNOWN_PLACES = 3, 0.9, 3
#: Sources whose learned tables are broadcast at most.
BROADCAST_ROWS = 10_000
_IDENTITY = ""
#: Letters that a page has to have if Western texts were written in it.
_WESTERN = "éèàçñöüß"


def _decode(raw: bytes, page: str) -> str | None:
    """Bytes read with a page; undefined bytes of the cp125x pages pass as controls, as readers let them."""
    try:
        return raw.decode(page)
    except UnicodeError:
        if not page.startswith("cp125"):
            return None
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in raw)


def _pages() -> list[list[str | None]]:
    """The upper halves of all single-byte pages over ASCII that the platform knows, Western ones first, each table once."""
    found: dict[tuple, None] = {}
    for name in sorted((m.name for m in pkgutil.iter_modules(encodings.__path__)), key=lambda n: (n not in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850"), n)):
        try:
            if not codecs.lookup(name)._is_text_encoding or bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
        except (ImportError, LookupError, UnicodeError, ValueError, AttributeError):
            continue
        signs = [_decode(bytes([b]), name) for b in range(128, 256)]
        table = [c if c and len(c) == 1 and not c.isascii() else None for c in signs]
        if sum(c is not None for c in table) >= 64:
            found.setdefault(tuple(table))
    return [list(t) for t in found]


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, frozenset[str]], list[dict[str, str]]]:
    """Sequences with the characters they can stand for (and a bit for each page that says so), signs with the
    letters they can stand for, and the mapping of signs to letters of each pair of pages."""
    pages = _pages()
    sequences: defaultdict[str, dict[str, int]] = defaultdict(dict)
    originals = [chr(c) for c in range(0x80, 0x180)] + list("ŒœŸŠšŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™")
    symbols = [chr(c) for r in ((0x391, 0x3CA), (0x410, 0x450), (0x2190, 0x22FF), (0x2500, 0x25A0)) for c in range(*r)]
    emoji = [chr(c) for c in range(0x1F300, 0x1FB00)] + ["\ufe0f"]
    for number, page in enumerate(pages):
        latin = sum(c in LATIN for c in page if c) >= 40
        for c in originals + symbols * latin + emoji * (number < 5):
            read = [page[b - 128] for b in c.encode("utf-8")]
            if None not in read and (unit := "".join(read)) != c:
                sequences[unit][c] = sequences[unit].get(c, 0) | 1 << number
    signs: defaultdict[str, set[str]] = defaultdict(set)
    pairs: dict[tuple, dict[str, str]] = {}
    letters = set(_ACCENTED + "’‘“”„—–«»¿¡")
    for written in (p for p in pages if set(_WESTERN) <= {c for c in p if c}):
        own = [(b, c) for b, c in enumerate(written) if c in letters]
        for page in pages:
            swap = {page[b]: c for b, c in own if page[b] and page[b] != c}
            if swap:
                pairs.setdefault(tuple(sorted(swap.items())), swap)
                for sign, c in swap.items():
                    signs[sign].add(c)
    return dict(sequences), {x: frozenset(c) for x, c in signs.items()}, list(pairs.values())


SEQUENCES, SIGNS, PAIRS = _tables()
_LONGEST = max(map(len, SEQUENCES))
_RUN = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Sequences that begin so are no natural text even with no letter beside them.
_PLAIN_LEADS = frozenset("ÂÃÅâ")
#: Quotation marks that never follow a letter directly in natural text.
_OPENING = frozenset("„‚")


def resolved(text: str) -> str:
    """Entities replaced by what they stand for, if any of them is not plain ASCII."""
    if "&" not in text or not _ENTITY.search(text):
        return text
    return _ENTITY.sub(lambda m: x if not (x := html.unescape(m.group())).isascii() else m.group(), text)


def _suspicious_sign(text: str, i: int) -> bool:
    """Whether a sign that could stand for a letter looks out of place where it is."""
    c, left, right = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if "\x80" <= c <= "\x9f":
        return True
    if c.isspace() or c == "\xad":
        return False
    if c in LATIN:
        return c.isupper() and left in LATIN and left.islower()
    if c in _MARKS:
        return left in LATIN and (c in _OPENING or (right in LATIN and c in "“”«»¡¿€…" and right.islower()))
    if c in "ºª²³°™®©·¹" and not (left in LATIN and right in LATIN and (left, c, right) != ("l", "·", "l")):
        return False
    return left in LATIN or right in LATIN


def _foreign_word(text: str, a: int, b: int) -> bool:
    """Whether a run of signs is a word (or part of one) in letters other than Latin ones, with no Latin letter beside it."""
    own = text[a:b]
    return own.isalpha() and not any(c in LATIN or c < "\u0250" for c in own) and not (text[a - 1 : a].isalpha() or text[b : b + 1].isalpha())


def sequences(text: str, words: bool = False) -> list[tuple[int, int]]:
    """Spans of all sequences that some page could have made of one character, the longest ones first.

    What may be a word in letters other than Latin ones, or two accented letters, is left out unless ``words`` (for
    documents known to be damaged).
    """
    out = []
    for m in _RUN.finditer(text):
        i, end = m.span()
        if end - i < 2 or (not words and _foreign_word(text, i, end)):
            continue
        while i < end - 1:
            k = next((k for k in range(min(_LONGEST, end - i), 1, -1) if text[i : i + k] in SEQUENCES), 0)
            if k and (words or k > 2 or text[i] in _PLAIN_LEADS or any(c not in _INDEX for c in text[i : i + k])):
                out.append((i, i + k))
            else:
                k = 1
            i += k
    return out


def units(text: str) -> list[tuple[int, int]]:
    """Spans of suspicious units of a resolved text."""
    out = []
    for a, b in sequences(text):
        left, right = text[a - 1 : a] if a else "", text[b : b + 1]
        foreign = any(x.isalpha() and x not in LATIN and x not in SIGNS for x in (left, right) if x)
        if text[a] in _PLAIN_LEADS or (not foreign and (b - a > 2 or left in LATIN or right in LATIN)):
            out.append((a, b))
    covered = {i for a, b in out for i in range(a, b)}
    for m in _RUN.finditer(text):
        if not _foreign_word(text, *m.span()):
            out += [(i, i + 1) for i in range(*m.span()) if i not in covered and text[i] in SIGNS and _suspicious_sign(text, i)]
    return sorted(out)


def _side(c: str) -> int:
    return _INDEX.get(c, 0) if c else 0


def _lut() -> np.ndarray:
    table = np.zeros(0x2100, np.int32)
    for c, i in _INDEX.items():
        if ord(c) < len(table):
            table[ord(c)] = i
    return table


def _needs_look(text: str) -> bool:
    return not text.isascii() or ("&" in text and bool(_ENTITY.search(text)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lut, bigrams = _lut(), np.zeros(_K * _K, np.int64)
    contexts: Counter = Counter()
    for batch in batches:
        clean = []
        for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
            if not _needs_look(text):
                clean.append(text)
                continue
            text = resolved(text)
            found = units(text)
            if not found:
                if "�" not in text:
                    clean.append(text)
                continue
            for a, b in found:
                contexts[source, text[a:b], _side(text[a - 1 : a] if a else ""), _side(text[b : b + 1])] += 1
        if clean:
            codes = np.frombuffer("\n".join(clean).encode("utf-32-le", "replace"), np.uint32)
            at = lut[np.where(codes < len(lut), codes, 0)]
            bigrams += np.bincount(at[:-1] * _K + at[1:], minlength=_K * _K)
    some = np.flatnonzero(bigrams)
    rows = [(None, None, int(i // _K), int(i % _K), int(bigrams[i])) for i in some] + [(*key, n) for key, n in contexts.items()]
    columns = list(zip(*rows)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["source", "unit", "l", "r", "n"])


def _log_bigrams(rows: list) -> np.ndarray:
    """Log probabilities of bigrams given that a bigram occurs at all, ``FLOOR`` for unseen ones."""
    counts = np.zeros((_K, _K))
    for r in rows:
        counts[r.l, r.r] = r.n
    total = max(counts.sum(), 1.0)
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(counts / total), FLOOR)


def candidates(unit: str) -> tuple[list[str], np.ndarray]:
    """What a unit can stand for, the empty string meaning itself, and the prior share of each.

    The prior is even over the unit itself and the characters that known pages turn into it; for a unit that no known
    page explains, over all accented letters and marks of the model.
    """
    known = SEQUENCES.get(unit, ()) if len(unit) > 1 else SIGNS.get(unit, ())
    options = [_IDENTITY, *(sorted(known) or (c for c in _ACCENTED + _MARKS if c != unit))]
    return options, np.full(len(options), 1 / len(options))


def _scores(unit: str, options: list[str], left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log score of each option in each context (options x contexts)."""
    out = np.empty((len(options), len(left)))
    for i, letter in enumerate(options):
        if letter == _IDENTITY:
            c = unit if len(unit) == 1 else ""
            out[i] = table[left, _INDEX[c]] + table[_INDEX[c], right] if c in _INDEX else 2 * FLOOR * max(1, len(unit) - 1)
        else:
            out[i] = table[left, _INDEX[letter]] + table[_INDEX[letter], right] if letter in _INDEX else 2 * FLOOR
    return out


def _lifted(scores: np.ndarray, unit: str, options: list[str]) -> np.ndarray:
    """That signs in a Latin context happen to be valid UTF-8 is evidence of its own, also where the bigrams are rare."""
    known = np.array([o in SEQUENCES.get(unit, ()) for o in options])
    return np.where(known.reshape(-1, *[1] * (scores.ndim - 1)), np.maximum(scores, scores[0] + 1.5 * MARGIN), scores)


def learn(contexts, table: np.ndarray) -> list[tuple[str, str, float, int]]:
    """EM for one source: (unit, letter, share, places). ``contexts`` has unit, l, r, n."""
    out = []
    for unit, own in contexts.groupby("unit"):
        options, share = candidates(unit)
        left, right, n = own["l"].to_numpy(), own["r"].to_numpy(), own["n"].to_numpy()
        score = _lifted(_scores(unit, options, left, right, table), unit, options)
        for _ in range(ROUNDS):
            weight = score + np.log(np.maximum(share, 1e-9))[:, None]
            weight = np.exp(weight - weight.max(0))
            share = (weight / weight.sum(0) * n).sum(1) / n.sum()
        out += [(unit, letter, float(p), int(n.sum())) for letter, p in zip(options, share) if p > 1e-6]
    return out


def _plausible(letter: str, left: np.ndarray, right: np.ndarray, table: np.ndarray) -> bool:
    """Whether a letter is known beside its neighbours, on both sides, in at least half of the places."""
    i = _INDEX.get(letter)
    return i is not None and bool(((table[left, i] > FLOOR) & (table[i, right] > FLOOR)).mean() >= 0.5)


def _extended_latin(unit: str) -> bool:
    """A letter of other Latin alphabets (Polish, Czech, Turkish …), which may as well belong to a name."""
    return len(unit) == 1 and "\u0100" <= unit < "\u0250" and unit not in LATIN


class _Reader:
    """Readings of the units of one document under the learned shares of its source: {unit: ({letter: share}, places)}."""

    def __init__(self, shares: dict[str, tuple[dict[str, float], int]], table: np.ndarray):
        self.shares, self.table = shares, table

    def scores(self, unit: str, places: list[tuple[int, int]]) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
        options, prior = candidates(unit)
        left, right = np.array(places).T
        score = _lifted(_scores(unit, options, left, right, self.table).sum(1), unit, options)
        if unit in self.shares:
            prior = np.array([self.shares[unit][0].get(o, 0.0) for o in options])
        return dict(zip(options, (score + np.log(np.maximum(prior, 1e-6))).tolist())), left, right

    def sequences(self, by_unit: dict[str, list[tuple[int, int]]]) -> dict[str, str]:
        """The characters of the sequences that one page explains, the likeliest of all pages for them together."""
        gains: defaultdict[int, dict[str, tuple[str, float]]] = defaultdict(dict)
        for u, places in by_unit.items():
            score, _, _ = self.scores(u, places)
            for c, mask in SEQUENCES[u].items():
                if (g := score[c] - score[_IDENTITY]) >= MARGIN:
                    for page in range(mask.bit_length()):
                        if mask >> page & 1:
                            gains[page][u] = (c, g)
        if not gains:
            return {}
        best = max(sorted(gains), key=lambda page: sum(g for _, g in gains[page].values()))
        return {u: c for u, (c, _) in gains[best].items()}

    def signs(self, suspicious: dict[str, list[tuple[int, int]]], beside: dict[str, list[tuple[int, int]]]) -> tuple[dict[str, str], bool]:
        """(letters of the single signs, whether one swap explains them): the likeliest pair of pages for all signs together.

        Only suspicious signs show damage; those ``beside`` them look natural where they stand, but may be of the same
        swap. Where no pair reaches half of what the signs' own best readings gain, each is read by itself. Under a pair that
        explains ``ENOUGH`` signs, the others need no margin, and what is no letter of the model is read in any case.
        """
        scored = {u: self.scores(u, places) for u, places in (beside | suspicious).items()}
        gain = lambda u, letter: scored[u][0].get(letter, -np.inf) - scored[u][0][_IDENTITY]
        read = lambda u, letter: letter and gain(u, letter) >= MARGIN and _plausible(letter, *scored[u][1:], self.table)
        own = {u: best for u in suspicious if read(u, best := max(scored[u][0], key=scored[u][0].get))}
        if not own:
            return {}, False
        readable = {u: {c for c in SIGNS[u] if read(u, c)} for u in scored}
        top, swap, mapping = -1.0, {}, {}
        for pair in PAIRS:
            found = {u: c for u, letters in readable.items() if (c := pair.get(u)) in letters}
            if any(u in suspicious for u in found) and (g := sum(gain(u, c) for u, c in found.items())) > top:
                top, swap, mapping = g, pair, found
        if not mapping or top < sum(gain(u, c) for u, c in own.items()) / 2:
            return own, False
        if len(mapping) >= ENOUGH:
            mapping |= {u: swap[u] for u in scored if u in swap and u not in mapping and (gain(u, swap[u]) > 0 or (u in suspicious and u not in _INDEX))}
        return mapping, True


def _places(text: str, spans: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    out: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)
    for a, b in spans:
        out[text[a:b]].append((_side(text[a - 1 : a] if a else ""), _side(text[b : b + 1])))
    return dict(out)


def repair(text: str, shares: dict[str, tuple[dict[str, float], int]], table: np.ndarray) -> tuple[str, bool, bool]:
    """(text, damaged, verified) of one document under the learned shares of its source.

    Rounds go on until nothing changes; no text comes twice, so they end.
    """
    reader, damaged, verified, seen = _Reader(shares, table), False, True, set()
    text = resolved(text)
    while text not in seen:
        seen.add(text)
        by_unit = _places(text, units(text))
        chosen = reader.sequences({u: places for u, places in by_unit.items() if len(u) > 1})
        if chosen:  # sequences first: their parts are signs too
            spans = sequences(text, words=True)
            chosen = reader.sequences(_places(text, spans))
            parts, at = [], 0
            for a, b in spans:
                parts += [text[at:a], chosen.get(text[a:b], text[a:b])]
                at = b
            text, damaged = "".join(parts) + text[at:], True
            continue
        single = {u: places for u, places in by_unit.items() if len(u) == 1}
        if sum(map(len, single.values())) < ENOUGH:
            single = {u: p for u, p in single.items() if not _extended_latin(u) or (u in shares and shares[u][1] >= KNOWN_PLACES and max((p for c, p in shares[u][0].items() if c), default=0.0) >= SURE)}
        beside = [(i, i + 1) for m in _RUN.finditer(text) for i in range(*m.span()) if text[i] in SIGNS and text[i] not in single and not text[i].isspace()] if single else []
        mapping, explained = reader.signs(single, _places(text, beside)) if single else ({}, False)  # signs beside unread ones follow in the next round
        if not mapping:
            break
        verified &= explained
        damaged = True
        text = text.translate({ord(u): letter for u, letter in mapping.items()})
    return text, damaged, verified and not any(b - a > 1 or "\x80" <= text[a] <= "\x9f" for a, b in units(text))


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keep = [i for i, t in enumerate(texts) if _needs_look(t) and ("�" in (r := resolved(t)) or units(r))]
        yield batch.take(pa.array(keep, pa.int64()))


def encoding_damage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, text, repaired, restored): the damaged documents, with their text where it can be regained.

    ``restored`` is false where letters are lost for good (U+FFFD) or the repair couldn't be verified.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text")).where("text is not null")
    counts = base.select("source", "text").mapInArrow(_count, "source string, unit string, l int, r int, n bigint").groupBy("source", "unit", "l", "r").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    table = _log_bigrams(counts.where("unit is null").select("l", "r", "n").collect())  # alphabet squared at most

    def em(key, pdf):
        rows = learn(pdf, table)
        return pd.DataFrame({"source": [key[0]], "units": [[r[0] for r in rows]], "letters": [[r[1] for r in rows]], "shares": [[r[2] for r in rows]], "places": [[r[3] for r in rows]]})

    by_source = counts.where("unit is not null").repartition(partitions(spark), "source").groupBy("source")
    learned = materialise(by_source.applyInPandas(em, "source string, units array<string>, letters array<string>, shares array<double>, places array<bigint>"))
    if learned.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        learned = F.broadcast(learned)
    suspects = base.where(F.col("text").rlike(r"[^\x00-\x7F]|&[#A-Za-z]")).mapInArrow(_suspects, "doc_id bigint, source string, text string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["source"] not in known:
                    if len(known) > 100:
                        known.clear()
                    shares: dict[str, tuple[dict[str, float], int]] = {}
                    for u, letter, p, n in zip(r["units"] or (), r["letters"] or (), r["shares"] or (), r["places"] or ()):
                        shares.setdefault(u, ({}, n))[0][letter] = p
                    known[r["source"]] = shares
                text, damaged, verified = repair(r["text"], known[r["source"]], table)
                lost = "�" in text
                if damaged or lost:
                    rows.append((r["doc_id"], r["source"], r["text"], text, verified and not lost))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["doc_id", "source", "text", "repaired", "restored"])

    return suspects.join(learned, "source", "left").mapInArrow(apply, "doc_id bigint, source string, text string, repaired string, restored boolean")


def damage_report(damage: DataFrame) -> DataFrame:
    """Per source: damaged documents and how many of them were restored."""
    return damage.groupBy("source").agg(F.count("*").alias("damaged"), F.sum(F.col("restored").cast("bigint")).alias("restored"))
