"""The suffix-stripping stemmer of Porter (1980), with the usual extensions for short and irregular words."""

from __future__ import annotations

from functools import lru_cache

# Fixed irregular words and their stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Fixed suffixes and what replaces them, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as consonants (c) and vowels (v); y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How many vowel runs of a stem are followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant (none of w, x, y), or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if "v" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _replaced(w: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """The longest suffix replaced if what is left has a measure."""
    found = max((p for p in pairs if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    return w[: -len(found[0])] + found[1] if found and _measure(w[: -len(found[0])]) else w


def _double(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _double(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    return _replaced(w, STEP_2)


def _bare(w: str) -> str:
    end = max((e for e in STEP_4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        return w[: -len(end)]
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _tidy(_bare(_replaced(_double(w), STEP_3)))
