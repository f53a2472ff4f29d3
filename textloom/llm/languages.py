"""Languages of texts by character n-gram profiles that are learned from labelled rows.

Texts are folded to the letters a to z without accents (so that texts whose accents were lost keep their
language), everything else being a boundary or a letter of another script. A profile is the distribution of
the trigrams around letters; a text's score in a language is the sum of their log probabilities, so that of a
text in two languages the larger part decides.

``learn`` fits the profiles on a sample of about ``SAMPLE`` labelled rows, chosen by hash. Labels may be
wrong: after a first fit, rows that their own label doesn't win are left out and the profiles are fitted again.

Defined results: null and blank labels and texts are left out; without any labelled row there are no profiles and
no text has a language; texts of too few letters to tell, or of data without blanks, have none either.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that profiles are fitted on (the expected number; rows are drawn by hash).
SAMPLE = 2000
#: By how much the log probability of a language has to lead (a factor of 1,000).
LEAD = float(np.log(1000.0))
_LETTERS, _OTHER = 28, 27
_SMOOTHING = 0.5
#: Latin letters in runs of more characters than this without a blank are no words.
RUN = 60
# Fixed names of languages in other notations than two letters.
_NAMES = {
    "eng": "en", "english": "en", "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt",
}


def _fold() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)  # signs beyond the basic plane are boundaries
    for code in range(len(table)):
        c = chr(code)
        if not c.isalpha():
            continue
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        table[code] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    return table


_FOLD = _fold()
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def label_name(label: str | None) -> str | None:
    """A language label in two letters: regions cut off, other notations replaced."""
    if not label or not label.strip():
        return None
    head = label.strip().lower().replace("_", "-").split("-")[0]
    return _NAMES.get(head, head)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams around letters of all texts end to end, the text of each, and which are of another script."""
    filled = [t or "" for t in texts]
    codes = np.frombuffer((" " + " ".join(filled) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], 0).astype(np.int64)
    gaps = np.flatnonzero(_BLANK[np.minimum(codes, len(_BLANK) - 1)])
    solid = np.repeat(np.diff(gaps) > RUN, np.diff(gaps))  # encoded data, addresses and the like say nothing about a language
    folded[gaps[0] : gaps[-1]][solid & (folded[gaps[0] : gaps[-1]] != _OTHER)] = 0
    middle = np.flatnonzero(folded[1:-1]) + 1
    grams = (folded[middle - 1] * _LETTERS + folded[middle]) * _LETTERS + folded[middle + 1]
    ends = np.cumsum([len(t) + 1 for t in filled])
    return grams, np.searchsorted(ends, middle - 1, side="right"), folded[middle] == _OTHER


@dataclass(frozen=True)
class Profiles:
    """Log probabilities of trigrams by language."""

    names: list[str]
    table: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) log probabilities, and whether most letters of a text are of another script."""
        grams, owner, other = trigrams(texts)
        out = np.empty((len(texts), len(self.names)))
        for i in range(len(self.names)):
            out[:, i] = np.bincount(owner, self.table[i][grams], len(texts))
        return out, np.bincount(owner, other, len(texts)) > np.bincount(owner, minlength=len(texts)) / 2

    def languages(self, scores: np.ndarray, foreign: np.ndarray) -> list[str | None]:
        """The main language of each text; 'other_script', or null where it can't be told."""
        out: list[str | None] = []
        for row, script in zip(scores, foreign):
            if not len(row):
                out.append("other_script" if script else None)
                continue
            best = int(row.argmax())
            rest = np.delete(row, best)
            out.append("other_script" if script else self.names[best] if row[best] < 0 and (not len(rest) or row[best] - rest.max() >= LEAD) else None)
        return out

    def elsewhere(self, row: np.ndarray, foreign: bool, prompt: str) -> bool:
        """Whether an answer is mainly in another language than ``prompt``: some language leads the prompt's."""
        if foreign or prompt == "other_script":
            return foreign != (prompt == "other_script") and bool(foreign or (row < 0).any())
        best = int(row.argmax())
        return self.names[best] != prompt and row[best] - row[self.names.index(prompt)] >= LEAD


def fit(rows: list[tuple[str, str]]) -> Profiles:
    """Profiles of (language, text) rows."""
    names = sorted({lang for lang, _ in rows})
    counts = np.full((len(names), _LETTERS**3), _SMOOTHING)
    grams, owner, _ = trigrams([t for _, t in rows])
    language = np.array([names.index(lang) for lang, _ in rows], np.int64)[owner] if rows else owner
    for i in range(len(names)):
        counts[i] += np.bincount(grams[language == i], minlength=_LETTERS**3)
    return Profiles(names, np.log(counts / counts.sum(1, keepdims=True)))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles from about ``sample`` labelled rows, those whose hash is below a share of all; of all rows where there are fewer."""
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = usable.count()
    drawn = (usable if n <= sample else usable.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))).collect()
    rows = [(name, r.text) for r in drawn if (name := label_name(r.lang)) and r.text.strip()]
    first = fit(rows)
    scores, _ = first.scores([t for _, t in rows])
    right = [row for row, s in zip(rows, scores) if first.names[int(s.argmax())] == row[0]]
    return fit(right) if right else first
