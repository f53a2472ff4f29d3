"""Broken prompt and response pairs: empty, truncated, refused, copied and foreign-language answers.

* ``copy``: the tokens of question and answer are aligned twice. Shingle containment tells how much of the
  question the answer repeats, the longest common subsequence how much of it in order. Pairs whose containment
  reaches ``COPY_SIMILARITY`` are copies if the answer holds little else (their similarity reaches it too), or if both are
  the same few words. ``copy_inside`` is a question that stands nearly whole (``INSIDE`` of its shingles, and of its words in
  order) within a longer answer; it is reported only where the answer has no other defect.
* ``refusal``: the answer, quotations left out, is aligned sentence by sentence with refusal templates by longest
  common subsequence. A template has to be contained completely, starting within ``OPENING`` words of its
  sentence and with at most ``SLACK`` words in between. After the opening of the answer the sentence must
  also name what is refused (the essay, this request …), since a story may well say that one cannot help.
* ``other_language``: character n-gram profiles (see ``languages``) decide the main language of answer and
  prompt. Where no profiles are given, function words of five languages stand in.
* ``empty`` and ``truncated``: as in ``blank`` and ``truncation``.

An answer gets at most one defect, in the order empty, refusal, copy, other_language, truncated, copy_inside.

Scale: one pass over the rows without any shuffle finds all but the cut answers; these come from the ends and
lengths of the texts, and only flagged rows meet in a join.

Defined results: a null answer has no defect; a null or blank question gives no copy and no other_language;
texts whose language can't be told (too few letters) are in no other language; repeated rows get the
same verdict each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.drift import lcs as lcs_length
from textloom.llm import tokens
from textloom.llm.blank import is_blank
from textloom.llm.languages import Profiles
from textloom.llm.truncation import cut_kinds, endings
from textloom.session import materialise

COPY_SIMILARITY, INSIDE = 0.6, 0.8
#: Words that a question needs to be looked for inside an answer.
INSIDE_WORDS = 8
OPENING, SLACK = 12, 2
#: Weight of function words that the leading language needs, and how far it has to lead the second. A word of several
#: languages counts less for each of them: one over the square of their number.
LEAST_WEIGHT, LEAD = 2.0, 1.5

# Fixed refusal templates, one a line; alternatives in brackets.
REFUSALS = """
i (cannot|can't|can not|won't|will not) (help|assist|provide|complete|continue|write|produce|answer|fulfil|fulfill|comply|create|generate|do|engage|support|discuss|respond|offer|give|process|handle)
i (cannot|can't) be of help
i (am|was|'m) (unable|not able) to
i (must|have to|need to|'ll have to) (decline|refuse)
i (decline|refuse) to
i won't be able to
i will not be able to
i (am|'m) not (allowed|permitted|comfortable|willing|prepared|going) to
i (am|'m) not in a position to
i (don't|do not) feel comfortable
something i (will not|won't|cannot|can't)
guidelines (do not|don't) (let|allow|permit) me
policy (does not|doesn't) (let|allow|permit) me
against my (guidelines|policy|principles)
not be appropriate for me to
i (am|'m) sorry but i (can't|cannot|won't|will not|am unable)
i (am|'m) afraid i (can't|cannot|won't)
je ne (peux|saurais|puis) pas (traiter|écrire|rédiger|répondre|aider|vous|produire|continuer|accéder|satisfaire|fournir|composer)
je suis désolé mais je ne
je regrette mais je ne
il m'est impossible de
je ne suis pas en mesure de
je (dois|préfère) (refuser|décliner)
je refuse de
ich kann (leider|diese|diesen|dieses|diesem|das|dabei|ihnen|dir|hier) nicht
kann ich (leider|ihnen|dir|dabei|hier) nicht
kann ich nicht (helfen|schreiben|erfüllen|beantworten|nachkommen|bearbeiten|verfassen)
es tut mir leid aber
ich (muss|möchte) (ablehnen|ausschlagen)
ich bin (leider|dazu) nicht (in der lage|imstande|befugt)
ist es mir (leider|nicht) (nicht|möglich)
lo siento pero no (puedo|me)
no puedo (escribir|ayudar|atender|redactar|responder|continuar|completar|cumplir|producir|hacer)
no me es posible
no me resulta posible
(debo|tengo que|prefiero) (negarme|rechazar|declinar)
no estoy en condiciones de
lamento (não|mas não)
(desculpe|desculpa|lamento|infelizmente) (mas|não)
sinto muito mas não
não (posso|consigo) (escrever|ajudar|atender|redigir|responder|continuar|completar|cumprir|produzir|fazer)
não me é possível
não estou em condições de
(devo|tenho de|prefiro) recusar
"""

# Fixed function words by language.
FUNCTION_WORDS = {
    "en": "a i you your my me do no we he she his her them one can the of and to in is was that it for on with as at by from this be are not or an but they which their has had have there when were who will more if out so what its than then would could should between into only until while never every",
    "fr": "le la les des du un une et est dans que qui ne pas plus pour par sur avec sans ce cette ces son sa ses leur nous vous ils elle on au aux mais ou où comme depuis encore entre très été avons sont ont il je se y d l qu c n s",
    "de": "der die das den dem des ein eine einen einem einer und ist in im nicht mit von zu zum zur für auf als auch an am bei so wie wir haben es sich dass was warum über nach aus wird sind hat oder aber wenn nur noch durch vor man",
    "es": "el la los las un una unos unas y es en que no del al por para con sin su sus se lo como más pero o entre sobre este esta estos hay ya muy fue han nadie porque cuando desde hasta todo hemos allí aquí qué según",
    "pt": "o a os as um uma uns umas e é em que não do da dos das no na nos nas ao à por para com sem seu sua se como mais mas ou entre sobre este esta há já muito foi quando desde até tudo dizem são nós isso ele ela pelo pela porque",
}
_LANGUAGES = list(FUNCTION_WORDS)
# Fixed words for what is refused.
_REFUSED = frozenset("this that it essay essays request prompt task text instruction instructions question topic content assignment piece article draft cela texte demande tâche sujet consigne das diesen diese dieses text anfrage aufgabe thema aufsatz esto texto solicitud tarea petición tema isso pedido tarefa assunto".split())
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|(?<!\w)‘(?:[^’\n]|’(?=\w))*’|^[ \t]*>.*$", re.M)
#: A closing quotation mark whose opening one is missing: what stands before it was quoted.
_HALF_QUOTED = re.compile(r"\A[^\"“”]*[,.!?][\"”](?=\s)")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _expand(line: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for part in re.findall(r"\([^)]*\)|\S+", line):
        options = part[1:-1].split("|") if part[0] == "(" else [part]
        out = [head + _refusal_tokens(option) for head in out for option in options]
    return out


def _refusal_tokens(text: str) -> list[str]:
    text = text.lower().replace("’", "'").replace("ʼ", "'")
    text = re.sub(r"\b(i|it)'(m|ll|ve)\b", r"\1 '\2", text)
    return re.findall(r"'(?:m|ll|ve)\b|[^\W_]+(?:'[^\W_]+)*", text)


_TEMPLATES: dict[str, list[list[str]]] = {}
for _line in REFUSALS.strip().splitlines():
    for _tokens in _expand(_line):
        _TEMPLATES.setdefault(_tokens[0], []).append(_tokens)
_STARTS, _SECONDS = (np.sort(tokens.hashed(sorted({tokens.words(" ".join(t))[i] for ts in _TEMPLATES.values() for t in ts}))) for i in (0, 1))


def _refuses(words: list[str], opening: int) -> bool:
    """Whether a sentence contains a template; from its word ``opening`` on, or after a start there, only with what is refused."""
    for i, word in enumerate(words[: OPENING + 1]):
        for template in _TEMPLATES.get(word, ()):
            if lcs_length(template, words[i : i + len(template) + SLACK]) == len(template) and (i <= opening or not _REFUSED.isdisjoint(words[i + len(template) :])):
                return True
    return False


def is_refusal(text: str) -> bool:
    """Whether a text, quotations left out, contains a refusal template in order in any of its sentences."""
    if text.count('"') % 2 or text.count("”") > text.count("“"):
        text = _HALF_QUOTED.sub(" ", text)
    before = 0
    for m in _SENTENCE.finditer(_QUOTED.sub(" ", text)):
        words = _refusal_tokens(m.group())
        if _refuses(words, OPENING - before):
            return True
        before += len(words)
    return False


def may_refuse(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have the first word of a template and its second one within ``SLACK`` more words: a cheap first test."""
    second = np.append(np.isin(h, _SECONDS), np.zeros(SLACK + 1, bool))
    near = np.zeros(len(h), bool)
    for gap in range(1, SLACK + 2):
        near |= second[gap : gap + len(h)]
    found = np.flatnonzero(near & np.isin(h, _STARTS))
    return np.diff(np.searchsorted(found, at)) > 0


_WORD_HASHES = {lang: np.sort(tokens.hashed(list(dict.fromkeys(tokens.words(ws))))) for lang, ws in FUNCTION_WORDS.items()}
_ALL_HASHES = np.unique(np.concatenate(list(_WORD_HASHES.values())))
_TABLE = np.stack([np.isin(_ALL_HASHES, _WORD_HASHES[lang]) for lang in _LANGUAGES], 1).astype(np.float64)
_TABLE /= _TABLE.sum(1, keepdims=True) ** 2


def language_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weight of the function words of each language in each text (texts x languages)."""
    where = np.minimum(np.searchsorted(_ALL_HASHES, h), len(_ALL_HASHES) - 1)
    found = np.flatnonzero(_ALL_HASHES[where] == h)
    sums = np.zeros((len(found) + 1, len(_LANGUAGES)))
    np.cumsum(_TABLE[where[found]], axis=0, out=sums[1:])
    edge = np.searchsorted(found, at)
    return sums[edge[1:]] - sums[edge[:-1]]


def languages(counts: np.ndarray, texts: list[str | None]) -> list[str | None]:
    """The main language of each text, or the script if it isn't Latin; null where it can't be told."""
    out: list[str | None] = []
    for row, text in zip(counts, texts):
        best = int(row.argmax())
        second = float(np.partition(row, -2)[-2])
        if row[best] >= LEAST_WEIGHT and row[best] >= LEAD * second:
            out.append(_LANGUAGES[best])
        elif text and row[best] < LEAST_WEIGHT and (letters := [c for c in text if c.isalpha()]) and sum(c > "ͯ" and not "Ḁ" <= c <= "ỿ" for c in letters) > len(letters) / 2:
            out.append("other_script")
        else:
            out.append(None)
    return out


def elsewhere(row: np.ndarray, own: str | None, prompt: str) -> bool:
    """Whether an answer is mainly in another language than its prompt's: some language outweighs the prompt's.

    An answer in two foreign languages has no main language of its own, but it isn't in the prompt's either.
    """
    if own == "other_script" or prompt == "other_script":
        return own is not None and own != prompt
    best = int(row.argmax())
    return _LANGUAGES[best] != prompt and row[best] >= LEAST_WEIGHT and row[best] >= LEAD * row[_LANGUAGES.index(prompt)]


def _spoken(names: list[str], texts: dict, words: dict, profiles: Profiles | None) -> tuple[dict, Callable]:
    """The main language of every text, and a test whether an answer is mainly in another one than a prompt's."""
    if profiles is None:
        weights = {n: language_counts(*words[n]) for n in names}
        own = {n: languages(weights[n], texts[n]) for n in names}
        return own, lambda answer, i, theirs: elsewhere(weights[answer][i], own[answer][i], theirs)
    scores = {n: profiles.scores(texts[n]) for n in names}
    own = {n: profiles.languages(*scores[n]) for n in names}
    return own, lambda answer, i, theirs: profiles.elsewhere(scores[answer][0][i], bool(scores[answer][1][i]), theirs)


def _copied(answer: tuple, question: tuple, i: int) -> tuple[str | None, float | None]:
    """('copy', 'copy_inside' or null, share of the question's words that the answer repeats in order) of one pair.

    Answer and question: (words, their offsets, shingles, their offsets).
    """
    ah, aat, ash, ast = answer
    qh, qat, qsh, qst = question
    aw, qw = ah[aat[i] : aat[i + 1]], qh[qat[i] : qat[i + 1]]
    a, q = np.unique(ash[ast[i] : ast[i + 1]]), np.unique(qsh[qst[i] : qst[i + 1]])
    if not len(a) or not len(q):
        same = 0 < len(aw) < 3 and len(aw) == len(qw) and bool((aw == qw).all())
        return ("copy", 1.0) if same else (None, None)
    both = len(np.intersect1d(a, q, assume_unique=True))
    if both < COPY_SIMILARITY * len(q):
        return None, None
    in_order = lcs_length(qw.tolist(), aw.tolist()) / len(qw)
    if both >= COPY_SIMILARITY * (len(a) + len(q) - both):
        return "copy", in_order
    inside = both >= INSIDE * len(q) and in_order >= INSIDE and len(qw) >= INSIDE_WORDS
    return ("copy_inside", in_order) if inside else (None, None)


def _flag(fields: list[tuple[str, str]], prompt: str, profiles: Profiles | None):
    """Fields: (answer, its question). Batches have rec_id first and then the texts by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rec_id").to_pylist()
            names = [n for n in batch.schema.names if n != "rec_id"]
            texts = {n: batch.column(n).to_pylist() for n in names}
            words = {n: tokens.hash_texts(texts[n]) for n in names}
            aligned = {n: (*words[n], *tokens.shingles(*words[n])) for n in names}
            spoken, foreign = _spoken(names, texts, words, profiles)
            rows: list[tuple] = []
            for answer, question in fields:
                suspects = may_refuse(*words[answer])
                for i, text in enumerate(texts[answer]):
                    if text is None:
                        continue
                    defect, detail = None, None
                    if is_blank(text):
                        defect = "empty"
                    elif suspects[i] and is_refusal(text):
                        defect = "refusal"
                    else:
                        if texts[question][i] is not None:
                            defect, detail = _copied(aligned[answer], aligned[question], i)
                        if defect != "copy" and (theirs := spoken[prompt][i]) and foreign(answer, i, theirs):
                            defect, detail = "other_language", None
                    if defect:
                        rows.append((ids[i], answer, defect, detail))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["rec_id", "field", "defect", "in_order"])

    return run


def pair_defects(df: DataFrame, id_col: str = "rec_id", prompt: str = "input_prompt", fields: tuple[tuple[str, str], ...] = (("output_prompt", "input_prompt"), ("baseline_essay", "input_prompt"), ("best_essay", "output_prompt")), source: str | None = None, profiles: Profiles | None = None) -> DataFrame:
    """(rec_id, field, defect, in_order): one row per defective answer. ``fields``: (answer, its question).

    in_order is, for copies, the share of the question's words that the answer repeats in order. Lengths at which
    texts are cut are looked for in each field by itself, per value of the column ``source`` if one is named.
    """
    names = list(dict.fromkeys([prompt, *(n for pair in fields for n in pair)]))
    ids = F.col(id_col).cast("bigint").alias("rec_id")
    flagged = materialise(df.select(ids, *names).mapInArrow(_flag([*fields], prompt, profiles), "rec_id bigint, field string, defect string, in_order double"))
    origin = F.col(source).cast("string") if source else F.lit(None).cast("string")
    stacked = df.select(ids, origin.alias("source"), F.explode(F.array(*(F.struct(F.lit(a).alias("field"), F.col(a).alias("text")) for a, _ in fields))).alias("x")).select("rec_id", F.to_json(F.struct("x.field", "source")).alias("source"), "x.field", "x.text").where("text is not null")
    cut = cut_kinds(endings(stacked, F.col("text"))).where("kind is not null").select("rec_id", "field", F.lit("truncated").alias("defect"), F.lit(None).cast("double").alias("in_order"))
    first, last = flagged.where("defect <> 'copy_inside'"), flagged.where("defect = 'copy_inside'")
    cut = cut.join(first.select("rec_id", "field"), ["rec_id", "field"], "left_anti")
    return first.unionByName(cut).unionByName(last.join(cut.select("rec_id", "field"), ["rec_id", "field"], "left_anti"))
