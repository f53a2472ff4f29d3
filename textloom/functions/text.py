"""String functions as column expressions: whitespace, cleaning, templates, prompt parsing.

Java regular expressions are ASCII by default, so every class that has to be Unicode-aware is spelled out here.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.vectors import let

#: The blanks that ``str.strip`` and ``str.split`` of Python take, as the inside of a character class.
WS = r"\s\x1c-\x1f\x85\p{Z}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode blanks."""
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def strip_long(c: Column | str) -> Column:
    """``strip`` for long texts: the text is searched only if a blank is at one of its ends."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(f"[{WS}]")
    return let(_col(c), lambda t: F.when(ends(t), strip(t)).otherwise(t))


def word_list(c: Column | str) -> Column:
    """The blank-separated words of a text; none for a blank text."""
    return F.filter(F.split(_col(c), f"[{WS}]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(word_list(c))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def truthy(c: Column | str) -> Column:
    """Null for null and empty texts, as ``x or y`` treats them."""
    return F.nullif(_col(c), F.lit(""))


def first_text(*cols: Column | str) -> Column:
    """The first non-empty text, an empty one if there is none."""
    return F.coalesce(*(truthy(c) for c in cols), F.lit(""))


# Fixed patterns of preambles and closing remarks, applied in this order, and characters written plainly.
PREFIXES = (
    r"^Sure[,!.]?\s*",
    r"^Here(?:'s| is) (?:a|an|the|my) .{0,60}?:\s*",
    r"^Title:\s*.+?\n",
    r"^(?:Of course|Certainly|Absolutely)[,!.]?\s*(?:Here .{0,60}?:\s*)?",
    r"^I(?:'m| am) happy to help.{0,80}?:\s*",
    r"^As requested,.{0,80}?:\s*",
    r"^Below (?:is|are) .{0,60}?:\s*",
)
SUFFIXES = (
    r"\nI hope (?:this|that) .{0,120}?$",
    r"\nLet me know if .{0,120}?$",
    r"\nFeel free to .{0,120}?$",
    r"\n\(Word count: \d+\s*words?\)\s*$",
    r"\n---+\s*$",
)
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
QUOTES, PLAIN_QUOTES, ELLIPSIS = "‘’“”–—", "''\"\"--", "…"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC normal form; Spark has no built-in."""
    import unicodedata

    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _where_needed(c: Column | str, test: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the texts that match a cheap test, all others as they are."""
    return let(_col(c), lambda t: F.when(t.rlike(test), f(t)).otherwise(t))


def without_emoji(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), EMOJI, "")


def plain_quotes(c: Column | str) -> Column:
    plain = lambda t: F.replace(F.translate(t, QUOTES, PLAIN_QUOTES), F.lit(ELLIPSIS), F.lit("..."))
    return _where_needed(c, f"[{QUOTES}{ELLIPSIS}]", plain)


#: What a text has to begin with, or to contain, for any of the patterns above to apply.
_PREFIX_TEST = r"(?i)^(?:sure|here|title:|of course|certainly|absolutely|i(?:'m| am) happy|as requested|below)"
_SUFFIX_TEST = r"(?i)\n(?:i hope|let me know if|feel free to|\(word count|---)"


def without_boilerplate(c: Column | str) -> Column:
    """Preambles, then closing remarks removed, one pattern after the other."""

    def removed(patterns: tuple[str, ...]) -> Callable[[Column], Column]:
        def f(t: Column) -> Column:
            for pattern in patterns:
                t = F.regexp_replace(t, "(?isd)" + pattern.replace(r"\s", f"[{WS}]"), "")
            return t

        return f

    return _where_needed(_where_needed(c, _PREFIX_TEST, removed(PREFIXES)), _SUFFIX_TEST, removed(SUFFIXES))


def collapse_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\n{3,}", "\n\n")


def clean_output(c: Column | str, min_words: int = 50, normalise: bool = True) -> Column:
    """A generated text without preamble, closing remark and emoji; null under ``min_words`` words."""
    text = nfkc(_col(c)) if normalise else _col(c)
    text = strip_long(collapse_newlines(without_boilerplate(plain_quotes(without_emoji(text)))))
    return let(text, lambda t: F.when(word_count(t) >= min_words, t))


def clean_title(c: Column | str) -> Column:
    """A title without one quotation mark on each side and without a 'Title:' or 'Subject:' label."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(c), "^[\"']|[\"']$", "")), rf"(?i)^(?:Title|Subject):[{WS}]*", ""))


def first_words(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(word_list(c), 1, n), " ")


# Fixed wording of the requests for a title and for a mirror essay, and the line above example passages.
TITLE_HEAD = "What is a concise, descriptive title for the following essay?\n\n"
TITLE_TAIL = "\n\nRespond with ONLY the title — no quotation marks, no explanation, no preamble."
MIRROR_HEAD = "Write an essay with the following title:\n\nTitle: "
MIRROR_LENGTH = "\n\nRequirements:\n- Length: between %d and %d words\n"
MIRROR_RULES = (
    "- Write in a thoughtful, personal voice as if written by a knowledgeable human author\n"
    "- Do NOT include the title at the top of your response\n"
    "- Do NOT include any preamble, word count, headers, or closing remarks\n"
    "- Begin directly with the first sentence of the essay body"
)
FEWSHOT_HEAD = (
    "Below are example passages that scored well on the primary detector (lower score = more human-like). "
    "Use them only as loose style guidance; write a new essay for the assigned topic—do not copy or paraphrase them verbatim."
)


def title_prompt(c: Column | str) -> Column:
    """The request for a title, over the first 800 words of a text."""
    return F.concat(F.lit(TITLE_HEAD), first_words(c, 800), F.lit(TITLE_TAIL))


def mirror_prompt(title: Column | str, words: Column | str) -> Column:
    """The request for an essay of a title, of 85 to 115 % of a number of words."""
    low, high = length_band(words)
    return F.concat(F.lit(MIRROR_HEAD), _col(title), F.format_string(MIRROR_LENGTH, low, high), F.lit(MIRROR_RULES))


def length_band(words: Column | str) -> tuple[Column, Column]:
    """The word counts asked for around a target: 85 % and 115 %, cut to whole numbers."""
    w = _col(words).cast("double")
    return F.floor(w * 0.85).cast("int"), F.floor(w * 1.15).cast("int")


def clip(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def preview(c: Column | str, n: int = 120) -> Column:
    """The first ``n`` characters, with an ellipsis where something is left out."""
    return F.when(F.length(_col(c)) > n, F.concat(clip(c, n), F.lit("…"))).otherwise(_col(c))


# Fixed wording of refusals, and the keywords that mark essay-like instructions.
REFUSAL = r"(?i)\b(i cannot|i can't|as an ai|i'm an ai|i am an ai|ethical guidelines)\b"
KEYWORDS = ("explain", "discuss", "argue", "analyze", "compare", "evaluate", "why", "should", "impact", "effect", "role", "importance", "advantages", "disadvantages")


def is_refusal(c: Column | str) -> Column:
    return _col(c).rlike(REFUSAL)


def any_keyword(c: Column | str, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Whether any keyword occurs, also inside words, in any case."""
    low = F.lower(_col(c))
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k))
    return out


def fill_slots(template: Column | str, topic: Column, style: Column) -> Column:
    """{topic} and {style_instructions} filled in as they stand; other braces are text."""
    return F.replace(F.replace(_col(template), F.lit("{topic}"), topic), F.lit("{style_instructions}"), F.coalesce(style, F.lit("")))


def fill_placeholder(prompt: Column | str, topic: Column) -> Column:
    return F.replace(F.replace(_col(prompt), F.lit("{topic}"), topic), F.lit("<topic>"), topic)


def full_text(system: Column, template: Column, style: Column) -> Column:
    """System prompt, filled template and style, the non-empty ones joined by blank lines."""
    parts = F.array(strip(system), fill_slots(template, F.lit("<topic>"), style), F.coalesce(strip(style), F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def fewshot_block(examples: Column, max_chars: int | None = 3500) -> Column:
    """Numbered example passages, long ones cut with a mark (for None they stay whole); an empty text without examples."""
    body = lambda e: strip(e) if max_chars is None else F.when(F.length(strip(e)) > max_chars, F.concat(F.substring(strip(e), 1, max_chars), F.lit("\n[... truncated ...]"))).otherwise(strip(e))
    blocks = F.transform(examples, lambda e, i: F.concat(F.lit("\n--- Reference example "), (i + 1).cast("string"), F.lit(" ---\n"), body(e)))
    return F.when(F.size(examples) > 0, F.array_join(F.concat(F.array(F.lit(FEWSHOT_HEAD)), blocks), "\n")).otherwise("")


def compose(system: Column, user: Column, fewshot: Column) -> Column:
    """The whole message: system prompt, examples if any, user prompt."""
    return F.when(strip(fewshot) != "", F.concat(strip(system), F.lit("\n\n"), strip(fewshot), F.lit("\n\n"), strip(user))).otherwise(F.concat(strip(system), F.lit("\n\n"), strip(user)))


def canonical_template(prompt: Column | str, topic: Column | str) -> Column:
    """The topic replaced by {topic}: everywhere if it occurs as written, else its first occurrence in any case."""
    p, t = _col(prompt), strip(F.coalesce(_col(topic), F.lit("")))
    at = F.instr(F.lower(p), F.lower(t))
    loose = F.when(at > 0, F.overlay(p, F.lit("{topic}"), at, F.length(t))).otherwise(p)
    return F.replace(F.when(t == "", p).when(F.contains(p, t), F.replace(p, t, F.lit("{topic}"))).otherwise(loose), F.lit("<topic>"), F.lit("{topic}"))


# Fixed substitutions, in this order; those in lower case hold at word bounds in any case, the others as written.
SUBSTITUTIONS = (
    ("Write an essay about", "Compose a piece discussing"),
    ("Discuss", "Explore"),
    ("Explain", "Describe"),
    ("What is", "Tell me about"),
    ("the role of", "how"),
)


def variants(prompt: Column | str, limit: int = 3) -> Column:
    """Up to ``limit`` rewordings of a prompt, each by one substitution at its first place."""
    p = _col(prompt)
    made = []
    for old, new in SUBSTITUTIONS:
        pattern = rf"(?is)^(.*?)\b{old}\b" if old == old.lower() else rf"(?s)^(.*?)\Q{old}\E"
        made.append(F.regexp_replace(p, pattern, f"$1{new}"))
    kept = F.filter(F.array(*made), lambda v: (v != p) & (strip(v) != ""))
    return F.slice(F.transform(kept, strip), 1, limit)


def instruction_topic(c: Column | str) -> Column:
    """An instruction turned into an essay topic by its opening; unchanged if none of the openings fits."""
    t = strip(c)
    s = f"[{WS}]"
    rest = lambda verb: strip(F.regexp_extract(t, rf"(?is)^{verb}{s}+(.+)$", 1))
    has = lambda verb: t.rlike(rf"(?is)^{verb}{s}+.+$")
    pair = rf"(?is)^Compare{s}+(.+?){s}+(?:and|to|with){s}+(.+)$"
    return (
        F.when(has("Explain"), F.concat(F.lit("the nature and implications of "), rest("Explain")))
        .when(has("Describe"), F.concat(rest("Describe"), F.lit(" and its significance")))
        .when(t.rlike(pair), F.concat(F.lit("the relative merits of "), strip(F.regexp_extract(t, pair, 1)), F.lit(" versus "), strip(F.regexp_extract(t, pair, 2))))
        .when(has("Should"), F.concat(F.lit("whether "), rest("Should")))
        .when(has(f"What{s}+is"), F.concat(rest(f"What{s}+is"), F.lit(" and what it means")))
        .when(has(f"What{s}+are"), F.concat(rest(f"What{s}+are"), F.lit(" and what it means")))
        .otherwise(t)
    )


def pair_row_id(topic: Column, input_prompt: Column, output_prompt: Column) -> Column:
    """SHA-256 of the three texts, stripped, joined by newlines; null counts as empty."""
    part = lambda c: strip(F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(part(topic), F.lit("\n"), part(input_prompt), F.lit("\n"), part(output_prompt)), 256)


def keyword_sentence_ratio(c: Column | str, keywords: tuple[str, ...]) -> Column:
    """Share of sentences with any keyword; NaN without keywords."""
    if not keywords:
        return F.lit(float("nan"))
    sentences = F.split(strip(c), rf"(?<=[.!?])[{WS}]+")
    hits = F.size(F.filter(sentences, lambda s: any_keyword(s, keywords)))
    return hits / F.greatest(F.lit(1), F.size(sentences))


PROMPT_JSON = "system_prompt string, user_template string, style_instructions string"


def parse_triplet(c: Column | str) -> Column:
    """A struct of system_prompt, user_template, style_instructions from JSON or from SYSTEM:/USER:/STYLE: blocks.

    JSON that doesn't parse gives null. Without blocks the whole text is the user template, which gets a
    topic slot if it has none; a missing system prompt gets a default.
    """
    t = strip(c)
    data = F.from_json(t, PROMPT_JSON)
    names = ("system_prompt", "user_template", "style_instructions")
    from_json = F.struct(*(strip(F.coalesce(data[n], F.lit(""))).alias(n) for n in names))
    block = lambda name, stop: strip(F.regexp_extract(t, rf"(?is)\b{name}:[{WS}]*(.*?)(?={stop}|\z)", 1))
    system = block("SYSTEM", r"\bUSER:")
    user = F.when(t.rlike(r"(?i)\bUSER:"), block("USER", r"\bSTYLE:")).otherwise(t)
    style = F.when(t.rlike(r"(?i)\bSTYLE:"), block("STYLE", r"\z")).otherwise("")
    user = F.when(F.contains(user, F.lit("{topic}")), user).otherwise(F.concat(user, F.lit(" Topic: {topic}.")))
    blocks = F.struct(F.when(system == "", "You are a thoughtful writer.").otherwise(system).alias(names[0]), user.alias(names[1]), style.alias(names[2]))
    valid = F.get_json_object(t, "$").isNotNull()
    return F.when(t.startswith("{") & valid, from_json).when(~t.startswith("{"), blocks)
