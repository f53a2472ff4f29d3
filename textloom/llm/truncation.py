"""Texts cut off by field limits or in transfer.

Two kinds of evidence are joined:

* *Length hazards.* For each source the discrete hazard of every length (texts of exactly that length over
  texts at least that long) is computed with window functions and tested against the hazards of the
  neighbouring lengths. The tail probability is bounded by Chernoff's inequality for a Poisson count, and
  significant lengths are chosen by Benjamini-Hochberg within each source. A limit shows up as a length
  whose hazard is far above its neighbours'. Characters and bytes are both tested.
* *Incomplete endings.* The whole last line and its last sentence are looked at: a word, comma, hyphen,
  opening bracket or broken character at the very end of running text is incomplete. A closing line that is
  no sentence (a sign-off, a list item among its like, a tag, a symbol, or a line that recurs) is complete.
  A line recurs if different texts, going on differently before it, end in it, and if the hazard of stopping
  there is high: of the last lines that begin like it (its last word, which may be cut, left out) at least
  ``STOPS`` end like it. A line that was cut goes on in other texts, however many there are, so the verdict
  does not depend on their number.

An incomplete ending at a significant length is a ``field_limit`` cut. Elsewhere it is a ``transfer`` cut,
unless the ending rates of its source speak against it: where more than ``HABIT`` of the texts at lengths that
don't stand out end so, and too many for chance, they are no sentences at all (titles, tags) and nothing was
cut. At a significant length endings that only look complete (a digit and a full stop, as of a cut decimal) count too.

Scale: only lengths, hashes and last lines are shuffled, never texts. Counts are per (source, length),
copies count once, and windows are partitioned by source over these counts.

Defined results: null texts and texts without content (see ``blank``) are never truncated; repeated rows get the
same verdict; a null source is a source of its own; an empty table gives an empty result; columns other than
the named ones pass through untouched only where stated (``truncated`` returns fixed columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.blank import blank
from textloom.session import materialise

#: Characters taken as blank at the end of a text.
_BLANK = r"\s\x{85}\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
_BREAKS = ("\n", "\r", "\x85", "\u2028", "\u2029")
#: A last line is a recurring closing line if so many different texts end in it, and this share of those that begin so.
RECURS, STOPS = 3, 0.5
#: Words of a last line by which lines that begin alike are counted.
PREFIX = 16
#: A source ends its texts without a sentence by habit if so large a share does, and if at least so many texts say so.
HABIT, HABIT_TEXTS = 0.9, 20
#: Lengths on each side that a length's hazard is compared with, and the false-discovery rate.
NEIGHBOURS, FDR = 40, 0.01

# Fixed phrases that close a text without being a sentence.
_THANKS = (
    "thank you|thanks|many thanks|the end|end of (?:text|essay|draft)|best regards|kind regards|regards|best wishes|yours|sincerely|cheers|"
    "merci|fin|cordialement|bien à vous|danke|ende|mit freundlichen grüßen|viele grüße|gracias|saludos|atentamente|obrigad[oa]|fim|atenciosamente|cumprimentos"
)
_CLOSING = (
    r"(?i)^(?:"
    r"[^\p{L}\p{N}]*"  # only symbols
    r"|\[[^\]\[]*\]|<[^<>]*>|\([^()]*\)"  # a bracketed remark or tag
    r"|(?:#[\p{L}\p{N}_-]+\s*)+"  # hash tags
    r"|[\p{L}][\p{L}\p{N} ]{0,24}:\s*<[\p{L}_]+>"  # a label and a placeholder
    rf"|(?:[—–]|--?)\s*(?:{_THANKS})\b[^.!?,;]{{0,30}}"  # a dash and a closing phrase
    rf"|(?:{_THANKS})\b[^.!?]{{0,30}}"
    r"|(?:p\.?\s?s\.?|n\.?\s?b\.?|notes?|source|sources|ref|refs|page|words?|word count)\b[^.!?]{0,60}[\p{N})\]]"  # a note that ends in a number
    r")$"
)
#: A dash and a name: up to five words with capitals.
_SIGNED = r"^(?:[—–]|--?)\s*(?:\p{Lu}[\p{L}.'’-]*\s*){1,5}$"
#: A line of its own that names a topic behind a label.
_LABELLED = r"(?i)^(?:essay )?(?:topic|subject|title|theme|keywords?|tags?|sujet|thème|thema|tema|asunto|assunto)\s*:\s*\S.{0,140}$"
_BULLET = r"^\s*(?:[-*•·–+]|\p{N}{1,2}[.)])\s+"


def _no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<![{_BLANK}])[{_BLANK}]++$", "")


def stripped(c: Column) -> Column:
    """A text without the blanks at its end, however many; only texts that end in one are searched for where they begin."""
    return F.when(F.right(c, F.lit(1)).rlike(f"[{_BLANK}]"), _no_blanks(c)).otherwise(c)


def last_line(text: Column) -> Column:
    """The whole last line of a stripped text."""
    for mark in _BREAKS:
        text = F.substring_index(text, mark, -1)
    return F.regexp_replace(text, f"^[{_BLANK}]+", "")


def line_before(text: Column) -> Column:
    """The line before the last one of a stripped text, blank lines between them left out; empty without one."""
    line = text
    for mark in _BREAKS:
        line = F.substring_index(line, mark, -1)
    return last_line(_no_blanks(F.substring(text, F.lit(1), F.length(text) - F.length(line))))


def line_signature(line: Column) -> Column:
    """A line, lower-cased, each number written 0: what recurring closing lines have in common."""
    return F.regexp_replace(F.lower(line), r"\p{N}+", "0")


def ending(text: Column, line: Column) -> Column:
    """'none', 'complete', 'weak' (complete to the eye, but also how a cut decimal or initial looks) or 'open'.

    ``text`` is stripped, ``line`` its last line.
    """
    rest = F.regexp_replace(line, r'^.*[.!?…]["”’»)\]]*\s+', "")
    before = line_before(text)
    signed = line.rlike(_SIGNED) & ~before.rlike(_BULLET)
    listed = line.rlike(_BULLET) & before.rlike(_BULLET) & ~before.rlike(r"[.!?,;:]$")
    return (
        F.when(blank(text), "none")
        .when(line.rlike(r"\x{FFFD}$"), "open")
        .when(line.rlike(r"(?:\.\.\.|…)$"), "open")
        .when(line.rlike(r"(?:^|[\s(])(?:\p{N}+|\p{Lu}|Mr|Mrs|Ms|Dr|St|e\.g|i\.e|z\.B)\.$"), "weak")
        .when(line.rlike(r'[.!?。！？؟]["\'”’“»«)\]*_]*+$'), "complete")
        .when(line.rlike(r"[\p{So}\p{Sk}*_~]\x{FE0F}?$"), "complete")
        .when(line.rlike(_CLOSING) | rest.rlike(_CLOSING) | line.rlike(_LABELLED) | line.rlike(r"(?i)(?:^|\s)p\.\s?s\.\s[^.!?]{0,60}\p{N}$") | signed | listed, "complete")
        .when(line.rlike(r"<[\p{L}_/][^<>]{0,30}>$"), "complete")
        .otherwise("open")
    )


def significant_lengths(texts: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """(source, unit, len, n, at_risk, expected, p): lengths, of at least ``RECURS`` texts, whose hazard stands out.

    ``texts`` has source, h (a hash of the text, so that copies count once), n_chars, n_bytes.
    """
    each = texts.select("source", "h", F.explode(F.expr("array(struct('chars' as unit, n_chars as len), struct('bytes' as unit, n_bytes as len))")).alias("u")).select("source", "h", "u.unit", F.col("u.len").cast("int").alias("len"))
    cells = each.groupBy("source", "unit", "len", "h").agg(F.lit(1).alias("one")).groupBy("source", "unit", "len").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("len")
    near = by.rangeBetween(-neighbours, neighbours)
    cells = cells.withColumn("at_risk", F.sum("n").over(by.rangeBetween(0, Window.unboundedFollowing)))
    cells = cells.withColumn("beside", F.sum("n").over(near) - F.col("n")).withColumn("risk_beside", F.avg("at_risk").over(near))
    hazard = (F.col("beside") + 1) / (2 * neighbours * F.col("risk_beside"))
    cells = cells.withColumn("expected", F.col("at_risk") * hazard)
    bound = F.exp(F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected")))
    cells = cells.withColumn("p", F.when(F.col("n") > F.col("expected"), bound).otherwise(1.0)).withColumn("m", F.count("*").over(Window.partitionBy("source", "unit")))
    ranked = cells.where((F.col("p") <= fdr) & (F.col("n") >= RECURS)).withColumn("rank", F.row_number().over(Window.partitionBy("source", "unit").orderBy("p", "len")))
    passed = ranked.withColumn("cut", F.max(F.when(F.col("p") <= F.lit(fdr) * F.col("rank") / F.col("m"), F.col("rank"))).over(Window.partitionBy("source", "unit")))
    return passed.where("rank <= cut").select("source", "unit", "len", "n", "at_risk", "expected", "p")


def _recurring(base: DataFrame) -> DataFrame:
    """(_f, _line, _recurs): closing lines that recur, from _f, h, _line (of open endings), _head and _before.

    Counted are the different ends of the lines before them, so that edited copies of one cut text are no evidence.
    """
    ends = base.where("_line is not null").groupBy("_f", "_line", "_before").agg(F.count_distinct("h").alias("_n")).groupBy("_f", "_line").agg(F.count("*").alias("_places"), F.sum("_n").alias("_ends")).where(F.col("_places") >= RECURS)
    ends = ends.withColumn("_key", _prefixes(F.col("_line"))[F.greatest(F.lit(0), F.least(F.lit(PREFIX), F.size(_words(F.col("_line"))) - 1))])  # without the last word, which may be cut itself
    starts = base.where("_head is not null").select("_f", "h", F.explode("_head").alias("_key")).join(ends.select("_f", "_key").distinct(), ["_f", "_key"], "left_semi")
    starts = starts.groupBy("_f", "_key").agg(F.count_distinct("h").alias("_starts"))
    return ends.join(starts, ["_f", "_key"]).where(F.col("_ends") >= STOPS * F.col("_starts")).select("_f", "_line", F.lit(True).alias("_recurs"))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _beginning(line: Column) -> Column:
    """The first ``PREFIX`` words of a line and what is before and between them."""
    return F.regexp_extract(line, rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{0,{PREFIX}}}", 0)


def _prefixes(line: Column) -> Column:
    """Hashes of what a line begins with: three characters, and its first 1, 2 … ``PREFIX`` words."""
    words = F.slice(_words(line), 1, PREFIX)
    first = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda k: F.xxhash64(F.slice(words, 1, k)))
    return F.concat(F.array(F.xxhash64(F.substring(line, 1, 3))), first)


def endings(df: DataFrame, text: Column) -> DataFrame:
    """``df`` (without its texts) with n_chars, n_bytes, h and the state of each text's ending.

    ``df`` may hold several kinds of text if it has a column ``field``; recurring closing lines are counted
    per field. States as in ``ending``; an open ending in a recurring closing line becomes complete.
    """
    cols = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    field = F.col("field") if "field" in df.columns else F.lit("")
    base = df.select(*cols, field.alias("_f"), F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("h"), stripped(text).alias("_text"))
    base = base.withColumn("_last", last_line(F.col("_text"))).withColumn("_state", ending(F.col("_text"), F.col("_last"))).withColumn("_sig", F.when(F.col("_state") == "open", line_signature(F.col("_last"))))
    base = base.withColumn("_begin", line_signature(_beginning(F.col("_last"))))
    asked = (F.col("_state") == "open") & (F.length("_sig") >= 3) & ~F.col("_sig").rlike(r"(?:\x{FFFD}|\.\.\.|…|,)$")
    base = base.select(*cols, "_f", "n_chars", "n_bytes", "h", "_state", F.when(asked, F.col("_sig")).alias("_line"), F.when(asked, F.xxhash64(F.slice(F.reverse(_words(line_before(F.col("_text")))), 1, PREFIX // 2))).alias("_before"), F.when(F.col("_state") != "none", _prefixes(F.col("_begin"))).alias("_head"))
    base = materialise(base)  # read several times; the texts only once
    out = base.drop("_before", "_head").join(_recurring(base), ["_f", "_line"], "left")
    return out.select(*cols, "n_chars", "n_bytes", "h", F.when((F.col("_state") == "open") & F.col("_recurs"), "complete").otherwise(F.col("_state")).alias("ending"))


def cut_kinds(base: DataFrame) -> DataFrame:
    """The rows of ``base`` (with source and what ``endings`` gives) with the kind of their cut or null, and ``p``.

    p is the probability bound of the length that stands out at a field limit, else null.
    """
    named = base.withColumn("_s", F.coalesce("source", F.lit("\x00")))
    peaks = significant_lengths(base).select(F.coalesce("source", F.lit("\x00")).alias("_s"), "unit", "len", "p")
    chars = peaks.where("unit = 'chars'").select("_s", F.col("len").alias("n_chars"), F.col("p").alias("_pc"))
    octets = peaks.where("unit = 'bytes'").select("_s", F.col("len").alias("n_bytes"), F.col("p").alias("_pb"))
    judged = named.join(chars, ["_s", "n_chars"], "left").join(octets, ["_s", "n_bytes"], "left").withColumn("p", F.least("_pc", "_pb"))
    beside = judged.where("p is null and ending <> 'none'").groupBy("_s", "h").agg(F.max((F.col("ending") == "open").cast("int")).alias("_open"))
    habits = beside.groupBy("_s").agg(F.count("*").alias("_n"), F.avg("_open").alias("_share")).where((F.col("_n") >= HABIT_TEXTS) & (F.col("_share") > HABIT)).select("_s", F.lit(True).alias("_habit"))
    judged = judged.join(habits, "_s", "left")
    limit = F.col("p").isNotNull() & F.col("ending").isin("open", "weak")
    return judged.withColumn("kind", F.when(limit, "field_limit").when((F.col("ending") == "open") & F.col("_habit").isNull(), "transfer"))


def truncated(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(rec_id, source, n_chars, ending, kind, p): every record with its ending; kind is null where nothing was cut."""
    base = endings(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("rec_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), F.col("text"))
    return cut_kinds(base).select("rec_id", "source", "n_chars", "ending", "kind", "p")


def truncation_rates(verdicts: DataFrame) -> DataFrame:
    """Per source: texts, cut texts by kind, and the share that was cut."""
    cut = F.col("kind").isNotNull()
    return verdicts.groupBy("source").agg(
        F.count("*").alias("texts"), F.sum(cut.cast("bigint")).alias("cut"),
        F.count_if(F.col("kind") == "field_limit").alias("at_field_limit"),
        F.round(F.avg(cut.cast("double")), 6).alias("share"),
    )
