"""Readers: line-delimited and whole-document JSON, CSV, topic lists, lexicons, whole text files.

All schemas are declared and malformed lines fail, instead of turning into nulls as Spark's default has it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.rows import require_columns


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is a single file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(p) and system.getFileStatus(p).isFile()


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Line-delimited JSON. Blank lines are skipped, a broken line raises when it is read."""
    return spark.read.schema(schema).json(path if isinstance(path, str) else list(path), mode="FAILFAST")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same; a missing file is an empty table."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl_files(spark: SparkSession, paths: Sequence[str], schema: str) -> tuple[DataFrame, list[str]]:
    """The files that are there in one table, and the paths that are missing."""
    there = [p for p in paths if exists(spark, p)]
    df = read_jsonl(spark, there, schema) if there else spark.createDataFrame([], schema)
    return df, [p for p in paths if p not in there]


def read_round_summaries(spark: SparkSession, path: str, schema: str, round_: str = "round") -> DataFrame:
    """The summaries of a run in the order of their rounds; empty where none has been written."""
    return read_jsonl_or_empty(spark, path, schema).orderBy(round_)


def read_csv(spark: SparkSession, path: str, schema: str, *required: str) -> DataFrame:
    """CSV with a header and with line breaks inside quoted fields; the required columns have to be in the header."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require_columns(header, *required)
    names = [c.split()[0] for c in schema.split(",")]
    kinds = dict(c.split() for c in schema.split(","))
    return header.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names if n in header.columns))


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON document, or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path, mode="FAILFAST")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic): one per line, or the items of a YAML list ``topics:``; stripped, blank ones and comments dropped."""
    lines = spark.read.text(path)
    if path.endswith((".yaml", ".yml")):
        item = F.regexp_extract("value", r"^\s*-\s+(.*?)\s*$", 1)
        lines = lines.select(F.regexp_replace(item, r"^([\"'])(.*)\1$", "$2").alias("value"))
    topic = T.strip("value")
    return lines.select(topic.alias("topic")).where("topic <> '' and not startswith(topic, '#')")


def read_lexicon(spark: SparkSession, directory: str, max_chars: int = 40) -> DataFrame:
    """(word): distinct lower-cased lines of all text files below a directory; comments and long lines are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,yaml,yml}").text(directory)
    return df.select(T.strip(F.lower("value")).alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#") & (F.length("word") < max_chars)).distinct()


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files; bytes that are no UTF-8 become the replacement character."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there, as for a validation file that goes by two names."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def resolve(path: str, config_dir: str, cwd: str | None = None) -> str:
    """A path as given, relative to the working directory, or relative to the configuration's folder, whichever is there."""
    if os.path.isabs(path):
        return path
    here = os.path.join(cwd or os.getcwd(), path)
    beside = os.path.join(config_dir, path)
    return here if os.path.exists(here) or not os.path.exists(beside) else beside


def coerce(raw: str) -> object:
    """A command-line value as what it looks like: true/false, null, a whole number, a number, or text."""
    low = raw.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            continue
    return raw


def with_overrides(cfg: dict, overrides: Sequence[str]) -> dict:
    """A configuration with ``dotted.key=value`` overrides."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in cfg.items()}
    for item in overrides:
        key, eq, raw = item.partition("=")
        if not eq:
            raise ValueError(f"an override is key=value, not {item!r}")
        *heads, last = key.split(".")
        at = out
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = coerce(raw)
    return out


def same_manifest(*configs: dict) -> str:
    """The split manifest path that all configurations name; an error if they differ."""
    paths = {str(c.get("split_manifest")) for c in configs}
    if len(paths) != 1:
        raise ValueError(f"the configurations name different split manifests: {sorted(paths)}")
    return paths.pop()


def file_sha256(path: str) -> str:
    """SHA-256 of a local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def topic_pool(spark: SparkSession, n: int, topics: Sequence[str]) -> DataFrame:
    """``n`` topics: the given ones, then 'topic variant i' for the places left."""
    given = [(i, t) for i, t in enumerate(topics[:n])]
    known = spark.createDataFrame(given, "place long, topic string")
    rest = spark.range(len(given), n).select(F.col("id").alias("place"), F.concat(F.lit("topic variant "), F.col("id").cast("string")).alias("topic"))
    return known.unionByName(rest)


def seed_prompts(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(prompt_id, system_prompt, user_template, style_instructions) of the prompts that a search starts with."""
    return stamped(spark.createDataFrame(list(rows), "system_prompt string, user_template string, style_instructions string"), "system_prompt", "user_template", "style_instructions")


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a prompt_id from the hash of its contents: the same prompt gets the same id in every run."""
    parts: list[Column] = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return df.withColumn("prompt_id", F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12))
