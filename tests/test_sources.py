import json

import pytest
from pyspark.sql import functions as F

from textloom.operators.rows import require_columns
from textloom.sources import files, schemas, sinks
from textloom.streaming import trace


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"text": "x", "score": 0.5}', "", '{"text": "y", "round": 2}')
    assert [(r.text, r.score, r["round"]) for r in files.read_jsonl(spark, good, schemas.SCORED_TEXT).orderBy("text").collect()] == [("x", 0.5, None), ("y", None, 2)]
    bad = write(tmp_path / "b.jsonl", '{"text": "x"}', '{"text": ')
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, schemas.SCORED_TEXT).collect()
    assert files.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), schemas.SCORED_TEXT).count() == 0
    df, missing = files.read_jsonl_files(spark, [good, str(tmp_path / "none.jsonl")], schemas.SCORED_TEXT)
    assert df.count() == 2 and len(missing) == 1
    assert files.first_existing(spark, str(tmp_path / "validation.jsonl"), good) == good


def test_csv_and_required_columns(spark, tmp_path):
    path = write(tmp_path / "e.csv", "essay,title", '"line one', 'line ""two""",T', "plain,")
    df = files.read_csv(spark, path, "essay string, title string", "essay")
    assert sorted(r.essay for r in df.collect()) == ['line one\nline "two"', "plain"]
    with pytest.raises(ValueError, match="nope"):
        files.read_csv(spark, path, "essay string", "nope")
    with pytest.raises(ValueError):
        require_columns(df, "x")


def test_topics_lexicon_and_text(spark, tmp_path):
    yaml = write(tmp_path / "t.yaml", "topics:", '  - "quoted one"', "  - plain two", "", "# note")
    assert {r.topic for r in files.read_topics(spark, yaml).collect()} == {"quoted one", "plain two"}
    text = write(tmp_path / "t.txt", " one ", "", "two")
    assert {r.topic for r in files.read_topics(spark, text).collect()} == {"one", "two"}
    (tmp_path / "lex" / "sub").mkdir(parents=True)
    write(tmp_path / "lex" / "a.txt", "Delve", "# note", "x" * 40, "delve ")
    write(tmp_path / "lex" / "sub" / "b.md", "tapestry")
    assert {r.word for r in files.read_lexicon(spark, str(tmp_path / "lex")).collect()} == {"delve", "tapestry"}
    (tmp_path / "raw.txt").write_bytes(b"ab\xffcd\n")
    assert files.read_text_files(spark, str(tmp_path / "raw.txt")).first().text == "ab�cd\n"


def test_documents_and_helpers(spark, tmp_path):
    doc = tmp_path / "m.json"
    doc.write_text(json.dumps({"schema_version": 1, "seed": 42, "splits": {"train": ["a"], "val": []}}, indent=2))
    assert files.read_json_document(spark, str(doc), schemas.MANIFEST).first().splits == {"train": ["a"], "val": []}
    assert [files.coerce(x) for x in ("true", "3", "0.5", "null", "abc")] == [True, 3, 0.5, None, "abc"]
    assert files.with_overrides({"a": {"b": 1}}, ["a.b=2", "c.d=x"]) == {"a": {"b": 2}, "c": {"d": "x"}}
    with pytest.raises(ValueError):
        files.with_overrides({}, ["novalue"])
    assert files.same_manifest({"split_manifest": "x"}, {"split_manifest": "x"}) == "x"
    with pytest.raises(ValueError):
        files.same_manifest({"split_manifest": "x"}, {"split_manifest": "y"})
    assert [r.topic for r in files.topic_pool(spark, 3, ["a"]).orderBy("place").collect()] == ["a", "topic variant 1", "topic variant 2"]
    ids = [r.prompt_id for r in files.seed_prompts(spark, [("s", "u", ""), ("s", "u", ""), ("s", "v", "")]).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 12


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", float("nan"), 1), ("b", "val", 0.5, 2)], "text string, split string, score double, round int")
    sinks.write_splits(df, str(tmp_path / "s"))
    lines = [json.loads(x) for p in (tmp_path / "s" / "split=train").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"text": "a", "round": 1}]
    out = str(tmp_path / "r")
    sinks.replace_rounds(df, out)
    sinks.replace_rounds(spark.createDataFrame([("c", "val", 0.1, 2)], df.schema), out)
    assert {(r.text, r["round"]) for r in spark.read.parquet(out).collect()} == {("a", 1), ("c", 2)}
    assert [json.loads(r.value) for r in sinks.json_lines(df.where("text = 'b'"), "text", "score").collect()] == [{"text": "b", "score": 0.5}]
    sinks.append_jsonl(df, str(tmp_path / "app"))
    sinks.append_jsonl(df, str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 4


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "1.json", '{"event": "log", "step": 1, "ts": "t", "extras": {"loss": 0.5}}')
    write(src / "2.json", '{"event": "end", "ts": "t"}')
    trace.append_trace(trace.trace_stream(spark, str(src), schemas.TRACE), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event for r in spark.read.schema(schemas.TRACE).json(str(tmp_path / "out")).collect()} == {"log", "end"}

    schema = "essay string, slop_score double, topic string, ordinal long"
    rows = [("e1", 0.5, "a", 1), ("e2", 0.6, "a", 2), ("e3", 0.4, "a", 3), ("e4", 0.45, "b", 4), ("e5", 0.3, "b", 5)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for p in (tmp_path / f"p{i}").glob("*.parquet"):
            (tmp_path / "pool").mkdir(exist_ok=True)
            p.rename(tmp_path / "pool" / f"{i}.parquet")
    stream = lambda: trace.parquet_stream(spark, str(tmp_path / "pool"))
    trace.run_to_end(stream(), str(tmp_path / "cp2"), trace.keep_pool(str(tmp_path / "kept"), 2, schema))
    last = sorted(p.name for p in (tmp_path / "kept").iterdir())[-1]
    assert {r.essay for r in spark.read.parquet(str(tmp_path / "kept" / last)).collect()} == {"e3", "e5"}
    trace.run_to_end(stream(), str(tmp_path / "cp3"), trace.keep_ratchet(str(tmp_path / "low"), "topic", "slop_score", schema))
    assert {r.essay for r in spark.read.parquet(*(str(p) for p in (tmp_path / "low").iterdir())).collect()} == {"e1", "e3", "e4", "e5"}


def test_plans(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").where("n_chars > 500").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,500)]" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    from textloom.operators.selection import top_k

    assert "TakeOrderedAndProject" in top_k(df, 5, F.col("doc_id").desc())._jdf.queryExecution().executedPlan().toString()


def test_builtin(spark):
    from textloom.sources import builtin

    assert builtin.prompts(spark).select("prompt_id").distinct().count() == 12
    assert [r.topic for r in builtin.topics(spark, 12).orderBy("place").collect()][9:] == ["winter roads", "topic variant 10", "topic variant 11"]
