"""DuckDB SQL for the registered queries. Queries that SQL can't express on whole tables have none."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.functions.vectors import linspace
from textloom.operators.evaluation import ternary_grid

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def tokens(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


SCORE = "greatest(0.0, least(1.0, CASE WHEN isnan(score) THEN NULL ELSE score END))"
#: greatest and least skip nulls in DuckDB, so a null score is kept by hand.
CLAMPED = f"CASE WHEN score IS NULL OR isnan(score) THEN NULL ELSE {SCORE} END"
MANIFEST = """listed AS (SELECT unnest(map_entries(splits)) AS e FROM rewriter_split_manifest),
ids AS (SELECT e.key AS split, unnest(e.value) AS pair_id FROM listed),
shipped AS (SELECT pair_id, min(split) AS split FROM ids GROUP BY pair_id)"""


def bucket(x: str, k: int) -> str:
    return f"greatest(0, least({k - 1}, floor({x} * {k})))::INTEGER"


def ternary(x: str) -> str:
    return f"CASE WHEN {x} >= 0.66 THEN 2 WHEN {x} >= 0.33 THEN 1 WHEN {x} IS NOT NULL THEN 0 END"


def hash_order(seed: int, *keys: str) -> str:
    return f"sha256(concat_ws('|', '{seed}', " + ", ".join(f"{k}::VARCHAR" for k in keys) + "))"


def uniform(seed: int, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {key}), 1, 13))::BIGINT::DOUBLE / {float(16**13)}::DOUBLE)"


WINDOWS = f"""w AS (SELECT doc_id, {tokens('text')} AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 128 THEN [0] ELSE list_filter(range(0, (ceil((len(w) - 128) / 64.0) * 64)::BIGINT + 1, 64), lambda s: s = 0 OR s < len(w)) END) AS start FROM w),
parts AS (SELECT doc_id, start, (start // 64)::INTEGER AS chunk, w[start + 1:start + 128] AS t FROM win)"""
PROXY = f"""{WINDOWS},
scored AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t))::DOUBLE / len(t) END AS s FROM parts),
proxy AS (SELECT doc_id, avg(s) AS mean, max(s) AS max, count(*) AS n_chunks, (0.5::DOUBLE * avg(s) + 0.5::DOUBLE * max(s)) / 1.0::DOUBLE AS proxy_score FROM scored GROUP BY doc_id),
judged AS (SELECT d.doc_id, x AS score, (x >= 0.5)::INTEGER AS y, {ternary('x')} AS t, round(proxy_score, 6) AS proxy
  FROM (SELECT doc_id, {CLAMPED} AS x FROM documents) d JOIN proxy USING (doc_id) WHERE x IS NOT NULL)"""


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN {tp} + {fp} + {fn} > 0 THEN 2.0::DOUBLE * {tp} / (2.0::DOUBLE * {tp} + {fp} + {fn}) END"


def _mean(*parts: str) -> str:
    total = " + ".join(f"coalesce({p}, 0.0::DOUBLE)" for p in parts)
    n = " + ".join(f"({p} IS NOT NULL)::INTEGER" for p in parts)
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE ({total}) / ({n}) END"


BINARY = f"""{PROXY},
grid AS (SELECT unnest({linspace(0.05, 0.95, 181)}::DOUBLE[]) AS threshold),
counts AS (SELECT threshold, sum((y = 1 AND proxy >= threshold)::INTEGER)::BIGINT AS tp, sum((y = 0 AND proxy >= threshold)::INTEGER)::BIGINT AS fp, sum((y = 1 AND proxy < threshold)::INTEGER)::BIGINT AS fn, sum((y = 0 AND proxy < threshold)::INTEGER)::BIGINT AS tn FROM judged, grid GROUP BY threshold),
sweep AS (SELECT threshold, {_mean(_f1('tp', 'fp', 'fn'), _f1('tn', 'fn', 'fp'))} AS f1, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc FROM counts)"""


def _ternary_sql() -> str:
    grid = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, lo, hi in ternary_grid())
    sums = ", ".join(f"sum((t = {c} AND z = {c})::INTEGER)::BIGINT AS tp{c}, sum((t <> {c} AND z = {c})::INTEGER)::BIGINT AS fp{c}, sum((t = {c} AND z <> {c})::INTEGER)::BIGINT AS fn{c}" for c in (0, 1, 2))
    f1 = _mean(*(_f1(f"tp{c}", f"fp{c}", f"fn{c}") for c in (0, 1, 2)))
    return f"""WITH {PROXY}, grid(i, lo, hi) AS (VALUES {grid}),
z AS (SELECT i, lo, hi, t, CASE WHEN proxy >= hi THEN 2 WHEN proxy >= lo THEN 1 ELSE 0 END AS z FROM judged, grid),
c AS (SELECT i, lo, hi, {sums} FROM z GROUP BY ALL)
SELECT i::INTEGER AS i, round(lo, 6) AS t_low, round(hi, 6) AS t_high, round({f1}, 6) AS macro_f1 FROM c"""


def _cleaned(c: str) -> str:
    out = f"replace(translate(regexp_replace({c}, '{T.EMOJI}', '', 'g'), '{T.QUOTES}', '{T.PLAIN_QUOTES.replace(chr(39), chr(39) * 2)}'), '{T.ELLIPSIS}', '...')"
    for p in (*T.PREFIXES, *T.SUFFIXES):
        pattern = "(?is)" + p.replace(r"\s", WS)
        if pattern.endswith("$"):
            pattern = pattern[:-1] + r"(?:\n?$)"
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return strip(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


CENTROIDS = "cen AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"
UNITS = "units AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)))) AS u FROM embeddings)"
LOG = "p AS (SELECT *, length(mutation_op) AS cluster_id FROM prompt_pairs WHERE mutation_op IS NOT NULL)"


def _canonical(p: str, t: str) -> str:
    low, name = f"lower({p})", strip(f"coalesce({t}, '')")
    at = f"instr({low}, lower({name}))"
    loose = f"CASE WHEN {at} > 0 THEN substr({p}, 1, {at} - 1) || '{{topic}}' || substr({p}, {at} + length({name})) ELSE {p} END"
    return f"replace(CASE WHEN {name} = '' THEN {p} WHEN contains({p}, {name}) THEN replace({p}, {name}, '{{topic}}') ELSE {loose} END, '<topic>', '{{topic}}')"


CLUSTERS = f"""{LOG},
first AS (SELECT cluster_id, {_canonical('output_prompt', 'topic')} AS template FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rec_id) AS rn FROM p WHERE output_prompt IS NOT NULL) WHERE rn = 1),
member AS (SELECT pair_id, max(cluster_id) AS cluster_id FROM p GROUP BY pair_id)"""
SOURCES = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY (slop_score IS NULL), slop_score, CASE WHEN slop_score IS NULL THEN -seq ELSE seq END) AS rn
  FROM topic_sources WHERE {strip("coalesce(topic, '')")} <> '' AND {strip("coalesce(source_passage, '')")} <> ''),
idx AS (SELECT * FROM ranked WHERE rn = 1)"""
RUNS = "runs AS (SELECT source, round, round(min(output_slop_score), 6) AS best, round(avg(output_slop_score), 6) AS mean FROM prompt_pairs WHERE source IS NOT NULL AND round IS NOT NULL AND output_slop_score IS NOT NULL GROUP BY source, round)"


def _ranked(key: str, order: str, where: str = "true", table: str = "prompt_pairs") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table} WHERE {where})"


def _instruction(c: str) -> str:
    t = strip(c)
    rest = lambda verb: strip(f"regexp_extract({t}, '(?is)^{verb}{WS}+(.+)$', 1)")
    has = lambda verb: f"regexp_matches({t}, '(?is)^{verb}{WS}+.+$')"
    pair = f"(?is)^Compare{WS}+(.+?){WS}+(?:and|to|with){WS}+(.+)$"
    return f"""CASE WHEN {has('Explain')} THEN 'the nature and implications of ' || {rest('Explain')} WHEN {has('Describe')} THEN {rest('Describe')} || ' and its significance'
WHEN regexp_matches({t}, '{pair}') THEN 'the relative merits of ' || {strip(f"regexp_extract({t}, '{pair}', 1)")} || ' versus ' || {strip(f"regexp_extract({t}, '{pair}', 2)")}
WHEN {has('Should')} THEN 'whether ' || {rest('Should')} WHEN {has(f'What{WS}+is')} THEN {rest(f'What{WS}+is')} || ' and what it means' WHEN {has(f'What{WS}+are')} THEN {rest(f'What{WS}+are')} || ' and what it means' ELSE {t} END"""


def _variants(c: str) -> str:
    made = []
    for old, new in T.SUBSTITUTIONS:
        pattern = rf"(?is)^(.*?)\b{old}\b" if old == old.lower() else rf"(?s)^(.*?){old}"
        made.append(rf"regexp_replace({c}, '{pattern}', '\1{new}')")
    return f"list_filter([{', '.join(made)}], lambda v: v <> {c} AND {strip('v')} <> '')[1:3]"


def oracle_sql() -> dict[str, str]:
    deciles = "greatest(0, least(9, floor(x * 10)))"
    keywords = " OR ".join(f"contains(lower(s), '{k}')" for k in ("nobody", "price", "difference", "critics", "rarely"))
    wanted = " OR ".join(f"contains(lower(instruction), '{k}')" for k in T.KEYWORDS)
    out = {
        "len_filter_dedup": "SELECT min(doc_id) AS doc_id, max(length(text)) AS n_chars FROM documents WHERE length(text) BETWEEN 500 AND 12000 GROUP BY text",
        "word_count_gate": f"SELECT doc_id, len({words('text')}) AS n_words FROM documents WHERE len({words('text')}) >= 150",
        "constraint_cascade": f"SELECT doc_id, CASE WHEN len({words('text')}) < 60 THEN 'too_short' WHEN len({words('text')}) > 2000 THEN 'too_long' WHEN regexp_matches(text, '{T.REFUSAL.replace(chr(39), chr(39) * 2)}') THEN 'refusal' WHEN lang <> 'en' THEN 'non_english' ELSE 'ok' END AS reason FROM documents WHERE text IS NOT NULL",
        "scored_record": "SELECT 'train' AS split, count(*) AS n, round(avg(greatest(0.0, least(1.0, coalesce(score, round::DOUBLE, 0.0)))), 6) AS mean_score FROM documents WHERE length(coalesce(nullif(text, ''), nullif(source, ''), '')) >= 10",
        "labels": f"SELECT doc_id, {bucket('x', 11)} AS b11, {bucket('x', 4)} AS b4, {bucket('x', 2)} AS b2, (x >= 0.5)::INTEGER AS y, {ternary('x')} AS t FROM (SELECT doc_id, {CLAMPED} AS x FROM documents) WHERE x IS NOT NULL",
        "clean_boilerplate": f"SELECT doc_id, sha256(c) AS cleaned FROM (SELECT doc_id, {_cleaned('text')} AS c FROM documents WHERE text IS NOT NULL) WHERE len({words('c')}) >= 50",
        "clean_title": f"""SELECT seq, {strip("regexp_replace(" + strip("regexp_replace(" + strip('topic') + ", '^[\"'']|[\"'']$', '', 'g')") + f", '(?i)^(?:Title|Subject):{WS}*', '')")} AS title FROM topic_sources WHERE topic IS NOT NULL""",
        "title_prompt": f"""WITH x AS (SELECT doc_id, coalesce(source, '') AS source, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, floor(len(w)::DOUBLE * 0.85::DOUBLE)::INTEGER AS low, floor(len(w)::DOUBLE * 1.15::DOUBLE)::INTEGER AS high FROM x)
SELECT doc_id, sha256('{T.TITLE_HEAD}' || array_to_string(w[1:800], ' ') || '{T.TITLE_TAIL}') AS prompt, low, high, sha256('{T.MIRROR_HEAD}' || source || printf('{T.MIRROR_LENGTH}', low, high) || '{T.MIRROR_RULES}') AS mirror FROM y""",
        "mirror_rows": "SELECT rec_id AS mirror_idx, 0.0::DOUBLE AS score, length(best_essay)::INTEGER AS n_chars FROM prompt_pairs WHERE baseline_essay IS NOT NULL AND best_essay IS NOT NULL UNION ALL SELECT rec_id, 1.0::DOUBLE, length(baseline_essay)::INTEGER FROM prompt_pairs WHERE baseline_essay IS NOT NULL AND best_essay IS NOT NULL",
        "label_balance": f"SELECT a AS n_human, b AS n_ai, least(a, b) AS n_pairs, least(a, b) >= 2000 AS enough FROM (SELECT count(*) FILTER (x < 0.5) AS a, count(*) FILTER (x >= 0.5) AS b FROM (SELECT {CLAMPED} AS x FROM documents))",
        "missing_prompts": f"SELECT rec_id FROM prompt_pairs WHERE {strip(chr(99) + 'oalesce(input_prompt, ' + chr(39) * 2 + ')')} = '' OR {strip('coalesce(output_prompt, ' + chr(39) * 2 + ')')} = ''",
        "improving_pairs": "SELECT mutation_op, count(*) AS n, round(avg(improvement), 6) AS mean_improvement FROM prompt_pairs WHERE improvement >= 0.1 GROUP BY mutation_op",
        "keyword_filter": f"""WITH l AS (SELECT rec_id, best_essay AS output, string_split(input_prompt, chr(10)) AS ls FROM prompt_pairs WHERE input_prompt IS NOT NULL),
e AS (SELECT rec_id, output, unnest(ls) AS instruction, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_no FROM l)
SELECT rec_id, line_no FROM e WHERE {strip('instruction')} <> '' AND {strip('output')} <> '' AND length({strip('instruction')}) <= 150 AND ({wanted}) AND len({words('output')}) BETWEEN 50 AND 500""",
        "stratified_split": f"""WITH b AS (SELECT doc_id, coalesce(domain, 'none') AS domain, {bucket(f'coalesce({CLAMPED}, 0.0)', 4)} AS bucket, {hash_order(42, 'doc_id')} AS o FROM documents),
s AS (SELECT *, count(*) OVER (PARTITION BY domain, bucket) < 2 AS small FROM b),
g AS (SELECT *, CASE WHEN small THEN NULL ELSE domain END AS gd, CASE WHEN small THEN NULL ELSE bucket END AS gb FROM s),
r AS (SELECT *, count(*) OVER (PARTITION BY small, gd, gb) AS n, row_number() OVER (PARTITION BY small, gd, gb ORDER BY o, doc_id) AS rn FROM g)
SELECT doc_id, CASE WHEN rn <= ceil(n * 0.05::DOUBLE) THEN 'test' WHEN rn <= ceil(n * 0.05::DOUBLE) + ceil(n * 0.05::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""",
        "hash_split_manifest": f"""WITH i AS (SELECT DISTINCT pair_id FROM prompt_pairs WHERE pair_id IS NOT NULL), r AS (SELECT pair_id, row_number() OVER (ORDER BY {hash_order(42, 'pair_id')}) AS rn, count(*) OVER () AS n FROM i),
k AS (SELECT *, CASE WHEN n < 3 THEN 1 ELSE greatest(1, least(floor(n * 0.7::DOUBLE), n - 2)) END AS a FROM r), v AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, least(floor(n * 0.15::DOUBLE), n - a - 1)) END AS b FROM k)
SELECT pair_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split FROM v""",
        "split_semi_join": f"WITH {MANIFEST} SELECT rec_id FROM prompt_pairs WHERE pair_id IN (SELECT pair_id FROM shipped WHERE split = 'train')",
        "split_by_topic": f"WITH {MANIFEST} SELECT rec_id FROM prompt_pairs WHERE topic IN (SELECT topic FROM prompt_pairs WHERE topic IS NOT NULL AND pair_id IN (SELECT pair_id FROM shipped WHERE split = 'train'))",
        "nested_manifest": f"WITH {MANIFEST} SELECT split, substr(pair_id, 1, 2) AS part, count(*) AS n, sha256(string_agg(pair_id, ',' ORDER BY pair_id)) AS ids FROM shipped GROUP BY ALL",
        "pair_row_id": "SELECT rec_id, made, made = pair_id AS same FROM (SELECT rec_id, pair_id, sha256(" + " || chr(10) || ".join(strip(f"coalesce({c}, '')") for c in ("topic", "input_prompt", "output_prompt")) + ") AS made FROM prompt_pairs)",
        "token_windows": f"WITH {WINDOWS} SELECT doc_id, chunk, start::INTEGER AS start, len(t)::INTEGER AS n_tokens FROM parts",
        "char_chunks": "SELECT doc_id, chunk::INTEGER AS chunk, least(400, n - chunk * 400)::INTEGER AS n_chars FROM (SELECT doc_id, length(text) AS n, unnest(range(0, ceil(length(text) / 400.0)::BIGINT)) AS chunk FROM documents WHERE length(text) > 0)",
        "chunk_score_agg": f"WITH {PROXY} SELECT doc_id, round(mean, 6) AS mean, round(max, 6) AS max, n_chunks, round(proxy_score, 6) AS proxy_score FROM proxy",
        "slop_stats": f"SELECT source, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE stddev_samp(x) END, 6) AS stdev, round(avg((x < 0.5)::INTEGER::DOUBLE), 6) AS share_below FROM (SELECT source, {CLAMPED} AS x FROM documents) GROUP BY source",
        "slop_histogram": f"SELECT printf('[%.1f,%.1f)', b / 10.0::DOUBLE, (b + 1) / 10.0::DOUBLE) AS bin, count(*) AS n FROM (SELECT {deciles} AS b FROM (SELECT {CLAMPED} AS x FROM documents) WHERE x IS NOT NULL) GROUP BY bin",
        "conditional_counts": f"SELECT count(*) AS n, count(*) FILTER (x < 0.1) AS below_10, count(*) FILTER (x < 0.3) AS below_30, count(*) FILTER (x < 0.5) AS below_50 FROM (SELECT {CLAMPED} AS x FROM documents)",
        "eval_rollup": f"WITH {PROXY} SELECT round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(avg(proxy), 6) AS mean_proxy FROM judged",
        "threshold_sweep_binary": f"WITH {BINARY} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS macro_f1, round(acc, 6) AS accuracy FROM sweep",
        "best_threshold": f"WITH {BINARY} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS macro_f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
        "threshold_sweep_ternary": _ternary_sql(),
        "roc_auc": f"""WITH {PROXY}, r AS (SELECT y, rank() OVER (ORDER BY proxy) + (count(*) OVER (PARTITION BY proxy) - 1) / 2.0::DOUBLE AS rk FROM judged)
SELECT round((sum(rk) FILTER (y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1::DOUBLE * n0), 6) AS auc, n1 AS n_pos, n0 AS n_neg FROM r, (SELECT sum((y = 1)::INTEGER)::BIGINT AS n1, sum((y = 0)::INTEGER)::BIGINT AS n0 FROM judged) GROUP BY n1, n0""",
        "macro_f1": f"""WITH {PROXY}, z AS (SELECT {bucket('score', 4)} AS y, {bucket('proxy', 4)} AS z FROM judged), cl AS (SELECT y AS c FROM z UNION SELECT z FROM z),
f AS (SELECT c, sum((y = c AND z = c)::INTEGER) AS tp, sum((y <> c AND z = c)::INTEGER) AS fp, sum((y = c AND z <> c)::INTEGER) AS fn FROM z, cl GROUP BY c)
SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0)), 6) AS macro_f1, round(sum(tp)::DOUBLE / sum(tp + fn), 6) AS accuracy, sum(tp + fn)::BIGINT AS n FROM f""",
        "nearest_centroid": f"""WITH {CENTROIDS}, s AS (SELECT vec_id, cen.label AS cluster_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS sim FROM embeddings, cen),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, cluster_id) AS rn FROM s) SELECT vec_id, cluster_id::BIGINT AS cluster_id, round(sim, 5) AS similarity FROM r WHERE rn = 1""",
        "centroid_mean": f"WITH {CENTROIDS} SELECT label AS cluster_id, (generate_subscripts(c, 1) - 1)::INTEGER AS pos, round(unnest(c), 6) AS value FROM cen",
        "pooled_vector": """WITH e AS (SELECT vec_id % 50 AS doc, floor(vec_id / 50.0) AS chunk, embedding FROM embeddings), x AS (SELECT doc, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM e),
m AS (SELECT doc, pos, avg(v) AS m FROM x GROUP BY ALL) SELECT doc, pos::INTEGER AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY doc)), 5) AS value FROM m""",
        "medoid": f"""WITH {UNITS}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM units) GROUP BY ALL) GROUP BY label),
d AS (SELECT label, vec_id, 1.0 - list_dot_product(u, c) AS d FROM units JOIN c USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 12), vec_id) AS rn FROM d)
SELECT label, vec_id, round(d, 5) AS mean_distance FROM r WHERE rn = 1""",
        "nearest_to_centroid": f"WITH {CENTROIDS}, d AS (SELECT label, vec_id, list_distance(list_transform(embedding, lambda x: x::DOUBLE), c) AS d FROM embeddings JOIN cen USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 12), vec_id) AS rn FROM d) SELECT label, vec_id, round(d, 5) AS distance FROM r WHERE rn = 1",
        "softmax_decode": """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE - list_max(embedding[1:4])::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, round((p[2] + 2 * p[3] + 3 * p[4]) / 3, 5) AS expected, round(list_max(p), 5) AS top, round(p[4], 5) AS last FROM p""",
        "cluster_template_join": f"WITH {CLUSTERS} SELECT q.rec_id, m.cluster_id::INTEGER AS cluster_id, length(f.template)::INTEGER AS n_chars FROM prompt_pairs q JOIN member m USING (pair_id) JOIN first f ON f.cluster_id = m.cluster_id WHERE {strip('f.template')} <> ''",
        "cross_topic_expand": f"""WITH {CLUSTERS}, one AS (SELECT * FROM {_ranked('pair_id', 'rec_id')} WHERE rn = 1),
named AS (SELECT o.pair_id, m.cluster_id, f.template FROM one o JOIN member m USING (pair_id) JOIN first f ON f.cluster_id = m.cluster_id WHERE {strip('f.template')} <> ''),
fresh AS (SELECT DISTINCT topic AS new_topic FROM topic_sources WHERE topic IS NOT NULL AND topic NOT IN (SELECT topic FROM prompt_pairs WHERE topic IS NOT NULL)),
rk AS (SELECT new_topic, ((row_number() OVER (ORDER BY {hash_order(42, 'new_topic')}) - 1) // 10 + 1) AS block FROM fresh), nb AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pair_id) AS block FROM named)
SELECT pair_id, cluster_id::INTEGER AS cluster_id, new_topic, md5(replace(replace(template, '{{topic}}', new_topic), '<topic>', new_topic)) AS prompt FROM nb JOIN rk USING (block)""",
        "topic_source_index": f"WITH {SOURCES} SELECT topic, seq, slop_score FROM idx",
        "lookup_fallback": f"WITH {SOURCES} SELECT t.topic, length(coalesce(source_passage, 'no passage'))::INTEGER AS n_chars FROM (SELECT DISTINCT topic FROM prompt_pairs WHERE topic IS NOT NULL) t LEFT JOIN idx USING (topic)",
        "topic_anti_join": "SELECT seq FROM topic_sources WHERE topic IS NOT NULL AND topic NOT IN (SELECT topic FROM prompt_pairs WHERE topic IS NOT NULL)",
        "union_sources": "SELECT origin, source, count(*) AS n, count(domain) AS with_domain FROM (SELECT 'documents' AS origin, source, NULL AS domain FROM documents UNION ALL SELECT 'fool_essays', source, domain FROM fool_essays) GROUP BY origin, source",
        "distinct_topics": "SELECT count(DISTINCT topic) AS topics, count(DISTINCT pair_id) AS pairs, count(*) AS n_rows FROM prompt_pairs",
        "set_operations": "WITH a AS (SELECT topic FROM prompt_pairs WHERE topic IS NOT NULL), b AS (SELECT topic FROM topic_sources WHERE topic IS NOT NULL), x AS (SELECT topic FROM a INTERSECT SELECT topic FROM b) SELECT topic, 'both' AS side FROM x UNION ALL (SELECT topic, 'pairs' FROM (SELECT topic FROM a EXCEPT SELECT topic FROM x))",
        "best_per_topic": f"SELECT topic, rec_id, output_slop_score FROM {_ranked('topic', 'output_slop_score, rec_id', 'topic IS NOT NULL AND output_slop_score IS NOT NULL')} WHERE rn = 1",
        "dedupe_by_output": f"SELECT rec_id, improvement FROM {_ranked('output_prompt', 'improvement DESC, rec_id', 'output_prompt IS NOT NULL AND improvement IS NOT NULL')} WHERE rn = 1",
        "contrastive_pairs": f"WITH g AS (SELECT *, round(input_slop_score - output_slop_score, 6) AS gap FROM prompt_pairs) SELECT topic, rec_id, gap FROM {_ranked('topic', 'gap DESC, rec_id', 'topic IS NOT NULL AND gap IS NOT NULL', 'g')} WHERE rn = 1 AND gap > 0.1",
        "last_per_pair": "SELECT pair_id, max(rec_id) AS rec_id, min(rec_id) AS first_rec_id FROM prompt_pairs GROUP BY pair_id",
        "topic_minimum": "SELECT topic, min(output_slop_score) AS best FROM prompt_pairs WHERE topic IS NOT NULL GROUP BY topic HAVING min(output_slop_score) IS NOT NULL ORDER BY best, topic LIMIT 10",
        "fewshot_pool_merge": "WITH e AS (SELECT rec_id AS ordinal, output_slop_score AS slop_score, coalesce(output_slop_score, 1.0) AS s, substr(best_essay, 1, 4000) AS pre FROM prompt_pairs WHERE best_essay IS NOT NULL AND round IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pre ORDER BY s, ordinal) AS rn FROM e) SELECT ordinal, slop_score FROM r WHERE rn = 1 ORDER BY s, ordinal LIMIT 50",
        "fewshot_texts": f"SELECT ordinal FROM (SELECT rec_id AS ordinal, text FROM fool_essays ORDER BY coalesce(1 - score, 1.0), rec_id LIMIT 5) WHERE {strip('coalesce(text, ' + chr(39) * 2 + ')')} <> ''",
        "candidate_agg": f"SELECT prompt_id, round(avg(score), 6) AS mean_score, round(avg(length(text) / 10000.0::DOUBLE), 6) AS mean_sim, bool_and(len({words('text')}) >= 30) AS ok, CASE WHEN bool_and(len({words('text')}) >= 30) THEN round(-avg(score) + 0.3::DOUBLE * avg(length(text) / 10000.0::DOUBLE), 6) END AS fitness FROM fool_essays WHERE prompt_id IS NOT NULL AND prompt_id <> '' AND text IS NOT NULL GROUP BY prompt_id",
        "elite_slice": "SELECT rec_id FROM (SELECT rec_id, count(*) OVER (PARTITION BY source, round) AS n, row_number() OVER (PARTITION BY source, round ORDER BY output_slop_score, rec_id) AS rn FROM prompt_pairs WHERE output_slop_score IS NOT NULL) WHERE rn <= greatest(1, floor(n * 0.2::DOUBLE))",
        "bandit_rewards": "SELECT mutation_op, count(*) AS tries, round(avg(improvement), 6) AS mean_reward FROM prompt_pairs WHERE improvement IS NOT NULL GROUP BY mutation_op",
        "epsilon_greedy": f"SELECT rec_id, CASE WHEN {uniform(7, 'rec_id::VARCHAR')} < 0.15 THEN ['add_style', 'crossover', 'paraphrase', 'persona', 'seed', 'shorten'][(floor({uniform(8, 'rec_id::VARCHAR')} * 6) + 1)::BIGINT] ELSE 'persona' END AS op FROM prompt_pairs",
        "refill_plan": f"SELECT CASE WHEN u < 0.4::DOUBLE THEN 'mutate' WHEN u < 0.7::DOUBLE THEN 'crossover' WHEN u < 0.9::DOUBLE THEN 'mutate_any' ELSE 'seed' END AS action, count(*) AS n FROM (SELECT {uniform(11, 'rec_id::VARCHAR')} AS u FROM prompt_pairs) GROUP BY action",
        "hash_sample": f"SELECT doc_id FROM documents ORDER BY {hash_order(42, 'doc_id')}, doc_id LIMIT 50",
        "recency_oversample": "WITH l AS (SELECT rec_id FROM fool_essays WHERE round = (SELECT max(round) FROM fool_essays)) SELECT rec_id, false AS repeated FROM fool_essays UNION ALL SELECT rec_id, true FROM (SELECT rec_id, row_number() OVER (ORDER BY rec_id) AS rn FROM l) WHERE rn <= floor((SELECT count(*) FROM l) * 0.5)",
        "mixed_training": f"WITH {MANIFEST} SELECT source, count(*) AS n FROM prompt_pairs WHERE source IN ('alpaca', 'augmented', 'cross_topic') OR source = 'organic' AND pair_id IN (SELECT pair_id FROM shipped WHERE split = 'train') GROUP BY source",
        "curriculum_rank": "SELECT rec_id, row_number() OVER (PARTITION BY source ORDER BY round(input_slop_score - output_slop_score, 6) DESC, rec_id)::INTEGER AS curriculum_rank FROM prompt_pairs WHERE input_slop_score IS NOT NULL AND output_slop_score IS NOT NULL",
        "plateau_stop": f"WITH {RUNS}, g AS (SELECT *, lag(mean) OVER (PARTITION BY source ORDER BY round) - mean AS gain FROM runs) SELECT source, round, count(gain) OVER w = 2 AND coalesce(bool_and(gain < 0.02::DOUBLE) OVER w, false) AS stop FROM g WINDOW w AS (PARTITION BY source ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
        "early_stop": f"""WITH {RUNS}, m AS (SELECT *, min(mean) OVER (PARTITION BY source ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(mean) OVER (PARTITION BY source ORDER BY round) AS low, row_number() OVER (PARTITION BY source ORDER BY round) AS n FROM runs),
h AS (SELECT *, n - max(CASE WHEN before IS NULL OR mean < before THEN n END) OVER (PARTITION BY source ORDER BY round) AS waited FROM m) SELECT source, round, low AS best, waited, waited >= 8 AS stop FROM h""",
        "trajectory_pairs": f"""WITH {RUNS}, s AS (SELECT source, round AS parent, lead(round) OVER w AS child, mean AS a, lead(mean) OVER w AS b, 'step' AS kind FROM runs WINDOW w AS (PARTITION BY source ORDER BY round)),
e AS (SELECT source, min(round) AS parent, max(round) AS child, arg_min(mean, round) AS a, arg_max(mean, round) AS b, 'whole' AS kind FROM runs GROUP BY source HAVING count(*) > 2) SELECT source, parent, child, kind FROM (SELECT * FROM s WHERE child IS NOT NULL UNION ALL SELECT * FROM e) WHERE b < a""",
        "ratchet_min": "SELECT rec_id FROM (SELECT rec_id, output_slop_score AS s, min(output_slop_score) OVER (PARTITION BY topic ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM prompt_pairs WHERE topic IS NOT NULL AND output_slop_score IS NOT NULL) WHERE b IS NULL OR s < b",
        "time_to_result": f"WITH {RUNS} SELECT source, threshold, min(round) AS round FROM runs, (SELECT unnest([0.7, 0.6, 0.5, 0.4, 0.25, 0.2]::DOUBLE[]) AS threshold) WHERE mean <= threshold GROUP BY source, threshold",
        "best_ever": f"SELECT source, rec_id, improvement FROM {_ranked('source', 'improvement DESC, rec_id', 'improvement IS NOT NULL')} WHERE rn = 1",
        "round_summary": "SELECT round, round(min(output_slop_score), 6) AS best_score, round(avg(output_slop_score), 6) AS mean_score, count(*) FILTER (output_slop_score < 0.3) AS n_below, count(output_slop_score) AS n, round(median(output_slop_score), 6) AS median FROM prompt_pairs WHERE round IS NOT NULL GROUP BY round",
        "fill_metrics": f"WITH {RUNS} SELECT a.round, coalesce(CASE WHEN a.round % 2 = 0 THEN a.best END, b.best) AS best FROM runs a LEFT JOIN (SELECT round, max(input_slop_score) AS best FROM prompt_pairs GROUP BY round) b USING (round) WHERE source = 'organic'",
        "lineage": "WITH e AS (SELECT prompt_id, min(round) AS round, min(rec_id) AS rec_id FROM fool_essays WHERE prompt_id <> '' GROUP BY prompt_id), c AS (SELECT *, nullif(min(prompt_id) OVER (PARTITION BY round), prompt_id) AS parent_id FROM e WHERE round IS NOT NULL) SELECT c.prompt_id, c.parent_id, p.rec_id AS parent_rec_id FROM c LEFT JOIN c p ON p.prompt_id = c.parent_id",
        "latest_rows": "SELECT rec_id, logged_at FROM prompt_pairs WHERE logged_at IS NOT NULL ORDER BY logged_at DESC, rec_id LIMIT 5",
        "percent_improvement": "SELECT source, round(avg((input_slop_score - output_slop_score) * 100.0::DOUBLE / nullif(input_slop_score, 0)), 6) AS mean_pct, round((1 - avg(output_slop_score) / avg(input_slop_score)) * 100, 6) AS pct_of_means FROM prompt_pairs GROUP BY source",
        "instruction_to_topic": f"""WITH l AS (SELECT rec_id, string_split(input_prompt, chr(10)) AS ls FROM prompt_pairs WHERE input_prompt IS NOT NULL), e AS (SELECT rec_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_no FROM l)
SELECT rec_id, line_no, md5({_instruction('line')}) AS topic FROM e WHERE {strip('line')} <> ''""",
        "prompt_variants": f"WITH v AS (SELECT rec_id, {_variants('output_prompt')} AS vs FROM prompt_pairs WHERE output_prompt <> ''), e AS (SELECT rec_id, unnest(vs) AS v, (generate_subscripts(vs, 1) - 1)::INTEGER AS variant_no FROM v) SELECT rec_id, variant_no, md5({strip('v')}) AS variant FROM e",
        "template_fill": f"SELECT rec_id, md5(replace(replace({_canonical('output_prompt', 'topic')}, '{{topic}}', coalesce(topic, '')), '<topic>', coalesce(topic, ''))) AS prompt FROM prompt_pairs WHERE output_prompt IS NOT NULL",
        "compose_messages": f"""WITH x AS (SELECT rec_id, {strip('input_prompt')} AS a, {strip('output_prompt')} AS b, output_prompt AS raw, {strip('baseline_essay')} AS e FROM prompt_pairs WHERE input_prompt IS NOT NULL AND output_prompt IS NOT NULL),
y AS (SELECT *, CASE WHEN e IS NULL THEN '' ELSE '{T.FEWSHOT_HEAD}' || chr(10) || chr(10) || '--- Reference example 1 ---' || chr(10) || e END AS block,
  replace(replace(raw, '{{topic}}', '<topic>'), '{{style_instructions}}', 'plain') AS filled FROM x)
SELECT rec_id, md5(a || chr(10) || chr(10) || CASE WHEN block = '' THEN '' ELSE {strip('block')} || chr(10) || chr(10) END || b) AS message, md5(array_to_string(list_filter([a, filled, 'plain'], lambda p: p <> ''), chr(10) || chr(10))) AS whole FROM y""",
        "lexicon_sentence_ratio": f"""WITH x AS (SELECT doc_id, string_split(regexp_replace({strip('text')}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(len(list_filter(ss, lambda s: {keywords}))::DOUBLE / greatest(1, len(ss)), 6) AS ratio FROM x""",
        "word_tokens": f"SELECT doc_id, len({tokens('text')}) AS n, len(list_distinct({tokens('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL",
        "json_preview": "SELECT doc_id, md5(CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END) AS preview, CASE WHEN NOT isnan(score) AND abs(score) <> 'inf'::DOUBLE THEN score END AS score FROM documents WHERE text IS NOT NULL",
        "self_bleu": f"""WITH d AS (SELECT source, rec_id, {tokens('text')} AS w FROM fool_essays WHERE text IS NOT NULL), n AS (SELECT unnest([1, 2, 3, 4]) AS o),
g AS (SELECT source, rec_id, o, unnest(list_transform(range(1, len(w) - o + 2), lambda i: array_to_string(w[i:i + o - 1], ' '))) AS g FROM d, n WHERE len(w) >= o),
c AS (SELECT source, rec_id, o, g, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT a.source, a.rec_id, a.o, least(min(a.c), max(b.c)) AS hit FROM c a JOIN c b ON a.source = b.source AND a.o = b.o AND a.g = b.g AND a.rec_id <> b.rec_id GROUP BY a.source, a.rec_id, a.o, a.g),
h AS (SELECT source, rec_id, o, sum(hit) AS h FROM m GROUP BY ALL),
r AS (SELECT a.source, a.rec_id, len(a.w) AS n, arg_min(len(b.w), abs(len(b.w) - len(a.w)) * 1000000 + len(b.w)) AS ref FROM d a JOIN d b ON a.source = b.source AND a.rec_id <> b.rec_id GROUP BY a.source, a.rec_id, a.w),
l AS (SELECT r.source, r.rec_id, r.n, ref, sum(ln((CASE WHEN coalesce(h, 0) > 0 THEN h::DOUBLE ELSE 0.1::DOUBLE END) / greatest(1, r.n - o + 1))) / 4 AS s, coalesce(max(h) FILTER (o = 1), 0) AS h1 FROM r CROSS JOIN n LEFT JOIN h USING (source, rec_id, o) GROUP BY ALL),
b AS (SELECT source, rec_id, CASE WHEN h1 = 0 THEN 0.0 ELSE exp(s) * CASE WHEN n > ref THEN 1.0 ELSE exp(1 - ref::DOUBLE / greatest(n, 1)) END END AS score FROM l)
SELECT source, count(*) AS n_docs, CASE WHEN count(*) < 2 THEN 'nan'::DOUBLE ELSE round(avg(score), 6) END AS self_bleu FROM d LEFT JOIN b USING (source, rec_id) GROUP BY source""",
        "drift_penalty": """WITH x AS (SELECT rec_id, output_slop_score AS s, greatest(0.0, least(1.0, improvement)) AS a, greatest(0.0, least(1.0, output_slop_score * 2)) AS b, CASE WHEN output_slop_score <= 0.42 THEN greatest(0.0, least(1.0, output_slop_score)) ELSE 0.0 END AS c FROM prompt_pairs WHERE output_slop_score IS NOT NULL AND improvement IS NOT NULL),
y AS (SELECT *, 1.0::DOUBLE * a + 0.35::DOUBLE * b + 0.5::DOUBLE * c AS p FROM x) SELECT rec_id, round(p, 6) AS penalty, s <= 0.42 AS bertscore_applied, round(s + p, 6) AS objective FROM y""",
        "drift_grid": """WITH p AS (SELECT output_slop_score AS s, output_slop_score / 2 AS a, output_slop_score / 3 AS b, output_slop_score / 5 AS c FROM prompt_pairs WHERE output_slop_score IS NOT NULL),
g AS (SELECT * FROM (SELECT unnest([0.5, 1.0, 1.5]::DOUBLE[]) AS ga), (SELECT unnest([0.1, 0.35, 0.6]::DOUBLE[]) AS gb), (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS gc)), x AS (SELECT ga, gb, gc, s + ga * a + gb * b + gc * c AS x FROM p, g)
SELECT ga AS alpha_semantic, gb AS alpha_rouge, gc AS alpha_bertscore, round(avg((x < 0.5)::INTEGER::DOUBLE), 6) AS fool_rate_hard, round(avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-40.0::DOUBLE * (0.5::DOUBLE - x)))), 6) AS fool_rate_approx FROM x GROUP BY ga, gb, gc""",
        "trace_event_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "cluster_members": "SELECT label, vec_id % 16 AS shard, count(*) AS n_organic, md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS members FROM embeddings GROUP BY ALL",
        "score_below": "SELECT rec_id FROM prompt_pairs WHERE output_slop_score < 0.3",
        "penalised_scores": f"""WITH e AS (SELECT rec_id, score, length(text) AS n, len({words('text')}) >= 30 AS ok FROM fool_essays WHERE text IS NOT NULL AND score IS NOT NULL)
SELECT rec_id, round(CASE WHEN ok THEN score ELSE 1.0 END, 6) AS score, round(CASE WHEN ok THEN n / 10000.0::DOUBLE ELSE 0.0 END, 6) AS similarity FROM e""",
        "usable_essays": "SELECT rec_id FROM prompt_pairs WHERE baseline_essay <> '' AND best_essay <> '' AND source IN ('organic', 'augmented')",
        "with_defaults": "SELECT rec_id, coalesce(score, 0.5) AS score, coalesce(domain, 'none') AS domain, 'en' AS lang FROM fool_essays",
        "training_record": "SELECT rec_id, md5('rewrite: ' || input_prompt) AS source_text, md5(output_prompt) AS target_text FROM prompt_pairs WHERE input_prompt IS NOT NULL",
        "nested_fields": "SELECT doc_id, n_chars::DOUBLE AS n, try_cast(lang AS DOUBLE) AS lang, round::DOUBLE AS round FROM documents",
        "routed_rows": f"""SELECT rec_id, CASE WHEN baseline_essay <> '' AND best_essay <> '' THEN 'score' ELSE 'build' END AS route FROM prompt_pairs
WHERE {strip("coalesce(topic, '')")} <> '' AND input_prompt <> '' AND output_prompt <> ''""",
        "assigned_templates": f"""WITH {CENTROIDS}, s AS (SELECT vec_id, cen.label AS cluster_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS sim FROM embeddings, cen),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, cluster_id) AS rn FROM s)
SELECT vec_id, cluster_id::BIGINT AS cluster_id, 'Write about ' || cluster_id AS canonical_template FROM r WHERE rn = 1 AND sim >= 0.2 AND cluster_id % 3 <> 0""",
        "round_robin": """WITH n AS (SELECT mutation_op, row_number() OVER (ORDER BY min(rec_id)) - 1 AS i, count(*) OVER () AS k FROM prompt_pairs WHERE mutation_op IS NOT NULL GROUP BY mutation_op)
SELECT p.place, n.mutation_op FROM (SELECT unnest(range(1000)) AS place) p JOIN n ON p.place % n.k = n.i""",
        "semantic_drift": """SELECT a.vec_id, round(CASE WHEN b.vec_id IS NULL THEN 1.0 ELSE 1.0 - greatest(0.0, least(1.0, list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)))) END, 5) AS drift
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "drift_sensitivity": """WITH p AS (SELECT output_slop_score AS s FROM prompt_pairs WHERE output_slop_score IS NOT NULL), g AS (SELECT unnest([0.0, 0.35, 0.7, 1.05]::DOUBLE[]) AS gb),
x AS (SELECT gb, s + 1.0::DOUBLE * (s / 2) + gb * (s / 3) + 0.5::DOUBLE * (s / 5) AS x FROM p, g)
SELECT gb AS alpha_rouge, round(avg((x < 0.5)::INTEGER::DOUBLE), 6) AS fool_rate_hard, round(avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-40.0::DOUBLE * (0.5::DOUBLE - x)))), 6) AS fool_rate_approx FROM x GROUP BY gb""",
        "parsed_triplets": f"""WITH x AS (SELECT rec_id, {strip('input_prompt')} AS a, {strip('output_prompt')} AS b, coalesce(mutation_op, '') AS style FROM prompt_pairs WHERE input_prompt IS NOT NULL AND output_prompt IS NOT NULL)
SELECT rec_id, md5(CASE WHEN a = '' THEN 'You are a thoughtful writer.' ELSE a END) AS system_prompt, md5(CASE WHEN contains(b, '{{topic}}') THEN b ELSE b || ' Topic: {{topic}}.' END) AS user_template, style FROM x""",
        "weighted_mix_sample": f"""WITH w AS (SELECT rec_id, source, CASE source WHEN 'alpaca' THEN 0.4 WHEN 'cross_topic' THEN 0.7 WHEN 'augmented' THEN 0.3 ELSE 1.0 END::DOUBLE AS w FROM prompt_pairs),
line AS (SELECT source, w, sum(w) OVER (ORDER BY {hash_order(42, 'rec_id')}, rec_id ROWS UNBOUNDED PRECEDING) AS hi FROM w),
u AS (SELECT {uniform(42, 'i::VARCHAR')} * (SELECT sum(w) FROM w) AS spot FROM (SELECT unnest(range(5000)) AS i))
SELECT source, count(*) AS n FROM u JOIN line ON spot >= hi - w AND spot < hi GROUP BY source""",
    }
    out["keyword_filter_first"] = f"SELECT rec_id, line_no FROM ({out['keyword_filter']}) ORDER BY rec_id, line_no LIMIT 40"
    out["topk_fitness"] = f"SELECT prompt_id, fitness FROM ({out['candidate_agg']}) ORDER BY fitness DESC NULLS LAST, prompt_id LIMIT 12"
    return out
