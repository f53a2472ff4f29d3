"""DuckDB SQL for those queries of the training-data problems that SQL can express on whole tables."""

from __future__ import annotations

from textloom.llm.sampling import DIGITS, SALT

_ESSAYS = """
listed AS (SELECT unnest(map_entries(splits)) AS e FROM rewriter_split_manifest),
ids AS (SELECT e.key AS split, unnest(e.value) AS pair_id FROM listed),
shipped AS (SELECT pair_id, min(split) AS split FROM ids GROUP BY pair_id),
essays AS (
  SELECT p.rec_id, p.source, s.split, p.best_essay AS text FROM prompt_pairs p LEFT JOIN shipped s USING (pair_id)
  UNION ALL SELECT rec_id, source, split, text FROM fool_essays)"""

_SHINGLES = r"""
words AS (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL),
long AS (SELECT {key}, w FROM words WHERE len(w) >= {least}),
each AS (SELECT DISTINCT {key}, sh FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh FROM long)),
sizes AS (SELECT {key}, count(*) AS n FROM each GROUP BY ALL)"""

_TOPIC_KEY = r"nullif(regexp_replace(regexp_replace(strip_accents(lower(replace(topic, '&', ' and '))), '^[^\p{L}\p{N}]*the[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+', '', 'g'), '')"


def _part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c})::VARCHAR || ':' || {c} END"


def _near(field: str) -> str:
    return f"""
SELECT '{field}' AS field, a.rec_id AS rec_id_a, b.rec_id AS rec_id_b
FROM (SELECT * FROM each WHERE field = '{field}') a JOIN (SELECT * FROM each WHERE field = '{field}') b ON a.sh = b.sh AND a.rec_id < b.rec_id
JOIN sizes x ON x.field = '{field}' AND x.rec_id = a.rec_id JOIN sizes y ON y.field = '{field}' AND y.rec_id = b.rec_id
GROUP BY a.rec_id, b.rec_id, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*))"""


def oracle_sql() -> dict[str, str]:
    key = "sha256(concat_ws('|', '" + SALT + "', " + ", ".join(map(_part, ("topic", "input_prompt", "output_prompt"))) + "))"
    fields = "fields AS (SELECT rec_id, 'input_prompt' AS field, input_prompt AS text FROM prompt_pairs UNION ALL SELECT rec_id, 'output_prompt', output_prompt FROM prompt_pairs)"
    return {
        "p1_found": f"""
WITH listed AS (SELECT unnest(map_entries(splits)) AS e FROM rewriter_split_manifest),
ids AS (SELECT e.key AS split, unnest(e.value) AS pair_id FROM listed),
shipped AS (SELECT pair_id, min(split) AS split FROM ids GROUP BY pair_id),
keyed AS (SELECT rec_id, {_TOPIC_KEY} AS k, split FROM prompt_pairs LEFT JOIN shipped USING (pair_id))
SELECT min(rec_id) AS rec_id FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT split) > 1""",
        "p3_found": f"""
WITH {_ESSAYS}, {_SHINGLES.format(key='rec_id, split', text='text', table='essays', least=50)}
SELECT least(a.rec_id, b.rec_id) AS rec_id_a, greatest(a.rec_id, b.rec_id) AS rec_id_b
FROM each a JOIN each b ON a.sh = b.sh AND a.split = 'train' AND b.split IN ('val', 'test')
JOIN sizes x ON x.rec_id = a.rec_id JOIN sizes y ON y.rec_id = b.rec_id
GROUP BY a.rec_id, b.rec_id, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*))""",
        "p3_report": f"""
WITH {_ESSAYS}, {_SHINGLES.format(key='rec_id, split, source', text='text', table='essays', least=50)},
pairs AS (SELECT a.rec_id AS train_id, b.rec_id AS eval_id, b.split AS eval_split, b.source AS eval_source, count(*) = x.n AND count(*) = y.n AS same
  FROM each a JOIN each b ON a.sh = b.sh AND a.split = 'train' AND b.split IN ('val', 'test')
  JOIN sizes x ON x.rec_id = a.rec_id JOIN sizes y ON y.rec_id = b.rec_id
  GROUP BY a.rec_id, b.rec_id, b.split, b.source, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*)))
SELECT eval_split, eval_source, count(DISTINCT eval_id) AS leaked_records, count(DISTINCT train_id) AS train_records, count(*) AS pairs, count(*) FILTER (same) AS exact_pairs FROM pairs GROUP BY ALL""",
        "p4_sample": f"""
SELECT sample_key, topic, input_prompt, output_prompt, count(*) AS n_rows, min(rec_id) AS first_rec_id
FROM (SELECT *, {key} AS sample_key FROM prompt_pairs)
WHERE ('0x' || substr(sample_key, 1, {DIGITS}))::BIGINT::DOUBLE / {float(16**DIGITS)}::DOUBLE < 0.1
GROUP BY ALL""",
        "p5_found": "SELECT rec_id FROM (SELECT rec_id, best_essay AS text FROM prompt_pairs UNION ALL SELECT rec_id, text FROM fool_essays) WHERE length(text) > 6000",
        "p6_found": f"WITH {fields}, {_SHINGLES.format(key='rec_id, field', text='text', table='fields', least=8)} {_near('input_prompt')} UNION ALL {_near('output_prompt')}",
        "p6_groups": f"""
WITH RECURSIVE {fields}, {_SHINGLES.format(key='rec_id, field', text='text', table='fields', least=8)},
pairs AS ({_near('input_prompt')} UNION ALL {_near('output_prompt')}),
both_ways AS (SELECT field, rec_id_a AS a, rec_id_b AS b FROM pairs UNION ALL SELECT field, rec_id_b, rec_id_a FROM pairs),
reach(field, a, b) AS (SELECT DISTINCT field, a, a FROM both_ways UNION SELECT r.field, r.a, e.b FROM reach r JOIN both_ways e ON e.field = r.field AND e.a = r.b),
grouped AS (SELECT field, a AS rec_id, min(b) AS group_id FROM reach GROUP BY field, a),
texts AS (SELECT field, rec_id, array_to_string(w, ' ') AS t FROM long),
linked AS (SELECT e.field, e.a AS rec_id, count(DISTINCT y.t) AS links FROM both_ways e JOIN texts x ON x.field = e.field AND x.rec_id = e.a JOIN texts y ON y.field = e.field AND y.rec_id = e.b WHERE x.t <> y.t GROUP BY ALL)
SELECT field, rec_id, group_id, coalesce(links, 0) AS links FROM grouped LEFT JOIN linked USING (field, rec_id)""",
        "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM heldout_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
