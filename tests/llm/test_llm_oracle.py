"""The queries of the training-data problems: against DuckDB where SQL can express them, else by what must hold of their rows."""

import collections

import pytest

from textloom.llm import oracle, packing, queries, segmentation, splits

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert [n for n in range(1, 11) if not any(q.startswith(f"p{n}_") for q in QUERIES)] == []
    assert set(QUERIES) - set(SQL) == set(INVARIANTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, duck, check_sql):
    check_sql(QUERIES[name](spark, data), duck, SQL[name])


def p1_splits(rows, duck):
    topics = dict(duck.execute("SELECT rec_id, topic FROM prompt_pairs").fetchall())
    assert sorted(r.rec_id for r in rows) == sorted(topics)
    held = collections.defaultdict(set)
    for r in rows:
        if key := splits.name_key(topics[r.rec_id]):
            held[key].add(r.split)
    assert all(len(s) == 1 for s in held.values()) and {s for own in held.values() for s in own} <= set(splits.TARGETS)


def p1_split_shares(rows, duck):
    assert sum(r.n_rows for r in rows) == duck.execute("SELECT count(*) FROM prompt_pairs").fetchone()[0]
    assert all(abs(r.share - splits.TARGETS[r.split]) < 0.06 for r in rows)


def p2_found(rows, duck):
    texts = dict(duck.execute("SELECT rec_id, best_essay FROM prompt_pairs UNION ALL SELECT rec_id, text FROM fool_essays").fetchall())
    found = {r.rec_id for r in rows}
    assert found and len(found) == len(rows) and all(texts[i].strip() for i in found)
    ends = {i: t.rstrip()[-1:] for i, t in texts.items() if t}
    assert not [i for i in found if ends[i] in "?!"] and {i for i, e in ends.items() if (e and e in ",;:") or texts[i].rstrip().endswith((" the", " of", " and"))} <= found


def p2_rates(rows, duck):
    n = duck.execute("SELECT count(*) FROM (SELECT best_essay AS t FROM prompt_pairs UNION ALL SELECT text FROM fool_essays) WHERE t IS NOT NULL").fetchone()[0]
    assert sum(r.texts for r in rows) == n and all(r.at_field_limit <= r.cut <= r.texts and abs(r.share - r.cut / r.texts) < 1e-6 for r in rows)


def p5_pieces(rows, duck):
    texts = dict(duck.execute("SELECT rec_id, t FROM (SELECT rec_id, best_essay AS t FROM prompt_pairs UNION ALL SELECT rec_id, text FROM fool_essays) WHERE length(t) > 6000").fetchall())
    assert {r.rec_id for r in rows} == set(texts)
    for i, text in texts.items():
        own = sorted((r for r in rows if r.rec_id == i), key=lambda r: r.piece)
        assert own[0].start == 0 and own[-1].end == len(text) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.text == text[r.start : r.end] and len(r.text) <= segmentation.LIMIT for r in own)
        assert all(0 < a.end - b.start <= segmentation.OVERLAP for a, b in zip(own, own[1:]))


def p7_found(rows, duck):
    assert {r.defect for r in rows} == {"empty", "truncated", "refusal", "copy", "other_language"} and len({(r.rec_id, r.field) for r in rows}) == len(rows)
    blanks = duck.execute("SELECT rec_id, f FROM (SELECT rec_id, 'output_prompt' AS f, output_prompt AS t FROM prompt_pairs UNION ALL SELECT rec_id, 'baseline_essay', baseline_essay FROM prompt_pairs UNION ALL SELECT rec_id, 'best_essay', best_essay FROM prompt_pairs) WHERE t IS NOT NULL AND trim(t) IN ('', 'N/A', '-', 'null')").fetchall()
    assert set(blanks) <= {(r.rec_id, r.field) for r in rows if r.defect == "empty"}


def p7_counts(rows, duck):
    assert all(r.n_rows > 0 for r in rows) and {r.field for r in rows} <= {"output_prompt", "baseline_essay", "best_essay"}


def p8_containers(rows, duck):
    ids = [i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()]
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r.piece)
        used[r.container].append(r.n_tokens)
    assert set(pieces) == set(ids) and all(sorted(p) == list(range(len(p))) for p in pieces.values())
    assert all(sum(n) <= packing.CAPACITY and len(n) <= packing.MAX_DOCUMENTS for n in used.values())
    assert all(sum(r.n_tokens for r in rows if r.doc_id == i) > packing.CAPACITY for i, p in pieces.items() if len(p) > 1)


def p8_fill(rows, duck):
    assert len(rows) == 1 and 0.9 < rows[0].fill <= 1 and rows[0].most_used <= packing.CAPACITY


def p9_items(rows, duck):
    want = dict(duck.execute(f"SELECT item_id, count(*) FROM ({SQL['p9_found']}) GROUP BY item_id").fetchall())
    assert {r.item_id: r.documents for r in rows if r.documents} == want and all(r.best_score >= 20 or r.longest_run >= 12 for r in rows)


def p10_found(rows, duck):
    lost = {i for (i,) in duck.execute("SELECT doc_id FROM documents WHERE contains(text, chr(65533))").fetchall()}
    ascii_only = {i for (i,) in duck.execute("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]') AND NOT contains(text, '&')").fetchall()}
    found = {r.doc_id for r in rows}
    assert lost <= found and not ascii_only & found


def p10_restored(rows, duck):
    assert rows and all(("�" in r.repaired) <= (not r.restored) for r in rows)
    assert not [r.doc_id for r in rows if r.restored and ("Ã©" in r.repaired or "â€" in r.repaired)]


INVARIANTS = {f.__name__: f for f in (p1_splits, p1_split_shares, p2_found, p2_rates, p5_pieces, p7_found, p7_counts, p8_containers, p8_fill, p9_items, p10_found, p10_restored)}


@pytest.mark.parametrize("name", sorted(INVARIANTS))
def test_what_must_hold(name, spark, data, duck):
    INVARIANTS[name](QUERIES[name](spark, data).collect(), duck)
