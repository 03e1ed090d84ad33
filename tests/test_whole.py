import random

import duckdb
import pandas as pd
import pytest

from larder import analytics_queries
from larder.operators import recommend
from tests import oracle


def test_fusion_takes_fifty_candidates_of_each_list(spark, tmp_path):
    random.seed(4)
    words = ["jam", "soup", "bread", "mustard", "tofu", "granola"]
    texts = [" ".join(random.choices(words, k=random.randint(3, 12))) for _ in range(150)]
    docs = pd.DataFrame({"doc_id": range(1, 151), "text": texts, "title": ["jam soup tofu"] * 150, "n_chars": [len(t) for t in texts]})
    docs.to_parquet(tmp_path / "documents.parquet")
    sql = analytics_queries.ORACLES["s_rank_fusion"].replace("from bm where rank <= 10", "from bm where rank <= 50").replace("from v where rank <= 10", "from v where rank <= 50")
    documents = docs  # noqa: F841 (the table of the SQL)
    got = analytics_queries.s_rank_fusion(spark, str(tmp_path)).toPandas()
    assert oracle.rows(got) == oracle.rows(duckdb.sql(sql).df())


def _far(near: dict, start: int) -> dict[int, int]:
    far, front = {start: 0}, [start]
    for x in front:
        for y in sorted(near.get(x, set()) - far.keys()):
            far[y] = far[x] + 1
            front.append(y)
    return far


def test_searches_share_the_rows_of_a_node(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(400)] + [(200 + i, 201 + i) for i in range(6)]
    pairs = [(a, b) for a in range(70) for b in range(120)] + [(200, 206), (206, 200)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    want = {(a, b): n for a, b in pairs if (n := _far(near, a).get(b)) is not None}
    assert want[200, 206] == 6 and (206, 200) not in want
    e, p = spark.createDataFrame(edges + edges[:20], "src long, dst long"), spark.createDataFrame(pairs, "source long, target long")
    got = [tuple(r) for r in recommend.shortest_hops(e, p).select("source", "target", "hops").collect()]
    assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)
    back = recommend.shortest_hops(e.selectExpr("dst src", "src dst"), p.selectExpr("target source", "source target"))
    assert {(r.target, r.source): r.hops for r in back.collect()} == want


def test_paths_of_the_query_keep_no_row_for_each_search_and_node(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    lines = pd.DataFrame({"l_partkey": [rng.randrange(12_000) for _ in range(15_000)], "l_suppkey": [rng.randrange(400) for _ in range(15_000)]})
    lines.to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": range(12_000)}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"s_suppkey": range(400)}).to_parquet(tmp_path / "supplier.parquet")
    written, cut = [], recommend.cut

    def counted(df, *done):
        out = cut(df, *done)
        written.append(out.count())
        return out

    monkeypatch.setattr(recommend, "cut", counted)
    got = {(r.source, r.target): r.hops for r in analytics_queries.g_shortest_path(spark, str(tmp_path)).collect()}
    near: dict[int, set[int]] = {}
    for q, s in zip(lines.l_partkey, lines.l_suppkey):
        near.setdefault(-1 - q, set()).add(s)
        near.setdefault(s, set()).add(-1 - q)
    want = {}
    for t in range(1, 400, 100):
        far = _far(near, t)
        want |= {(-q, t): far[-1 - q] for q in range(0, 12_000, 100) if -1 - q in far}
    assert got == want and max(written) <= len(near)


@pytest.mark.parametrize("name", ["s_bm25", "s_rank_fusion"])
def test_searches_broadcast_nothing_that_grows(spark, tmp_path, name):
    docs = pd.DataFrame({"doc_id": range(1, 201), "text": ["jam soup tofu"] * 200, "title": ["jam"] * 200, "n_chars": [13] * 200, "url": [f"{i:0200d}" for i in range(200)]})
    docs.to_parquet(tmp_path / "documents.parquet")
    plan = analytics_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rank_fusion_exchanges_texts_once_and_lengths_instead_of_documents(spark, tmp_path):
    rng = random.Random(8)
    sizes = [rng.choice([None, 40, 41, 44, 60]) for _ in range(1200)]
    docs = pd.DataFrame({"doc_id": range(1200), "text": ["jam soup tofu"] * 1200, "title": ["jam"] * 1200, "n_chars": pd.array(sizes, "Int64")})
    docs.to_parquet(tmp_path / "documents.parquet")
    got = analytics_queries.nearest_by_number(spark.createDataFrame([(1, 42), (2, 42), (3, None), (4, 60)], "query_id long, q_chars long"), spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "n_chars"), 50)
    near = lambda v: [i for _, i in sorted((abs(n - v) if None not in (n, v) else 1 << 62, i) for i, n in enumerate(sizes))[:50]]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "doc_id").collect()) == [(q, k, i) for q, v in ((1, 42), (2, 42), (3, None), (4, 60)) for k, i in enumerate(near(v), 1)]
    plan = analytics_queries.s_rank_fusion(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert any(x.startswith("d#") for x in keys) and not any("d#" in x and "term#" in x for x in keys)


def test_scores_of_many_pairs_are_those_of_each():
    import random

    from larder.functions import text as tx
    from larder.operators import pairs

    r = random.Random(1)
    words = ["ab", "cream", "crème", "日本", "soup" * 9, "x" * 70, "lite", "", "tea", "7up", "ÿ𝄞"]
    name, brand = ([" ".join(r.choice(words) for _ in range(r.randint(0, k))) for _ in range(120)] for k in (6, 2))

    def score(i, j):
        (n, m), (b, c) = ((t[i], t[j]) for t in (name, brand))
        return (0.5 * tx.indel_ratio(tx.token_sort(n), tx.token_sort(m)) + 0.2 * tx.indel_ratio(b, c) + 0.3 * tx.indel_ratio(tx.token_sort(f"{n} {b}"), tx.token_sort(f"{m} {c}"))) / 100

    met = [(i, j) for i in range(50) for j in range(i + 1, 50)] + [(i, j) for i in range(50, 70) for j in range(70, 120)]
    for least in (0.3, 0.6, 0.85):
        got = pairs.linked(name, brand, [(slice(0, 50), slice(0, 50)), (slice(50, 70), slice(70, 120))], (0.5, 0.2, 0.3), least)
        assert {(i, j): s for i, j, s in zip(*(x.tolist() for x in got))} == {(i, j): s for i, j in met if (s := score(i, j)) >= least}


def test_links_do_not_depend_on_slices_or_on_what_a_task_holds(spark, monkeypatch):
    import random

    from larder.operators import dedup, pairs

    r = random.Random(2)
    rows = [(i, "soup " + "".join(r.choice("abc") for _ in range(7)) + r.choice([" mild", " hot", ""]), r.choice(["Acme", "Acme Ltd", None])) for i in range(400)] + [(400, "  ", "Acme"), (401, None, None), (402, "alone", "x")]
    df = spark.createDataFrame(rows, "id long, product_name string, brand_name string")
    links = lambda: sorted(map(tuple, dedup.fuzzy_links(df, "id").collect()))
    whole = links()
    assert whole and all(a < b for a, b, _ in whole) and len({x[:2] for x in whole}) == len(whole)
    monkeypatch.setattr(dedup, "SLICE_ROWS", 30)
    plan = dedup.fuzzy_links(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert links() == whole
    monkeypatch.setattr(pairs, "TABLE_PAIRS", 100)
    monkeypatch.setattr(pairs, "SCORED_PAIRS", 10)
    i = pairs.linked([n.lower() for _, n, _ in rows[:400]], [(b or "").lower() for _, _, b in rows[:400]], [(slice(0, 400), slice(0, 400))], dedup.PAIR_WEIGHTS, dedup.THRESHOLD)[0]
    assert len(i) >= len(whole)
