import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions import text as tx
from larder.operators import cleaning, dedup, joins, observe, profiling, quality, recommend, search
from larder.plans import guards, registry
from larder.sources import readers, writers
from larder.streaming import events as ev


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd ", max_size=12), st.text(alphabet="abcd ", max_size=12))
def test_indel_ratio_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * t[-1][-1] / (len(a) + len(b))
    assert tx.indel_ratio(a, b) == pytest.approx(want)


def test_components_against_search(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in dedup.connected_components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert dedup.connected_components(df.limit(0)).collect() == []


def test_fuzzy_links_against_all_pairs(spark):
    names = ["red apple pie", "apple pie red", "red apple pies", "redd grape", "blue cake", None, "", "red apple pie"]
    rows = [(i, n, "Acme" if i % 2 else "acme") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, product_name string, brand_name string")
    got = {(r.a, r.b) for r in dedup.fuzzy_links(df, "id", slices=3).collect()}
    want = set()
    reps = {}
    for i, n, b in rows:
        reps.setdefault(((n or "").lower(), b.lower()), i)
    key = lambda n, b: n[:4].strip() + "_" + b[:2]
    for (n, b), i in reps.items():
        for (m, c), j in reps.items():
            if i < j and n[:4].strip() and m[:4].strip() and key(n, b) == key(m, c):
                s = 0.5 * tx.indel_ratio(tx.token_sort(n), tx.token_sort(m)) + 0.2 * tx.indel_ratio(b, c) + 0.3 * tx.indel_ratio(tx.token_sort(f"{n} {b}"), tx.token_sort(f"{m} {c}"))
                if s >= 85:
                    want.add((i, j))
    assert got == want
    out = {r.id: r.duplicate_group_id for r in dedup.duplicate_groups(df, "id").collect()}
    assert out[7] == out[0] and out[5] == 5 and out[6] == 6


def test_merge_prefers_longest_then_first(spark):
    df = spark.createDataFrame([(1, 1, "ab", None), (2, 1, "cd", 5), (3, 1, None, 6), (4, 2, None, None)], "id long, g long, t string, n int")
    out = {r.g: (r.id, r.t, r.n) for r in dedup.merge_columns(df, "g", "id").collect()}
    assert out == {1: (1, "ab", 5), 2: (4, None, None)}


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("Acme Inc.", " a\t"), ("LLC", "  "), (None, None)], "brand_name string, product_name string")
    assert [r.brand_name for r in cleaning.remove_noise_words(df).collect()] == ["Acme", "LLC", None]
    assert [r.product_name for r in cleaning.strip_whitespace(df).collect()] == ["a", None, None]
    q = cleaning.extract_quantity(spark.createDataFrame([("Oat 12 oz, 2 pack",), ("12 oz",), (None,)], "product_name string")).collect()
    assert [(r.product_name, r.sizes) for r in q] == [("Oat", "12oz; 2pack"), ("12 oz", "12oz"), (None, None)]
    t = spark.createDataFrame([("Caf%C3%A9 &amp; tea",), ("plain",), (None,)], "t string")
    assert [(r.t, r.t_changed) for r in cleaning.repair_text(t, ["t"]).collect()] == [("Café & tea", True), ("plain", False), (None, False)]


def test_schema_and_quarantine(spark):
    s = quality.Schema((quality.Field("a", "integer", required=True), quality.Field("b"), quality.Field("c", "float", enrichment=True)))
    df = spark.createDataFrame([("1", 2, "x"), (None, 3, "y")], "a string, b int, extra string")
    out = quality.enforce(df, s)
    assert out.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    clean, bad = quality.split_quarantine(out, s.required)
    assert clean.count() == 1 and bad.first().reason == "Null in required field(s): a"
    with pytest.raises(ValueError):
        quality.Schema((), (0.5, 0.5, 0.5))


def test_null_safe_first_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    right = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 1, "none")], "k string, o int, v string")
    out = {r.id: (r.v, r.hit) for r in joins.left_first_match(left, right, ["k"], ["o"], ["v"], "hit").collect()}
    assert out == {1: ("first", True), 2: ("none", True), 3: (None, False)}


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "apple"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "Apple apple"), (8, "nothing")], "query_id long, query string")
    out = search.bm25(docs, q).collect()
    assert {r.doc_id for r in out} == {1, 2} and {r.query_id for r in out} == {7}


def test_rules_edges(spark):
    tx_ = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "c"), (None, "x")], "t long, i string")
    out = {(r.antecedent, r.consequent): r.pair_count for r in recommend.pair_rules(tx_, "t", "i", min_count=2, confidence=0.0, lift=0.0).collect()}
    assert out == {("a", "b"): 2, ("b", "a"): 2}


def test_profiles():
    assert profiling.structure(['{"a": 1}'] * 5) == "json_object" and profiling.structure(["a|b|c"] * 4) == "delimited" and profiling.structure([]) == "scalar"
    assert profiling.sample_size(0) == 0 and profiling.sample_size(50) == 50 and profiling.sample_size(1_000_000) == 700
    assert profiling.fingerprint(["b", "a"], "d", "1") == profiling.fingerprint(["a", "b"], "d", "1")
    assert profiling.unify_groups(["x1", "x2", "size", "size_unit"]) == [["x1", "x2"], ["size", "size_unit"]]


def test_forest_finds_the_odd_one():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 2))
    x[17] = (9, 9)
    assert int(observe.forest_scores(x).argmax()) == 17


def test_sequences_and_guards():
    for d in registry.SEQUENCES:
        errors, _ = registry.validate(registry.sequence_of(d))
        assert errors == (["unknown block pharma"] if d == "none" else [])
    assert registry.validate(["dq_score_post", "dq_score_pre"])[0] == ["dq_score_pre must come first", "dq_score_post must come last"]
    s = quality.Schema((quality.Field("a"), quality.Field("allergens", enrichment=True)))
    assert guards.check_plan([{"primitive": "CAST", "source": "zz", "target": "allergens"}], ["a"], s)[0] == ["operation 0: no source column zz", "operation 0: allergens is not to be mapped"]
    assert guards.check_response("```json\n{}\n```")[0] == [] and guards.check_response("no")[0] == ["no JSON"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|N/A\n2|b\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), infer=True).collect()] == [(1, None), (2, "b")]
    d = tmp_path / "bronze" / "s" / "2024" / "01" / "02"
    d.mkdir(parents=True)
    (d / "p.jsonl").write_text('{"a": 1, "b": {"c": 2}}\n\nnot json\n')
    row = readers.read_jsonl(spark, str(tmp_path / "bronze"), source="s").collect()
    assert len(row) == 1 and row[0].b == '{"c":2}' and row[0]._bronze_file.endswith("p.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([(1, "p")], "id long, product_name string")
    for day in ("2024/01/01", "2024/01/03"):
        writers.write_silver(df.withColumn("day", __import__("pyspark.sql.functions", fromlist=["x"]).lit(day)), str(tmp_path / "silver"), "s", day)
    got = readers.read_silver(spark, str(tmp_path / "silver"), "s", "2025/01/01", pattern="part-*.parquet")
    assert got.first().day == "2024/01/03"


def test_idempotent_sink_and_cursor(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "id long, k string, v int")
    sink = ev.idempotent_sink(str(tmp_path / "t"), ["k"], "id")
    sink(df, 0)
    sink(df, 0)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a", 5), (3, "b", 7)]
    page, mark = ev.cursor_page(df, 1, 1)
    assert page.count() == 1 and mark == 2 and ev.cursor_page(df, 9)[1] == 9


def test_shortest_paths_against_breadth_first_search(spark):
    import random

    from larder.operators import recommend

    rng = random.Random(6)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(14)}
    pairs = [(a, b) for a in range(0, 30, 5) for b in range(30)] + [(100, 114)]

    def hops(a, b):
        seen, front, n = {a}, {a}, 0
        while front:
            if b in front:
                return n
            front = {y for x, y in edges if x in front} - seen
            seen, n = seen | front, n + 1
        return None

    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {(r.source, r.target): r for r in recommend.shortest_paths(e, spark.createDataFrame(pairs, "source long, target long")).collect()}
    want = {(a, b): n for a, b in pairs if (n := hops(a, b)) is not None}
    assert {k: r.hops for k, r in got.items()} == want and want[100, 114] == 14
    assert all(len(r.path) == r.hops + 1 and all(x in edges for x in zip(r.path, r.path[1:])) for r in got.values())
