import json
from fractions import Fraction

import numpy as np
import pytest

from larder.operators import drift, load_profile, units


def test_units_of_many_notations(spark):
    cases = [
        (None, "eine Portion (90 g)", "g", 900), (34.0, "MLT", "ml", 340), (None, "4 x 30 g", "g", 1200), (3.0, "x 68 ml", "ml", 2040), (2.0, "biscuits (38g)", "g", 380), (None, "66g/2.33oz", "g", 660),
        (2.29, "oz", "g", 649), (None, "1½ cup", "ml", 3549), (None, "ca. 0,117 kilos", "g", 1170), (141000.0, "MG", "g", 1410), (None, "8.4 US fl oz", "ml", 2484), (None, "3/4 tsp", "ml", 37), (1.0, "portion", None, None),
        (107.1, "", None, None), (None, None, None, None), (None, "2 cookies", None, None), (5.0, "G", "g", 50),
    ]
    df = spark.createDataFrame([(i, s, u, "f/a.jsonl") for i, (s, u, _, _) in enumerate(cases)], "record_id long, serving_size double, serving_size_unit string, gcs_source_file string")
    got = {r.record_id: (r.common_unit, r.amount_tenths) for r in units.found(df).collect()}
    assert got == {i: (k, t) for i, (_, _, k, t) in enumerate(cases) if k}


def test_plain_grams_are_no_cases_and_empty_tables_pass(spark):
    schema = "record_id long, serving_size double, serving_size_unit string, gcs_source_file string, device string"
    df = spark.createDataFrame([(1, 30.0, "g", None, "x"), (2, float("nan"), "g", None, "x")], schema)
    assert units.found(df).collect() == []
    assert units.common_units(df.limit(0)).collect() == []


SERVINGS = "record_id long, serving_size double, serving_size_unit string, gcs_source_file string"


def _servings(n=400):
    """A device in grams that switches to kilograms without saying so, and another with one unit slip."""
    rows = [(i, 30.0 + i % 7, "g" if i % 3 else "GRM", "a/x.jsonl") for i in range(n)]
    rows[120:180] = [(i, (30.0 + i % 7) / 1000, None, "a/x.jsonl") for i in range(120, 180)]
    rows[250] = (250, 31.0, "kg", "a/x.jsonl")
    return rows


def test_decoder_follows_a_switch(spark):
    df = spark.createDataFrame(_servings(), SERVINGS)
    got = {r.record_id: r for r in units.common_units(df).collect()}
    assert {got[i].unit_name for i in range(120, 180)} <= {"kg", "l"}
    assert all(got[i].amount_tenths == (30 + i % 7) * 10 for i in range(120, 180))


def test_decoder_corrects_a_stated_unit_that_the_level_denies(spark):
    rows = _servings()
    by = lambda df: {r.record_id: (r.common_unit, r.amount_tenths) for r in units.found(df).collect()}
    got = by(spark.createDataFrame(rows, SERVINGS))
    assert got[250] == ("g", 310) and got[249] == ("g", (30 + 249 % 7) * 10)
    rows[250] = (250, 31.0, "oz", "a/x.jsonl")  # a large serving, but no slip of a thousand
    assert by(spark.createDataFrame(rows, SERVINGS))[250] == ("g", 8788)


def test_decoding_is_the_same_for_any_block(spark):
    rows = _servings() + [(1000 + i, 0.25, None, "b/x.jsonl") for i in range(50)] + [(1050, 250.0, "ml", "b/x.jsonl")]
    df = spark.createDataFrame(rows, SERVINGS)
    results = [sorted(map(str, units.common_units(df, n).collect())) for n in (7, 64, 10**6)]
    assert results[0] == results[1] == results[2]


def test_composed_pieces_against_one_viterbi():
    rng = np.random.default_rng(4)
    for before, after in ((-1, -1), (1, -1), (-1, 0), (2, 1)):
        e, m = rng.normal(size=(23, 3)), np.log(rng.dirichlet(np.ones(3), 3))
        m[:] = np.log(0.1)
        np.fill_diagonal(m, np.log(0.8))
        whole = units.viterbi(e, m, before, after)
        cuts = [0, 4, 5, 16, 23]
        ends = units.compose([units.transfer(e[a:b], m) for a, b in zip(cuts, cuts[1:])], m, before, after)
        assert ends == [whole[b - 1] for b in cuts[1:]]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    e, m = rng.normal(size=(4, 3)), np.log(rng.dirichlet(np.ones(3), 3))
    import itertools

    def score(p):
        return m[1][p[0]] + e[0, p[0]] + sum(m[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))) + m[p[-1], 2]

    assert tuple(units.viterbi(e, m, 1, 2)) == max(itertools.product(range(3), repeat=4), key=score)


def _records(spark, batches):
    rows = [("t", "f", b, i, json.dumps(r) if r is not None else "{cut") for i, (b, rs) in enumerate(batches) for r in rs]
    df = spark.createDataFrame(rows, "table_name string, feed string, batch_name string, n int, j string")
    return drift.ingest(df, "j", {}).withColumn(drift.FIELDS, drift.fields_of({})).withColumn("batch_order", __import__("pyspark.sql.functions", fromlist=["x"]).timestamp_seconds("n"))


def test_changes(spark):
    a = [{"unit_price": 5, "x": "one two"}] * 3
    b = [{"unitPrice": 5, "x": ["one"]}] * 3 + [{"unitPrice": None, "x": "odd"}, None]
    c = [{"unitPrice": 6, "x": ["one"], "y": True}] * 2
    d = [{"unitPrice": 6, "y": True}]
    got = {tuple(r) for r in drift.changes(_records(spark, [("a", a), ("b", b), ("c", c), ("d", d)])).collect()}
    assert got == {("t", "f", "b", "renamed", "unit_price", "unitPrice"), ("t", "f", "b", "retyped", "x", ""), ("t", "f", "c", "added", "y", ""), ("t", "f", "d", "removed", "x", "")}


def test_ingest_rescues_and_replays(spark):
    df = spark.createDataFrame([('{"a": "7", "b": "x", "c": {"d": 1}}',), ('{"a": "bad"}',), ("{cut",), (None,), ("{}",)], "j string")
    t = {"a": "double", "z": "string"}
    rows = drift.ingest(df, "j", t).collect()
    assert [r.a for r in rows] == [7.0, None, None, None, None]
    assert json.loads(rows[0]._rescued) == {"b": "x", "c": {"d": 1}} and json.loads(rows[1]._rescued) == {"a": "bad"}
    assert json.loads(rows[2]._rescued) == {"_record": "{cut"} and rows[3]._rescued is None and rows[4]._rescued is None
    back = drift.replay(drift.ingest(df, "j", t), {"z": ["b"]}, t).collect()
    assert back[0].z == "x" and json.loads(back[0]._rescued) == {"c": {"d": 1}}


def test_ranks_quantiles_and_distances_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f"l{i % 3}", float(v)) for s in "ab" for i, v in enumerate(rng.integers(0, 12, 60))] + [("a", "l0", None)]
    df = spark.createDataFrame(rows, "s string, l string, v double")
    ranks = load_profile.range_ranks(df, ["s"], "v")
    q = {r.s: r for r in load_profile.quantiles(ranks, ["s"], "v").collect()}
    ks = {(r.s, r.l): r.ks for r in load_profile.ks_distances(df, ["s"], "l", "v").collect()}
    for s in "ab":
        v = sorted(x for k, _, x in rows if k == s and x is not None)
        assert (q[s].n_values, q[s].n_distinct, q[s].q50) == (len(v), len(set(v)), v[-(-len(v) // 2) - 1])
        for load in ("l0", "l1", "l2"):
            own, rest = [x for k, m, x in rows if k == s and m == load and x is not None], [x for k, m, x in rows if k == s and m != load and x is not None]
            want = max(abs(Fraction(sum(y <= x for y in own), len(own)) - Fraction(sum(y <= x for y in rest), len(rest))) for x in own + rest)
            assert ks[s, load] == pytest.approx(float(want))


def test_findings(spark):
    rows = [("t", "s", f"r{i:02d}", f"{i:02d}", "b", "c", "0.10" if i != 7 else "0.60") for i in range(20)] + [("t", "s", "r03", "03", "b", "d", "n/a"), ("t", "s", "r04", "04", "b", "d", "1.5"), ("t", "s", "r05", "05", "b", "d", "45%"), ("t", "s", "r06", "06", "b", "d", None)]
    df = spark.createDataFrame(rows, "table_name string, source string, run_id string, at string, block_name string, column_name string, text string")
    assert {tuple(r) for r in load_profile.findings(df, 1.0).collect()} == {("t", "r07", "c", "shift"), ("t", "r03", "d", "type"), ("t", "r04", "d", "range")}
    assert load_profile.findings(df.limit(0), 1.0).collect() == []


def test_the_distance_decides_what_a_shift_is(spark):
    rows = [("t", "s", f"r{i:02d}", f"{i:02d}", f"b{b}", "c", f"{0.10 + (0.4 if i == 7 and b < 3 else 0.4 if i == 9 and b < 1 else 0):.2f}") for i in range(20) for b in range(5)]
    df = spark.createDataFrame(rows, "table_name string, source string, run_id string, at string, block_name string, column_name string, text string")
    runs = lambda **k: {r.run_id for r in load_profile.findings(df, 1.0, **k).collect()}
    assert runs() == {"r07"} and runs(least_ks=0.15) == {"r07", "r09"} and runs(least_ks=0.9) == set() and runs(least=0.45) == set()


def test_fields_come_from_typed_columns_and_the_rescue_column(spark):
    df = spark.createDataFrame([('{"a": "7", "b": null, "c": [1], "d": true}',), ("{cut",)], "j string")
    got = drift.ingest(df, "j", {"a": "double", "d": "string"})
    rows = got.select(drift.fields_of({"a": "double", "d": "string"})).collect()
    assert {(f.field_name, f.kind) for f in rows[0]._fields} == {("a", "string"), ("b", None), ("c", "array"), ("d", "boolean")} and rows[1]._fields is None
    none = got.selectExpr("cast(null as double) as a", "d", "_rescue", "_cast")
    assert "a" not in {f.field_name for f in none.select(drift.fields_of({"a": "double", "d": "string"})).first()._fields}


def test_consistent_table_promotes_approved_fields_and_replays_renames(spark):
    bronze = [("f1", 1, "x", "2024-01-01", '{"title": "Oat", "unit_price": 5}'), ("f2", 1, "x", "2024-01-02", '{"title": "Rye", "unitPriceNow": 5}')]
    b = spark.createDataFrame(bronze, "bronze_file string, line_no long, feed string, d string, record_json string").selectExpr("*", "cast(d as date) file_date")
    t = spark.createDataFrame([(1, "s", "r", "2024-01-01", '{"c": 0.5, "d": "odd"}')], "id long, source string, run_id string, ts string, null_rates string")
    c = spark.createDataFrame([(1, "x/a.jsonl", "Snacks"), (2, "x/a.jsonl", '["Snacks"]'), (3, "x/a.jsonl", None)], "record_id long, gcs_source_file string, food_category string")
    rows = {(r.table_name, r.batch_name, r.row_key): r for r in drift.consistent_table(b, t, c).collect()}
    assert [rows["bronze_records", f, "1"].product_name for f in ("f1", "f2")] == ["Oat", "Rye"]
    assert [rows["bronze_records", f, "1"].unit_price for f in ("f1", "f2")] == [5.0, 5.0]
    assert rows["block_trace", "r", "1"].rates == {"c": 0.5} and json.loads(rows["block_trace", "r", "1"]._rescued) == {"d": "odd"}
    assert [rows["nutrition_sample", "x/a.jsonl", str(i)].food_category for i in (1, 2, 3)] == ["Snacks", None, None]
    assert json.loads(rows["nutrition_sample", "x/a.jsonl", "2"]._rescued) == {"food_category": ["Snacks"]}
    assert {r.product_name for r in drift.consistent_table(b, t, c, approved=[]).filter("table_name = 'bronze_records'").collect()} == {None}


def test_runs_decoded_together_are_those_decoded_alone():
    rng = np.random.default_rng(7)
    length = rng.integers(1, 9, 40)
    first = np.cumsum(length) - length
    e, m = rng.normal(size=(length.sum(), 4)), np.log(rng.dirichlet(np.ones(4), 4))
    before, after = rng.integers(-1, 4, 40), rng.integers(-1, 4, 40)
    got = units.viterbi_runs(e, m, first, length, before, after)
    for i, (f, n) in enumerate(zip(first, length)):
        assert got[f : f + n].tolist() == units.viterbi(e[f : f + n], m, before[i], after[i]).tolist()


def test_each_text_is_searched_once_and_runs_are_decoded_together(spark, monkeypatch):
    df = spark.createDataFrame(_servings(), SERVINGS)
    plans = []
    kept = units.cut
    monkeypatch.setattr(units, "cut", lambda d, *x: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), kept(d, *x))[1])
    out = units.common_units(df)
    # One search for amounts in any unit, one for a unit alone.
    assert plans[0].count("milligrammes|") == 2
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
