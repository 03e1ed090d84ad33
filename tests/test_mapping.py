import pytest

from larder.operators import mapping


def run(spark, rows, schema, *ops, **kw):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in mapping.apply(df, {"column_operations": list(ops)}, **kw).collect()]


def test_cast_keeps_only_what_fits(spark):
    out = run(spark, [("1.5",), ("2",), ("x",), (None,)], "a string", {"action": "type_cast", "source": "a", "target": "n", "type": "integer"})
    assert [r["n"] for r in out] == [None, 2, None, None] and "a" not in out[0]


def test_boolean_words(spark):
    out = run(spark, [(" Yes ",), ("0",), ("maybe",)], "a string", {"action": "type_cast", "source": "a", "target": "a", "type": "boolean"})
    assert [r["a"] for r in out] == [True, False, None]


def test_set_null_spares_data(spark):
    out = run(spark, [(1, None)], "a int, b string", {"action": "set_null", "target": "a", "type": "float"}, {"action": "set_default", "target": "b", "default_value": "z"})
    assert out == [{"a": 1, "b": "z"}]


def test_extract_json_field_forms(spark):
    rows = [('{"k": 1}',), ('[{"k": "a", "t": "X"}, {"k": "b", "t": "y"}]',), ("{'k': None}",), ("plain",), ("3",), (None,)]
    out = run(spark, rows, "j string", {"action": "extract_json_field", "source": "j", "target": "v", "key": "k", "filter": {"t": "Y"}})
    assert [r["v"] for r in out] == ["1", "b", None, "plain", None, None]


def test_pad_is_sign_aware_and_never_cuts(spark):
    out = run(spark, [("-5",), ("12345",)], "a string", {"action": "pad_string", "source": "a", "target": "a", "min_length": 4})
    assert [r["a"] for r in out] == ["-005", "12345"]


def test_two_groups_are_an_error(spark):
    op = {"action": "regex_extract", "source": "a", "target": "b", "pattern": "(a)(b)"}
    with pytest.raises(ValueError):
        run(spark, [("ab",)], "a string", op)
    with pytest.warns(UserWarning):
        assert run(spark, [("ab",)], "a string", op, on_error="skip") == [{"a": "ab"}]


def test_expression_allows_arithmetic_only(spark):
    out = run(spark, [(1.0, 0.0)], "a double, b double", {"action": "expression", "expression": "__import__('os')", "target": "x"}, {"action": "expression", "expression": "-a * 2 + b ** 2", "target": "y"})
    assert out[0]["x"] is None and out[0]["y"] == -2.0


def test_gate_and_validation(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert mapping.apply(df, {"apply_if_column_present": "zz", "column_operations": [{"action": "drop_column", "source": "a"}]}).columns == ["a"]
    assert mapping.validate({"column_operations": [{"action": "nope"}, {"action": "rename", "source": "a"}]}) == ["operation 0: unknown action 'nope'", "operation 1 (rename): lacks target"]


def test_round_trip_and_plan():
    program = mapping.compile_plan([{"primitive": "RENAME", "source": "x", "target": "y"}, {"primitive": "ADD", "target": "z", "type": "float"}], {"x": "x1"})
    assert mapping.load(mapping.dump(program)) == program
    assert program["column_operations"][0]["source"] == "x1"
