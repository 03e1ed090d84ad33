"""Declarative column programs: a list of actions compiled to Spark columns.

Contract of every action: a missing source makes a typed null target (which is a no-op if the target already has data); with
`on_error="skip"` an action that cannot be compiled is dropped with a warning, else it raises. Casts never fail: a value
that does not fit becomes null. Whole-number casts of fractional values give null.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as tx

TYPES = {"string": "string", "float": "double", "integer": "bigint", "boolean": "boolean"}
Op = dict[str, Any]


def spark_type(name: str | None) -> str:
    """Spark type of a schema type; unknown names are strings."""
    return TYPES.get((name or "string").lower(), "string")


def to_type(c: Column, name: str | None, dtype: str = "string") -> Column:
    """Cast that gives null where a value does not fit."""
    t = spark_type(name)
    if t == "double":
        return c.try_cast("double")
    if t == "bigint":
        d = c.try_cast("double")
        return F.when(d == F.floor(d), d.try_cast("bigint"))
    if t == "boolean":
        k = F.lower(tx.strip(tx.as_text(c, dtype)))
        return F.when(k.isin("true", "1", "yes", "1.0"), True).when(k.isin("false", "0", "no", "0.0"), False)
    return tx.as_text(c, dtype)


def _dtype(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


class _Presence:
    """Which columns of a program's input hold any value: one aggregation for all columns that the program may ask about."""

    def __init__(self, df: DataFrame, ops: list[Op]):
        asked = {str(op.get(k)) for op in ops for k in ("target", "source")}
        self.df, self.columns, self.held = df, [c for c in df.columns if c in asked], None

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __getitem__(self, name: str) -> bool:
        if self.held is None:
            there = [c for c in self.columns if c is not None]
            row = self.df.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(there)]).first()
            self.held = dict(zip(there, row))
        return bool(self.held[name])

    def changed(self, op: Op, df: DataFrame) -> None:
        """Forget the columns that an operation may have written or dropped."""
        written = {op.get("source"), op.get("target"), *(op.get("target_columns") or ()), *(op.get("column_names") or ())}
        for c in [c for c in self.columns if c in written or c not in df.columns]:
            self.columns[self.columns.index(c)] = None


_PRESENCE: ContextVar[_Presence | None] = ContextVar("presence", default=None)


def _has_data(df: DataFrame, name: str) -> bool:
    """Whether a column is there with any value. Within a program, columns that it has not written are answered together."""
    if name not in df.columns:
        return False
    known = _PRESENCE.get()
    return known[name] if known is not None and name in known else df.filter(F.col(name).isNotNull()).limit(1).count() > 0


def _put(df: DataFrame, op: Op, value: Column, keep: bool = False) -> DataFrame:
    """Set the target; drop the source if it is another column and the action does not keep it."""
    target = op.get("target") or op["source"]
    out = df.withColumn(target, value)
    source = op.get("source")
    return out if keep or not source or source == target or source not in df.columns else out.drop(source)


def set_null(df: DataFrame, op: Op) -> DataFrame:
    target = op["target"]
    if not op.get("force") and _has_data(df, target):
        return df
    return df.withColumn(target, F.lit(None).cast(spark_type(op.get("type"))))


def set_default(df: DataFrame, op: Op) -> DataFrame:
    if op.get("default_value") is None:
        return set_null(df, op)
    if _has_data(df, op["target"]):
        return df
    return df.withColumn(op["target"], to_type(F.lit(op["default_value"]), op.get("type")))


def _need(f: Callable[[DataFrame, Op], DataFrame]) -> Callable[[DataFrame, Op], DataFrame]:
    """A missing source column gives a null target."""

    def run(df: DataFrame, op: Op) -> DataFrame:
        if op.get("source") not in df.columns:
            return set_null(df, {"target": op.get("target") or op.get("source"), "type": op.get("type")})
        return f(df, op)

    return run


@_need
def type_cast(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, to_type(F.col(op["source"]), op.get("type"), _dtype(df, op["source"])))


def rename(df: DataFrame, op: Op) -> DataFrame:
    return df.withColumnRenamed(op["source"], op["target"]) if op["source"] in df.columns else df


def drop_column(df: DataFrame, op: Op) -> DataFrame:
    return df.drop(op.get("source") or op.get("target"))


@_need
def to_string(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, tx.as_text(F.col(op["source"]), _dtype(df, op["source"])))


@_need
def to_lowercase(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, F.lower(F.col(op["source"]).cast("string")))


@_need
def to_uppercase(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, F.upper(F.col(op["source"]).cast("string")))


@_need
def strip_whitespace(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, tx.strip(F.col(op["source"]).cast("string")))


@_need
def parse_date(df: DataFrame, op: Op) -> DataFrame:
    """`format`: unix_timestamp, a strptime format, or none for ISO and compact dates; unknown formats give nulls."""
    c, fmt = F.col(op["source"]).cast("string"), op.get("format")
    if fmt == "unix_timestamp":
        value = F.timestamp_seconds(c.try_cast("double")).cast("timestamp_ntz")
    elif fmt:
        java = tx.from_strptime(fmt)
        value = F.try_to_timestamp(c, F.lit(java)).cast("timestamp_ntz") if java else F.lit(None).cast("timestamp_ntz")
    else:
        value = F.coalesce(c.try_cast("timestamp_ntz"), F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd"))).cast("timestamp_ntz"))
    return _put(df, op, value)


def format_transform(df: DataFrame, op: Op) -> DataFrame:
    known = {"to_string": to_string, "parse_date": parse_date, "lower": to_lowercase, "to_lowercase": to_lowercase, "upper": to_uppercase, "to_uppercase": to_uppercase, "strip": strip_whitespace, "strip_whitespace": strip_whitespace}
    return known.get(op.get("transform"), _need(lambda d, o: _put(d, o, F.col(o["source"]))))(df, op)


@_need
def regex_replace(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, F.regexp_replace(F.col(op["source"]).cast("string"), tx.java_pattern(op["pattern"]), tx.java_replacement(op.get("replacement", ""))))


@_need
def regex_extract(df: DataFrame, op: Op) -> DataFrame:
    """First match's only group (the whole match without a group); a pattern with several groups is an error."""
    groups = re.compile(op["pattern"]).groups
    if groups > 1:
        raise ValueError(f"regex_extract takes one group: {op['pattern']}")
    value = tx.extract(F.col(op["source"]).cast("string"), tx.java_pattern(op["pattern"]), groups)
    return _put(df, op, to_type(value, op.get("type")), keep=bool(op.get("keep_source")))


@_need
def truncate_string(df: DataFrame, op: Op) -> DataFrame:
    return _put(df, op, F.substring(F.col(op["source"]).cast("string"), 1, int(op.get("max_length", 255))))


@_need
def pad_string(df: DataFrame, op: Op) -> DataFrame:
    """Pads to `min_length`, never cuts; zeros on the left go behind a sign."""
    c, n, fill, side = F.col(op["source"]).cast("string"), int(op["min_length"]), str(op.get("fill_char", "0")), op.get("side", "left")
    if side == "right":
        padded = F.rpad(c, n, fill)
    elif fill == "0":
        padded = F.when(c.rlike(r"^[+-]"), F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, 2, 1_000_000), n - 1, "0"))).otherwise(F.lpad(c, n, "0"))
    else:
        padded = F.lpad(c, n, fill)
    return _put(df, op, F.when(F.length(c) < n, padded).otherwise(c))


@_need
def value_map(df: DataFrame, op: Op) -> DataFrame:
    """Keys match stripped and in lower case; an unmapped value gives the default or stays as it is, null gives the default."""
    c = tx.as_text(F.col(op["source"]), _dtype(df, op["source"]))
    pairs = {str(k).strip().lower(): v for k, v in op["mapping"].items()}
    default = op.get("default")
    table = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, None if v is None else str(v))]) if pairs else None
    key = F.lower(tx.strip(c))
    hit = F.map_contains_key(table, key) if pairs else F.lit(False)
    value = F.when(c.isNull(), F.lit(default)).when(hit, F.try_element_at(table, key) if pairs else c).otherwise(F.lit(str(default)) if default is not None else c)
    return _put(df, op, to_type(value, op.get("type")))


def _value_of(key: str) -> Callable[[Column], Column]:
    return lambda m: F.try_element_at(m, F.lit(key))


def _objects(items: Column, key: str, only: dict | None) -> Column:
    """The objects of a list that have the key and pass the first pair of the filter, compared without case."""
    there = F.filter(items, lambda m: m.isNotNull() & F.map_contains_key(m, key))
    if not only:
        return there
    k, v = next(iter(only.items()))
    return F.filter(there, lambda m: F.lower(F.try_element_at(m, F.lit(k))) == str(v).lower())


@_need
def json_array_extract_multi(df: DataFrame, op: Op) -> DataFrame:
    """Columns from a JSON (or Python literal) list of objects: `key` of the first object that passes the filter, or of all
    joined by ", ". Only the first pair of a filter counts, compared without case; a present key with null value counts."""
    items = F.from_json(tx.json_text(F.col(op["source"])), "array<map<string,string>>")
    out = {}
    for name, spec in op["target_columns"].items():
        values = F.transform(_objects(items, spec["key"], spec.get("filter")), _value_of(spec["key"]))
        joined = F.when(F.size(F.array_compact(values)) > 0, F.array_join(values, ", "))
        out[name] = to_type(joined if spec.get("join_all") else F.get(values, F.lit(0)), spec.get("type"))
    return df.withColumns(out)


@_need
def split_column(df: DataFrame, op: Op) -> DataFrame:
    """Parts by position; missing parts are null, further ones dropped. A delimiter of several characters is a pattern."""
    delimiter = op.get("delimiter", ",")
    parts = F.split(F.col(op["source"]).cast("string"), re.escape(delimiter) if len(delimiter) == 1 else tx.java_pattern(delimiter))
    return df.withColumns({name: tx.strip(F.get(parts, F.lit(i))) if op.get("strip", True) else F.get(parts, F.lit(i)) for i, name in enumerate(op["column_names"])})


@_need
def xml_extract(df: DataFrame, op: Op) -> DataFrame:
    tag = re.escape(op["tag"])
    return _put(df, op, tx.strip(tx.extract(F.col(op["source"]).cast("string"), rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")), keep=True)


def coalesce(df: DataFrame, op: Op) -> DataFrame:
    there = [c for c in op["sources"] if c in df.columns]
    if not there:
        return set_null(df, op)
    kinds = {_dtype(df, c) for c in there}
    columns = [F.col(c) if len(kinds) == 1 else tx.as_text(F.col(c), _dtype(df, c)) for c in there]
    value = F.coalesce(*columns)
    return df.withColumn(op["target"], to_type(value, op["type"], kinds.pop() if len(kinds) == 1 else "string") if op.get("type") else value)


def concat_columns(df: DataFrame, op: Op) -> DataFrame:
    there = [tx.as_text(F.col(c), _dtype(df, c)) for c in op["sources"] if c in df.columns]
    if not there:
        return set_null(df, op)
    sep = op.get("separator", " ")
    if op.get("exclude_nulls", True):
        return df.withColumn(op["target"], F.when(F.coalesce(*there).isNotNull(), F.concat_ws(sep, *there)))
    return df.withColumn(op["target"], F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in there]))


def string_template(df: DataFrame, op: Op) -> DataFrame:
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", op["template"]):
        if m.group(1) not in df.columns:
            return set_null(df, op)
        parts += [F.lit(op["template"][at : m.start()]), F.coalesce(tx.as_text(F.col(m.group(1)), _dtype(df, m.group(1))), F.lit(""))]
        at = m.end()
    return df.withColumn(op["target"], F.concat(*parts, F.lit(op["template"][at:])))


@_need
def extract_json_field(df: DataFrame, op: Op) -> DataFrame:
    """`key` of an object, or of the first object of a list that passes the filter and has it; other JSON gives null, text that
    is no JSON (or is null) stays itself."""
    raw = F.col(op["source"]).cast("string")
    js = tx.json_text(raw)
    key = op["key"]
    one = F.try_element_at(F.from_json(js, "map<string,string>"), F.lit(key))
    items = _objects(F.from_json(js, "array<map<string,string>>"), key, op.get("filter"))
    value = F.when(js.isNull() | (tx.strip(raw) == "null"), raw).when(tx.strip(js).startswith("["), F.try_element_at(F.get(items, F.lit(0)), F.lit(key))).otherwise(one)
    return _put(df, op, to_type(value, op.get("type")))


@_need
def conditional_map(df: DataFrame, op: Op) -> DataFrame:
    c = F.lower(F.col(op["source"]).cast("string"))
    value = None
    for word, label in op["mapping"].items():
        hit = c.contains(str(word).lower())
        value = F.when(hit, F.lit(str(label))) if value is None else value.when(hit, F.lit(str(label)))
    default = F.lit(op.get("default"))
    return _put(df, op, to_type(value.otherwise(default) if value is not None else default, op.get("type")), keep=True)


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite, 0/0 not a number."""
    inf = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, inf).otherwise(a / F.nullif(b, F.lit(0.0)))


def arithmetic(expression: str, columns: dict[str, str]) -> Column:
    """Column of an arithmetic expression over column names; only numbers, names, + - * / % ** and signs are allowed."""

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise KeyError(n.id)
            return F.col(n.id).try_cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: _divide(a, b)), (ast.Mod, lambda: F.pmod(a, F.nullif(b, F.lit(0.0)))), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(n.op, kind):
                    return f()
        raise ValueError(f"not allowed in an expression: {ast.dump(n)[:60]}")

    return walk(ast.parse(expression, mode="eval"))


def expression(df: DataFrame, op: Op) -> DataFrame:
    try:
        value = arithmetic(op["expression"], dict(df.dtypes))
    except (KeyError, ValueError, SyntaxError):
        return set_null(df, {"target": op["target"], "type": op.get("type", "float")})
    return df.withColumn(op["target"], to_type(value, op.get("type", "float"), "double"))


@_need
def contains_flag(df: DataFrame, op: Op) -> DataFrame:
    """True if any keyword is in the text, without case; null is False."""
    c = F.lower(F.col(op["source"]).cast("string"))
    hit = F.lit(False)
    for k in op["keywords"]:
        hit = hit | c.contains(str(k).lower())
    return _put(df, op, F.coalesce(hit, F.lit(False)), keep=True)


#: Actions with the fields each needs.
ACTIONS: dict[str, tuple[Callable[[DataFrame, Op], DataFrame], tuple[str, ...]]] = {
    "set_null": (set_null, ("target",)), "set_default": (set_default, ("target",)), "type_cast": (type_cast, ("source", "type")), "rename": (rename, ("source", "target")),
    "drop_column": (drop_column, ()), "format_transform": (format_transform, ("source", "transform")), "to_string": (to_string, ("source",)), "parse_date": (parse_date, ("source",)),
    "to_lowercase": (to_lowercase, ("source",)), "to_uppercase": (to_uppercase, ("source",)), "strip_whitespace": (strip_whitespace, ("source",)), "regex_replace": (regex_replace, ("source", "pattern")),
    "regex_extract": (regex_extract, ("source", "pattern")), "truncate_string": (truncate_string, ("source",)), "pad_string": (pad_string, ("source", "min_length")), "value_map": (value_map, ("source", "mapping")),
    "json_array_extract_multi": (json_array_extract_multi, ("source", "target_columns")), "split_column": (split_column, ("source", "column_names")), "xml_extract": (xml_extract, ("source", "target", "tag")),
    "coalesce": (coalesce, ("sources", "target")), "concat_columns": (concat_columns, ("sources", "target")), "string_template": (string_template, ("template", "target")),
    "extract_json_field": (extract_json_field, ("source", "key")), "conditional_map": (conditional_map, ("source", "target", "mapping")), "expression": (expression, ("expression", "target")), "contains_flag": (contains_flag, ("source", "target", "keywords")),
}


def validate(program: dict) -> list[str]:
    """Errors of a program: unknown actions, lacking fields."""
    errors = []
    for i, op in enumerate(program.get("column_operations") or []):
        action = op.get("action")
        if action not in ACTIONS:
            errors.append(f"operation {i}: unknown action {action!r}")
            continue
        errors += [f"operation {i} ({action}): lacks {f}" for f in ACTIONS[action][1] if op.get(f) is None]
    return errors


def apply(df: DataFrame, program: dict, on_error: str = "raise") -> DataFrame:
    """Run a program {column_operations: [...], apply_if_column_present: name}; without the gate column nothing happens."""
    gate = program.get("apply_if_column_present")
    if gate and gate not in df.columns:
        return df
    ops = program.get("column_operations") or []
    known = _Presence(df, ops)
    token = _PRESENCE.set(known)
    try:
        for op in ops:
            try:
                if op.get("action") not in ACTIONS:
                    raise ValueError(f"unknown action {op.get('action')!r}")
                df = ACTIONS[op["action"]][0](df, op)
                known.changed(op, df)
            except Exception as e:
                if on_error != "skip":
                    raise
                warnings.warn(f"skipped {op.get('action')}: {e}", stacklevel=2)
    finally:
        _PRESENCE.reset(token)
    return df


def dump(program: dict) -> str:
    """A program as text that `load` reads (JSON, which is YAML too)."""
    return json.dumps(program, indent=1, ensure_ascii=False)


def load(text: str) -> dict:
    """A validated program from JSON text, or from YAML where a YAML reader is installed."""
    try:
        program = json.loads(text)
    except ValueError:
        import yaml

        program = yaml.safe_load(text)
    if errors := validate(program):
        raise ValueError("; ".join(errors))
    return program


def merge_decisions(program: dict, decisions: dict[str, dict]) -> dict:
    """A program with decisions on columns: {column: {action: set_default | accept_null | exclude, value, type}}."""
    ops = list(program.get("column_operations") or [])
    for column, d in decisions.items():
        if d["action"] == "set_default":
            ops.append({"action": "set_default", "target": column, "default_value": d.get("value"), "type": d.get("type", "string")})
        elif d["action"] == "accept_null":
            ops.append({"action": "set_null", "target": column, "type": d.get("type", "string")})
        elif d["action"] == "exclude":
            ops = [o for o in ops if o.get("target") != column] + [{"action": "drop_column", "source": column}]
    return program | {"column_operations": ops}


def compile_plan(plan: list[dict], column_mapping: dict[str, str] | None = None) -> dict:
    """Program of a plan of primitives (ADD, CAST, FORMAT, RENAME, DELETE, SPLIT, UNIFY, DERIVE); sources already renamed by
    `column_mapping` are looked up under their new name."""
    names = column_mapping or {}
    ops: list[Op] = []
    for p in plan:
        kind = str(p.get("primitive", "")).upper()
        source = names.get(p.get("source"), p.get("source"))
        sources = [names.get(s, s) for s in p.get("sources", [])]
        target = p.get("target") or source
        base = {"source": source, "target": target, "type": p.get("type", "string")}
        if kind == "ADD":
            value = p.get("default_value")
            ops.append({"action": "set_null" if value is None else "set_default", "target": target, "type": base["type"], "default_value": value})
        elif kind == "CAST":
            ops.append(base | {"action": "type_cast"})
        elif kind == "FORMAT":
            ops.append(base | {"action": p.get("action", "format_transform")} | {k: p[k] for k in ("transform", "format", "pattern", "replacement", "max_length", "min_length", "fill_char", "side") if k in p})
        elif kind == "RENAME":
            ops.append({"action": "rename", "source": source, "target": target})
        elif kind == "DELETE":
            ops.append({"action": "drop_column", "source": source})
        elif kind == "SPLIT":
            ops.append(base | {"action": p.get("action", "split_column")} | {k: p[k] for k in ("delimiter", "column_names", "target_columns", "tag", "strip") if k in p})
        elif kind == "UNIFY":
            ops.append({"action": p.get("action", "coalesce"), "sources": sources, "target": target} | {k: p[k] for k in ("separator", "exclude_nulls", "template", "type") if k in p})
        elif kind == "DERIVE":
            ops.append(base | {"action": p.get("action", "conditional_map")} | {k: p[k] for k in ("mapping", "default", "expression", "keywords", "key", "filter", "pattern", "keep_source") if k in p})
        else:
            raise ValueError(f"unknown primitive {kind!r}")
    return {"column_operations": ops}
