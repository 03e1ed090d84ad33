"""Dataset profiles and samples."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as tx

# Share and number of values for a structure, sizes of a sample.
STRUCTURE_SHARE, STRUCTURE_VALUES = 0.6, 20


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), the most frequent first, nulls as "(null)"; `top` is the length of the report."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(null)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, std, min, p25, p50, p75, max) of numeric columns, exact percentiles with linear interpolation."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*")
    out = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"), F.max("v").alias("max"),
    )
    return out.select("column_name", "n", "mean", "std", "min", *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "max")


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n) of right-closed bins; values outside and nulls are left out."""
    c = F.col(column)
    b = F.coalesce(*[F.when((c > lo) & (c <= hi), F.lit(f"({lo:g}, {hi:g}]")) for lo, hi in zip(edges, edges[1:])])
    return df.select(b.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def rounded_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values rounded to whole numbers."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.round(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share in percent); the total is a sum over the groups."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("_t"), 4).alias("share"))  # one row


def profile(df: DataFrame, samples: int = 5) -> dict:
    """Per column: type, null rate, distinct values, samples, structure, keys of JSON; one aggregation for all columns."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.avg(F.col(c).isNull().cast("int")).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out: dict = {"__meta__": {"rows": row["_rows"], "columns": len(df.columns), "unify": unify_groups(df.columns)}}
    for i, (c, t) in enumerate(df.dtypes):
        values = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).limit(STRUCTURE_VALUES).collect()]
        kind = structure(values) if t == "string" else "scalar"
        info = {"dtype": t, "null_rate": round(row[f"n{i}"] or 0.0, 4), "distinct": row[f"d{i}"], "samples": values[:samples], "numeric": t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"), "structure": kind}
        if kind in ("json_array", "json_object"):
            info["keys"] = keys_and_types(df.select(c).filter(F.col(c).isNotNull()).limit(50), c)
        if kind in ("delimited", "json_array"):
            info["components"] = component_count(values, kind)
        out[c] = info
    return out


def _parsed(v: str):
    try:
        return json.loads(v)
    except ValueError:
        import ast

        try:
            return ast.literal_eval(v)
        except (ValueError, SyntaxError):
            return None


def structure(values: Sequence[str]) -> str:
    """json_array, json_object, xml, delimited, composite or scalar, by the share of the values that have the form."""
    if not values:
        return "scalar"
    tests = (
        ("json_array", lambda v: isinstance(_parsed(v), list)), ("json_object", lambda v: isinstance(_parsed(v), dict)), ("xml", lambda v: bool(re.match(r"\s*<\w[^>]*>.*</\w+>", v, re.S))),
        ("delimited", lambda v: any(v.count(d) >= 2 for d in "|;\t")), ("composite", lambda v: bool(re.match(r"^\d+(\.\d+)?\s+[a-zA-Z]+", v))),
    )
    for name, test in tests:
        if sum(map(test, values)) / len(values) >= STRUCTURE_SHARE:
            return name
    return "scalar"


def component_count(values: Sequence[str], kind: str) -> int:
    """Mean number of components, cut to a whole number."""
    if kind == "json_array":
        n = [len(p) for v in values if isinstance(p := _parsed(v), list)]
    else:
        n = [max(v.count(d) for d in "|;\t") + 1 for v in values]
    return int(sum(n) / len(n)) if n else 0


def keys_and_types(df: DataFrame, column: str) -> dict[str, str]:
    """Keys of the JSON objects (or objects of the lists) of a few rows with their type; `mixed` for several."""
    c = tx.json_text(F.col(column))
    items = df.select(F.when(F.trim(c).startswith("["), F.from_json(c, "array<map<string,variant>>")).otherwise(F.array(F.from_json(c, "map<string,variant>"))).alias("a"))
    seen = items.select(F.explode("a").alias("m")).filter("m is not null").select(F.explode("m").alias("k", "v")).selectExpr("k", "schema_of_variant(v) t").distinct().collect()
    names = {"BIGINT": "integer", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "boolean", "STRING": "string", "VOID": "null"}
    out: dict[str, set[str]] = {}
    for r in seen:
        out.setdefault(r["k"], set()).add(names.get(r["t"], "float" if r["t"].startswith("DECIMAL") else "string"))
    return {k: (next(iter(t - {"null"} or t)) if len(t - {"null"}) <= 1 else "mixed") for k, t in sorted(out.items())}


def unify_groups(columns: Sequence[str]) -> list[list[str]]:
    """Columns that belong together: numbered ones, and a value with its unit."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        if m := re.match(r"^(.*?)_?\d+$", c):
            groups.setdefault(m.group(1), []).append(c)
    out = [sorted(g) for g in groups.values() if len(g) > 1]
    return out + [[c, f"{c}_unit"] for c in columns if f"{c}_unit" in columns]


def sample_size(n: int) -> int:
    """Rows to look at among n."""
    if n <= 0:
        return 0
    return max(min(min(500, math.isqrt(n)) + min(200, n // 20), n), min(100, n))


def hash_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of the whole row: the same rows for any partitioning (a sampling operator)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *[c for c, t in df.dtypes if t in ("bigint", "int", "string")]).limit(n)


def sparse_columns(rates: dict[str, float], limit: float = 0.5) -> list[str]:
    """Columns with more than `limit` nulls."""
    return sorted(c for c, r in rates.items() if r > limit)


def adaptive_sample(df: DataFrame, seed: int = 42) -> DataFrame:
    """The whole of a small or sparse table, else a hash sample of `sample_size` rows."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    rates = {c: row[c] or 0.0 for c in df.columns}
    if row["_n"] <= 500 or len(sparse_columns(rates)) > len(rates) / 2 or any(r > 0.8 for r in rates.values()):
        return df
    return hash_sample(df, sample_size(row["_n"]), seed)


def confidence(null_rate: float, factors: Sequence[float] = ()) -> tuple[float, str]:
    """Confidence of a mapping: share of values times further factors, with its level."""
    c = 1 - null_rate
    for f in factors:
        c *= f
    c = min(1.0, max(0.0, c))
    return c, "high" if c >= 0.9 else "medium" if c >= 0.5 else "low"


def schema_difference(source: Sequence[str], target: Sequence[str]) -> dict[str, list[str]]:
    """Columns mapped by the same name, and those to add."""
    return {"mapped": [c for c in target if c in set(source)], "add": [c for c in target if c not in set(source)], "unused": [c for c in source if c not in set(target)]}


def fingerprint(columns: Sequence[str], domain: str, version: str) -> str:
    """Short hash of a schema, whatever the order of its columns."""
    return hashlib.sha256(json.dumps({"cols": sorted(columns), "domain": domain, "schema_version": version}, sort_keys=True).encode()).hexdigest()[:16]


def derive_schema(dtypes: Sequence[tuple[str, str]], null_rates: dict[str, float]) -> list[dict]:
    """Target fields of a first source: type by its own, required if less than half is null."""
    kinds = {"double": "float", "float": "float", "bigint": "integer", "int": "integer", "boolean": "boolean"}
    return [{"name": c, "type": kinds.get(t, "float" if t.startswith("decimal") else "string"), "required": null_rates.get(c, 0.0) < 0.5} for c, t in dtypes]
