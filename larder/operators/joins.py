"""Joins in which nulls can match and the first match counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (null keys are keys)."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def latest_per_key(df: DataFrame, keys: Sequence[str], date: str, tie: str) -> DataFrame:
    """The latest row of each key (null dates last, ties by `tie`); rows with a null key all stay."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = first_per_key(df.filter(known), keys, [F.col(date).desc_nulls_last(), F.col(tie)])
    return rows.unionByName(df.filter(~known))


def null_safe_on(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition under which null equals null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def left_first_match(df: DataFrame, other: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], matched: str | None = None) -> DataFrame:
    """Left join to the first row per key of `other`, null keys matching null keys; `matched` names a flag column. The size of
    `other` decides between broadcast and sort-merge at run time."""
    right = first_per_key(other, keys, order).select(*keys, *[F.col(c).alias(f"_{c}") for c in take], F.lit(True).alias("_hit"))
    out = df.alias("l").join(right.alias("r"), null_safe_on("l", "r", keys), "left")
    columns = [F.col(f"l.{c}") for c in df.columns if c not in take]
    taken = [F.col(f"_{c}").alias(c) for c in take]
    flag = [F.coalesce(F.col("_hit"), F.lit(False)).alias(matched)] if matched else []
    return out.select(*columns, *taken, *flag)


def lookup_by_either(df: DataFrame, dim: DataFrame, id_col: str, name_col: str, take: Sequence[str], order: str) -> DataFrame:
    """Attributes by id, else by name (case aside), each from the first row of the dimension."""
    by_id = first_per_key(dim.filter(F.col(id_col).isNotNull()), [id_col], [order]).select(id_col, *[F.col(c).alias(f"_i_{c}") for c in take])
    by_name = first_per_key(dim.filter(F.col(name_col).isNotNull()).withColumn("_n", F.lower(name_col)), ["_n"], [order]).select("_n", *[F.col(c).alias(f"_n_{c}") for c in take])
    out = df.join(by_id, id_col, "left").withColumn("_n", F.lower(name_col)).join(by_name, "_n", "left")
    return out.select(*df.columns, *[F.coalesce(f"_i_{c}", f"_n_{c}").alias(c) for c in take])


def restrict(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among those allowed."""
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def exclude(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those removed; null keys stay."""
    return df.join(removed.select(key).distinct(), key, "left_anti")


def hash_sample(df: DataFrame, key: str, total: int, wanted: int) -> DataFrame:
    """Deterministic sample: keys divisible by ceil(total / wanted)."""
    step = max(1, -(-total // max(1, wanted)))
    return df.filter(F.pmod(F.col(key), F.lit(step)) == 0)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compare_columns(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns in both and in one of two frames only."""
    x, y = set(a.columns), set(b.columns)
    return {"both": sorted(x & y), "only_first": sorted(x - y), "only_second": sorted(y - x)}


def inner_details(df: DataFrame, details: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Rows of `df` that are wanted, with all columns of the rows of `details` of their key; null keys meet nothing."""
    return df.filter(wanted).join(details, key)
