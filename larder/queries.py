"""Queries of the core operators; each takes (spark, data directory) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators import drift, load_profile, units
from larder.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(read(spark, d, "nutrition_sample"))


def p1_common_units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(read(spark, d, "nutrition_sample"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(read(spark, d, "bronze_records"), read(spark, d, "block_trace"), read(spark, d, "nutrition_sample"))


def p4_consistent_table(spark: SparkSession, d: str) -> DataFrame:
    """The drifting tables as one: typed columns filled from every known name, the rest as JSON in `_rescued`."""
    return drift.consistent_table(read(spark, d, "bronze_records"), read(spark, d, "block_trace"), read(spark, d, "nutrition_sample"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rates = load_profile.findings(load_profile.trace_values(read(spark, d, "block_trace")), 1.0)
    return rates.union(load_profile.findings(load_profile.score_values(read(spark, d, "api_runs")), 100.0))


def p6_column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the columns of every catalogue file."""
    columns = ["product_name", "brand_owner", "brand_name", "ingredients", "food_category", "serving_size", "serving_size_unit", "published_date"]
    return load_profile.column_profile(read(spark, d, "nutrition_sample"), ["gcs_source_file"], columns, {"published_date": r"^\d{4}-\d{2}-\d{2}$"})


def p6_load_profile(spark: SparkSession, d: str) -> DataFrame:
    return load_profile.load_profile(load_profile.trace_values(read(spark, d, "block_trace")), 1.0)


QUERIES = {f.__name__: f for f in (p1_found, p1_common_units, p4_found, p4_consistent_table, p6_found, p6_column_profile, p6_load_profile)}
ORACLES: dict[str, str] = {}
