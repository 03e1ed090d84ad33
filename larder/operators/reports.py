"""Report aggregations over layers, runs, clusters and caches, and the flattening of nested logs and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suppress_recalled(df: DataFrame, flag: str = "is_recalled", level: str = "recall_class", wanted: str = "CLASS I", prefix: bool = False) -> DataFrame:
    """Rows without recalls of a class, matched exactly, or as a prefix (which takes in the classes that begin alike)."""
    c = F.upper(F.trim(F.coalesce(level, F.lit(""))))
    hit = F.coalesce(F.col(flag), F.lit(False)) & (c.startswith(wanted) if prefix else c == wanted)
    return df.filter(~hit)


def empty_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_percent, empty_percent, n_distinct) in one scan per column set; blanks are empty, not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("column_name").agg(
        F.round(100 * F.avg(F.col("v").isNull().cast("int")), 4).alias("null_percent"), F.round(100.0 * F.count_if(F.trim("v") == "") / F.count(F.lit(1)), 4).alias("empty_percent"), F.count_distinct("v").alias("n_distinct"),
    )


def top_values(df: DataFrame, column: str, n: int = 15, least: int = 1) -> DataFrame:
    """The n most frequent values with at least `least` rows, nulls left out (a report; ties by value)."""
    c = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return c.orderBy(F.desc("n"), column).limit(n)


def sum_of_max(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Sum over `outer` of the greatest value of each (outer, inner): gauges that are sampled several times per run."""
    return df.groupBy(*outer, *inner).agg(F.max(value).alias("_m")).groupBy(*outer).agg(F.sum("_m").alias(value))


def key_figures(runs: DataFrame, day: str, last: int = 20) -> DataFrame:
    """One row: runs, success rate, mean delta and quarantine rate of the runs of a day, or of the last ones if that day has none."""
    today = runs.filter(F.substring("started_at", 1, 10) == day)
    chosen = today if today.limit(1).count() else runs.orderBy(F.desc("started_at"), "run_id").limit(last)
    return chosen.agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col("status") == "completed").cast("int")), 6).alias("success_rate"), F.round(F.avg("dq_delta"), 4).alias("mean_delta"),
        F.round(F.sum("rows_quarantined") / F.nullif(F.sum("rows_in"), F.lit(0)), 6).alias("quarantine_rate"),
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """One row of totals over all runs."""
    s = lambda c: F.sum(c).alias(c)
    return runs.agg(s("rows_in"), s("rows_out"), s("rows_quarantined"), F.round(F.avg("dq_score_pre"), 4).alias("mean_pre"), F.round(F.avg("dq_score_post"), 4).alias("mean_post"))


def extreme_runs(runs: DataFrame, by: str = "source", value: str = "dq_delta") -> DataFrame:
    """Best and worst run of each group by a value (ties: the first run id in order)."""
    there = runs.filter(F.col(value).isNotNull())
    return there.groupBy(by).agg(F.max_by("run_id", F.struct(value, _backwards("run_id"))).alias("best_run"), F.min_by("run_id", F.struct(value, "run_id")).alias("worst_run"))


def _backwards(c: str) -> Column:
    """Sort key that turns the order of a text round."""
    return F.transform(F.split(F.col(c), ""), lambda x: -F.ascii(x))


def coverage_by(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per row value with a column per value, the total and each value's share of it."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return wide.withColumn("total", total).withColumns({f"{v}_share": F.round(F.col(f"`{v}`") / F.nullif(F.col("total"), F.lit(0)), 6) for v in values})


def hit_rates(lookups: DataFrame, prefix: str = "prefix", hit: str = "hit") -> DataFrame:
    """Hits, lookups and hit rate per key prefix."""
    return lookups.groupBy(prefix).agg(F.count(F.lit(1)).alias("lookups"), F.sum(F.col(hit).cast("int")).alias("hits"), F.round(F.avg(F.col(hit).cast("int")), 6).alias("hit_rate"))


def cluster_totals(clusters: DataFrame, decisions: str = "merge_decisions") -> DataFrame:
    """Per source: clusters, and rows saved by merging (size minus one of each); unreadable sizes count as one."""
    size = F.coalesce(F.get_json_object(decisions, "$.size").try_cast("long"), F.lit(1))
    return clusters.groupBy("source").agg(F.count(F.lit(1)).alias("clusters"), F.sum(size - 1).alias("merged_rows"))


def replayable(events: DataFrame, kind: str, payload: str = "null_rates", mark: str = "backfilled") -> DataFrame:
    """Events of a kind with a payload that does not carry the mark, in order."""
    return events.filter((F.col("event_type") == kind) & F.col(payload).isNotNull() & F.get_json_object(payload, f"$.{mark}").isNull()).orderBy("id")


def flatten_audit(logs: DataFrame, key: str, chunks: str, entries: str = "entries") -> DataFrame:
    """(key, chunk_no, entry_no, block, rows_in, rows_out, dq) of nested logs: JSON array of chunks, each with entries; a quality
    of zero or none falls back to the other field."""
    kind = f"array<struct<{entries}:array<struct<block:string,rows_in:bigint,rows_out:bigint,dq_score:double,dq:double>>>>"
    c = logs.select(key, F.posexplode(F.from_json(chunks, kind)).alias("chunk_no", "c"))
    e = c.select(key, "chunk_no", F.posexplode(f"c.{entries}").alias("entry_no", "e"))
    return e.select(key, "chunk_no", "entry_no", "e.block", "e.rows_in", "e.rows_out", F.coalesce(F.nullif(F.col("e.dq_score"), F.lit(0.0)), F.col("e.dq")).alias("dq"))


def flatten_records(df: DataFrame, file: str, json_col: str, fields: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(files, records) of raw JSON lines: rows and readable rows per file, and the fields cut to their greatest length."""
    m = F.from_json(json_col, "map<string,string>")
    files = df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.count(m).alias("readable"), F.sum(F.length(json_col)).alias("chars"))
    records = df.withColumn("_m", m).filter("_m is not null").select(file, *[F.substring(F.try_element_at("_m", F.lit(f)), 1, n).alias(f) for f, n in fields.items()])
    return files, records


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor zero, else the last one."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns[:-1]], columns[-1])


def nested_value(json_col: str, paths: Sequence[str]) -> Column:
    """Number at the first of several JSON paths that has one other than zero."""
    return first_truthy(*[F.get_json_object(json_col, p).try_cast("double") for p in paths])


def incremental_files(names: Sequence[str], mark: int) -> list[str]:
    """Delta files `..._{start}_{end}.json.gz` that start at or beyond a mark, in order."""
    import re

    found = [(int(m.group(1)), n) for n in names if (m := re.search(r"_(\d+)_(\d+)\.json\.gz$", n))]
    return [n for start, n in sorted(found) if start >= mark]


def layer_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of two layers and their difference."""
    x, y = a.agg(F.count(F.lit(1)).alias("first_rows")), b.agg(F.count(F.lit(1)).alias("second_rows"))
    return x.crossJoin(F.broadcast(y)).withColumn("difference", F.col("second_rows") - F.col("first_rows"))  # one row each
