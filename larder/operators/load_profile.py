"""Column profiles of every load: null rates, exact distincts and quantiles, pattern violations, distances between loads.

All columns are unpivoted to (series, load, value) rows and range-sorted by series and value. Counts of the partitions,
summed in partition order, turn the position inside a partition into the exact global rank, so quantiles and distincts are
exact without bringing a column to one task. The cumulative curve of one load against the rest is read off the same ranks
and gives exact Kolmogorov-Smirnov distances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.session import cut


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column_name, value) with every value as text; nulls stay."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def range_ranks(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a series: `n`, `rank_to` (rows with a value up to it), `rank_before` (rows below it),
    `total` (rows of the series) and `distinct_to` (distinct values up to it). Nulls are left out; ties share one row."""
    series = list(series)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*series, value).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.repartitionByRange(*series, value).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*series, "_part").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    before = W.partitionBy(*series).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*series)
    parts = parts.select(*series, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.sum("_n").over(whole).alias("total"))
    inside = W.partitionBy(*series, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.withColumns({"_c": F.sum("n").over(inside), "_k": F.row_number().over(inside)}).join(parts, [*series, "_part"])
    return ranked.select(*series, value, "n", (F.col("_n0") + F.col("_c")).alias("rank_to"), (F.col("_n0") + F.col("_c") - F.col("n")).alias("rank_before"), "total", (F.col("_d0") + F.col("_k")).alias("distinct_to"))


def quantiles(ranks: DataFrame, series: Sequence[str], value: str, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact lower quantiles (the smallest value with at least a share q of the rows up to it), `n_values`, `n_distinct`,
    `min_value`, `max_value` of each series."""

    def picked(q: float) -> Column:
        need = F.greatest(F.ceil(F.col("total") * F.lit(q)), F.lit(1))
        return F.min(F.when(F.col("rank_to") >= need, F.col(value))).alias(f"q{round(q * 100)}")

    return ranks.groupBy(*series).agg(F.max("total").alias("n_values"), F.max("distinct_to").alias("n_distinct"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), *[picked(q) for q in at])


def ks_distances(df: DataFrame, series: Sequence[str], load: str, value: str, ranks: DataFrame | None = None) -> DataFrame:
    """Exact distance `ks` of the curve of each load from that of all other loads of its series; null for a lone load."""
    series = list(series)
    ranks = range_ranks(df, series, value) if ranks is None else ranks
    own = df.filter(F.col(value).isNotNull()).groupBy(*series, load, value).agg(F.count(F.lit(1)).alias("_own"))
    up = W.partitionBy(*series, load).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumns({"_to": F.sum("_own").over(up), "_all": F.sum("_own").over(W.partitionBy(*series, load))})
    both = own.join(ranks, [*series, value])
    rest = F.nullif(F.col("total") - F.col("_all"), F.lit(0))
    at = F.abs(F.col("_to") / F.col("_all") - (F.col("rank_to") - F.col("_to")) / rest)
    below = F.abs((F.col("_to") - F.col("_own")) / F.col("_all") - (F.col("rank_before") - F.col("_to") + F.col("_own")) / rest)
    return both.groupBy(*series, load).agg(F.max(F.greatest(at, below)).alias("ks"), F.max("_all").alias("n_load"))


def column_profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per key (a load) and column: `n_rows`, `null_rate`, `n_distinct`, `min_value`, `max_value`, quantiles of the
    numeric reading and `violations` of the column's pattern (0 where none is given). A column with only nulls has null rate
    1, zero distincts and null values; an empty table gives no rows. Text order for min and max."""
    keys = list(keys)
    long = unpivot(df, keys, columns).withColumn("number", F.col("value").try_cast("double"))
    series = [*keys, "column_name"]
    wrong = F.lit(False)
    for name, pattern in (patterns or {}).items():
        wrong = wrong | ((F.col("column_name") == name) & ~F.col("value").rlike(pattern))
    base = long.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("value").isNull().cast("int")).alias("null_rate"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.sum(F.when(wrong, 1).otherwise(0)).alias("violations"),
    )
    text = range_ranks(long, series, "value").groupBy(*series).agg(F.max("distinct_to").alias("n_distinct"))
    number = quantiles(range_ranks(long, series, "number"), series, "number").drop("n_values", "n_distinct", "min_value", "max_value")
    return base.join(text, series, "left").join(number, series, "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def number_of(text: Column) -> Column:
    """A number in any notation: plain, decimal comma, with a percent sign, or an object with a `rate`."""
    t = F.trim(text)
    t = F.when(t.startswith("{"), F.coalesce(F.get_json_object(t, "$.rate"), F.get_json_object(t, "$.value"))).otherwise(t)
    plain = F.regexp_replace(t, r"^([+-]?[0-9]*),([0-9]+)(?=%|$)", "$1.$2")
    share = F.rtrim(F.regexp_extract(plain, r"^([^%]*)%$", 1)).try_cast("double") / 100
    # Most texts are plain numbers, which a cast alone reads; a cast would also take suffixes, so the last character must be a digit.
    quick = text.try_cast("double")
    is_quick = quick.isNotNull() & ~F.isnan(quick) & (F.abs(quick) < float("inf")) & F.right(F.rtrim(text), F.lit(1)).between("0", "9")
    number = F.coalesce(F.when(is_quick, quick), F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double")), share)
    return number


def trace_values(df: DataFrame) -> DataFrame:
    """Rates of block_trace: table_name, source, run_id, at, block_name, column_name, text. Unreadable objects give no rows."""
    m = F.expr("from_json(null_rates, 'map<string,string>')")
    return df.filter("null_rates is not null").select(F.lit("block_trace").alias("table_name"), "source", "run_id", F.col("ts").cast("timestamp").alias("at"), "block_name", F.explode(m).alias("column_name", "text"))


def score_values(df: DataFrame) -> DataFrame:
    """Scores of api_runs in the same form, one pseudo block."""
    long = unpivot(df.select("source", "run_id", "started_at", "dq_score_pre", "dq_score_post"), ["source", "run_id", "started_at"], ["dq_score_pre", "dq_score_post"])
    return long.select(F.lit("api_runs").alias("table_name"), "source", "run_id", F.col("started_at").try_cast("timestamp").alias("at"), F.lit("").alias("block_name"), "column_name", F.col("value").alias("text"))


def load_profile(values: DataFrame, top: float, around: int = 10, least: float = 0.12, widths: float = 8.0) -> DataFrame:
    """One row per (table_name, source, run_id, column_name) of `values` with a number in 0..top: `level_gap` (median distance
    from the level of the neighbouring runs, in units of `top`), exact `iqr` of all such distances of the column, exact `ks` of the
    load's distances beyond the usual scatter against those of all other loads of the source, and exact `q50` of the column. The usual
    scatter reaches to `least` or `widths` interquartile ranges, whichever is more; what lies within it counts as no distance, so
    `ks` is 0 for loads like the others and near 1 for a load whose blocks have all left the level.

    The level of a run's value is the median of up to `around` runs before and after it in the same source, column and
    block, so slow trends and differences between blocks cancel and a spell of up to `around` runs stands out. Repeated
    values of a run and block are averaged. A column seen in fewer than four other runs has a null gap.
    """
    key = ["table_name", "source", "column_name"]
    number = number_of(F.col("text"))
    clean = values.withColumn("v", number / top).filter(F.col("v").between(0, 1)).groupBy(*key, "block_name", "run_id").agg(F.avg("v").alias("v"), F.min("at").alias("at"))
    near = W.partitionBy(*key, "block_name").orderBy("at", "run_id")
    others = F.array_sort(F.concat(F.collect_list("v").over(near.rowsBetween(-around, -1)), F.collect_list("v").over(near.rowsBetween(1, around))))
    size = F.size("_o")
    middle = (F.get("_o", F.floor((size - 1) / 2).cast("int")) + F.get("_o", F.floor(size / 2).cast("int"))) / 2
    clean = clean.withColumn("_o", others).withColumn("gap", F.when(size >= 4, F.round(F.col("v") - middle, 6))).drop("_o")
    clean = cut(clean)
    ranks = cut(range_ranks(clean, key, "gap"))
    spread = quantiles(ranks, key, "gap").select(*key, (F.col("q75") - F.col("q25")).alias("iqr"))
    margin = F.greatest(F.lit(least), F.col("iqr") * widths)
    beyond = F.round(F.signum("gap") * F.greatest(F.abs("gap") - margin, F.lit(0.0)), 6) + F.lit(0.0)
    clean = clean.join(spread, key, "left").withColumn("beyond", F.when(F.col("gap").isNotNull(), beyond)).drop("iqr")
    ks = ks_distances(clean, key, "run_id", "beyond")
    per = clean.groupBy(*key, "run_id").agg(F.percentile("gap", F.lit(0.5)).alias("level_gap"), F.percentile("v", F.lit(0.5)).alias("q50"))
    return per.join(ks, [*key, "run_id"], "left").join(spread, key, "left")


def findings(values: DataFrame, top: float, least: float = 0.12, widths: float = 8.0, least_ks: float = 0.5) -> DataFrame:
    """Impossible values and unusual loads: (table_name, run_id, column_name, finding) with finding `type` (no number in any
    notation), `range` (outside 0..top) or `shift` (the curve of the load's distances from its neighbours' level is at least `least_ks`
    away from that of the other loads, beyond the usual scatter of `least` and `widths`). Null values are no findings."""
    number = number_of(F.col("text"))
    bad = F.when(number.isNull(), "type").when(~number.between(0, top), "range")
    single = values.filter(F.col("text").isNotNull()).withColumn("finding", bad).filter(F.col("finding").isNotNull()).select("table_name", "run_id", "column_name", "finding")
    far = load_profile(values, top, least=least, widths=widths).filter(F.col("ks") >= least_ks)
    return single.union(far.select("table_name", "run_id", "column_name", F.lit("shift"))).distinct()
