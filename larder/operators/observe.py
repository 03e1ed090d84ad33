"""Run logs and events: queries, summaries, anomaly detection."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Share of anomalies, trees, seed, least number of runs and score of a signal.
CONTAMINATION, TREES, SEED, MIN_RUNS, Z = 0.15, 100, 42, 5, 2.0


def latest_logs(df: DataFrame, key: str = "run_id", order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """The last log of each run."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("_i = 1").drop("_i")


def filter_runs(df: DataFrame, source: str | None = None, status: str | None = None, since: str | None = None, order: str = "started_at", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Runs that meet all filters, the latest first; `limit` and `offset` page the list."""
    if source:
        df = df.filter(F.col("source") == source)
    if status:
        df = df.filter(F.col("status") == status)
    if since:
        df = df.filter(F.col(order) >= since)
    df = df.orderBy(F.desc(order), "run_id")
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def run_summary(df: DataFrame) -> DataFrame:
    """One row: runs, completed and failed ones, mean delta, distinct sources."""
    return df.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg("dq_delta"), 6).alias("mean_delta"), F.count_distinct("source").alias("sources"),
    )


def source_summary(df: DataFrame) -> DataFrame:
    """Per source: runs, rows, mean scores, the best and the worst delta, quarantine share."""
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.round(F.avg("dq_score_pre"), 6).alias("mean_pre"), F.round(F.avg("dq_score_post"), 6).alias("mean_post"),
        F.max("dq_delta").alias("best_delta"), F.min("dq_delta").alias("worst_delta"), F.round(F.sum("rows_quarantined") / F.nullif(F.sum("rows_in"), F.lit(0)), 6).alias("quarantine_share"),
    )


def recent_runs(df: DataFrame, n: int, order: str = "started_at") -> DataFrame:
    """The n latest runs of each source, with their place."""
    return df.withColumn("recent", F.row_number().over(W.partitionBy("source").orderBy(F.desc(order), "run_id"))).filter(F.col("recent") <= n)


def run_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (source, run_id, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select("source", "run_id", F.explode(pairs).alias("p")).select("source", "run_id", "p.*").filter("value is not null")


def pivot_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per run with a column per metric; a run lacks what it never reported."""
    return metrics.groupBy("run_id").pivot("metric", list(names)).agg(F.max("value"))


def block_trace(df: DataFrame, run_id: str | None = None, source: str | None = None) -> DataFrame:
    """Events of a run or source in time order."""
    if run_id:
        df = df.filter(F.col("run_id") == run_id)
    if source:
        df = df.filter(F.col("source") == source)
    return df.orderBy("ts", "id")


def block_durations(df: DataFrame) -> DataFrame:
    """Per block: ends, mean and greatest duration, rows dropped; repeated events of one block and run count once."""
    once = df.filter("event_type = 'block_end'").groupBy("run_id", "block_name").agg(F.max("duration_ms").alias("duration_ms"), F.max("rows_in").alias("rows_in"), F.max("rows_out").alias("rows_out"))
    return once.groupBy("block_name").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.sum(F.col("rows_in") - F.col("rows_out")).alias("dropped"))


def source_stats(metrics: DataFrame) -> DataFrame:
    """(source, metric, by_run): a map of the values by run."""
    return metrics.groupBy("source", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run_id", "value")))).alias("by_run"))


def feature_matrix(metrics: DataFrame, names: Sequence[str], last: int | None = None) -> DataFrame:
    """Runs with all metrics, absent values as the mean of the column (0 if it has none); the `last` runs by id."""
    wide = pivot_metrics(metrics, names)
    if last:
        wide = wide.orderBy(F.desc("run_id")).limit(last)
    means = wide.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_{c}") for c in names])
    return wide.crossJoin(F.broadcast(means)).select("run_id", *[F.coalesce(c, f"_{c}").alias(c) for c in names])  # one row


def z_signals(matrix: DataFrame, names: Sequence[str], limit: float = Z) -> DataFrame:
    """(run_id, signal, value, z) for every value more than `limit` population deviations from the mean."""
    stats = matrix.agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names])
    wide = matrix.crossJoin(F.broadcast(stats))  # one row
    rows = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("value"), ((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9)).alias("z")) for c in names])
    return wide.select("run_id", F.explode(rows).alias("p")).select("run_id", "p.*").filter(F.abs("z") > limit)


def _path_length(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def forest_scores(x: np.ndarray, trees: int = TREES, seed: int = SEED, size: int = 256) -> np.ndarray:
    """Isolation forest scores (higher is stranger): 2 to the minus mean depth over the expected depth."""
    rng = np.random.default_rng(seed)
    n = len(x)
    m = min(size, n)
    most = int(np.ceil(np.log2(max(m, 2))))
    depth = np.zeros(n)

    def grow(sample: np.ndarray, rows: np.ndarray, level: int) -> None:
        if not len(rows):
            return
        spread = sample.max(0) - sample.min(0) if len(sample) else np.zeros(x.shape[1])
        open_features = np.flatnonzero(spread > 0)
        if level >= most or len(sample) <= 1 or not len(open_features):
            depth[rows] += level + _path_length(len(sample))
            return
        f = rng.choice(open_features)
        at = rng.uniform(sample[:, f].min(), sample[:, f].max())
        low = x[rows, f] < at
        grow(sample[sample[:, f] < at], rows[low], level + 1)
        grow(sample[sample[:, f] >= at], rows[~low], level + 1)

    for _ in range(trees):
        grow(x[rng.choice(n, m, replace=False)], np.arange(n), 0)
    return 2 ** (-(depth / trees) / max(_path_length(m), 1e-9))


def forest_anomalies(matrix: DataFrame, group: str, names: Sequence[str], contamination: float = CONTAMINATION) -> DataFrame:
    """(group, run_id, score, anomaly) per group of runs (a source); the share `contamination` of highest scores are anomalies.
    A group of fewer than five runs gives no rows. A group is one row per run of a source, so it fits a task."""
    kind = dict(matrix.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < MIN_RUNS:
            return pd.DataFrame({group: [], "run_id": [], "score": [], "anomaly": []})
        pdf = pdf.sort_values("run_id")
        x = pdf[list(names)].astype(float)
        x = x.fillna(x.mean()).fillna(0.0).to_numpy()
        std = x.std(0)
        s = forest_scores((x - x.mean(0)) / np.where(std > 0, std, 1))
        cut_at = np.quantile(s, 1 - contamination)
        return pd.DataFrame({group: pdf[group].to_numpy(), "run_id": pdf["run_id"].to_numpy(), "score": s, "anomaly": s > cut_at})

    return matrix.groupBy(group).applyInPandas(run, f"{group} {kind}, run_id string, score double, anomaly boolean")


def label_signals(anomalies: DataFrame, signals: DataFrame) -> DataFrame:
    """Anomalous runs with their strongest signals, `general_outlier` where no single value stands out."""
    names = signals.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ", ").alias("signals"))
    return anomalies.filter("anomaly").join(names, "run_id", "left").withColumn("signals", F.coalesce("signals", F.lit("general_outlier")))


def event_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with `event_text`: "name: value" of the columns that are not null."""
    return df.withColumn("event_text", F.concat_ws("; ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]))


def question_scope(question: str, sources: Sequence[str]) -> dict:
    """What a question about runs is about: a run id, sources to compare, one source, the last n runs, or the recent ones."""
    q = question.lower()
    if m := re.search(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", q):
        return {"kind": "run", "run_id": m.group()}
    named = [s for s in sources if s.lower() in q]
    if len(named) > 1 or ("compare" in q and named):
        return {"kind": "compare", "sources": named}
    if named:
        return {"kind": "source", "source": named[0]}
    if m := re.search(r"last (\d+)", q):
        return {"kind": "last", "n": int(m.group(1))}
    return {"kind": "recent"}


def backfill_gap(bronze: DataFrame, silver: DataFrame, quarantine: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows per key in three layers and what was dropped between them, with its share in percent."""
    c = lambda d, n: d.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    j = c(bronze, "bronze").join(c(silver, "silver"), list(key), "full").join(c(quarantine, "quarantine"), list(key), "full").fillna(0, ["bronze", "silver", "quarantine"])
    dropped = F.col("bronze") - F.col("silver") - F.col("quarantine")
    return j.withColumns({"dropped": dropped, "drop_percent": F.round(100.0 * dropped / F.nullif(F.col("bronze"), F.lit(0)), 4)})


def list_runs(df: DataFrame) -> DataFrame:
    """The last export of every run."""
    return latest_logs(df.filter("run_id is not null"), "run_id", ("updated_at", "started_at"))


def cost_report(df: DataFrame, calls: str, price: float = 0.0004) -> DataFrame:
    """Per source: rows, runs and what its classifier calls cost."""
    return df.filter("source is not null").groupBy("source").agg(F.sum("rows_in").alias("rows_in"), F.count(F.lit(1)).alias("runs"), F.round(F.sum(calls) * price, 6).alias("cost_usd"))


def trace_by_run(df: DataFrame) -> DataFrame:
    """Per run and source: first event, events, blocks and the best score."""
    return df.groupBy("run_id", "source").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events"), F.count_distinct("block_name").alias("blocks"), F.max("dq_score").alias("best_score"))


def cluster_rows(df: DataFrame) -> DataFrame:
    """Clusters with `n_members`, null for an unreadable list."""
    return df.withColumn("n_members", F.json_array_length("members").cast("long"))


def quarantine_rows(df: DataFrame, row_id: str, required: Sequence[str]) -> DataFrame:
    """(row_id, row_hash, reason) of rows that lack required fields; the hash is of those fields."""
    lacking = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    row_hash = F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in required]))
    return df.select(row_id, row_hash.alias("row_hash"), lacking.alias("_l")).filter("_l <> ''").select(row_id, "row_hash", F.concat(F.lit("Null in required field(s): "), F.col("_l")).alias("reason"))


def gold_log(df: DataFrame) -> DataFrame:
    """Runs, rows and mean scores per source, rounded to four places."""
    a, b = F.avg("dq_score_pre"), F.avg("dq_score_post")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.round(a, 4).alias("dq_score_pre"), F.round(b, 4).alias("dq_score_post"), F.round(b - a, 4).alias("dq_delta"))
