"""Writers of the layers; every write is one committed job, so a failed task never leaves half a file behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.joins import first_per_key

GOLD_ROWS = 500_000


def write_silver(df: DataFrame, root: str, source: str, date: str) -> str:
    """Overwrite the partition `source/YYYY/MM/DD`."""
    path = f"{root}/{source}/{date}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("source", "date")) -> None:
    """Overwrite only the partitions that `df` has rows of, one shuffle by partition so that files are few."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def gold_frame(df: DataFrame, source: str, text_columns: Sequence[str] = (), date_columns: Sequence[str] = ()) -> DataFrame:
    """Gold form: `source_name` and `data_source` set, lists as text (empty ones null), dates without zone."""
    out = {"source_name": F.lit(source), "data_source": F.lit(source)}
    for c, t in df.dtypes:
        if t.startswith("array"):
            out[c] = F.when(F.size(c) > 0, F.try_element_at(c, F.lit(1)).cast("string") if c in date_columns else F.to_json(c))
        elif c in text_columns:
            out[c] = F.col(c).cast("string")
    df = df.withColumns(out)
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in date_columns if c in df.columns})


def write_gold(df: DataFrame, path: str, rows_per_file: int = GOLD_ROWS) -> None:
    """Append to the Gold table; new columns widen it (readers merge schemas)."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_with_quarantine(clean: DataFrame, bad: DataFrame, root: str, source: str) -> None:
    """The clean rows as CSV and the quarantined ones as Parquet and CSV beside them."""
    clean.write.mode("overwrite").csv(f"{root}/{source}", header=True)
    bad.write.mode("overwrite").parquet(f"{root}/{source}_quarantine")
    bad.write.mode("overwrite").csv(f"{root}/{source}_quarantine_csv", header=True)


def rebuild_gold(spark: SparkSession, silver_roots: Sequence[str], path: str) -> DataFrame:
    """Gold as the union of all Silver tables, columns by name."""
    out = None
    for r in silver_roots:
        part = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(r)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out.write.mode("overwrite").option("maxRecordsPerFile", GOLD_ROWS).parquet(path)
    return spark.read.parquet(path)


def direct_to_gold(df: DataFrame, names: dict[str, str], key: str, order: str, target: Sequence[str]) -> DataFrame:
    """Bronze rows in Gold form at once: renamed, the first of each key, blank texts null, only the target's columns."""
    df = df.withColumnsRenamed(names)
    df = first_per_key(df, [key], [order])
    df = df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c, t in df.dtypes if t == "string"})
    return df.select(*[c for c in target if c in df.columns])


def write_run_log(df: DataFrame, path: str) -> None:
    """Append run logs as JSON."""
    df.write.mode("append").json(path)


def save_rules(rules: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Rules and graph as tables."""
    for name, df in (("rules", rules), ("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("rules", "nodes", "edges"))
