"""Readers of delimited files, JSON lines and partitioned Parquet."""

from __future__ import annotations

import fnmatch
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.text import NA_TEXTS, null_texts
from larder.operators.joins import first_per_key


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> list[str]:
    """Files of a folder of any Hadoop file system whose base name has the pattern, sorted."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out, it = [], fs.listFiles(root, recursive)
    while it.hasNext():
        p = it.next().getPath()
        if fnmatch.fnmatch(p.getName(), pattern):
            out.append(p.toString())
    return sorted(out)


def head_text(spark: SparkSession, path: str, size: int = 8192) -> str:
    """First bytes of a file as text."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(size)).decode("utf-8", errors="replace")
    finally:
        stream.close()


def sniff_delimiter(text: str) -> str:
    """The delimiter among comma, tab and bar that cuts the first lines most evenly; else tab or comma by count."""
    lines = [line for line in text.splitlines()[:20] if line.strip()]
    best, width = None, 0
    for d in (",", "\t", "|"):
        n = [line.count(d) for line in lines]
        if n and min(n) > 0 and len(set(n)) == 1 and n[0] > width:
            best, width = d, n[0]
    return best or ("\t" if text.count("\t") > text.count(",") else ",")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", na_texts: Sequence[str] = NA_TEXTS, infer: bool = False, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header; malformed lines are dropped and texts that stand for a missing value are null. Columns are
    strings; with `infer` those whose values are all numbers become bigint or double. `multi_line` is for values with line
    breaks; such a file is read by one task, others are split."""
    sep = delimiter or sniff_delimiter(head_text(spark, path))
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, mode="DROPMALFORMED", multiLine=multi_line, escape='"')
    df = df.select(*[null_texts(F.col(f"`{c}`"), tuple(na_texts)).alias(c) for c in df.columns])
    return infer_types(df) if infer else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers or numbers get that type; one aggregation for all columns."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    bad = lambda c, t: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
    row = df.agg(*[x for i, c in enumerate(texts) for x in (bad(c, "bigint").alias(f"i{i}"), bad(c, "double").alias(f"d{i}"), F.count(c).alias(f"n{i}"))]).first()
    kind = {c: "bigint" if row[f"n{i}"] and not row[f"i{i}"] else "double" if row[f"n{i}"] and not row[f"d{i}"] else None for i, c in enumerate(texts)}
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kind.items() if k})


def chunk_count(df: DataFrame, size: int = 10_000) -> int:
    """Number of chunks of a size."""
    return -(-df.count() // size)


def read_jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl", schema: T.StructType | str | None = None, run_id: str | None = None, source: str | None = None) -> DataFrame:
    """JSON lines of a folder; blank and malformed lines are dropped, nested values kept as JSON text, and each row has its
    `_bronze_file`, `_source` and `_pipeline_run_id`. Without files it raises FileNotFoundError."""
    files = list_files(spark, path, pattern, recursive=True)
    if not files:
        raise FileNotFoundError(f"{path}/{pattern}")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    df = (reader.schema(schema) if schema else reader).json(path, mode="DROPMALFORMED")
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*flat, F.col("_metadata.file_path").alias("_bronze_file"), F.lit(source).alias("_source"), F.lit(run_id).alias("_pipeline_run_id"))


def read_sample(spark: SparkSession, path: str, n: int = 5000, pattern: str = "*.jsonl") -> DataFrame:
    """The first n rows of the first file (a sample for its schema)."""
    files = list_files(spark, path, pattern, recursive=True)
    if not files:
        raise FileNotFoundError(f"{path}/{pattern}")
    return spark.read.json(files[0]).limit(n)


def partition_of(file: Column) -> Column:
    """`YYYY/MM/DD` of a path, null without one."""
    m = F.regexp_extract(file, r"/(\d{4}/\d{2}/\d{2})(?:/|$)", 1)
    return F.when(m != "", m)


def partitions(paths: Sequence[str]) -> dict[str, list[str]]:
    """Dates of each source in paths `root/source/YYYY/MM/DD/...`."""
    out: dict[str, set[str]] = {}
    for p in paths:
        if m := re.search(r"([^/]+)/(\d{4}/\d{2}/\d{2})/", p):
            out.setdefault(m.group(1), set()).add(m.group(2))
    return {s: sorted(d) for s, d in sorted(out.items())}


def read_silver(spark: SparkSession, root: str, source: str, date: str | None = None, required: Sequence[str] = ("product_name",), expected: Sequence[str] = (), pattern: str = "part[_-]*.parquet") -> DataFrame:
    """Parquet of a source and date, as `write_silver` or other writers name its files; without files of that date its latest one is
    taken. Absent required columns raise, absent expected ones are warned of."""
    found = partitions(list_files(spark, f"{root}/{source}", pattern, recursive=True))
    dates = sorted({d for ds in found.values() for d in ds})
    if not dates:
        raise FileNotFoundError(f"{root}/{source}")
    day = date if date in dates else dates[-1]
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", pattern).parquet(f"{root}/{source}/{day}")
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"{source}/{day} lacks {', '.join(lacking)}")
    if lacking := [c for c in expected if c not in df.columns]:
        warnings.warn(f"{source}/{day} lacks {', '.join(lacking)}", stacklevel=2)
    return df


def read_gold(spark: SparkSession, path: str, sources: Sequence[str]) -> DataFrame:
    """Gold rows of some sources; none at all raises."""
    df = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col("source_name").isin(*sources))
    if df.limit(1).count() == 0:
        raise ValueError(f"no rows of {', '.join(sources)} in {path}")
    return df


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The last log of each run over all log files, timestamps parsed, in order of time. A line is a log; with `multi_line` a file is."""
    df = spark.read.option("recursiveFileLookup", "true").json(path, mode="DROPMALFORMED", multiLine=multi_line).withColumn("_file", F.col("_metadata.file_path"))
    return first_per_key(df, ["run_id"], [F.desc("_file")]).drop("_file").withColumn("timestamp", F.col("timestamp").try_cast("timestamp")).orderBy("timestamp")


def compare_schemas(frames: dict[str, DataFrame]) -> dict:
    """Columns, nested columns of each frame, and the columns that each pair has in common."""
    names = sorted(frames)
    nested = {n: [c for c, t in frames[n].dtypes if t.startswith(("struct", "array", "map"))] for n in names}
    common = {(a, b): sorted(set(frames[a].columns) & set(frames[b].columns)) for i, a in enumerate(names) for b in names[i + 1 :]}
    return {"columns": {n: frames[n].columns for n in names}, "nested": nested, "common": common}


def row_audit(spark: SparkSession, bronze: str, silver: str, quarantine: str | None = None) -> DataFrame:
    """Rows per date of the three layers, what was dropped and its share."""
    from larder.operators.observe import backfill_gap

    lines = spark.read.option("recursiveFileLookup", "true").text(bronze).filter(F.trim("value") != "").select(partition_of(F.col("_metadata.file_path")).alias("date"))
    parquet = lambda p: spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(p).select(partition_of(F.col("_metadata.file_path")).alias("date"))
    empty = spark.createDataFrame([], "date string")
    return backfill_gap(lines, parquet(silver), parquet(quarantine) if quarantine else empty, ["date"])


def newer_than(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows beyond a high-water mark in text order; all without a mark."""
    return df if mark is None else df.filter(F.col(column).cast("string") > mark)
