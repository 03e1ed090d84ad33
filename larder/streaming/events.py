"""Structured Streaming over event files or topics: demultiplexing, idempotent sinks, cursors, windows and sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_time(c: Column) -> Column:
    """Timestamp of ISO text or epoch seconds; now if neither."""
    return F.coalesce(c.cast("string").try_cast("timestamp"), F.timestamp_seconds(c.cast("string").try_cast("double")), F.current_timestamp())


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def topic_stream(spark: SparkSession, servers: str, topic: str, schema: str, most: int = 100_000) -> DataFrame:
    """Stream of the JSON messages of a topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def _append_new(batch: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Append the rows of a batch whose key the table lacks; of equal keys in the batch the first by `order`."""
    spark = batch.sparkSession
    fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
    try:
        there = spark.read.parquet(path).select(*keys)
        fresh = fresh.join(there, list(keys), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    fresh.select(*batch.columns).write.mode("append").parquet(path)


def idempotent_sink(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink where the first write of a key wins, also when a batch is written again after a failure."""
    return lambda batch, _: _append_new(batch, path, keys, order)


def demux_sink(root: str, routes: dict[str, Sequence[str]], kind: str, keys: dict[str, Sequence[str]], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that sends each kind of event to the table of its route, first write wins; unknown kinds are dropped."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for table, kinds in routes.items():
                _append_new(batch.filter(F.col(kind).isin(*kinds)), f"{root}/{table}", keys[table], order)
        finally:
            batch.unpersist()

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, then stop; a later run goes on behind it."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> None:
    """Write all that is there to files, exactly once."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(events: DataFrame, ts: str, keys: Sequence[str], width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Events per tumbling window and key, with the sum of `value`; events later than `late` behind the latest are dropped in a stream."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.round(F.sum(value), 4).alias("total")] if value else [])
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), *keys, *[a for a in ("n", "total") if a == "n" or value])


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: runs of events with no pause of `gap` or more."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def cursor_page(df: DataFrame, cursor: int, size: int = 200, key: str = "id") -> tuple[DataFrame, int]:
    """The next page behind a cursor in key order, and the new cursor (the old one if nothing is left)."""
    page = df.filter(F.col(key) > cursor).orderBy(key).limit(size)
    last = page.agg(F.max(key)).first()[0]
    return page, cursor if last is None else last


def advance_marks(marks: DataFrame, seen: DataFrame, by: Sequence[str] = ("layer", "source"), value: str = "date") -> DataFrame:
    """High-water marks of each layer and source after new partitions were seen; they never go back."""
    return marks.unionByName(seen).groupBy(*by).agg(F.max(value).alias(value))


def beyond_marks(df: DataFrame, marks: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows beyond the mark of their key, in text order; keys without a mark are all new."""
    m = marks.select(*by, F.col(value).alias("_mark"))
    return df.join(m, list(by), "left").filter(F.col("_mark").isNull() | (F.col(value) > F.col("_mark"))).drop("_mark")
