"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larder")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LARDER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan one table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="larder-code-")) / "larder.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run on the driver's machine, so that a folder of that machine can be seen by all of them."""
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoint() and `cut`: the cluster's spark.checkpoint.dir. Only where it is unset on one machine (tests) a new
    temporary one is made; a cluster without the setting raises, as its machines would each write to a disk of their own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not shared and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="larder-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as a Parquet table to the shared checkpoint folder and read it back.

    The table survives the loss of executors, is compressed and can be pruned by column. `done` are tables made by `cut` that
    nothing reads any more, such as those of the round before; they are deleted at once, all others when the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/larder-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    for old in done:
        drop_cut(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._larder_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table of a frame that `cut` gave; other frames are left alone."""
    path = getattr(df, "_larder_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove((df.sparkSession, path))
        df._larder_path = None


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to: it does so after a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # a session that is gone leaves its tables to the folder's owner
            _delete(spark, path)
