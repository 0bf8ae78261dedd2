"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}

#: Codec of written tables: texts, and hashes spelled as hexadecimal digits, take about half of what they do by default.
CODEC = "zstd"

_shipped: set[str] = set()
_written: set[str] = set()


def build_session(app: str = "parcelwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster may override any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, so that functions pickled by module name load anywhere.

    Not needed where the package is installed on all machines. Once per application.
    """
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="parcelwise-"), "parcelwise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when set.

    Only a local master may fall back to a temporary folder, because there the
    driver and the executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return str(named).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="parcelwise-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, even: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where a result is read several times or a loop grows the lineage: a lost
    executor then costs a re-read, not a re-run, and every reader sees the same rows.
    ``even`` rebalances the rows first, for results that come out of a skewed step. A table with a ``path`` is not scratch: it
    stays where it is.
    """
    if even:
        df = df.hint("rebalance")
    spark = df.sparkSession
    where = path or f"{shared_dir(spark)}/parcelwise-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", CODEC).parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    if path is None:
        out.scratch_path = where
        register_scratch(where)
    return out


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove what is materialized inside, except the tables that are put on the list, and let shuffle files go."""
    before, kept = set(_written), []
    yield kept
    for path in _written - before - {df.__dict__.get("scratch_path") for df in kept}:
        remove_scratch(spark, path)
    free_shuffles(spark)


def register_scratch(path: str) -> None:
    """Have ``clear_scratch`` remove what lies at ``path``."""
    _written.add(path)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a registered path now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Remove the table behind a ``materialize`` result that nothing reads any more."""
    if path := df.__dict__.get("scratch_path"):
        remove_scratch(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, before a step that needs the disk."""
    gc.collect()
    spark._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table that was written or registered in this process; call it once results are saved."""
    for path in sorted(_written):
        remove_scratch(spark, path)
