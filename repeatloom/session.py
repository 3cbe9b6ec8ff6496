"""Session, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "repeatloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests, benches and the command line; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus or os.cpu_count() or 8))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The Parquet table `name` of a data folder.

    spread: where its files are so few or small that a scan would leave cores idle, rows are dealt out to as many tasks
    as there are cores, which pays for work on each row that takes longer than moving it.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


#: Bytes on disk that one range of a range-partitioned table has at most, about.
RANGE_BYTES = 64 << 20


def width(spark: SparkSession, size: int = 0, each: int = RANGE_BYTES) -> int:
    """Number of ranges for a table of some bytes on disk: the session's shuffle partitions, or more for a large table."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all tasks are local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{at}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def _located(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for Hadoop's file calls."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Written tables of one operator's run in the shared folder.

    Writing a table there cuts its lineage and survives the loss of executors. Tables that a later step replaces are
    deleted by `drop`; the rest stay, as a result may still read them, until `release` or the end of the program.
    """

    made: list[tuple] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(_located(spark, self.at))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.read(name, schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def size(self, name: str) -> int:
        """Bytes of a written table."""
        path, fs = _located(self.spark, f"{self.at}/{name}")
        return fs.getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = _located(self.spark, f"{self.at}/{name}")
            fs.delete(path, True)

    @classmethod
    def release(cls, since: int = 0) -> None:
        """Deletes the tables of all operators so far, or of those after the first `since`, once their results are written."""
        while len(cls.made) > since:
            path, fs = cls.made.pop()
            try:
                fs.delete(path, True)
            except Py4JError:  # the program's JVM is gone
                cls.made.clear()


atexit.register(Scratch.release)
