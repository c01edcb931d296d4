"""Session helpers: a default session, the shared folder and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "loomgraph", **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


_written: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that :func:`materialize` wrote in this process, once the results that read them are stored; their number."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


class Lazy:
    """A value that is built at first use and again after :meth:`reload`, for an index that many questions share."""

    def __init__(self, build: Callable[[], Any]) -> None:
        self._build, self._value = build, None

    def get(self) -> Any:
        if self._value is None:
            self._value = self._build()
        return self._value

    def reload(self) -> Any:
        self._value = None
        return self.get()


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. ``by`` names columns of few values that readers filter by."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    _written.append(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: plans, broadcasts and shuffle files of many small jobs else stay until its heap is full, which then does not shrink."""
    gc.collect()  # holds the JVM's objects
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
