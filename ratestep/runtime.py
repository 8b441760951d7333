"""Session helpers: the shared scratch folder, cut lineage, worker import path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when they see the driver's folders; clusters ship it with --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs on this machine alone, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="ratestep-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


class Scratch:
    """Written tables in the shared folder, used to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_importable(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a frame that reads the written table."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if (path := getattr(df, "_scratch_path", None)) is not None:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 2048, megabytes: int = 8) -> None:
    """Arrow batches of few bytes, so that a batch of long texts stays small; read when a plan is run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
