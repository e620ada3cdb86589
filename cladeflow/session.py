"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

T = TypeVar("T")


def get_spark(app: str = "cladeflow", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session gets a folder of its own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cladeflow.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-cladeflow-")
        spark.conf.set("spark.cladeflow.shared.dir", folder)
    return folder.rstrip("/")


_stored: dict[tuple, object] = {}


def stored(name: str, rows: DataFrame, build: Callable[[], T]) -> T:
    """What ``build`` returns for a frame over unchanged files; the application's later calls with the same name and frame get it again."""
    key = (name, rows.sparkSession.sparkContext.applicationId, rows.semanticHash(), tuple(sorted(rows.inputFiles())))
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs only a re-read.

    ``keep`` writes a frame and returns it as a scan, ``drop`` removes a table
    that a later one has replaced. What is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
        self.count = 0
        path, files = self._hadoop(self.root)
        files.deleteOnExit(path)

    def _hadoop(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> str:
        """Writes a frame and returns its path, so that several can be read as one scan."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        return path

    def read(self, schema: StructType, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.write(df)
        out = self.read(df.schema, path)
        self.paths[out] = path
        return out

    def remove(self, *paths: str) -> None:
        for path in paths:
            found, files = self._hadoop(path)
            files.delete(found, True)

    def drop(self, df: DataFrame) -> None:
        """Removes the table of a frame that ``keep`` returned; frames derived from it don't count."""
        self.remove(self.paths.pop(df))
