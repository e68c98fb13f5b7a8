"""Sessions and the shared folder in which iterative operators write their intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "brindle") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's executors, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(here):
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle"), "zip", os.path.dirname(here), "brindle"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark's setting that a query's shuffled files are removed when it ends.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Written tables that cut lineage: they outlive lost executors, and each is dropped once no later step reads it.

    Of a tidy one, what was shuffled for a table is removed as soon as that is written; else when the driver collects garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        ship(spark)
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.kept: dict[str, str] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = os.path.join(self.root, name)
        was = self.spark.conf.get(_REMOVED, None)
        if self.tidy:
            self.spark.conf.set(_REMOVED, "true")
        try:
            df.write.mode("overwrite").parquet(at)
        finally:
            if self.tidy:
                self.spark.conf.set(_REMOVED, was) if was is not None else self.spark.conf.unset(_REMOVED)
        self.kept[name] = at
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.kept.pop(name, None)
            if at:
                self._fs.delete(self._path(at), True)
