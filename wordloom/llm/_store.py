"""Tables written between the phases of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent, a folder of this process serves on a local master (tests); on
    a cluster that would lose tables with their machine, so it is an error there.
    """
    named = spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="wordloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


class Workspace:
    """Written tables of one job; `drop` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
        self._count = 0
        self._rooted = False

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the written table: its lineage is cut, a lost executor costs nothing."""
        self._count += 1
        path = f"{self.root}/{self._count}-{name}"
        if not self._rooted:
            self._rooted = True
            _delete_on_exit(self.spark, self.root)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._wordloom_path = path  # type: ignore[attr-defined]
        return read

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_wordloom_path", None)
        if path:
            _path(self.spark, path, lambda fs, p: fs.delete(p, True))


def _path(spark: SparkSession, path: str, act) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    act(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
