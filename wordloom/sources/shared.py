"""Tables between the phases of a query, in the folder that all executors share (spark.checkpoint.dir).

A written table is computed once, cuts the lineage and outlives the executors that made it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_roots: dict[str, str] = {}
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. Where the setting is absent, a local master (tests) gets a folder of its own; on a cluster that is an error."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        named = spark.conf.get(_KEY, None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"set {_KEY} to a folder that all executors share")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="wordloom-core-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            named = "file://" + _own[0]
        _roots[app] = f"{named.rstrip('/')}/wordloom-core-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[app])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _roots[app]


def write(df: DataFrame, name: str = "t") -> str:
    """Write df and return where, for `batches`."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df and return the written table."""
    return read(df, write(df, name))


def read(df: DataFrame, path: str) -> DataFrame:
    """What `write` has written of df."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dataset(path: str):
    from pyarrow import dataset, fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, at = fs.FileSystem.from_uri(path)
    return dataset.dataset(at, format="parquet", filesystem=system)


def files(path: str, shares: list[int] | None = None, of: int = 1) -> Iterator[pa.Table]:
    """The table that `write` has written, in a Python worker: one file after the other; each has one partition of the table, in its order. With `shares` only those files whose number, modulo `of`, is among them."""
    for i, fragment in enumerate(sorted(_dataset(path).get_fragments(), key=lambda f: f.path)):
        if shares is not None and i % of not in shares:
            continue
        table = fragment.to_table(use_threads=False)
        if table.num_rows:
            yield table


def batches(path: str, rows: int) -> Iterator[pa.Table]:
    """The table that `write` has written, in a Python worker: in pieces of about `rows` rows, of which few are held at once."""
    held: list[pa.RecordBatch] = []
    for b in _dataset(path).to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False):
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)
