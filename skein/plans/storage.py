"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made by ``new_folder`` and not yet deleted, in order, and those of written tables by their files' name.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where the session has none, a local master (plain
    tests) gets a temporary one; on a cluster that is an error, as executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is deleted when the application ends, if not before."""
    path = f"{shared_folder(spark)}/skein/{label}-{uuid.uuid4().hex}"
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    _made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: later steps do not compute it anew, and it survives the
    loss of any executor."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.skein_path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
        at, files = _files(spark, path)
        files.delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at the end all folders made within, but for the tables put into the list that this gives.
    What is built on the others must have been written by then."""
    before, keep = set(_made), []
    yield keep
    held = {df.skein_path for df in keep}
    for path in [p for p in _made if p not in before and p not in held]:
        _delete(spark, path)
