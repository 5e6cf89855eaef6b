"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of cut tables by scope; "" holds the temporary folder of a local master.
_KEPT: dict[str, list[str]] = {}
_SCOPE = ["other"]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "" not in _KEPT:
        _KEPT[""] = [tempfile.mkdtemp(prefix="evidencelake-")]
    return f"file://{_KEPT[''][0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/evidencelake-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    _KEPT.setdefault(_SCOPE[0], []).append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a cut table that nothing will read again."""
    files = df.inputFiles()
    for folders in _KEPT.values():
        gone = [f for f in folders if files and f"/{f.rsplit('/', 1)[-1]}/" in files[0]]
        _delete(df.sparkSession, gone)
        folders[:] = [f for f in folders if f not in gone]


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Cut tables belong to ``name`` here; those that an earlier use of the name has left are deleted first.

    For steps whose results are written before the next step begins.
    """
    _delete(spark, _KEPT.pop(name, []))
    before, _SCOPE[0] = _SCOPE[0], name
    try:
        yield
    finally:
        _SCOPE[0] = before
