"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set as the checkpoint folder; a temporary one where that is unset and all run on one machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="leadwright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in any file system that Spark reads."""
    files, where = _file_system(spark, pattern)
    found = files.globStatus(where)
    return [f.getPath().toString() for f in found or []]


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not there: written beside its place and moved to it; one of that name is replaced."""
    files, where = _file_system(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}.new")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    files, where = _file_system(spark, path)
    source = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later jobs start from the files, also after a lost executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
