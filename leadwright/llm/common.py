"""Small helpers that the corpus operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.sources.shared import shared_folder, written

#: White space of the contracts: space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_state() -> dict:
    """A dict of this worker process that stays for its further tasks. Functions travel by value with each, so a module of its own holds it."""
    return vars(sys.modules.setdefault("_leadwright_worker", types.ModuleType("_leadwright_worker")))


#: Bytes of texts that are worked on at once, or one longer text.
GROUP_BYTES = 1 << 20


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about GROUP_BYTES of text, with the bytes of its texts (no nulls) end to end and where each begins, and the end."""
    texts = batch.column(column)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + GROUP_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1].astype(np.int64) - int(offsets[at])
        at = to


#: Rows whose texts a task holds as Python objects at once.
AT_ONCE = 256


def mapped(df: DataFrame, source: str | Column, kinds: dict[str, str], make: Callable[[], Callable[[list], list[pa.Array]]], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) and new ones, computed from the source column in Arrow batches.

    make is called once in a task; what it returns turns a list of the source's values into the new columns' arrays. The
    kept columns pass through as they are, and the function runs once for each row whatever follows. kinds: the new
    columns' names and types; they replace columns of the same names.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in kinds]
    plain = [f"c{i}" for i in range(len(kept))]  # whatever they are called
    new = [f"n{i}" for i in range(len(kinds))]
    there = isinstance(source, str) and source in kept
    of = F.col(f"`{source}`") if isinstance(source, str) else source
    columns = [F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)]
    rows = df.select(*columns) if there else df.select(*columns, of.alias("source"))
    place = kept.index(source) if there else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *work(part.column(place).to_pylist())], names=[*plain, *new])

    schema = ", ".join([f"{p} {df.schema[c].dataType.simpleString()}" for p, c in zip(plain, kept)] + [f"{n} {k}" for n, k in zip(new, kinds.values())])
    return rows.mapInArrow(run, schema).toDF(*kept, *kinds)
