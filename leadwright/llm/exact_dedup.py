"""Exact duplicates through a log-structured merge index of content digests."""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leadwright.llm.common import SPACE, delete, glob, new_path, written
from leadwright.llm.url_filter import BlockedBloom


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """A log-structured merge index (digest -> smallest id, number of rows), kept as Parquet under one folder.

    flush() appends a run of level 0: each task's rows (its memtable) sorted by digest. A level with `fanout` runs is
    merged by compact() into one run of the next level, with one row for each digest and its smallest id. Every run has a
    blocked Bloom filter beside it, sized by its rows, which lookups ask first. Which runs are live stands in numbered
    manifests, and the newest one that is complete holds: a reader sees all of a change or nothing of it, and a task or
    driver that is lost leaves only a folder that no manifest names. Runs that a compaction replaced are deleted by the
    next one, so that whoever reads the manifest before can finish.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "digest-index"), fanout

    def manifest(self) -> tuple[int, list[Row]]:
        """The newest manifest's number and rows (run, level, rows, live)."""
        found = [int(re.search(r"manifest-(\d+)/", p)[1]) for p in glob(self.spark, f"{self.path}/manifest-*/_SUCCESS")]
        if not found:
            return 0, []
        return max(found), self.spark.read.parquet(f"{self.path}/manifest-{max(found)}").collect()  # a row a run

    def _switch(self, number: int, runs: list[tuple[str, int, int, bool]]) -> None:
        self.spark.createDataFrame(runs, "run string, level int, rows long, live boolean").coalesce(1).write.parquet(f"{self.path}/manifest-{number + 1}")

    def live(self) -> list[Row]:
        return [r for r in self.manifest()[1] if r.live]

    def run(self, name: str) -> DataFrame:
        """Rows (digest, keep_id, group_size) of one run; a digest of level 0 may have several."""
        return self.spark.read.parquet(f"{self.path}/{name}/rows")

    def _write(self, rows: DataFrame, level: int) -> tuple[str, int, int, bool]:
        name = f"level{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}/rows")
        n = self.run(name).count()
        BlockedBloom(self.run(name), "digest", self._blocks(n)).blocks.write.parquet(f"{self.path}/{name}/filter")
        return name, level, n, True

    @staticmethod
    def _blocks(rows: int) -> int:
        """Blocks of 512 bits, so that a row has 16 bits."""
        return max(1, rows * 16 // 512)

    def flush(self, rows: DataFrame) -> None:
        """Append a run of rows (digest, id)."""
        number, runs = self.manifest()
        made = self._write(rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), 0)
        self._switch(number, [*map(tuple, runs), made])

    def _merge(self, names: list[str]) -> DataFrame:
        rows = functools.reduce(DataFrame.union, map(self.run, names))
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def compact(self, whole: bool = False) -> None:
        """Merge each level that has `fanout` runs into a run of the next; whole: all runs into one."""
        number, runs = self.manifest()
        for old in (r for r in runs if not r.live):
            delete(self.spark, f"{self.path}/{old.run}")
        live = [tuple(r) for r in runs if r.live]
        gone: list[tuple] = []
        level = 0
        while level <= max((r[1] for r in live), default=-1):
            here = live if whole else [r for r in live if r[1] == level]
            if len(here) >= self.fanout or whole and (len(here) > 1 or here[0][1] == 0):
                made = self._write(self._merge([r[0] for r in here]), 1 + max(r[1] for r in here))
                live = [r for r in live if r not in here] + [made]
                gone += [(*r[:3], False) for r in here]
            level = max(r[1] for r in live) + 1 if whole else level + 1
        if gone:
            self._switch(number, live + gone)

    def merged(self) -> DataFrame:
        """One row (digest, keep_id, group_size) for each digest of all live runs."""
        live = self.live()
        return self.run(live[0].run) if len(live) == 1 and live[0].level else self._merge([r.run for r in live])

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, keep_id, group_size) for the digests of `rows` that the index holds: each run is joined only with those that its filter may hold."""
        wanted = rows.select("digest").distinct()
        hits = []
        for r in self.live():
            kept = BlockedBloom.stored(self.spark.read.parquet(f"{self.path}/{r.run}/filter"), self._blocks(r.rows))
            hits.append(self.run(r.run).join(kept.possible(wanted, "digest"), "digest"))
        if not hits:
            return wanted.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).limit(0)
        found = functools.reduce(DataFrame.union, hits)
        return found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def later_duplicates(batch: DataFrame, index: DigestIndex, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """Rows (id, keep_id) of a later batch whose text equals one of the corpus that the index was made of.

    The index proposes the smallest id of a digest, and the bytes of that document are compared with the batch's own.
    Null counts as empty; rows of the corpus without an id are not found; repeated rows are each returned; an empty batch
    or an empty index gives no rows.
    """
    plain = batch.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest("body"))
    proposed = plain.join(index.lookup(plain), "digest").select("id", "body", "keep_id")
    known = corpus.select(F.col(id_col).alias("keep_id"), normalised(F.col(text_col)).alias("known_body")).join(proposed.select("keep_id").distinct(), "keep_id", "left_semi").distinct()
    return proposed.join(known, "keep_id").where("body = known_body").select(F.col("id").alias(id_col), "keep_id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64, n_blocks: int = 1 << 15) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts are equal when they are the same bytes after normalised(). The row with the smallest id of a group stays. The
    index finds the candidates by a 64-bit digest; then the bytes of every hit are compared: hits fold by digest and bytes,
    first in the task that reads them, so that of a group of any size a body a task is shuffled, and a digest with more
    than one body is a collision. Only hits take part: a blocked Bloom filter of the repeated digests lets the others go
    before it. Digests that cover different texts are grouped anew by the bytes themselves.

    Null counts as empty text, and empty texts are equal to each other. Rows that repeat an id with the same text share
    one verdict; rows without an id rank after all others. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest("body"))

    told = written(plain.select("digest", "id", F.sha2("body", 256).alias("text_sha256")), "exact-rows")
    index = DigestIndex(spark)
    index.flush(told)
    index.compact(whole=True)
    merged = index.merged()

    # A digest's hits are the same bytes or more than one body is left of them; equal bodies fold in the task that reads them.
    hits = BlockedBloom(merged.where("group_size > 1").select("digest"), "digest", n_blocks).possible(plain, "digest")
    bodies = hits.select("digest", "body").distinct()
    differing = bodies.groupBy("digest").agg(F.count("*").alias("bodies")).where("bodies > 1").select("digest")
    differing = written(differing, "collided-digests")

    if differing.isEmpty():
        told = told.join(merged, "digest").select("id", "keep_id", "group_size", "text_sha256")
    else:
        alike = told.join(differing, "digest", "left_anti").join(merged, "digest").select("id", "keep_id", "group_size", "text_sha256")
        collided = plain.join(differing, "digest", "left_semi")
        groups = collided.groupBy("body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        told = alike.union(collided.join(groups, "body").select("id", "keep_id", "group_size", F.sha2("body", 256)))
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
