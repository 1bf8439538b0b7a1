"""Captures as a stream: the fold in micro-batches, at least once, with the same result as in one batch."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leadwright.operators.fold import accepted, accumulated, merged, told
from leadwright.policy import SCORE_WEIGHTS
from leadwright.sources.shared import get_text, listed, put_text


class LeadStore:
    """Folded leads under one folder, in buckets by address, of which a batch rewrites those that it touches.

    A bucket holds the accumulators of its addresses (fold.accumulated). A batch reads the touched buckets as they stood
    before it, merges its own captures in, and writes them under its own number; then it writes the manifest of which
    batch's files each bucket is in. A batch that is delivered again after a failure starts from the same manifest and
    overwrites its own files, so it counts once. Rejects lie beside, by batch.
    """

    def __init__(self, spark: SparkSession, path: str, captures: StructType, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.parts = accumulated(spark.createDataFrame([], captures)).schema

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch whose files each bucket is in, by the newest manifest that is whole (of a batch before the given one)."""
        done = [int(p.rsplit("=", 1)[1]) for p in listed(self.spark, f"{self.path}/manifest/batch=*") if p.rsplit("=", 1)[1].isdigit()]
        done = [b for b in done if before is None or b < before]
        told = json.loads(get_text(self.spark, f"{self.path}/manifest/batch={max(done)}")) if done else {}
        return {int(bucket): batch for bucket, batch in told.items()}

    def state(self, where: dict[int, int]) -> DataFrame | None:
        """The accumulators of the buckets of a manifest."""
        paths = [f"{self.path}/state/batch={batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
        return self.spark.read.schema(self.parts).parquet(*paths) if paths else None

    def save(self, batch: DataFrame, batch_id: int) -> None:
        good, bad = accepted(batch)
        bad.write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch_id}")
        bucket = F.pmod(F.xxhash64("email"), F.lit(self.buckets)).cast("int").alias("bucket")
        parts = accumulated(good).persist()  # a lost executor's part is made again from the batch
        try:
            self._merge(parts, bucket, batch_id)
        finally:
            parts.unpersist()

    def _merge(self, parts: DataFrame, bucket: Column, batch_id: int) -> None:
        touched = [r["bucket"] for r in parts.select(bucket).distinct().collect()]  # at most the number of buckets
        if not touched and batch_id:
            return
        stood = self.manifest(batch_id)
        old = self.state({b: stood[b] for b in touched if b in stood})
        whole = merged(parts if old is None else parts.unionByName(old)).select("*", bucket)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/batch={batch_id}")
        put_text(self.spark, f"{self.path}/manifest/batch={batch_id}", json.dumps(stood | dict.fromkeys(touched, batch_id)))

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejects")

    def leads(self, weights: Mapping[str, int] = SCORE_WEIGHTS) -> DataFrame:
        """All leads, as one fold of all captures gives them."""
        return told(found if (found := self.state(self.manifest())) is not None else self.spark.createDataFrame([], self.parts), weights)


def capture_stream(source: DataFrame, store: LeadStore, checkpoint: str) -> StreamingQuery:
    """Run a streaming source of captures into the store until all that is there is taken; the next run starts where this one ended."""
    return source.writeStream.foreachBatch(store.save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_as_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 8) -> DataFrame:
    """Parquet files as a stream; `per_trigger` files a batch hold back a burst."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def quiet_sessions(events: DataFrame, key: str, at: str, gap_s: int = 150, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, beats) of runs of events without a gap longer than gap_s, on a stream or a table. On a stream a session comes out when the watermark passes its end."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    window = F.session_window("_at", f"{gap_s} seconds")
    return timed.groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("beats")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats")
