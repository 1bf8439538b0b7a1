"""The streaming queries over the fixture tables: each runs until all files are taken."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.plans import views as V
from leadwright.sources.shared import shared_folder
from leadwright.streaming.captures import LeadStore, capture_stream, files_as_stream, quiet_sessions
from leadwright.streaming.liveness import lockouts, transitions


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Captures of a file of the stream, about.
FILE = 1 << 17


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """Captures in four batches; a batch's files and the store's buckets, and so the tasks, follow the number of captures."""
    at = folder(spark, "capture-stream")
    rows = V.captures(spark, d)
    files = max(1, -(-rows.count() // (4 * FILE)))
    rows.repartitionByRange(4 * files, "seq").write.parquet(f"{at}/in")
    store = LeadStore(spark, f"{at}/store", rows.schema, 8 * files)
    capture_stream(files_as_stream(spark, f"{at}/in", rows.schema, files), store, f"{at}/progress").awaitTermination()
    return store.leads()


def lead_store_batches(spark: SparkSession, d: str) -> DataFrame:
    """Captures in two batches, most addresses of which are in the first alone, the second delivered twice: the second reads and writes the buckets of its addresses only."""
    at = folder(spark, "lead-store")
    rows = V.captures(spark, d)
    late = F.pmod(F.xxhash64(F.lower("email")), F.lit(16)) == 3
    store = LeadStore(spark, at, rows.schema, 32)
    store.save(rows.where(~late | (F.col("seq") % 2 == 0)), 0)
    for _ in range(2):
        store.save(rows.where(late & (F.col("seq") % 2 == 1)), 1)
    return store.leads()


def _taken(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark: SparkSession, d: str, at: str, least: int) -> DataFrame:
    """Events as one batch; its files follow their number."""
    rows = V.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    files = max(least, -(-rows.count() // FILE))
    rows.repartitionByRange(files, "ts").write.parquet(f"{at}/in")
    return files_as_stream(spark, f"{at}/in", rows.schema, files)


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "session-stream")
    return _taken(quiet_sessions(_events(spark, d, at, 4), "user_id", "ts", 6 * 3600), at)


#: Rows of a bucket of users, about.
BUCKET = 1 << 12


def stream_liveness(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats in one batch; the buckets of jobs follow their number."""
    at = folder(spark, "liveness-stream")
    buckets = max(1, -(-V.table(spark, d, "events").count() // BUCKET))
    beats = _events(spark, d, at, 2).select(F.col("user_id").alias("job_id"), (F.unix_micros("ts") / 1e6).alias("at"))
    return _taken(transitions(beats, 86_400, timers=False, buckets=buckets), at)


def login_lockouts(spark: SparkSession, d: str) -> DataFrame:
    """Logins in three batches, by time: locks of one batch hold in the next. A batch's files and the buckets of users follow the number of logins."""
    at = folder(spark, "lockout-stream")
    rows = V.table(spark, d, "events").where("event_type in ('view', 'error') and user_id is not null")
    rows = rows.select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "view").alias("ok"))
    told = rows.agg(F.count("*").alias("logins"), F.percentile_approx("at", [0.3, 0.6], 100).alias("cuts")).first()
    first, second = told["cuts"] or (0.0, 0.0)
    files, buckets = max(1, -(-told["logins"] // (3 * FILE))), max(1, -(-told["logins"] // BUCKET))
    for part in (F.col("at") < first, (F.col("at") >= first) & (F.col("at") < second), F.coalesce(F.col("at") >= second, F.lit(True))):
        rows.where(part).repartition(2 * files).write.mode("append").parquet(f"{at}/in")
        stream = lockouts(files_as_stream(spark, f"{at}/in", rows.schema, 2 * files), 3, 3 * 1440, buckets=buckets)
        out = _taken(stream, at)  # takes up where it ended: what is new is one batch
    return out
