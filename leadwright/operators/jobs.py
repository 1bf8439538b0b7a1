"""Crawl jobs: life cycle, liveness, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.functions.score import progress, visit_rate
from leadwright.schemas import TERMINAL_JOB_STATES


def owned(df: DataFrame, owner_id: int | None, view_all: bool = False) -> DataFrame:
    """Rows of an owner, or all."""
    return df if view_all else df.where(F.col("owner_id").eqNullSafe(owner_id))


def newest(df: DataFrame, page: int = 1, limit: int = 20, by: str = "created_at") -> DataFrame:
    """A page of the newest rows; the id breaks ties."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col("id").desc()).offset((page - 1) * limit).limit(limit)


def _moved(jobs: DataFrame, when: Column, status: str, **more: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in {"status": F.lit(status), **more}.items()})


def started(jobs: DataFrame, ids: list[int], now: Column) -> DataFrame:
    return _moved(jobs, F.col("id").isin(ids) & (F.col("status") == "pending"), "running", started_at=now)


def finished(jobs: DataFrame, ids: list[int], status: str, now: Column, error: str | None = None) -> DataFrame:
    """Jobs ended; one that has ended before stays as it is."""
    open_ = F.col("id").isin(ids) & ~F.col("status").isin(list(TERMINAL_JOB_STATES))
    return _moved(jobs, open_, status, finished_at=now, error_message=F.lit(error).cast("string"))


def cancel_requested(jobs: DataFrame, ids: list[int]) -> DataFrame:
    return jobs.withColumn("cancel_requested", F.col("cancel_requested") | (F.col("id").isin(ids) & ~F.col("status").isin(list(TERMINAL_JOB_STATES))))


def resumed(jobs: DataFrame, ids: list[int]) -> DataFrame:
    """Jobs that run again: the request to cancel is cleared."""
    return _moved(jobs, F.col("id").isin(ids) & (F.col("status") != "done"), "running", cancel_requested=F.lit(False), finished_at=F.lit(None).cast("timestamp_ntz"))


def claimed(jobs: DataFrame, job_id: int, agent: str) -> DataFrame:
    """The job with an agent: the first to claim it keeps it; mine says whether it is this one."""
    here = F.col("id") == job_id
    return jobs.withColumn("agent_hostname", F.when(here, F.coalesce("agent_hostname", F.lit(agent))).otherwise(F.col("agent_hostname"))).withColumn("mine", here & (F.col("agent_hostname") == agent))


def created(jobs: DataFrame, new: DataFrame, domain_ids: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after new jobs: jobs, their domains (each once) and their custom addresses (each once)."""
    return jobs.unionByName(new, allowMissingColumns=True), domain_ids.select("job_id", "domain_id").distinct(), urls.groupBy("job_id", "url").agg(F.min("seq").alias("seq"))


def latest_heartbeats(beats: DataFrame, key: str = "job_id", at: str = "ts", seq: str = "seq") -> DataFrame:
    """The last report of each job."""
    rest = [c for c in beats.columns if c != key]
    return beats.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, seq)).alias("b"), F.count("*").alias("beats")).select(key, "b.*", "beats")


def with_heartbeats(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """Jobs after their last report: an interrupted one that reports again runs again, however late."""
    last = latest_heartbeats(beats).select(F.col("job_id").alias("id"), F.col("ts").alias("_at"))
    both = jobs.join(last, "id", "left")
    late = F.col("_at").isNotNull() & (F.col("status") == "interrupted")
    return both.withColumns({"last_heartbeat_at": F.coalesce("_at", "last_heartbeat_at"), "status": F.when(late, "running").otherwise(F.col("status"))}).drop("_at")


def reaped(jobs: DataFrame, now: Column, silence_s: int = 150) -> DataFrame:
    """Jobs with those interrupted that run and have been silent for longer; one that never reported counts from its start."""
    last = F.coalesce("last_heartbeat_at", "started_at")
    silent = (F.col("status") == "running") & (F.timestamp_diff("SECOND", last, now) > silence_s)
    return _moved(jobs, F.coalesce(silent, F.lit(False)), "interrupted")


def agent_summary(jobs: DataFrame) -> DataFrame:
    """Jobs and the last one's time for each agent."""
    return jobs.where("agent_hostname is not null").groupBy("agent_hostname").agg(F.count("*").alias("jobs"), F.max("created_at").alias("last_job_at"))


def job_label(jobs: DataFrame) -> Column:
    return F.format_string("Job #%d (%s)", F.col("id"), F.coalesce(F.nullif("title_filter", F.lit("")), F.nullif("category_filter", F.lit("")), F.col("source_type"), F.lit("all")))


def activity(jobs: DataFrame, campaigns: DataFrame, recent: int = 5) -> DataFrame:
    """(section, id, label, status): running jobs and campaigns, and the newest jobs that do not run."""
    shape = ["section", "id", "label", "status"]
    running = jobs.where("status = 'running'").select(F.lit("running job").alias("section"), "id", job_label(jobs).alias("label"), "status")
    sending = campaigns.where("status = 'RUNNING'").select(F.lit("running campaign").alias("section"), "id", F.format_string("Campaign #%d (%s)", F.col("id"), F.col("name")).alias("label"), "status")
    last = newest(jobs.where("status <> 'running'"), limit=recent).select(F.lit("recent job").alias("section"), "id", job_label(jobs).alias("label"), "status")
    return running.select(shape).union(sending.select(shape)).union(last.select(shape))


def progress_panel(jobs: DataFrame, now: Column) -> DataFrame:
    """(id, percent, rate, elapsed_s) of jobs."""
    elapsed = F.timestamp_diff("SECOND", F.col("started_at"), F.coalesce(F.col("finished_at"), now))
    return jobs.select("id", progress(F.col("visited_urls"), F.col("queued_urls")).alias("percent"), visit_rate(F.col("visited_urls"), elapsed).alias("rate"), elapsed.alias("elapsed_s"))


def without_task(running: DataFrame, known: DataFrame) -> DataFrame:
    """Running rows whose id is not known yet."""
    return running.join(known.select("id"), "id", "left_anti")


def adopted(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows without an owner get the first administrator."""
    first = users.where("is_admin").agg(F.min("id").alias("_admin"))
    return df.join(first, F.col("owner_id").isNull(), "left").withColumn("owner_id", F.coalesce("owner_id", "_admin")).drop("_admin")
