"""Liveness of jobs from a stream of heartbeats, by state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A job that is silent for longer is interrupted.
SILENCE_S = 150


def _dealt(rows: DataFrame, key: str, buckets: int, *whole: str) -> DataFrame:
    """rows with the bucket of their key. Integers that may be null get a flag, no_<name>, and 0, since pandas would make floats of integers among nulls."""
    columns = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in (key, *whole)} | {f"no_{c}": F.col(c).isNull() for c in (key, *whole)}
    return rows.withColumns(columns | {"bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})


def _lists(known: dict) -> tuple:
    """The state of a bucket: its keys, and a list for each of their values."""
    return tuple(map(list, zip(*((key, *values) for key, values in known.items()))))


def transitions(beats: DataFrame, silence_s: int = SILENCE_S, timers: bool = True, buckets: int = 1024) -> DataFrame:
    """(job_id, status, at, beats): each change of a job's state, from a stream of (job_id, at in epoch seconds, queued).

    The first report makes a job run; silence interrupts it, seen in the reports' own times or by a timer while none come;
    a later report, however late, makes it run again. Jobs are dealt to buckets like the users of lockouts; the state of a
    job is four numbers, the last of them when it was heard of, and a bucket's timer is that of its job that waits longest.
    Without timers only reports change states, so that a run over what is there comes to an end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, wait = state.getCurrentProcessingTimeMs(), int(silence_s * 1000)
        known = {job: tuple(values) for job, *values in zip(*state.get)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.iloc[np.lexsort([rows[c] for c in ("at", "job_id", "no_job_id")])]
            for job, at in zip(np.where(rows["no_job_id"], None, rows["job_id"]).tolist(), rows["at"].tolist()):
                running, last, count, _ = known.get(job, (False, 0.0, 0, now))
                if running and at - last > silence_s:
                    out.append((job, "interrupted", last + silence_s, count))
                    running = False
                if not running:
                    out.append((job, "running", at, count + 1))
                known[job] = True, max(last, at), count + 1, now
        if timers:
            for job, (running, last, count, seen) in known.items():
                if running and seen + wait <= now:
                    out.append((job, "interrupted", last + silence_s, count))
                    known[job] = False, last, count, seen
            heard = [seen for running, _, _, seen in known.values() if running]
            if heard:
                state.setTimeoutDuration(min(heard) + wait - now)
        state.update(_lists(known))
        jobs, status, at, count = map(list, zip(*out)) if out else ([], [], [], [])
        yield pd.DataFrame({"job_id": pd.array(jobs, "Int64"), "status": status, "at": np.array(at, float), "beats": np.array(count, np.int64)})

    dealt = _dealt(beats, "job_id", buckets).select("bucket", "job_id", "no_job_id", F.col("at").cast("double").alias("at"))
    return dealt.groupBy("bucket").applyInPandasWithState(
        step, "job_id long, status string, at double, beats long", "jobs array<long>, running array<boolean>, last array<double>, beats array<long>, seen array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout,
    )


def lockouts(logins: DataFrame, threshold: int = 5, minutes: float = 15, forget_days: float | None = None, buckets: int = 1024) -> DataFrame:
    """(user_id, id, outcome, failures): what each login of a stream (user_id, id, at in epoch seconds, ok) meets: ok, failed, locks or locked.

    An attempt during a lock is turned away and changes nothing. A success starts anew; an expired lock leaves the number of
    failures. Logins of a batch are taken in the order of their time, then id; one without a time comes last and starts no
    lock. Users are dealt to buckets by a hash, and a bucket is one key of the stream, since a key costs more than a login;
    its state lists its users with two values each, and when they came last. A task holds one bucket's logins of a batch.
    With forget_days, users who have not come for so long are dropped when their bucket is next visited, or by its timer.
    The number of buckets stays as it was when the stream first ran.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        oldest = now - int(forget_days * 86_400_000) if forget_days is not None else None
        known = {user: (failures, until, seen) for user, failures, until, seen in zip(*state.get) if oldest is None or seen > oldest} if state.exists else {}
        rows = pd.concat(list(frames))
        rows = rows.iloc[np.lexsort([rows[c] for c in ("id", "no_id", "at", "user_id", "no_user_id")])]
        users = np.where(rows["no_user_id"], None, rows["user_id"])
        outcomes, counts = [], []
        last, failures, until = object(), 0, 0.0
        for user, at, ok in zip(users.tolist(), rows["at"].tolist(), rows["ok"].tolist()):
            if user != last:
                failures, until, _ = known.get(user, (0, 0.0, now))
                last = user
            if at < until:
                outcomes.append("locked")
            else:
                failures = 0 if ok else failures + 1
                if failures >= threshold and at >= until:
                    until = at + 60.0 * minutes
                outcomes.append("ok" if ok else "locks" if failures >= threshold else "failed")
            known[user] = failures, until, now
            counts.append(failures)
        state.update(_lists(known))
        if forget_days is not None:
            state.setTimeoutDuration(int(forget_days * 86_400_000))
        ids = pd.array(rows["id"], "Int64")
        ids[rows["no_id"].to_numpy()] = pd.NA
        yield pd.DataFrame({"user_id": pd.array(users, "Int64"), "id": ids, "outcome": outcomes, "failures": np.array(counts, np.int32)})

    dealt = _dealt(logins, "user_id", buckets, "id").select("bucket", "user_id", "no_user_id", "id", "no_id", F.col("at").cast("double").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    timeout = GroupStateTimeout.NoTimeout if forget_days is None else GroupStateTimeout.ProcessingTimeTimeout
    return dealt.groupBy("bucket").applyInPandasWithState(
        step, "user_id long, id long, outcome string, failures int", "users array<long>, failures array<int>, until array<double>, seen array<long>", "append", timeout
    )
