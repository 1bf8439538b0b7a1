import random
import time
from datetime import datetime, timedelta

from leadwright.plans import streams
from leadwright.streaming.captures import files_as_stream
from leadwright.streaming.liveness import lockouts

LOGIN = "user_id long, id long, at double, ok boolean"


def met(batches, threshold, minutes, forget=False):
    """What each login meets, one after another."""
    out, known = [], {}
    for batch in batches:
        known = {} if forget else known
        for user, number, at, ok in sorted(batch, key=lambda r: (r[2] is None, r[2] or 0.0, r[1] is None, r[1] or 0)):
            failures, until = known.get(user, (0, 0.0))
            if at is not None and at < until:
                out.append((user, number, "locked", failures))
                continue
            failures = 0 if ok else failures + 1
            if failures >= threshold and at is not None:
                until = at + 60.0 * minutes
            out.append((user, number, "ok" if ok else "locks" if failures >= threshold else "failed", failures))
            known[user] = failures, until
    return sorted(map(str, out))


def taken(spark, tmp_path, batches, **kind):
    """The outcomes of a stream that takes one batch a run, and the rows of state after the last."""
    told = []
    for batch in batches:
        spark.createDataFrame(batch, LOGIN).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lockouts(files_as_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LOGIN).schema, 3), **kind)
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        if "forget_days" in kind:  # its timers keep it running
            query = writer.trigger(processingTime="1 second").start()
            until = time.monotonic() + 30
            while not any(p["numInputRows"] for p in query.recentProgress) and time.monotonic() < until:
                time.sleep(0.2)
            query.stop()
        else:
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
        told.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(str(tuple(r)) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()), told[-1]


def batches_of(seed, users, count):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 2**60 + 1, -3, *range(users)]), 2**60 + i, rng.choice([None, *(1e9 + rng.random() * 1e5 for _ in range(30))]), rng.choice([True, False, False, None])) for i in range(count)]
    rows += [(7, None, 1e9 + 5.0, False), (8, 1, 1e9, False), (8, 2, 1e9, False), (8, 3, 1e9, False), (8, 4, 1e9, True)]
    rows.sort(key=lambda r: (r[2] is None, r[2] or 0.0))
    return [rows[: count // 3], rows[count // 3 : count // 2], rows[count // 2 :]]


def test_lockouts_of_many_users_in_few_keys(spark, tmp_path):
    """The stream has as many keys as buckets, whatever the number of users; locks and failures outlast a batch."""
    batches = batches_of(3, 300, 3000)
    got, keys = taken(spark, tmp_path, batches, threshold=3, minutes=200, buckets=5)
    assert got == met(batches, 3, 200)
    assert keys == 5


def test_lockouts_forget_users(spark, tmp_path):
    batches = batches_of(4, 5, 200)
    got, keys = taken(spark, tmp_path, batches, threshold=3, minutes=2000, forget_days=2e-8, buckets=2)
    assert got == met(batches, 3, 2000, forget=True) != met(batches, 3, 2000)
    assert keys <= 2


def test_login_lockouts_follows_the_logins(spark, tmp_path, monkeypatch):
    """Files and buckets grow with the logins; logins without a time come last, logins of nobody are left out, as in its SQL."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    events = [(i, rng.randrange(40), rng.choice(["view", "error", "error", "click"]), start + timedelta(minutes=rng.randrange(20000))) for i in range(900)]
    events += [(1000 + i, i % 7, "error", None) for i in range(30)] + [(2000 + i, None, "error", start) for i in range(5)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    logins = [(user, number, (ts - datetime(1970, 1, 1)).total_seconds() if ts else None, kind == "view") for number, user, kind, ts in events if kind in ("view", "error") and user is not None]
    made, asked, at = streams.lockouts, [], []
    monkeypatch.setattr(streams, "FILE", 50)
    monkeypatch.setattr(streams, "BUCKET", 100)
    monkeypatch.setattr(streams, "lockouts", lambda *a, **k: asked.append(k["buckets"]) or made(*a, **k))
    folder = streams.folder
    monkeypatch.setattr(streams, "folder", lambda *a: at.append(folder(*a)) or at[-1])
    got = streams.login_lockouts(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == met([logins], 3, 3 * 1440)
    assert set(asked) == {-(-len(logins) // 100)} and len(spark.read.parquet(f"{at[0]}/in").inputFiles()) == 6 * -(-len(logins) // 150)
