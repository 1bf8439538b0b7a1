import random
import time

import pytest
from pyspark.sql import functions as F

from leadwright.operators.history import failure_runs, ordered, rate_limited, round_robin, spaced


@pytest.fixture(scope="module")
def rows(spark):
    """4000 rows, nine tenths of one key, some without a key, in no order."""
    r = random.Random(4)
    made = [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.randrange(5000), r.random() < 0.2) for i in range(4000)]
    r.shuffle(made)
    return spark.createDataFrame(made, "id long, k string, at long, ok boolean").repartition(7).cache()


ORDER = ["at", "id"]


@pytest.mark.parametrize("split", [1 << 20, 150])
def test_histories_against_loops(rows, split):
    want, starts, fails, places = {}, {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r.id)):
        starts[r.k] = max(r["at"], starts.get(r.k, -(10**9)) + 3)
        fails[r.k] = 0 if r.ok else fails.get(r.k, 0) + 1
        places[r.k] = places.get(r.k, -1) + 1
        want[r.id] = (starts[r.k], fails[r.k], fails[r.k] >= 5 and not r.ok, places[r.k] % 4)
    got = {r.id: [r.start] for r in spaced(rows, "k", F.col("at"), 3, ORDER, split).collect()}
    for r in failure_runs(rows, "k", ORDER, F.col("ok"), 5, split).collect():
        got[r.id] += [r.failures, r.locks]
    for r in round_robin(rows, "k", ORDER, F.lit(4), split).collect():
        got[r.id] += [r.slot]
    assert {k: tuple(v) for k, v in got.items()} == want


def test_a_hot_key_lies_in_many_tasks(rows):
    cut = ordered(rows, "k", ORDER, 150)
    sizes = [r["count"] for r in cut.rows.where("k = 'hot'").groupBy("_range").count().collect()]
    assert cut.cut and len(sizes) > 15 and max(sizes) < 600
    plain = ordered(rows, "k", ORDER)
    assert not plain.cut and plain.rows is rows


def test_rate_limit_against_a_loop(rows):
    all_rows = rows.collect()
    got = rate_limited(rows, "k", F.col("at"), 20, 90).collect()
    assert len(got) == len(all_rows)
    times = {}
    for r in all_rows:
        times.setdefault(r.k, []).append(r["at"])
    for r in got:
        recent = sum(r["at"] - 90 < t <= r["at"] for t in times[r.k]) - 1
        assert (r.recent, r.rejected) == (recent, recent >= 20)


def test_rate_limit_takes_dense_seconds_in_linear_time(spark):
    """A failure in every second of ten windows: a frame that is summed anew for each row adds 1.7e9 times."""
    made = spark.range(200_000).selectExpr("id", "'k' as k", "id - 90000 as at")
    began = time.perf_counter()
    got = rate_limited(made, "k", F.col("at"), 20, 20_000).selectExpr("recent = least(id, 19999) as right").groupBy("right").count().collect()
    assert [(r.right, r["count"]) for r in got] == [(True, 200_000)] and time.perf_counter() - began < 15


def test_reused_tokens_meet_once_each(spark):
    """Each token shown 300 times and revoked 300 times by one user: the join makes no row for each pair."""
    from leadwright.operators.rbac import reused_tokens

    at = "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {})"
    shown = spark.range(3000).selectExpr("concat('t', id % 10) as token", f"case when id < 20 then null else {at.format('id % 3000')} end as at")
    gone = spark.range(3000).selectExpr("sha2(concat('t', id % 10), 256) as token_hash", "id % 10 as user_id", f"case when id % 10 = 9 then null else {at.format('id div 10 + 290 + id % 10')} end as revoked_at")
    told = reused_tokens(shown, gone)
    joins = told._jdf.queryExecution().executedPlan()
    assert {r.user_id for r in told.collect()} == {r.user_id for r in shown.join(gone, F.sha2("token", 256) == F.col("token_hash")).where("at >= revoked_at").select("user_id").distinct().collect()}
    pairs = shown.groupBy("token").agg(F.max("at")).count() * gone.where("revoked_at is not null").select("token_hash", "user_id").distinct().count()
    assert 0 < _join_rows(joins) <= pairs


def _join_rows(plan) -> int:
    """The rows that the joins of an executed plan made."""
    own = int(plan.metrics().apply("numOutputRows").value()) if "Join" in plan.nodeName() else 0
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if hasattr(plan, "plan") and "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + sum(map(_join_rows, inner))


def test_empty_histories(rows):
    none = rows.where("false")
    assert spaced(none, "k", F.col("at"), 3, ORDER).count() == failure_runs(none, "k", ORDER, F.col("ok")).count() == rate_limited(none, "k", F.col("at")).count() == 0
