import random
import time

from leadwright.streaming.captures import files_as_stream
from leadwright.streaming.liveness import transitions

BEAT = "job_id long, at double"


def changes(batches, silence_s):
    out, known = [], {}
    for batch in batches:
        for job, at in sorted(batch, key=lambda r: r[1]):
            running, last, count = known.get(job, (False, 0.0, 0))
            if running and at - last > silence_s:
                out.append((job, "interrupted", last + silence_s, count))
                running = False
            if not running:
                out.append((job, "running", at, count + 1))
            known[job] = True, max(last, at), count + 1
    return sorted(map(str, out)), {job: (last, count) for job, (_, last, count) in known.items()}


def test_liveness_of_many_jobs_in_few_keys(spark, tmp_path):
    """The stream has as many keys as buckets, whatever the number of jobs; states outlast a batch, also late reports."""
    rng = random.Random(2)
    batches = [[(rng.choice([None, 2**60 + 1, *range(200)]), 1e9 + start + rng.random() * 5000) for _ in range(1000)] for start in (0, 4000, 9000)]
    for batch in batches:
        spark.createDataFrame(batch, BEAT).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = transitions(files_as_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], BEAT).schema, 3), 600, timers=False, buckets=5)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 5
    assert sorted(str(tuple(r)) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()) == changes(batches, 600)[0]


def test_a_timer_interrupts_each_silent_job(spark, tmp_path):
    """Jobs of one bucket are interrupted when no report comes, each once."""
    beats = [(j, 100.0 * j + i) for j in range(20) for i in range(3)]
    spark.createDataFrame(beats, BEAT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = transitions(files_as_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], BEAT).schema), 3, buckets=2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    told = lambda: [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out/_spark_metadata/0").exists() else []
    until = time.monotonic() + 40
    while len(told()) < 40 and time.monotonic() < until:
        time.sleep(1)
    time.sleep(4)
    query.stop()
    want, left = changes([beats], 3)
    want += [str((job, "interrupted", last + 3, count)) for job, (last, count) in left.items()]
    assert sorted(map(str, told())) == sorted(want)
