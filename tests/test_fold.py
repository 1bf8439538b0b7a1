import json
import random

import pytest
from pyspark.sql import functions as F

from leadwright.operators import fold as K
from leadwright.operators.leads import upsert_manual
from leadwright.schemas import TABLES, conformed
from leadwright.streaming.captures import LeadStore, capture_stream, files_as_stream

RANK = {"HIGH": 1, "LOW": 0}


def captures(spark, rows):
    fields = TABLES["captures"]
    names = [f.split()[0] for f in fields.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)


def one_by_one(rows):
    """The fold as a plain loop."""
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        key = r["email"].lower()
        if key not in out:
            out[key] = {c: r.get(c) for c in (*K.FIRST, *K.ENRICHABLE, "confidence_band", "field_provenance")}
            continue
        lead = out[key]
        for c in K.ENRICHABLE:
            lead[c] = lead[c] or r.get(c) or lead[c]
        if RANK.get(r.get("confidence_band"), -1) > RANK.get(lead["confidence_band"], -1):
            lead["confidence_band"] = r["confidence_band"]
            lead["field_provenance"] = r.get("field_provenance") or lead["field_provenance"]
    for lead in out.values():
        score = 0 if lead["channel_tag"] == "manual" else (20 if lead["confidence_band"] == "HIGH" else 10) + sum(w for c, w in (("person_name", 40), ("designation", 30), ("phone", 10)) if (lead[c] or "").strip())
        lead["lead_score"] = score
    return out


def some(seed, n=600):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return [
        {
            "seq": i, "job_id": r.randrange(5), "email": pick("A@x.org", "a@X.org", "b@x.org", f"u{r.randrange(80)}@y.org"), "source_url": f"http://s{i}", "person_name": pick(None, "", "N", "M"), "designation": pick(None, "", "D"),
            "department": pick(None, "", "P"), "phone": pick(None, "", "1"), "channel_tag": pick("office", "role", "manual"), "confidence_band": pick(None, "LOW", "HIGH", "ODD"), "field_provenance": pick(None, "", f'{{"n": {i}}}'), "depth": i % 3,
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_the_sequential_one(spark, seed):
    rows = some(seed)
    want = one_by_one(rows)
    got = {r.email: r for r in K.fold(captures(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for key, lead in want.items():
        for c in (*K.FIRST, "confidence_band", "field_provenance", "lead_score"):
            assert got[key][c] == lead[c], (key, c)
        for c in K.ENRICHABLE:
            assert (got[key][c] or None) == (lead[c] or None), (key, c)


def test_high_stays_and_keeps_its_provenance(spark):
    rows = [{"seq": i, "email": "a@b.c", "job_id": 1, "source_url": "u", "confidence_band": b, "field_provenance": json.dumps(b)} for i, b in enumerate(("LOW", "HIGH", "LOW"))]
    lead = K.fold(captures(spark, rows)).first()
    assert (lead.confidence_band, lead.field_provenance, lead.lead_score) == ("HIGH", '"HIGH"', 20)


def test_bad_items_do_not_stop_good_ones(spark):
    rows = [{"seq": 0, "email": "a@b.c", "job_id": 1, "source_url": "u"}, {"seq": 1, "email": " "}, {"seq": 2, "email": "c@b.c", "job_id": 1, "source_url": "u"}]
    good, bad = K.accepted(captures(spark, rows))
    assert ({r.seq for r in good.collect()}, [(r.seq, r.reason) for r in bad.collect()]) == ({0, 2}, [(1, "no e-mail")])


def test_stream_and_batch_agree_also_after_a_restart(spark, tmp_path):
    rows = captures(spark, some(5, 300))
    rows.where("seq < 150").repartition(2).write.parquet(str(tmp_path / "in"))
    store = LeadStore(spark, str(tmp_path / "store"), rows.schema)
    source = lambda: files_as_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    capture_stream(source(), store, str(tmp_path / "at")).awaitTermination(60)
    rows.where("seq >= 150").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    capture_stream(source(), store, str(tmp_path / "at")).awaitTermination(60)
    assert sorted(map(str, store.leads().collect())) == sorted(map(str, K.fold(rows).collect()))


def test_department_swap(spark):
    rows = captures(spark, [{"seq": 0, "email": "a@b.c", "snapshot_id": 1, "department": "tn", "field_provenance": '{"department": "url_default"}'}, {"seq": 1, "email": "b@b.c", "snapshot_id": 1, "department": "tn", "field_provenance": "oops"}])
    out = K.with_department(rows, spark.createDataFrame([(1, "Tamil Nadu")], "id long, title string"))
    assert {r.seq: r.department for r in out.collect()} == {0: "Tamil Nadu", 1: "tn"}


def test_merge_of_stored_duplicates(spark):
    leads = spark.createDataFrame(
        [(1, 1, "a@b.c", None, "D", "LOW"), (2, 2, "a@b.c", "N", None, "HIGH"), (3, 1, "z@b.c", None, None, None)], "id long, job_id long, email string, person_name string, designation string, confidence_band string"
    )
    occ = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 1)], "id long, lead_id long, job_id long")
    mail = spark.createDataFrame([(1, 1)], "id long, lead_id long")
    kept, seen, sent = K.merge_duplicates(leads, occ, mail)
    assert {(r.id, r.person_name, r.designation, r.confidence_band) for r in kept.collect()} == {(2, "N", "D", "HIGH"), (3, None, None, None)}
    assert {(r.lead_id, r.job_id) for r in seen.collect()} == {(2, 1), (2, 2), (3, 1)}
    assert [r.lead_id for r in sent.collect()] == [2]


def test_manual_rows(spark):
    pool = conformed(spark.createDataFrame([(1, "m@x.y", "Old", "manual"), (2, "c@x.y", "Keep", "office")], "id long, email string, person_name string, channel_tag string"), "leads")
    rows = spark.createDataFrame([(1, "M@x.y", "New", "", None, None), (2, "c@x.y", "Typed", None, None, None), (3, "n@x.y", "Ann", None, None, None)], "row long, email string, person_name string, designation string, department string, phone string")
    got = {r.email: (r.outcome, r.person_name) for r in upsert_manual(pool, rows, 7).collect()}
    assert got == {"m@x.y": ("updated", "New"), "c@x.y": ("skipped", "Keep"), "n@x.y": ("imported", "Ann")}


def test_occurrences_are_unique(spark):
    rows = captures(spark, [{"seq": 2, "email": "a@b.c", "job_id": 1, "source_url": "y"}, {"seq": 1, "email": "A@b.c", "job_id": 1, "source_url": "x"}, {"seq": 3, "email": "a@b.c", "job_id": 2, "source_url": "z"}])
    assert {(r.job_id, r.source_url) for r in K.occurrences(rows).collect()} == {(1, "x"), (2, "z")}
    assert K.fold(rows).select(F.sum("captures")).first()[0] == 3


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    made = [r | {"email": f"P{r['seq'] % 40}@x.com"} for r in some(9, 400)]
    rows = captures(spark, made)
    store = LeadStore(spark, str(tmp_path), rows.schema, 16)
    store.save(rows.where("seq % 2 = 0"), 0)
    first = store.manifest()
    late = rows.where("seq % 2 = 1 and email in ('P1@x.com', 'P3@x.com')")
    for _ in range(2):  # delivered again: it counts once
        store.save(late, 1)
    now = store.manifest()
    touched = {b for b, batch in now.items() if batch == 1}
    assert len(first) > 8 and 1 <= len(touched) <= 2 and all(now[b] == 0 for b in set(first) - touched)
    assert {int(p.name[7:]) for p in (tmp_path / "state/batch=1").glob("bucket=*")} == touched
    whole = rows.where("seq % 2 = 0").union(late)
    want = K.fold(whole)
    assert sorted(map(str, store.leads().select(want.columns).collect())) == sorted(map(str, want.collect()))
    store.save(rows.where("false"), 2)
    assert store.manifest() == now
    again = LeadStore(spark, str(tmp_path / "none"), rows.schema)
    assert again.leads().count() == 0


def test_stream_files_and_buckets_follow_the_captures(spark, monkeypatch):
    """More captures come in more files, and so tasks, a batch and go to more buckets; the leads are those of one fold."""
    from leadwright.plans import streams
    from leadwright.plans import views

    small = "/root/testdata/sf0.001"
    rows = views.captures(spark, small)
    stores = []
    made = streams.LeadStore
    monkeypatch.setattr(streams, "FILE", -(-rows.count() // 8))
    monkeypatch.setattr(streams, "LeadStore", lambda *a: stores.append(made(*a)) or stores[-1])
    got = streams.stream_fold(spark, small)
    assert stores[0].buckets == 16 and len(spark.read.parquet(stores[0].path.removesuffix("store") + "in").inputFiles()) == 8
    want = K.fold(K.accepted(rows)[0])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
