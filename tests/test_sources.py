import json

import pytest
from pyspark.sql import functions as F

from leadwright.policy import merged
from leadwright.sources import catalog, contacts, transfer


def test_contact_file_and_rejects(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('﻿ Full Name ,E-MAIL,Job Title,Shoe size,mobile\n"Lee, Ann",Ann@X.org,Clerk,37,+1\nBob,,Guard,44,\nCid,not an address,,,\nAnn again,ann@x.ORG ,,,\nDee,dee@x.org,,,\nEve,eve@x.org,,,\n')
    rows = contacts.read_contacts(spark, str(path))
    assert rows.columns == ["row", "name", "email", "designation", "department", "phone"] and rows.first().name == "Lee, Ann"
    good, bad = contacts.judged_contacts(rows, most=2)
    assert [(r.email, r.person_name, r.designation, r.department) for r in good.orderBy("row").collect()] == [("ann@x.org", "Lee, Ann", "Clerk", None), ("dee@x.org", "Dee", None, None)]
    assert [(r.row, r.reason) for r in bad.orderBy("row").collect()] == [(3, "missing e-mail"), (4, "invalid e-mail"), (5, "duplicate in file"), (7, "row limit")]


def test_headers_and_template(spark, tmp_path):
    assert [contacts.field_of(h) for h in (" Mail", "person_name", "ROLE", "dept", "Contact Number", "shoe")] == ["email", "name", "designation", "department", "phone", None]
    assert set(contacts.template(spark).columns) == set(contacts.FIELDS)
    contacts.write_export(spark.createDataFrame([("a@x.org", 'says "hi"')], "email string, note string"), str(tmp_path / "out"), ["note", "email"])
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()
    assert [tuple(r) for r in back] == [('says "hi"', "a@x.org")]
    with pytest.raises(LookupError):
        contacts.write_export(spark.createDataFrame([], "email string"), str(tmp_path / "none"))


CATALOG = {
    "Rivers": {"North": {"Board": ["https://alpha.gov.in/x", "https://shop.example/"], "Trust": [{"title": "Beta", "url": "https://beta.gov.in", "contact_url": "https://beta.nic.in/c", "external_id": "7"}]}},
    "Lakes / Ponds": {"South": {"Board": [{"title": "Gamma", "contact_url": "https://gamma.nic.in/who"}, {"title": "Delta", "url": "http://delta.example"}]}},
}


def test_catalog_document_there_and_back(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG))
    rows = catalog.read_catalog(spark, str(path), codes={"Rivers": "riv"}).orderBy("seq").collect()
    got = [(r.category_code, r.state, r.org_type, r.title, r.main_url, r.contact_url, r.external_id) for r in rows]
    assert got == [
        ("riv", "North", "board", "Alpha", "https://alpha.gov.in", "https://alpha.gov.in/x", None), ("riv", "North", "trust", "Beta", "https://beta.gov.in", "https://beta.nic.in/c", "7"),
        ("lakes___ponds", "South", "board", "Gamma", "https://gamma.nic.in", "https://gamma.nic.in/who", None), ("lakes___ponds", "South", "board", "Delta", None, None, None),
    ]
    assert len({r.seq for r in rows}) == 4
    documents = {r.category_title: json.loads(r.document) for r in catalog.catalog_document(spark.createDataFrame(rows)).collect()}
    assert documents["Rivers"]["states"]["North"]["Trust"] == [{"title": "Beta", "url": "https://beta.gov.in", "contact_url": "https://beta.nic.in/c", "external_id": "7"}]
    assert {e["title"] for e in documents["Lakes / Ponds"]["states"]["South"]["Board"]} == {"Gamma", "Delta"}


def test_directory_answers(spark, tmp_path):
    def line(category, page, titles, total=None):
        return json.dumps({"category": category, "page": page, "total": total, "rows": [{"title": t, "state": "s"} for t in titles]})

    (tmp_path / "a.json").write_text("\n".join([line("x", 2, ["c"]), line("x", 1, ["a", "b"]), line("x", 3, []), line("x", 4, ["never"]), line("y", 1, ["p", "q"], 2), line("y", 2, ["over"], 2)]))
    (tmp_path / "b.json").write_text(line("z", 1, []))
    got = sorted((r.category_code, r.seq, r.title, r.state) for r in catalog.read_directory(spark, str(tmp_path)).collect())
    assert got == [("x", 0, "a", "s"), ("x", 1, "b", "s"), ("x", 2, "c", "s"), ("y", 0, "p", "s"), ("y", 1, "q", "s")]


def test_log_tail_and_policy(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(f"line {i}" for i in range(50)))
    assert [r.line for r in transfer.log_tail(spark, str(tmp_path / "log"), 3).collect()] == ["line 47", "line 48", "line 49"]
    base = {"a": {"b": 1, "c": {"d": 2}}, "e": [1]}
    assert merged(base, {"a": {"c": {"d": 3, "f": 4}}, "e": [2], "g": 5}) == {"a": {"b": 1, "c": {"d": 3, "f": 4}}, "e": [2], "g": 5} and base["a"]["c"] == {"d": 2}


def test_ids_with_an_outlier_keep_their_order(spark):
    ids = [*range(200), 10**15]
    got = {r.old_id: r.new_id for r in transfer.id_map(spark.createDataFrame([(i,) for i in ids], "id long"), 10, buckets=8).collect()}
    assert got == {i: 11 + n for n, i in enumerate(ids)}
    assert transfer.id_map(spark.createDataFrame([], "id long")).count() == 0


def test_catalog_entries_of_several_files_and_any_size(spark, tmp_path):
    from leadwright.operators import history

    for n in range(2):
        kinds = {f"T{k}": [{"title": f"{n}-{k}-{i}"} for i in range(40_000 if k == 1 else 3)] for k in range(3)}
        (tmp_path / f"doc{n}.json").write_text(json.dumps({"Cat": {"S": kinds}, "Next": {"S": {"T": [{"title": f"{n}-last"}]}}}))
    want = [f"{n}-{k}-{i}" for n in range(2) for k in (0, 1, 2, 3) for i in range({0: 3, 1: 40_000, 2: 3, 3: 0}[k])]
    plain = [r.title for r in catalog.read_catalog(spark, str(tmp_path)).orderBy("seq").collect()]
    assert [t for t in plain if "last" not in t] == want and plain[40_006] == "0-last" and plain[-1] == "1-last"
    cut = history.ordered(catalog.read_catalog(spark, str(tmp_path)).withColumn("k", F.lit(1)), "k", ["seq"], 9_000).running("n", F.lit(1), history.SUM).done("k")
    assert cut.where("n <> seq + 1").count() == 0 and cut.count() == len(plain)
