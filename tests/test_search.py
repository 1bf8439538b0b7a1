import random

from pyspark.sql import functions as F

from leadwright.operators import leads as L
from leadwright.operators import search as S

FIELDS = ("email", "name")


def table(spark, n=2000):
    r = random.Random(8)
    part = lambda k: "".join(r.choice("abcdeF.@_%é ") for _ in range(k))
    return spark.createDataFrame([(i, part(r.randrange(0, 14)), None if i % 9 == 0 else part(r.randrange(0, 10))) for i in range(n)], "id long, email string, name string")


def test_index_and_scan_agree(spark):
    rows = table(spark).cache()
    index = S.trigram_index(rows, "id", FIELDS).cache()
    r = random.Random(2)
    for term in ["abc", "ABC", "a%cd", "ab_de", "é a", "abcd", "@", "zzz", "b.@", "c\\d", "%%%", "aba"] + ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(5)]:
        got = {x.id for x in S.searched(rows, index, term, "id", FIELDS).collect()}
        assert got == {x.id for x in rows.where(S.holds(term, FIELDS)).collect()}, term


def test_few_rows_are_verified(spark):
    rows = table(spark)
    index = S.trigram_index(rows, "id", FIELDS)
    asked = S.proposed(index, "abcd").count()
    assert asked < rows.count() / 50 and asked >= rows.where(S.holds("abcd", FIELDS)).count()
    assert S.proposed(index, "ab") is None and S.proposed(index, "a%b_c") is None


def test_terms_and_their_grams():
    assert S.grams_of("ABCd%xé1y_zz") == ["abc", "bcd"]


def test_facets_are_one_scan(spark):
    leads = spark.createDataFrame([(1, 1, 7, "a@b.c", "office", None, 50, "1"), (2, 1, None, "b@b.c", "manual", "Goa", 0, "2"), (3, 2, None, "c@b.c", "office", None, 30, "")], "id long, job_id long, snapshot_id long, email string, channel_tag string, manual_state string, lead_score int, phone string")
    leads = leads.withColumns({c: F.lit(None).cast("string") for c in ("person_name", "designation", "department")})
    snaps = spark.createDataFrame([(7, 70, "c1", "", "Kerala", "o1", "One", "t")], "id long, source_domain_id long, category_code string, category_title string, state string, org_type string, org_type_title string, title string")
    found = L.facets(leads, snaps, L.LeadFilter(states=("Goa",)))
    assert {tuple(r) for r in found.collect()} == {("state", "Kerala", "Kerala", 1), ("state", "Goa", "Goa", 1), ("state", "Unknown", "Unknown", 1)}
    found = L.facets(leads, snaps, L.LeadFilter(categories=("c1",)))
    assert {tuple(r) for r in found.collect()} == {("category", "c1", "c1", 1), ("category", L.UNKNOWN_CODE, "Unknown", 1), ("org_type", "o1", "One", 1), ("state", "Kerala", "Kerala", 1), ("state", "Goa", "Goa", 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_deep_pages_are_those_of_the_whole(spark):
    rows = spark.range(120_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50))).alias("score"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("at"))
    order = [F.col("score").desc_nulls_last(), F.col("at").asc_nulls_last(), F.col("id").desc()]
    whole = [r.id for r in rows.orderBy(*order).collect()]
    paged = L.Pages(rows, order, 5_000)
    assert len(paged.upto) > 15
    for number, limit in ((1, 10), (0, 10), (100, 100), (1199, 100), (1200, 100), (1201, 100), (7, 13_000), (100_000, 1)):
        assert [r.id for r in paged.page(number, limit).collect()] == whole[(max(1, number) - 1) * limit :][:limit], number
    assert L.Pages(rows.where("false"), order).page(1).count() == 0
