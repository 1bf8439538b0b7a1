import pytest
from pyspark.sql import functions as F

from leadwright.functions import url as U
from leadwright.operators.attribution import attribute, drop_below, netloc_map, snapshots

CATALOG = [(1, "https://tn.gov.in"), (2, "https://rera.tn.gov.in"), (3, "https://mospi.nic.in")]


def resolve(spark, urls, suffixes=(".gov.in", ".nic.in"), catalog=CATALOG):
    domains = spark.createDataFrame(catalog, "id long, main_url string")
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    return {r.u: r.domain_id for r in attribute(rows, netloc_map(domains), "u", "id", suffixes).collect()}


def test_host_resolution(spark):
    want = {
        "https://tn.gov.in/page": 1, "https://www.tn.gov.in/page": 1, "https://tn.gov.in/": 1, "https://tn.gov.in:8080/x": 1, "https://rera.tn.gov.in/contact": 2,
        "https://forms.tn.gov.in/x": 1, "https://forms.unknown.nic.in/x": None, "not a url": None, "https://a.b.mospi.nic.in": 3,
    }
    assert resolve(spark, list(want)) == want


def test_public_suffix_never_matches(spark):
    assert resolve(spark, ["https://random.gov.in/x"], catalog=[*CATALOG, (99, "https://gov.in")]) == {"https://random.gov.in/x": None}
    assert resolve(spark, ["https://random.gov.in/x"], suffixes=()) == {"https://random.gov.in/x": None}


def test_lowest_id_wins_and_ports_stay_in_the_key(spark):
    domains = spark.createDataFrame([(5, "http://www.a.org"), (4, "https://a.org/x"), (6, "https://a.org:81"), (7, None)], "id long, main_url string")
    assert {(r.netloc, r.id) for r in netloc_map(domains).collect()} == {("a.org", 4), ("a.org:81", 6)}


def test_drop_below(spark):
    rows = spark.createDataFrame([("https://a.org/1",), ("https://x.a.org/2",), ("https://ba.org/3",), ("http://b.com",)], "url string")
    kept = drop_below(rows, spark.createDataFrame([("www.a.org",)], "root string"), "url", "root")
    assert {r.url for r in kept.collect()} == {"https://ba.org/3", "http://b.com"}


def test_snapshots_are_made_once(spark):
    have = spark.createDataFrame([(1, 10)], "job_id long, source_domain_id long")
    want = spark.createDataFrame([(1, 10, 0, "old"), (1, 11, 2, "b"), (1, 11, 1, "a")], "job_id long, source_domain_id long, seq long, title string")
    assert [(r.source_domain_id, r.title) for r in snapshots(have, want).collect()] == [(11, "a")]


@pytest.mark.parametrize(
    ("url", "key"),
    [("https://www.A.org/x/", "a.org/x"), ("http://a.org", "a.org/"), ("http://a.org:8/y?b=1#f", "a.org:8/y?b=1"), ("https://a.org/?q", "a.org/?q"), ("nothing", "nothing")],
)
def test_url_key(spark, url, key):
    assert spark.range(1).select(U.url_key(F.lit(url))).first()[0] == key


def test_url_functions(spark):
    c = F.lit
    row = spark.range(1).select(
        U.is_target(c("https://x.gov.in/a"), (".gov.in",)).alias("target"), U.root_url(c("https://x.gov.in/a?b")).alias("root"), U.title_of(c("https://land-records.tn.gov.in")).alias("title"),
        U.with_scheme(c("  a.org/b ")).alias("scheme"), U.with_scheme(c("  ")).alias("blank"), U.is_skippable(c("http://a.org/x.PDF?y"), (".pdf",)).alias("skip"), U.in_scope(c("http://a.gov.in:80/"), (".gov.in",)).alias("port"),
        U.query_value(c("http://a/?Page=3&x"), "page").alias("page"), U.query_value(c("http://a/?x"), "x").alias("empty"), U.query_value(c("http://a/?xx=1"), "x").alias("none"), U.client_ip(c(" 1.2.3.4, 5"), c("9")).alias("ip"),
        U.seed_url(c("m"), c("")).alias("seed"), U.seed_url(c("m"), c("k")).alias("seed2"), U.seed_url(c("m"), c("k"), True).alias("seed3"),
    ).first()
    assert row.asDict() == {"target": True, "root": "https://x.gov.in", "title": "Land Records Tn", "scheme": "http://a.org/b", "blank": None, "skip": True, "port": False, "page": "3", "empty": "", "none": None, "ip": "1.2.3.4", "seed": "m", "seed2": "k", "seed3": "m"}
