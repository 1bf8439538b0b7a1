import random

import pytest
from pyspark.sql import functions as F

from leadwright.llm.language_id import fit, identify

DATA = "/root/testdata/sf0.1/documents.parquet"


@pytest.fixture(scope="module", params=[("fr", "es"), ("es", "fr")], ids=["es", "fr"])
def told(spark, request):
    """English and German are learned, 2 in 100 of their labels are wrong, and texts of a third language are labelled English. Parts of the learned ones and of a fourth are judged: its name and the share rejected by language and size."""
    third, fourth = request.param
    docs = spark.read.parquet(DATA).where("text is not null and length(text) >= 1200").where("doc_id % 3 = 0")
    mixed = F.when(F.col("doc_id") % 50 == 1, F.when(F.col("lang") == "en", "de").otherwise("en"))
    learned = docs.where("lang in ('en', 'de')").withColumn("lang", F.coalesce(mixed, "lang"))
    odd = docs.where(F.col("lang") == third).limit(12).withColumn("lang", F.lit("en")).withColumn("text", F.concat_ws(" ", "text", "text"))
    model = fit(learned.where("doc_id % 2 = 0").union(odd))
    parts = docs.where("doc_id % 2 = 1").select("lang", F.explode(F.array(*(F.lit(n) for n in (60, 200, 1000)))).alias("size"), "text")
    parts = parts.withColumn("text", F.expr("substr(text, 100, size)"))
    rows = identify(parts, model).groupBy("lang", "size").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
    return fourth, {(r.lang, r["size"]): r.share for r in rows}


def test_unlearned_languages_are_rejected(told):
    fourth, shares = told
    assert all(shares[fourth, size] > least for size, least in ((60, 0.8), (200, 0.9), (1000, 0.95))), shares


def test_learned_languages_are_kept(told):
    shares = told[1]
    assert all(shares[lang, size] < 0.01 for lang in ("en", "de") for size in (60, 200, 1000)), shares


def test_random_letters_are_rejected(spark):
    docs = spark.read.parquet(DATA).where("doc_id % 4 = 0")
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(size))) for i, size in enumerate([100, 300, 1000, 3000] * 10)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string"), fit(docs)).where("not rejected")
    assert got.count() == 0
