import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadwright.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def sample(seed=3, rows=60, size=12):
    r = np.random.default_rng(seed)
    features = [np.flatnonzero(r.random(size) < 0.3) for _ in range(rows)]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    return T.Sample(np.concatenate(features), bounds, (r.random(rows) < 0.3).astype(float), r.integers(0, 3, rows).astype(float)), features


def by_hand(made, features, weights, bias, prior):
    """Both parts of the risk, document by document."""
    z = [bias + sum(weights[i] for i in f) for f in features]
    p, u = made.toxic / made.toxic.sum(), made.unlabelled / made.unlabelled.sum()
    plus = prior * sum(a * np.log1p(np.exp(-x)) for a, x in zip(p, z))
    minus = sum(b * np.log1p(np.exp(x)) for b, x in zip(u, z)) - prior * sum(a * np.log1p(np.exp(x)) for a, x in zip(p, z))
    return plus, minus


def test_risks_and_slopes_by_hand():
    made, features = sample()
    r = np.random.default_rng(1)
    seen = set()
    for scale in (0.1, 1.0, 4.0):
        for prior in (0.05, 0.95):
            made.unlabelled[made.toxic > 0] = prior < 0.5
            weights, bias = r.normal(size=12) * scale, r.normal()
            plus, minus = T.risks(made, weights, bias, prior)
            assert np.allclose((plus, minus), by_hand(made, features, weights, bias, prior))
            whole = lambda w, b: sum(by_hand(made, features, w, b, prior)) if minus >= 0 else -by_hand(made, features, w, b, prior)[1]
            by_weight, by_bias = T.slope(made, weights, bias, prior)
            steps = np.eye(12) * 1e-6
            assert np.allclose(by_weight, [(whole(weights + s, bias) - whole(weights - s, bias)) / 2e-6 for s in steps], atol=1e-6)
            assert np.isclose(by_bias, (whole(weights, bias + 1e-6) - whole(weights, bias - 1e-6)) / 2e-6, atol=1e-6)
            seen.add(minus >= 0)
    assert seen == {True, False}


def test_a_negative_risk_is_raised():
    """Two documents that are toxic and hardly among the unlabelled: the unbiased risk falls without end, the second part does not stay below 0."""
    made = T.Sample(np.array([0, 1]), np.array([0, 1, 2, 2]), np.array([1.0, 1.0, 0.0]), np.array([0.0, 0.0, 50.0]))
    weights, bias = T.descend(made, 2, 0.4, 0.0)
    assert T.risks(made, weights, bias, 0.4)[1] > -0.05




@pytest.fixture(scope="module")
def told(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return T.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").toPandas()


def test_held_out_accuracy(told):
    hit, miss, wrong = (((told.predicted == a) & (told.toxic == b)).sum() for a, b in ((1, 1), (0, 1), (1, 0)))
    assert hit / (hit + miss) > 0.8 and wrong / len(told) < 0.02
    ranks, toxic = told.score.rank(), told.toxic == 1
    assert (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.93
    assert ((told.score >= 0.5) == (told.predicted == 1)).all() and told.score.between(0, 1).all()


def made(spark, n=400):
    r = random.Random(5)
    plain = [" ".join(r.choice(["river", "stone", "house", "green", "walks", "under"]) for _ in range(20)) for _ in range(n)]
    bad = [i % 5 == 0 for i in range(n)]
    rows = [(i, p + (" vile rotter" if b else "")) for i, (p, b) in enumerate(zip(plain, bad))]
    docs = spark.createDataFrame([*rows, (None, "vile rotter"), (n, None), (n + 1, ""), (n + 2, "vile " * 300_000), (n + 2, "river")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad) if i % 2 == 0] + [(2, None), (None, 1)], "doc_id long, toxic int")
    return docs, labels, bad


def test_labels_learned_and_odd_rows(spark):
    docs, labels, bad = made(spark)
    model = T.fit(docs, labels)
    assert 0.15 < model.prior < 0.25
    got = T.score(docs.withColumn("score", F.lit("mine")).withColumn("_source", F.lit(1)), model).collect()
    assert len(got) == docs.count() and all(r._source == 1 for r in got)
    assert all(r.predicted == bad[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 400)
    assert {r.predicted for r in got if r.text and "rotter" in r.text} == {1}
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_labels_of_the_other_fold_teach_nothing(spark):
    docs, labels, _ = made(spark, 200)
    flipped = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda of: sorted(map(str, T.score_held_out(docs, of).collect()))
    assert rows(labels) == rows(flipped)


def test_empty_tables_and_no_toxic_label(spark):
    docs, labels, _ = made(spark, 20)
    assert T.score_held_out(docs.where("false"), labels).count() == 0
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.predicted for r in T.score_held_out(docs, few).collect()} == {0}


def test_words_do_not_end_at_a_piece():
    text = "ab " * 500_000 + "Zürich9x"
    assert T.words_of(text) == {"ab", "zürich", "^züri", "x"}
