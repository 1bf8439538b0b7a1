import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadwright.functions.addresses import Scanner, marked_spans, with_places
from leadwright.functions.text import bracketed_pattern, clean_emails, emails_in, unbracketed
from leadwright.policy import EMAIL, Policy

PAIRS = Policy().obfuscation
#: Texts on which patterns that go back need quadratic time, or recurse.
LONG = {
    "letters": "a" * 1_000_000,
    "labels": "x@" + "a." * 100_000,
    "labels and a domain": "x@" + "a." * 100_000 + "com",
    "signs": "a@" * 100_000,
    "spaces": "a" + " " * 1_000_000 + "[at]b",
    "marks": "a[hyphen]" * 50_000 + "[at]b",
    "marked labels": "x[at]" + "ab[dot]" * 50_000 + "9",
}


def pieces(seed):
    r = random.Random(seed)
    alphabet = ["a", "bc", "9", "-", "_", ".", "..", "@", "@", " ", "com", "communities", "x1", "é", "%", "[at]", "(at) ", " [AT]", "[dot]", " (dot)", "[hyphen]", " (Hyphen) ", "[", "\n"]
    return ["".join(r.choices(alphabet, k=r.randrange(1, 40))) for _ in range(4000)]


def test_scanner_finds_what_the_patterns_find():
    scanner, shape = Scanner(EMAIL, PAIRS), re.compile(bracketed_pattern(PAIRS))
    for t in pieces(1):
        assert list(scanner.plain(t)) == [m.span() for m in re.finditer(EMAIL, t)], t
        assert list(scanner.with_marks(t)) == [m.span() for m in shape.finditer(t)], t


def test_spark_finds_what_the_patterns_find(spark):
    texts = pieces(2)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = rows.select("i", emails_in(F.col("t"), EMAIL).alias("plain"), marked_spans(F.col("t"), PAIRS).alias("marked"), with_places(F.col("t"), EMAIL, 3).alias("places"))
    shape = re.compile(bracketed_pattern(PAIRS))
    for r in both.collect():
        t = texts[r.i]
        assert r.plain == [m[0] for m in re.finditer(EMAIL, t)], t
        assert r.marked == [m[0] for m in shape.finditer(t)], t
        assert [tuple(p) for p in r.places] == [(m[0], m.start(), t[max(m.start() - 3, 0) : m.end() + 3]) for m in re.finditer(EMAIL, t)], t


def test_other_patterns_are_taken_as_they_are(spark):
    assert [*Scanner(r"\w+@\w+", ()).plain("A@b c@d")] == [(0, 3), (4, 7)]
    assert spark.range(1).select(emails_in(F.lit("A@b c@d"), "[a-c]@[a-z]")).first()[0] == ["A@b", "c@d"]


@pytest.mark.parametrize("name", LONG)
def test_long_runs_take_linear_time(spark, name):
    scanner = Scanner(EMAIL, PAIRS)
    began = time.perf_counter()
    found = list(scanner.plain(LONG[name])), list(scanner.with_marks(LONG[name]))
    assert time.perf_counter() - began < 1.5

    def told(text):
        rows = spark.createDataFrame([(text,)], "t string")
        return rows.select(F.size(emails_in(F.col("t"), EMAIL)).alias("n"), F.size(marked_spans(F.col("t"), PAIRS)).alias("m"), clean_emails(F.col("t"), EMAIL).alias("c"), unbracketed(F.col("t"), PAIRS, EMAIL, (".com",)).alias("u")).first()

    told("a")  # compiles the plan
    began = time.perf_counter()
    got = told(LONG[name])
    assert time.perf_counter() - began < 4
    assert (got.n, got.m) == tuple(map(len, found))
