import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from leadwright.llm import source_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, kept_in=3, top=200):
    """Term by term, with fractions."""
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= kept_in]
        sources = [s for x, s in counts if x == lang]

        def shares(of):
            total = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + floor(Fraction(10**9 * (of[t] + 1), total)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: floor(Fraction((a - b) ** 2, b))
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(ranked) if part == "pair" or n < top]
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in A.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(seed, n=120):
    r = random.Random(seed)
    words = ["Tree", "leaf", "ROOT", "straße", "Äpfel", "äpfel", "naïve", "𠀠x", "ｱ", "b", "c-d", "e_f", "g1h", "zzz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(r.choice(["de", "fr", None]), r.choice(["a", "b", "ü", None, "c"]), " ".join(r.choices(words, k=r.randint(0, 30)))) for _ in range(n)]
    return rows + [("xx", "only", "once"), ("xx", "two", None), ("yy", "s", ""), ("de", "silent", "!!! 123"), (None, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_against_fractions(spark):
    rows = rows_of(1)
    assert got(table(spark, rows)) == by_hand(rows)


def test_blocks_chunks_and_salted_joins(spark, monkeypatch):
    rows = rows_of(2) + [("de", f"s{i}", "tree leaf " * i) for i in range(1, 9)]
    for name, value in (("BLOCK", 3), ("CHUNK_BYTES", 500), ("GROUPS", 1), ("CELLS", 16), ("PIECE", 64)):
        monkeypatch.setattr(A, name, value)
    assert got(table(spark, rows).repartition(3)) == by_hand(rows)


def test_top_and_ties(spark):
    rows = [("l", "a", " ".join(f"t{chr(97 + i)}" for i in range(26))), ("l", "b", "x")] * 3
    assert got(table(spark, rows), top=5) == by_hand(rows, top=5)


def test_long_text_in_pieces(spark, monkeypatch):
    text = "Alpha beta " * 30_000 + "gamma" * 2000
    rows = [("l", "a", text)] * 3 + [("l", "b", "beta")]
    monkeypatch.setattr(A, "PIECE", 1000)
    assert got(table(spark, rows)) == by_hand(rows)


def test_empty_repeated_and_extra_columns(spark):
    assert got(table(spark, [])) == []
    rows = rows_of(3, 40) * 2
    df = table(spark, rows).withColumn("term", F.lit(1)).withColumn("chunk", F.lit(2)).withColumn("known", F.lit(3)).withColumn("n", F.lit(4))
    assert got(df) == by_hand(rows)


@pytest.mark.parametrize("total", [1, 10**6, 4 * 10**15])
def test_shares_are_exact(total):
    r = random.Random(total)
    for _ in range(300):
        kinds, count = r.randint(1, 10**6), r.randint(0, total)
        assert A.share_of([count], total, kinds)[0] == 1 + 10**9 * (count + 1) // (total + kinds)
