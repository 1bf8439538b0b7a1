import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadwright.llm import vector_codes as V


def lloyd(rows, parts, entries, rounds, scale):
    """All of it with Python integers, vector by vector."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = []
    for r in kept:
        ratio = [float(x).as_integer_ratio() for x in r[1]]
        ints = [a * scale // b for a, b in ratio]
        w = len(ints) // parts
        whole.append([ints[p * w : (p + 1) * w] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))[:entries]
    books = [[list(whole[i][p]) for i in order] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (away(v[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(parts)] for v in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(whole, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out, by_label = [], {}
    for r, v in zip(kept, whole):
        c = [near(v, p) for p in range(parts)]
        error = sum(away(v[p], books[p][c[p]]) for p in range(parts))
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{x:02x}" for x in c), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, long(e), long(by_label[label]), digest) for i, c, e, label in out), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def got(df, **options):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.vector_codes(df, **options).collect()), key=str)


def vectors(seed, n=150, size=8, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(size)], r.choice([1, 2, None])) for i in r.sample(range(10**6), n)]
    return rows + [(5, rows[0][1], 1), (6, rows[0][1], 1)]


@pytest.mark.parametrize("spread", [1.0, 1e5, 3e7])
def test_against_integers_by_hand(spark, spread):
    rows = vectors(int(spread), spread=spread)
    assert got(table(spark, rows), parts=2, entries=5, rounds=3) == lloyd(rows, 2, 5, 3, 4096)


def test_very_large_and_small_components(spark):
    rows = vectors(8, 20)[:20] + [(70, [1e300, -1e300, 5e-324, 0.0, -5e-324, 1.0, 2.0, 3.0], 2), (71, [1e300] * 8, None)]
    assert got(table(spark, rows, "double"), parts=2, entries=4, rounds=2) == lloyd(rows, 2, 4, 2, 4096)


def test_odd_rows(spark):
    rows = vectors(9, 40)
    odd = [(1, None, 1), (2, [1.0, None] * 4, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 2), (None, [0.5] * 8, 1), (7, [], 1), (8, [1.0, 2.0], 1)]
    want = lloyd(rows + [odd[4]], 2, 5, 2, 4096)
    df = table(spark, rows + odd).withColumn("chunk", F.lit(1)).withColumn("codes", F.lit("x")).withColumn("id", F.lit(2))
    assert got(df, parts=2, entries=5, rounds=2) == want
    assert got(table(spark, odd[:4])) == got(table(spark, [])) == []


def test_fewer_vectors_than_entries_and_one_value(spark):
    rows = vectors(10, 3)
    assert got(table(spark, rows), parts=4, entries=16, rounds=6) == lloyd(rows, 4, 16, 6, 4096)
    same = [(i, [1.0] * 8, 1) for i in range(40)]
    assert got(table(spark, same), parts=4, entries=16, rounds=2) == lloyd(same, 4, 16, 2, 4096)


def test_only_changed_parts_contribute(spark):
    rows = vectors(11, 300)
    df = table(spark, rows)
    fitted = V.fit_codes(df, parts=2, entries=4, rounds=12)
    again = V._round(fitted.chunks, fitted.codes, fitted.books, 4096, 2)
    moved = again.select(F.explode(F.arrays_zip("places", "values")).alias("d")).where("d.places = 0").count()
    first = V._round(fitted.chunks, None, fitted.books, 4096, 2).select(F.explode(F.arrays_zip("places", "values")).alias("d")).where("d.places = 0").count()
    assert moved < first
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    size, sums = len(fitted.books.entries[0]), {}
    for codes, vectors_ in zip(fitted.codes.orderBy("chunk").collect(), fitted.chunks.orderBy("chunk").collect()):
        whole = V.scaled(np.array(vectors_.vectors, np.float64).reshape(len(vectors_.ids), -1), 4096).reshape(len(vectors_.ids), 2, -1)
        for v, c in zip(whole, np.frombuffer(codes.codes, np.uint8).reshape(-1, 2)):
            for p in range(2):
                n, total = sums.get(p * size + int(c[p]), (0, np.zeros(whole.shape[2])))
                sums[p * size + int(c[p])] = n + 1, total + v[p]
    assert {s: (n, list(map(int, t))) for s, (n, t) in sums.items()} == {s: (n, fitted.books.sums[s]) for s, n in fitted.books.counts.items() if n}


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    rows = vectors(12, 60)
    monkeypatch.setattr(V, "LABELS", 1)
    assert got(table(spark, rows), parts=2, entries=5, rounds=2) == lloyd(rows, 2, 5, 2, 4096)


def test_decoding(spark):
    rows = vectors(13, 50)
    df = table(spark, rows)
    fitted = V.fit_codes(df, parts=2, entries=5, rounds=3)
    row = fitted.coded().first()
    vector = next(v for i, v, _ in rows if i == row.id)
    assert sum((np.floor(4096 * a) - 4096 * b) ** 2 for a, b in zip(vector, V.decoded(row.code, fitted.books))) == row.error
