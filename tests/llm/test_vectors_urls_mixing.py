import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadwright.llm import embedding_dedup
from leadwright.llm.embedding_dedup import embedding_groups
from leadwright.llm.mixing import Mixture, mix, permuted, source_targets
from leadwright.llm.url_filter import BlockedBloom, filter_urls, rule_table


def brute(rows, threshold=0.98):
    ok = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    links = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= threshold:
                links[i].append(j)
    root = {i: rows[i][0] for i in links}
    for _ in range(len(rows)):
        for i in links:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return sorted((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]) for i in links)


@pytest.mark.parametrize("tile", [1024, 8])
def test_embedding_groups(spark, monkeypatch, tile):
    """tile 8: full cells are cut into pairs of shards."""
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    r = np.random.default_rng(4)
    rows, n = [], 0
    for size in (16, 11):
        for c in range(12):
            centre = r.normal(size=size)
            for k in range(10 if c < 3 else 3):
                v = (centre + r.normal(size=size) * (0.05 + 0.03 * c)) * (1 + k)
                rows.append((n, v.astype(np.float32).tolist(), c % 2))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [1.0, None] + [0.0] * 14, 0), (n + 6, [float("nan")] * 16, 0), (n + 7, [float("inf")] * 16, 0), (n + 8, [], 0), (n + 9, [1e30] * 16, 1), (n + 10, [2e30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_groups(df).collect()))
    assert got == brute(rows) and sum(g[1] for g in got) > 50


def test_embedding_edges(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    same = spark.createDataFrame([(3, [1.0, 2.0], 1, "x"), (3, [1.0, 2.0], 1, "x"), (2, [2.0, 4.0], 1, "y")], "vec_id long, embedding array<float>, label int, component_id string")
    assert sorted(map(tuple, embedding_groups(same).collect())) == [(2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]


def test_url_filter(spark):
    urls = {
        1: "https://a.b.COM/en/x?y#z", 2: "http://example.com/en/7", 3: "http://sub.example.com/en/75/q", 4: "http://example.com/en/8", 5: "https://x.net/de/8", 6: "https://example.net/de/8", 7: "https://example.net/de/9",
        8: "https://q.org/es/", 9: "https://q.org/es", 10: "nothing", 11: None, 12: "://com/en/", 13: "http://notcom/en/", 14: "http://com:80/en/", 15: "http://com?/en/", 16: "a://b://com/en/", 17: "http://x.com/EN/",
    }
    pages = spark.createDataFrame([(k, v, "old") for k, v in urls.items()], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rule_table(spark)).collect()}
    assert got == {
        1: ("a.b.com", "/en/x", "com/en/", "block"), 2: ("example.com", "/en/7", "example.com/en/7", "allow"), 3: ("sub.example.com", "/en/75/q", "example.com/en/7", "allow"), 4: ("example.com", "/en/8", "com/en/", "block"),
        5: ("x.net", "/de/8", "net/de/", "allow"), 6: ("example.net", "/de/8", "example.net/de/8", "block"), 7: ("example.net", "/de/9", "net/de/", "allow"), 8: ("q.org", "/es/", "org/es/", "block"), 9: ("q.org", "/es", None, "allow"),
        10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("com", "/en/", "com/en/", "block"), 13: ("notcom", "/en/", None, "allow"), 14: ("com:80", "/en/", None, "allow"), 15: ("com", "", None, "allow"),
        16: ("b:", "//com/en/", None, "allow"), 17: ("x.com", "/EN/", None, "allow"),
    }
    clash = filter_urls(pages.selectExpr("*", "1 as best", "2 as judged_host", "3 as row", "4 as key", "5 as `a.b`"), rule_table(spark))
    assert clash.columns == ["page_id", "url", "best", "judged_host", "row", "key", "a.b", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.rule, r.verdict, r.best, r.judged_host, r.row, r.key, r["a.b"]) for r in clash.collect()} == {k: (*v[2:], 1, 2, 3, 4, 5) for k, v in got.items()}
    assert filter_urls(pages.limit(0), rule_table(spark)).count() == 0
    assert filter_urls(pages.union(pages), rule_table(spark)).count() == 2 * len(urls)
    assert {r.verdict for r in filter_urls(pages, rule_table(spark).limit(0), default="block").collect()} == {"block"}


@pytest.mark.parametrize("n_blocks", [1, 64, 1 << 20])
def test_bloom_loses_nothing(spark, n_blocks):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    probes = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("block"))
    passed = {r.block for r in BlockedBloom(keys, "k", n_blocks).possible(probes, "k").collect()}
    assert set(range(500)) <= passed
    if n_blocks > 1:
        assert len(passed) < 1000


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    both = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit(9)).alias("to")).withColumn("back", permuted(F.col("to"), F.lit(n), F.lit(9), inverse=True)).collect()
    assert sorted(r.to for r in both) == list(range(n)) and all(r.id == r.back for r in both)


def targets_brute(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, target, free = sum(sizes.values()), {}, set(keys)
    while True:
        level = (total - sum(3 * sizes[k] for k in keys if k not in free)) / (sum(weights[k] for k in free) or 1)
        over = {k for k in free if level * weights[k] > 3 * sizes[k]}
        if not over:
            return {k: level * weights[k] if k in free else 3.0 * sizes[k] for k in keys}
        free -= over


def test_targets_and_mix(spark):
    r = random.Random(2)
    rows = [(i, None if i % 41 == 0 else " ".join(["w"] * r.randrange(1, 400)) if i % 17 else " \n", r.choice(["a", "a", "a", "b", "ü", "z", None, ""]) if i < 380 else "tiny") for i in range(400)]
    rows += [(7, "x y z", "a"), (7, "x y z", "a"), (None, "q", "b"), (900, None, "empty"), (901, "one", "é")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, size string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    want = targets_brute(size)
    taken = {}
    for g in got:
        assert g.source_size == size[g.source] and g.target == pytest.approx(want[g.source], rel=1e-9, abs=1e-9) and 0 <= g.taken <= 3 * g["size"]
        taken[g.source] = taken.get(g.source, 0) + g.taken
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 1e-6 for s in size), (want, taken)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def walked(rows, block, shard, seed):
    """The blend by hand: {(shard, source, block, words)} with repeats, and each document's words by shard."""
    from leadwright.llm import mixing

    key = lambda source: "1" if source is None else "0" + source
    by = {}
    for doc, text, source in rows:
        by.setdefault(key(source), []).append((doc, (text or "").split()))
    sizes = {k: sum(len(w) for _, w in docs) for k, docs in by.items()}
    want = targets_brute({(None if k == "1" else k[1:]): n for k, n in sizes.items()})
    slots, lines = {}, {}
    for k, docs in by.items():
        n_buckets = -(-len(docs) // mixing.BUCKET)
        docs = sorted(docs, key=lambda d: (spark_hash((d[0], 8), (seed, 4)) % n_buckets, d[0]))
        line = [(doc, i) for doc, words in docs for i in range(len(words))]
        blocks = [line[i : i + block] for i in range(0, len(line), block)]
        order = []
        for at in range(len(blocks)):
            x = at
            for r in range(1, mixing.ROUNDS + 1):
                seed_key = spark_hash(k, (seed, 4))
                other = (spark_hash((seed_key, 8), (r, 4)) % len(blocks) - x) % len(blocks)
                if spark_hash((seed_key, 8), (r, 4), (max(x, other), 8)) & 1:
                    x = other
            order.append(x)
        left, out = int(want[None if k == "1" else k[1:]] + 1e-9), []
        while left > 0:
            b = order[len(out) % len(blocks)]
            out.append((b, min(left, len(blocks[b]))))
            left -= out[-1][1]
        slots[k], lines[k] = out, blocks
    shards = max(1, sum(map(len, slots.values())) // shard)
    blend, words = [], []
    for k, out in slots.items():
        drawn = sorted(spark_hash(k, (i, 8), (seed, 4)) % shards for i in range(len(out)))  # slots are numbered through the shards
        for s, (b, n) in zip(drawn, out):
            blend.append((s, k, b, n))
            words += [(s, *w) for w in lines[k][b][:n]]
    return sorted(blend), sorted(words)


@pytest.mark.parametrize(("block", "shard", "seed"), [(8, 10, 7), (64, 4096, 3), (5, 3, 1)])
def test_blocks_walked_by_hand(spark, monkeypatch, block, shard, seed):
    """The draw, the permutation and the join by index; a text stays what it was, and each stretch is the words of its block."""
    monkeypatch.setattr("leadwright.llm.mixing.BUCKET", 20)
    r = random.Random(seed)
    rows = [(i, "  ".join(f"d{i}w{k}" for k in range(r.randrange(0, 90))) or None, r.choice(["a", "a", "a", "b", "ü", None])) for i in range(70)]
    made = Mixture(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, place string"), block=block, shard=shard, seed=seed)
    blend, words = walked(rows, block, shard, seed)
    got = made.blocks.collect()
    assert sorted((x.shard, x.source_key, x.block, x.words) for x in got) == blend
    places = {}
    for x in got:
        places.setdefault(x.shard, []).append(x.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted((x.shard, x.doc_id, int(w.partition("w")[2])) for x in made.texts().collect() for w in x.text.split()) == words
    whole = {i: t for i, t, _ in rows}
    assert all(x.text == whole[x.doc_id] or x.text in whole[x.doc_id] and len(x.text.split()) < len(whole[x.doc_id].split()) for x in made.texts().collect())
    assert {x.doc_id: x.taken for x in made.taken().collect()} == {i: sum(w[1] == i for w in words) for i, _, _ in rows}


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r.target, r.taken) for r in mix(blank).collect()} == {(0, 0.0, 0)}
    assert Mixture(blank).texts().count() == Mixture(empty).texts().count() == 0
    twice = spark.createDataFrame([(1, "a b c ", "s"), (1, "a b c ", "s"), (1, "a", "s"), (None, " d e", None)], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in Mixture(twice, weights=(1,)).texts().collect()]  # 4 words of each source
    assert [t for i, t in got if i is None] == [" d e", " d e"] and sum(len(t.split()) for i, t in got if i == 1) == 4
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 5)], "source_key string, size long")
    assert {r.source_key: round(r.target, 6) for r in source_targets(sizes).collect()} == {"0a": 30.0, "0b": 970.0, "0c": 15.0}
