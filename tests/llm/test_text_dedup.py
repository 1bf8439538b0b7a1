import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from leadwright.llm.components import connected_components
from leadwright.llm.exact_dedup import DigestIndex, exact_duplicates, later_duplicates, normalised
from leadwright.llm.simhash import fingerprint, linked, simhash_groups
from leadwright.llm.suffix_dedup import remove_repeats, repeated

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, simhash string, component_id string"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def reached(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {x.node: x.component for x in connected_components(docs(spark, edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in reached({n for e in edges for n in e}, edges).items() if n in nodes}
    assert connected_components(docs(spark, [], "a long, b long")).count() == 0


TEXTS = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (3, None), (5, ""), (6, " "), (7, "\n"), (8, "x" * 50_000), (1, "x" * 50_000), (10, "A b"), (11, " "), (11, " ")]


def exact_brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, n in norm:
        groups.setdefault(n, []).append(i)
    return sorted((i, min(groups[n]), len(groups[n]), i == min(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in norm)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """weak: a digest of three values, so that nearly all texts collide and only the bytes tell them apart."""
    digest = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    assert sorted(map(tuple, exact_duplicates(docs(spark, TEXTS), digest=digest).collect())) == exact_brute(TEXTS)


def test_exact_duplicates_edges(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_duplicates(docs(spark, [(None, "a"), (1, "a"), (None, "z")])).collect() if r.group_size == 2}
    assert got == {None: (1, False), 1: (1, True)}
    clash = docs(spark, [(1, "a", "e", "s", 1, "k", "h", "c")], DOCS)
    assert exact_duplicates(clash).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_over_batches_and_levels(spark):
    r = random.Random(4)
    index, seen = DigestIndex(spark, fanout=2), {}
    for batch in range(5):
        rows = [(r.randrange(60), r.randrange(1000)) for _ in range(30)]
        known = {x.digest: (x.keep_id, x.group_size) for x in index.lookup(docs(spark, rows, "digest long, id long")).collect()}
        assert known == {d: (min(seen[d]), len(seen[d])) for d, _ in rows if d in seen}
        index.flush(docs(spark, rows, "digest long, id long"))
        for d, i in rows:
            seen.setdefault(d, []).append(i)
        before = index.live()
        index.compact()
        assert {tuple(x) for x in index.merged().collect()} == {(d, min(i), len(i)) for d, i in seen.items()}
        assert index.run(before[0].run).count()  # a reader of the manifest before can finish
    assert {x.level for x in index.live()} == {0, 2}
    index.compact(whole=True)
    assert len(index.live()) == 1 and {tuple(x) for x in index.run(index.live()[0].run).collect()} == {(d, min(i), len(i)) for d, i in seen.items()}


def test_half_written_change_is_not_seen(spark):
    index = DigestIndex(spark)
    index.flush(docs(spark, [(1, 5)], "digest long, id long"))
    docs(spark, [("nothing", 0, 1, True)], "run string, level int, rows long, live boolean").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{index.path}/manifest-2")
    assert [tuple(x) for x in index.merged().collect()] == [(1, 5, 1)]


@pytest.mark.parametrize("weak", [False, True])
def test_later_batch_against_the_index(spark, weak):
    digest = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    corpus = docs(spark, [(3, "a  b"), (2, "a b"), (5, None), (9, "z")])
    index = DigestIndex(spark)
    batch = docs(spark, [(20, "a\tb"), (20, "a\tb"), (21, ""), (22, "new"), (23, "A b")])
    assert later_duplicates(batch, index, corpus).count() == 0
    index.flush(corpus.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").alias("id")))
    got = sorted(map(tuple, later_duplicates(batch, index, corpus, digest=digest).collect()))
    assert set(got) <= {(20, 2), (21, 5)} and (weak or got == [(20, 2), (20, 2), (21, 5)])
    assert later_duplicates(batch.limit(0), index, corpus).count() == 0


def simhash_brute(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "É x y z"), (6, "é x y z")]
    for i in range(7, 60):
        words = list(base)
        if i % 3:
            words[r.randrange(120)] = f"v{i % 5}"
        rows.append((i, " ".join(words)))
    prints = {i: simhash_brute(t) for i, t in rows}
    assert all(fingerprint(t.encode() if t is not None else None) % (1 << 64) == prints[i] for i, t in rows)
    root = reached(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash_groups(docs(spark, rows)).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i, _ in rows}
    assert len({root[i] for i in root}) < len(root) - 10


def test_ball_links_are_complete(spark):
    r = random.Random(8)
    values = [r.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values for _ in range(2)] + [values[0] ^ 7]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = reached(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2])
    edges = [tuple(x) for x in linked(docs(spark, [(v,) for v in signed], "v long")).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)
    assert reached(signed, edges) == want
    with pytest.raises(ValueError):
        linked(docs(spark, [], "v long"), 3)


def test_long_text_is_counted_in_parts(monkeypatch):
    from leadwright.llm import simhash

    text = " ".join(f"q{i % 37}" for i in range(500))
    monkeypatch.setattr(simhash, "HASHES", 64)
    assert fingerprint(text.encode()) % (1 << 64) == simhash_brute(text)


def test_simhash_edges(spark):
    assert simhash_groups(docs(spark, [])).count() == 0
    assert {tuple(r)[1:] for r in simhash_groups(docs(spark, [(1, "a"), (1, "a"), (None, "a")])).collect()} == {(f"{simhash_brute('a'):016x}", 1)}
    assert simhash_groups(docs(spark, [(1, "a", "e", "s", 1, "k", "h", "c")], DOCS)).columns == ["doc_id", "fingerprint", "component_id"]


def repeats_brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        lost = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                lost[j : j + length] = b"\1" * length
        kept = bytes(x for x, gone in zip(b, lost) if not gone)
        out.append((i, len(b), sum(lost), len(re.findall(b"\1+", bytes(lost))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [2, 6, 8, 12, 40, 400])
def test_bucket_refinement_by_hand(length):
    r = random.Random(length)
    base = [bytes(r.choice(b"ab") for _ in range(length + 30)) for _ in range(3)]
    cut = [bytes(r.choice(b"ab") for _ in range(r.randrange(20))) + r.choice(base)[r.randrange(20) :] + bytes(r.choice(b"ab") for _ in range(r.randrange(20))) for _ in range(25)]
    cut += [b"", b"a", b"ab" * length]
    seen = Counter(c[i : i + length] for c in cut for i in range(len(c) - length + 1))
    want = [(o, i) for o, c in enumerate(cut) for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1]
    owner, inner = repeated(cut, length)
    assert list(zip(owner.tolist(), inner.tolist())) == want and want


@pytest.mark.parametrize(("length", "together", "letters"), [(8, 4000, "ab"), (12, 1, "abc"), (40, 2, "abcdefgh"), (400, 4000, "abcdefgh"), (400, 1, "ab")])
def test_repeats(spark, monkeypatch, length, together, letters):
    """Small pieces and chunks, so that texts are cut; together: buckets beyond it are refined by shuffles."""
    from leadwright.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 50 + length)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300 + 2 * length)
    r = random.Random(length)
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [text(length + d) for d in (-1, 0, 1, 30)]
    rows = [(0, None), (1, ""), (2, "é" * 30), (3, "z" * 90), (4, text(150)), (5, text(150))]
    rows += [(i, text(r.randrange(60)) + r.choice(shared) + text(r.randrange(60)) + r.choice(shared)) for i in range(6, 30)]
    rows += [(30, rows[10][1]), (31, rows[11][1]), (31, rows[11][1]), (None, shared[3])]
    got = sorted((tuple(x)[:5] for x in remove_repeats(docs(spark, rows), length=length, together=together, with_text=False).collect()), key=str)
    assert got == repeats_brute(rows, length)


def test_repeats_edges(spark):
    assert remove_repeats(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "ab" * 300, "e", "s", 1, "k", "h", "c"), (2, "c", "e", "s", 1, "k", "h", "c")], DOCS)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in remove_repeats(clash).collect()}
    assert got == {1: (600, b""), 2: (0, b"c")}
