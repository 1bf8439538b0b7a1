"""Repeated byte strings: suffix buckets by q-grams, refined by the buckets of later offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import written
from leadwright.llm.grams import Rolling, mixed, sliding_min

#: Suffixes of one text, and bytes of several, that are hashed at once; bounds a task's memory for texts of any length.
PIECE, CHUNK = 1 << 20, 1 << 21
#: Contexts of a bucket that one task refines; larger buckets are refined by shuffles of their suffixes.
TOGETHER = 4000
#: Low bits that carry a position while hashes are compared.
PLACE = np.uint64((1 << 24) - 1)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, and for each piece in them: its text, where it starts in the text and where in the bytes (and the end of the bytes)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        places = np.cumsum([0, *(len(part) for _, _, part in held)])
        return np.frombuffer(b"".join(part for _, _, part in held), np.uint8), np.array([d for d, _, _ in held]), np.array([a for _, a, _ in held]), places

    for doc, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, PIECE):
            part = text[a : a + PIECE + length - 1]
            if held and size + len(part) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((doc, a, part))
            size += len(part)
    if held:
        yield out()


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of set flags; a run also ends before a break."""
    starts = flags.copy()
    starts[1:] &= ~flags[:-1] | breaks[1:]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | breaks[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """Rows (gram, ctx, id, k, start, n): every suffix of at least `length` bytes belongs to one stretch.

    A suffix's q-gram (half the length) with the least hash within its first `length` bytes is its pivot; equal strings of
    `length` bytes have equal pivots at equal distances. A stretch is n suffixes in a row with one pivot: gram is the
    pivot's bucket, ctx identifies all bytes that the stretch's strings cover and the pivot's place in them.
    """
    q = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or b"" for t in part.column(2).to_pylist()]
                for data, doc, offset, place in _chunks(texts, length):
                    grams = Rolling(data, 0).windows(q)
                    least = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
                    pivot = (least & PLACE).astype(np.int64)
                    piece = np.repeat(np.arange(len(doc)), np.diff(place))[: len(pivot)]
                    valid = np.arange(len(pivot)) + length <= place[piece + 1]
                    breaks = np.ones(len(pivot), bool)
                    breaks[1:] = (pivot[1:] != pivot[:-1]) | (piece[1:] != piece[:-1])
                    first, last = _runs(valid, breaks)
                    ctx = Rolling(data, 1).of(first, last + length)
                    with np.errstate(over="ignore"):
                        ctx = mixed(ctx ^ mixed((pivot[first] - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)))
                    of = piece[first]
                    rows = pa.array(doc[of], pa.int64())
                    start = first - place[of] + offset[of]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(grams[pivot[first]]), _signed(ctx), part.column(0).take(rows), part.column(1).take(rows), pa.array(start, pa.int64()), pa.array(last - first + 1, pa.int32())],
                        names=["gram", "ctx", "id", "k", "start", "n"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"gram long, ctx long, id {kind}, k long, start long, n int")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as they travel: compressed in the task that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = pa.array([press.compress(t or b"") for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], packed], names=["id", "k", "packed"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k long, packed binary")


def _contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Rows (gram, ctx, bytes) for the stretches wanted (gram, ctx, id, k, start, n), cut from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                grams, ctxs, cut = [], [], []
                part = batch.slice(at, 200)
                for packed, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = unpack.decompress(packed)
                    for w in want:
                        grams.append(w["gram"])
                        ctxs.append(w["ctx"])
                        cut.append(text[w["start"] : w["start"] + w["n"] + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(ctxs, pa.int64()), pa.array(cut, pa.binary())], names=["gram", "ctx", "bytes"])

    wanted = wanted.groupBy("id", "k").agg(F.collect_list(F.struct("gram", "ctx", "start", "n")).alias("wanted")).select(F.col("id").alias("want_id"), F.col("k").alias("want_k"), "wanted")
    joined = texts.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("k") == F.col("want_k"))).select("packed", "wanted")
    return joined.mapInArrow(run, "gram long, ctx long, bytes binary")


def _suffixes(cut: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of at least `length` bytes: their context, their place in it, their bucket and that of the later offset where the rest starts."""
    q = length // 2
    place = np.cumsum([0, *map(len, cut)])
    buckets = Rolling(np.frombuffer(b"".join(cut), np.uint8), 0).windows(q)
    counts = np.diff(place) - length + 1
    owner = np.repeat(np.arange(len(cut)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place[owner] + inner
    return owner, inner, buckets[at], buckets[at + length - q]


def _split(bucket: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Put the active suffixes into buckets by their keys: a bucket's identifier is its first suffix's place. Returns those that are not alone."""
    if not len(active):
        return active
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    number = np.cumsum(start) - 1
    bucket[active[order]] = active[order[start]][number]
    return np.sort(active[order[np.bincount(number)[number] > 1]])


def repeated(cut: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all strings of `length` bytes in the contexts, those that occur twice or more: their context and their place in it, in order.

    Bucket-pointer refinement: suffixes are put into buckets by their first q bytes, then each bucket is refined by sorting
    on the identifiers of the buckets in which the suffixes' later offsets stand. An identifier covers as many bytes as
    the rounds before have compared, so that each round doubles them; suffixes that are alone leave.
    """
    sizes = np.array([len(c) for c in cut])
    place = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(cut), np.uint8)
    bucket = np.arange(len(data))
    left = np.repeat(place + sizes, sizes) - bucket
    width = min(8, length)
    active = np.flatnonzero(left >= width)
    key = np.zeros(len(active), np.uint64)
    for k in range(width):
        key = key << np.uint64(8) | data[active + k]
    active = _split(bucket, active, key)
    while width < length:
        step = min(width, length - width)
        active = active[left[active] >= width + step]
        active = _split(bucket, active, bucket[active] << 32 | bucket[active + step])
        width += step
    owner = np.searchsorted(place, active, "right") - 1
    return owner, active - place[owner]


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (gram, ctx, spans): runs (a, b) of each context's suffixes whose string stands in another context too."""

    def told(keys: list, cut: list[bytes]) -> pa.RecordBatch:
        owner, inner = repeated(cut, length)
        breaks = np.ones(len(owner), bool)
        breaks[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
        a, b = _runs(np.ones(len(owner), bool), breaks)
        spans: list[list] = [[] for _ in cut]
        for o, x, y in zip(owner[a].tolist(), inner[a].tolist(), inner[b].tolist()):
            spans[o].append({"a": x, "b": y})
        keep = [i for i, s in enumerate(spans) if s]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in keep], pa.int64()), pa.array([keys[i][1] for i in keep], pa.int64()), pa.array([spans[i] for i in keep], kind)], names=["gram", "ctx", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        cut: list[bytes] = []
        size = 0
        for batch in batches:
            for gram, ctx, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size > CHUNK and gram != keys[-1][0]:  # a bucket's contexts stay together
                    yield told(keys, cut)
                    keys, cut, size = [], [], 0
                keys.append((gram, ctx))
                cut.append(data)
                size += len(data)
        if cut:
            yield told(keys, cut)

    together = contexts.select("gram", "ctx", "bytes").repartition("gram").sortWithinPartitions("gram")
    return together.mapInArrow(run, "gram long, ctx long, spans array<struct<a:int,b:int>>")


def _refined_apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same rows as _refined for buckets of any size: each suffix travels by its own two buckets, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                gram, ctx, data = (batch.slice(at, 2000).column(i) for i in range(3))
                owner, inner, first, later = _suffixes(data.to_pylist(), length)
                of = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([gram.take(of), ctx.take(of), pa.array(inner, pa.int32()), _signed(first), _signed(later)], names=["gram", "ctx", "a", "first", "later"])

    suffixes = contexts.select("gram", "ctx", "bytes").mapInArrow(run, "gram long, ctx long, a int, first long, later long")
    shared = suffixes.groupBy("first", "later").agg(F.count("*").alias("seen")).where("seen > 1").drop("seen")
    found = suffixes.join(shared, ["first", "later"]).groupBy("gram", "ctx").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("spans"))
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, together: int = TOGETHER, with_text: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, n_kept and, with_text, kept: the bytes that are left.

    Every byte goes that a string of `length` bytes covers which also starts anywhere else, in the same text or another;
    strings are judged on the input. Suffixes are put into buckets by a q-gram of their first `length` bytes (_stretches),
    which only suffixes of equal strings need share. Stretches whose strings all occur twice are settled by counting;
    only where a bucket holds different surroundings are its suffixes refined, in the tasks that hold whole buckets
    (repeated). Pivot buckets are found by 64-bit hashes, and stretches and the strings of the largest buckets are told
    apart by two of them; nothing is decided by fewer than 128 bits. A bucket with more than `together` contexts is
    refined by shuffles on the buckets of its suffixes' first half and later offset, so none has to fit a task.

    Null counts as empty; texts under `length` bytes keep all; repeated rows repeat each other's strings, so they lose
    them; matches never cross texts; rows without an id are handled like others; an empty table gives an empty one.
    """
    if length % 2 or length < 2:
        raise ValueError("the length must be even")
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    stretches = written(_stretches(plain, length), "stretches")

    distinct = written(stretches.groupBy("gram", "ctx").agg(F.count("*").alias("seen"), F.min(F.struct("id", "k", "start", "n")).alias("at")), "contexts")
    buckets = distinct.groupBy("gram").agg(F.count("*").alias("variety")).where("variety > 1")
    open_ = distinct.join(buckets, "gram").select("gram", "ctx", "seen", "variety", "at.*")
    contexts = _contexts(open_.select("gram", "ctx", "id", "k", "start", "n"), _packed(plain), length)
    contexts = written(contexts, "context-bytes").join(buckets, "gram")
    spans = _refined(contexts.where(F.col("variety") <= together), length).union(_refined_apart(contexts.where(F.col("variety") > together), length))

    twice = distinct.where("seen > 1").select("gram", "ctx", F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("spans"), F.lit(True).alias("all"))
    once = spans.join(distinct.where("seen = 1").select("gram", "ctx"), ["gram", "ctx"]).select("gram", "ctx", "spans", F.lit(False).alias("all"))
    verdict = twice.union(once)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    gone = stretches.join(verdict, ["gram", "ctx"]).select("id", "k", "start", F.explode(F.when(F.col("all"), whole).otherwise(F.col("spans"))).alias("span"))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("k").alias("gone_k")).agg(F.collect_list(F.struct((F.col("start") + F.col("span.a")).alias("a"), (F.col("start") + F.col("span.b")).alias("b"))).alias("gone"))
    joined = _packed(plain).join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("k") == F.col("gone_k")), "left").select("id", "packed", "gone")
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                told: list[tuple] = []
                for packed, lists in zip(part.column(1).to_pylist(), part.column(2)):
                    text = unpack.decompress(packed)
                    cover = lists.values
                    if cover is None or not len(cover):
                        told.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), len(text), text if with_text else None))
                        continue
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, np.asarray(cover.field("a")), 1)
                    np.subtract.at(step, np.asarray(cover.field("b")) + length, 1)
                    lost = np.cumsum(step)[:-1] > 0
                    kept = np.frombuffer(text, np.uint8)[~lost].tobytes()
                    spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                    told.append((len(text), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), len(kept), kept if with_text else None))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([t[i] for t in told], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept"])

    cut = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept binary")
    return (cut if with_text else cut.drop("kept")).withColumnRenamed("id", id_col)
