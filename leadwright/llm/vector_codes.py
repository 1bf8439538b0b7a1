"""Vector code compression: product codes whose codebooks are fitted by delta-maintained Lloyd rounds in integers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.llm.common import new_path, written

#: Vectors of a chunk: one row of the vector table, and one of each round's assignments.
CHUNK = 512
#: Bits of a limb: integer sums travel as signed limbs, whose own sums stay within a long over 2**33 chunks.
LIMB = 30
#: Most buckets of a table; Spark allows no more by default.
BUCKETS = 100_000
#: The mark of a part that has no assignment yet.
NONE = 255
#: Labels whose sums are broadcast; more are joined by salted keys.
LABELS, SALT = 1 << 16, 32
#: Integers whose float64 sums are exact.
EXACT = 1 << 53


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, exactly: float64 where all fit, else Python integers."""
    values = vectors.astype(np.float64)
    if scale & scale - 1 == 0 and (not values.size or np.abs(values).max() * scale < EXACT):  # a power of two rounds nothing
        return np.floor(values * scale)
    return np.array([[_floored(float(x), scale) for x in row] for row in values], object).reshape(values.shape)


def _floored(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


@dataclass
class Codebooks:
    """Entries (parts x entries x width, Python integers) with each entry's running sum and count."""

    entries: list[list[list[int]]]
    sums: dict[int, list[int]] = field(default_factory=dict)
    counts: dict[int, int] = field(default_factory=dict)

    def state(self) -> list:
        return self.entries

    def moved(self, deltas: list[tuple[int, int, int]]) -> Codebooks:
        """The next round's entries: deltas (slot, place, value) are added to the running sums; unused entries stay.

        A slot is part * entries + entry. Place 0 is the count; others are a component's limbs.
        """
        size, width = len(self.entries[0]), len(self.entries[0][0])
        sums, counts = {s: list(v) for s, v in self.sums.items()}, dict(self.counts)
        limbs = {}
        for slot, place, value in deltas:
            if place == 0:
                counts[slot] = counts.get(slot, 0) + value
            else:
                limb, component = divmod(place - 1, width)
                limbs[slot, component] = limbs.get((slot, component), 0) + (value << LIMB * limb)
        for (slot, component), value in limbs.items():
            sums.setdefault(slot, [0] * width)[component] += value
        entries = [[list(e) for e in part] for part in self.entries]
        for slot, n in counts.items():
            if n:
                entries[slot // size][slot % size] = [s // n for s in sums.get(slot, [0] * width)]
        return Codebooks(entries, sums, counts)

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: list) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (n x parts x width): the nearest entry of each part, ties to the lower, and its squared distance.

    Distances are exact: float64 products where none exceeds its integers, else Python integers.
    """
    n, count, width = parts.shape
    most = max((abs(x) for part in entries for entry in part for x in entry), default=0)
    least = int(np.abs(parts).max()) if parts.size else 0
    codes, away = np.zeros((n, count), np.int64), np.zeros((n, count), object)
    if width * (most + least) ** 2 < EXACT // 4:
        away = np.zeros((n, count), np.int64)
        parts = parts.astype(np.float64)
        for p in range(count):
            book = np.array(entries[p], np.float64)
            square = (parts[:, p] ** 2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * parts[:, p] @ book.T
            codes[:, p] = square.argmin(1)
            away[:, p] = square[np.arange(n), codes[:, p]]
        return codes, away
    whole = parts if parts.dtype == object else np.vectorize(int, otypes=[object])(parts)
    for p in range(count):
        square = np.stack([((whole[:, p] - np.array(entry, object)) ** 2).sum(1) for entry in entries[p]], 1)
        for i in range(n):
            best = min(range(square.shape[1]), key=lambda e: square[i, e])
            codes[i, p], away[i, p] = best, square[i, best]
    return codes, away


def changes(parts: np.ndarray, before: np.ndarray, after: np.ndarray, size: int) -> tuple[list[int], list[int], list[int]]:
    """What moves between entries, as slots, places and values that are not 0: minus where a part was, plus where it is now."""
    width, net = parts.shape[2], {}
    for p in range(parts.shape[1]):
        moved = np.flatnonzero(before[:, p] != after[:, p])
        for codes, sign in ((before[moved, p], -1), (after[moved, p], 1)):
            for e in np.unique(codes):
                if e != NONE:
                    some = parts[moved[codes == e], p]
                    if some.dtype != object and np.abs(some).max() * len(some) >= EXACT:
                        some = np.vectorize(int, otypes=[object])(some)
                    total = [int(x) for x in some.sum(0)]
                    n, sums = net.setdefault(p * size + int(e), [0, [0] * width])
                    net[p * size + int(e)] = [n + sign * len(some), [s + sign * t for s, t in zip(sums, total)]]
    slots, places, values = [], [], []
    half, mask = 1 << LIMB - 1, (1 << LIMB) - 1
    for slot, (n, sums) in net.items():
        found = [(0, n)]
        for i, v in enumerate(sums):
            limb = 0
            while v:
                low = ((v + half) & mask) - half
                found.append((1 + limb * width + i, low))
                v, limb = (v - low) >> LIMB, limb + 1
        for place, value in found:
            if value:
                slots.append(slot)
                places.append(place)
                values.append(value)
    return slots, places, values


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad)


def _chunks(rows: DataFrame, width: int) -> DataFrame:
    """Rows (chunk, ids, labels, vectors): CHUNK vectors end to end in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), part.column(1), part.column(2).flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names=["chunk", "ids", "labels", "vectors"])
                number += 1

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"chunk long, ids array<{kinds['id']}>, labels array<{kinds['label']}>, vectors {kinds['vector']}")


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """The rows as files in the shared folder, bucketed by chunk, so that tables of equal buckets join without a shuffle."""
    spark, known = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk").option("path", new_path(spark, name.replace("_", "-"))).saveAsTable(known)
    back = spark.table(known)
    spark.sql(f"drop table {known}")  # the name alone: the files stay, and what was read knows their buckets
    return back


def _round(chunks: DataFrame, before: DataFrame | None, books: Codebooks, scale: int, parts: int) -> DataFrame:
    """Rows (chunk, codes, slots, places, values): this round's assignments as a byte a part, and what changes the sums."""
    told = chunks.sparkSession.sparkContext.broadcast(books.state())
    size = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = told.value
        for batch in batches:
            for chunk, ids, codes, vectors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                n = len(ids.values)
                whole = scaled(np.asarray(vectors.values).reshape(n, -1), scale).reshape(n, parts, -1)
                was = np.full((n, parts), NONE, np.int64) if codes is None else np.frombuffer(codes, np.uint8).reshape(n, parts).astype(np.int64)
                now, _ = nearest(whole, entries)
                moved = changes(whole, was, now, size)
                row = [[chunk], [now.astype(np.uint8).tobytes()], *([m] for m in moved)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["chunk", "codes", "slots", "places", "values"])

    joined = chunks.withColumn("codes", F.lit(None).cast("binary")) if before is None else chunks.join(before.select("chunk", "codes").hint("shuffle_hash"), "chunk")
    return joined.select("chunk", "ids", "codes", "vectors").mapInArrow(run, "chunk long, codes binary, slots array<int>, places array<int>, values array<long>")


def _summed(moved: DataFrame) -> list[tuple[int, int, int]]:
    """The changes of all chunks, added up: a row for each slot and limb."""
    rows = moved.where(F.size("slots") > 0).select(F.explode(F.arrays_zip("slots", "places", "values")).alias("d"))
    rows = rows.groupBy(F.col("d.slots").alias("slot"), F.col("d.places").alias("place")).agg(F.sum("d.values").alias("value")).where("value <> 0")
    return [tuple(r) for r in rows.collect()]


@dataclass
class Fitted:
    """Codebooks after the last round, the vectors in chunks, and the last round's assignments."""

    books: Codebooks | None
    chunks: DataFrame
    codes: DataFrame | None
    scale: int
    parts: int

    def coded(self) -> DataFrame:
        """Rows (id, label, code, error): assigned to the final entries. An error beyond a long is null."""
        spark = self.chunks.sparkSession
        kinds = {f.name: f.dataType.elementType.simpleString() for f in self.chunks.schema if f.name in ("ids", "labels")}
        schema = f"id {kinds['ids']}, label {kinds['labels']}, code string, error long"
        if self.books is None:
            return spark.createDataFrame([], schema)
        told, scale, parts = spark.sparkContext.broadcast(self.books.state()), self.scale, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, vectors in zip(*batch.columns):
                    n = len(ids.values)
                    codes, away = nearest(scaled(np.asarray(vectors.values).reshape(n, -1), scale).reshape(n, parts, -1), told.value)
                    errors = [int(e) if e < 1 << 63 else None for e in away.sum(1)]
                    names = [bytes(c).hex() for c in codes.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(names), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

        return self.chunks.select("ids", "labels", "vectors").mapInArrow(run, schema)


def fit_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Fitted:
    """Fit a codebook for each of `parts` equal parts of the vectors by Lloyd rounds in integers.

    The vectors are dealt once to a table bucketed by chunk. Each round's assignments are a table of a byte a part in
    equal buckets, so a round joins the vectors with the assignments before it where they lie. Only parts whose
    assignment changed contribute: minus to the entry they left and plus to the one they joined. A chunk's contributions
    are netted in its task and shuffled as sums by entry; the driver keeps the running sums and counts, whose number is
    that of the entries. A lost executor costs the running round's tasks; all else lies in the shared folder.

    Entries start as the parts of the smallest ids (equal ids by vector, ids that are null last). Vectors of another length
    than most have (the shorter of equally frequent ones), or without components, are left out as those with a null or
    non-finite component are. parts must divide the length. Entries are at most 255.
    """
    spark: SparkSession = vectors.sparkSession
    if not 0 < entries < NONE:
        raise ValueError("a code is one byte: 1 to 254 entries")
    rows = usable(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vector")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").where("n > 0").first()
    width = usual["n"] if usual else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components are not cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == width)
    buckets = max(spark.sparkContext.defaultParallelism, min(BUCKETS, rows.rdd.getNumPartitions()))
    chunks = _bucketed(_chunks(rows, width).repartition(buckets, "chunk"), "vector_chunks", buckets)
    first = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()]
    if not first:
        return Fitted(None, chunks, None, scale, parts)
    seeds = scaled(np.array(first, np.float64), scale).reshape(len(first), parts, -1)
    books = Codebooks([[[int(x) for x in seed[p]] for seed in seeds] for p in range(parts)])
    codes = None
    for number in range(rounds):
        codes = _bucketed(_round(chunks, codes, books, scale, parts), f"vector_codes_{number}", buckets)
        books = books.moved(_summed(codes))
    return Fitted(books, chunks, codes, scale, parts)


def decoded(code: str, books: Codebooks, scale: int = 4096) -> list[float]:
    """The vector that a code stands for: its entries' components over the scale."""
    return [x / scale for p, e in enumerate(bytes.fromhex(code)) for x in books.entries[p][e]]


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row for each vector kept: id, code, error, label_error and codebooks_sha256.

    Fitted by fit_codes. error is the exact squared distance to the entries, in integers; label_error adds it up over
    rows of equal label, nulls together; beyond a long either is null. Labels' sums are broadcast where there are at most
    LABELS, else joined by salted keys, so that a label of many rows does not meet in one task. Repeated rows are coded
    each; a table without usable vectors gives no rows; other columns of the table play no part.
    """
    fitted = fit_codes(vectors, id_col, vector_col, label_col, parts, entries, rounds, scale)
    told = written(fitted.coded(), "vector-errors")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = (F.count("*") == F.count("error")) & (total <= F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    sums = written(told.groupBy("label").agg(F.when(whole, total.cast("long")).alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    if sums.count() <= LABELS:
        joined = told.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of_label")), "left")
    else:
        salted = told.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)))
        sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
        joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")), "left")
    digest = fitted.books.sha256() if fitted.books else ""
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
