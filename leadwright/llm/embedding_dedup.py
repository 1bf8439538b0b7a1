"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadwright.llm.common import written
from leadwright.llm.components import connected_components, smallest_reached

#: Dimensions of a block of the rotated space.
BLOCK = 8
#: Vectors of a cell that meet in one tile; larger cells are cut into shards of half as many, and pairs of shards meet.
TILE = 1024
#: Added to every budget of a block, so that rounding loses no pair; the verification is exact.
SLACK = 1e-9
#: Added to a block's budget where its coordinates are float32.
ROUNDED = 1e-5


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]


def unscaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is about 1: no product of theirs overflows or vanishes, and their cosines are the same to the bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated space."""
    scaled = unscaled(vectors)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def cells(points: np.ndarray, side: float, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For points of one block: (rows, cell keys, whether it is their own), every cell that a point's ball of this radius touches and that does not come before its own.

    A pair within the radius then meets in the later of its two cells. side is at least twice the radius, so a ball
    reaches over at most one face in each direction.
    """
    place = np.floor(points / side).astype(np.int64)
    inner = points - place * side
    step = np.where(inner < side / 2, -1, 1)
    gap = np.minimum(inner, side - inner) ** 2
    rows, cost, moved = np.arange(len(points)), np.zeros(len(points)), place.copy()
    for d in range(points.shape[1]):
        reach = cost + gap[rows, d] <= radius**2 + SLACK
        more = moved[reach].copy()
        more[:, d] += step[rows[reach], d]
        rows, cost, moved = np.concatenate([rows, rows[reach]]), np.concatenate([cost, cost[reach] + gap[rows[reach], d]]), np.concatenate([moved, more])

    def key(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for d in range(x.shape[1]):
            out = out * 256 + (x[:, d] + 128)
        return out

    with np.errstate(over="ignore"):
        own, at = key(place)[rows], key(moved)
    keep = at >= own
    yield rows[keep], at[keep], at[keep] == own[keep]


def _placed(reps: DataFrame, threshold: float) -> DataFrame:
    """Rows (label, block, cell, rep, own, point): the cells where each vector meets others, with its coordinates in the block as float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(2)
                sizes = np.asarray(lists.value_lengths())
                for size in np.unique(sizes):
                    some = part.take(pa.array(np.flatnonzero(sizes == size)))
                    vectors = np.asarray(some.column(2).flatten()).reshape(-1, size)
                    points = rotated(vectors.astype(np.float64))
                    for b, dims in enumerate(blocks_of(int(size))):
                        radius = np.sqrt((2 - 2 * threshold) * (dims.stop - dims.start) / size)
                        raw = pa.array([v.tobytes() for v in points[:, dims].astype(np.float32)], pa.binary())
                        for rows, cell, own in cells(points[:, dims], max(4 / np.sqrt(size), 2 * radius + SLACK), radius):
                            of = pa.array(rows)
                            yield pa.RecordBatch.from_arrays(
                                [some.column(0).take(of), pa.array(np.full(len(rows), size * 4096 + b), pa.int64()), pa.array(cell), some.column(1).take(of), pa.array(own), raw.take(of)],
                                names=["label", "block", "cell", "rep", "own", "point"],
                            )

    kind = reps.schema["label"].dataType.simpleString()
    return reps.select("label", "rep", "vector").mapInArrow(run, f"label {kind}, block long, cell long, rep long, own boolean, point binary")


def _met_at_home(own: np.ndarray, shard: np.ndarray, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a tile meet which: one of a pair is in its own cell; in a tile of two shards, one is of each."""
    home, guest = np.flatnonzero(own), np.flatnonzero(~own)
    if a == b:
        return [(home, home), (home, guest)]
    first = shard == a
    return [(np.flatnonzero(x), np.flatnonzero(y)) for x, y in ((own & first, own & ~first), (own & first, ~own & ~first), (own & ~first, ~own & first))]


def _close(tiles: DataFrame, threshold: float) -> DataFrame:
    """The tiles' rows without their points, those alone that have a partner within the block's budget."""

    def told(key: tuple, rows: list[tuple]) -> list[tuple]:
        points = np.stack([np.frombuffer(r[3], np.float32) for r in rows]).astype(np.float64)
        own, shard = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        budget = (2 - 2 * threshold) * points.shape[1] / (key[1] // 4096) + ROUNDED
        square = (points**2).sum(1)
        close = np.zeros(len(rows), bool)
        for a, b in _met_at_home(own, shard, key[3], key[4]):
            near = square[a][:, None] + square[b][None, :] - 2 * points[a] @ points[b].T <= budget
            near &= a[:, None] != b[None, :]
            close[a[near.any(1)]] = True
            close[b[near.any(0)]] = True
        return [(*key, r[2], r[0], r[1]) for r, keep in zip(rows, close) if keep]

    order = ["label", "block", "cell", "a", "b"]
    columns = [*order, "shard", "rep", "own"]
    kinds = {f.name: pa.int64() for f in tiles.schema if f.name in columns} | {"own": pa.bool_(), "a": pa.int32(), "b": pa.int32(), "shard": pa.int32(), "label": to_arrow_type(tiles.schema["label"].dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds[c]) for i, c in enumerate(columns)], names=columns)

        for batch in batches:
            for label, block, cell, a, b, shard, rep, own, point in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, block, cell, a, b) != key:
                    if len(rows) > 1:
                        found += told(key, rows)
                    key, rows = (label, block, cell, a, b), []
                    if len(found) > 10_000:
                        yield out()
                        found = []
                rows.append((rep, own, shard, point))
        if len(rows) > 1:
            found += told(key, rows)
        yield out()

    kind = tiles.schema["label"].dataType.simpleString()
    rows = tiles.select(*columns[:7], "own", "point").repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"label {kind}, block long, cell long, a int, b int, shard int, rep long, own boolean")


def _matched(points: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in points) of a x b that are within the budget of this block and of none before it, and whose cosine reaches the threshold."""
    size = points.shape[1]

    def within(x: np.ndarray, y: np.ndarray, dims: slice) -> np.ndarray:
        budget = (2 - 2 * threshold) * (dims.stop - dims.start) / size + SLACK
        return ((x[:, None, dims] - y[None, :, dims]) ** 2).sum(2) <= budget if len(x) * len(y) < 4096 else (x[:, dims] ** 2).sum(1)[:, None] + (y[:, dims] ** 2).sum(1)[None, :] - 2 * x[:, dims] @ y[:, dims].T <= budget

    dims = blocks_of(size)
    hit = within(points[a], points[b], dims[block])
    for before in dims[:block]:
        if not hit.any():
            break
        hit &= ~within(points[a], points[b], before)
    i, j = np.nonzero(hit)
    i, j = a[i], b[j]
    keep = np.zeros(len(i), bool)
    norm = np.linalg.norm(vectors, axis=1)
    for at in range(0, len(i), 1 << 17):
        x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        keep[at : at + (1 << 17)] = np.einsum("nd,nd->n", vectors[x], vectors[y]) / (norm[x] * norm[y]) >= threshold
    return i[keep], j[keep]


def _met(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, links, other): partial numbers of links, and edges that join what a tile joins."""

    def told(key: tuple, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        block = key[1] % 4096
        vectors = unscaled(np.stack([np.frombuffer(r[2], np.float32 if len(r[2]) == 4 * (key[1] // 4096) else np.float64) for r in rows]).astype(np.float64))
        points = rotated(vectors)
        rep, weight, own, shard = (np.array([r[c] for r in rows]) for c in (0, 1, 3, 4))
        pairs = [_matched(points, vectors, a, b, block, threshold) for a, b in _met_at_home(own, shard, key[3], key[4])]
        if key[3] == key[4]:  # those at home meet in both directions
            pairs[0] = tuple(x[pairs[0][0] < pairs[0][1]] for x in pairs[0])
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        root = smallest_reached(len(rows), i, j)
        some = np.flatnonzero(links > 0)
        return rep[some], links[some].astype(np.int64), rep[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        found: list[tuple[np.ndarray, ...]] = []
        count = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in range(3)], names=["rep", "links", "other"])

        for batch in batches:
            for label, block, cell, a, b, shard, rep, weight, vector, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, block, cell, a, b) != key:
                    if len(rows) > 1:
                        found.append(told(key, rows))
                        count += len(found[-1][0])
                    key, rows = (label, block, cell, a, b), []
                    if count > 10_000:
                        yield out()
                        found, count = [], 0
                rows.append((rep, weight, vector, own, shard))
        if len(rows) > 1:
            found.append(told(key, rows))
        if found:
            yield out()

    order = ["label", "block", "cell", "a", "b"]
    return tiles.select(*order, "shard", "rep", "weight", "vector", "own").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "rep long, links long, other long")


def _tiles(placed: DataFrame) -> DataFrame:
    """Cells of up to TILE vectors as one tile (a = b = 0); larger ones as pairs of shards a <= b, where each vector stands in every pair of its shard. Only the larger cells' sizes are joined."""
    cell = ["label", "block", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    sizes = sizes.select(*cell, F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("cut"))
    rows = placed.join(sizes, cell, "left").withColumn("shards", F.coalesce("cut", F.lit(1)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    rows = rows.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return rows.select(*cell, "rep", "own", "point", "shard", F.least("shard", "peer").alias("a"), F.greatest("shard", "peer").alias("b"))


def _with_vectors(close: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows with their weight, and the vector's bytes as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            raw = pa.array([np.asarray(lists[i].values).tobytes() for i in range(len(lists))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["rep", "weight", "vector"])

    wanted = reps.select("rep", "weight", "vector").join(close.select("rep").distinct(), "rep", "left_semi")
    return close.join(wanted.mapInArrow(run, "rep long, weight long, vector binary"), "rep")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id and kept.

    Vectors of one label (not null) and length link when the cosine in double precision is at least the threshold. Unit
    vectors with that cosine are within a squared distance of 2 - 2 * threshold; cut into blocks of the rotated space,
    one block at least is within its share. Each block is range-joined on a grid, all rows against all: a vector's
    coordinates in the block stand in its own cell and in those after it that its ball touches. Only rows with a partner
    within the block's share get their vectors, with which candidates are verified exactly; a pair counts in the first
    block that proposes it. Equal vectors travel once, with their number; of a tile's links only counts and a
    spanning forest leave it, and a full cell is split into pairs of shards, so neither groups nor pairs pile up.

    n_links counts other rows linked directly, component_id is the smallest id that links reach, itself included. Vectors
    that are null, empty or zero or hold null or non-finite components, and rows without a label, link with nothing.
    Components may be as large or small as a double: vectors are scaled by powers of two before they are compared.
    Repeated rows are vectors of their own; an empty table gives an empty one.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0)
    usable = base.withColumn("good", F.coalesce(good, F.lit(False)))
    reps = written(usable.where("good").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).where("rep is not null"), "distinct-vectors")

    close = written(_close(_tiles(_placed(reps, threshold)), threshold), "vector-candidates")
    met = written(_met(_with_vectors(close, reps), threshold), "vector-links")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = connected_components(met.select("rep", "other"))
    told = reps.join(links, "rep", "left").join(nodes, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = usable.join(told, F.col("good") & (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
