"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadwright.llm.common import written

#: Documents of a language that a kept term stands in, at least, and the ranks of terms that a source returns.
KEPT_IN, TOP = 3, 200
#: Probabilities are counted in parts of this many.
UNIT = 1_000_000_000
#: Bytes of text for each chunk of the dictionary of a language.
CHUNK_BYTES = 8 << 20
#: Bytes of text that are counted at once, and cells of a dense array.
PIECE, CELLS = 4 << 20, 1 << 18
#: Sources that meet in a block; more are audited in pairs of blocks.
BLOCK = 256
#: Groups, and bytes of their names, that are broadcast with the chunks; more are joined by salted keys.
GROUPS, GROUP_BYTES, SALT = 1 << 16, 8 << 20, 32

#: Bytes that are no part of a term become spaces, A-Z become a-z; all bytes of other characters stay.
_FOLD = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces of about PIECE bytes that end where a term does."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        to = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def share_of(count: np.ndarray, total: int | np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + kinds)) in int64, exactly: three steps of a thousand each keep the products small."""
    below = np.asarray(total + kinds, np.int64)
    rest = np.asarray(count, np.int64) + 1
    out = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) in int64; shares are below 2^31, so no square is too large."""
    d = p - q
    return d * d // q


def tallied(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts end to end, each with its group: their terms once each, and by group and term the places in those, how often and in how many texts."""
    term = data != 32
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = term[:-1], term[1:]
    some = np.flatnonzero(np.diff(bounds))
    before[bounds[some]] = after[bounds[some + 1] - 1] = False
    starts, ends = np.flatnonzero(term & ~before), np.flatnonzero(term & ~after) + 1
    cuts = np.concatenate([np.zeros(1, np.int32), np.cumsum(ends - starts).astype(np.int32)])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[term])]).dictionary_encode()
    size = max(len(words.dictionary), 1)
    text = np.searchsorted(bounds, starts, "right") - 1
    once, often = np.unique(text * size + np.asarray(words.indices), return_counts=True)
    cells, where = np.unique(group[once // size] * size + once % size, return_inverse=True)
    return words.dictionary, cells // size, cells % size, np.bincount(where, often, len(cells)).astype(np.int64), np.bincount(where, minlength=len(cells))


def _counted(docs: DataFrame, chunks: int) -> DataFrame:
    """Rows (lang, source, chunk, term, n, docs): how often a term occurs and in how many documents, partly added up in tasks.

    Texts are counted together, up to PIECE bytes of them; a longer one alone, piece by piece.
    """
    names = ["lang", "source", "term", "n", "docs"]
    fold = np.frombuffer(_FOLD, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(2))).astype(np.int64)
            upto = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + PIECE, "right")))
                part = batch.slice(at, to - at)
                if sizes[at] > PIECE:
                    n = Counter()
                    for piece in terms_of(part.column(2)[0].as_py()):
                        n.update(piece)
                    lang, source, terms = part.column(0), part.column(1), pa.array(list(n), pa.binary())
                    group = place = np.arange(len(n))
                    group, often, texts = group * 0, np.fromiter(n.values(), np.int64, len(n)), np.ones(len(n), np.int64)
                else:
                    data = fold[np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8)]
                    lang, source = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                    both = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
                    known, group = np.unique(both, return_inverse=True)
                    lang, source = lang.dictionary.take(pa.array(known // len(source.dictionary))), source.dictionary.take(pa.array(known % len(source.dictionary)))
                    terms, group, place, often, texts = tallied(data, np.concatenate([[0], np.cumsum(sizes[at:to])]), group)
                at = to
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(group)), source.take(pa.array(group)), terms.take(pa.array(place)), pa.array(often), pa.array(texts)], names=names)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0").mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.select("lang", "source", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), "term", "n", "docs")


def _encoded(counted: DataFrame, kept_in: int) -> DataFrame:
    """A row for each language and chunk: the sorted kept terms, the sources that have any, and their counts by source, term id and number.

    A term's id is its place in the sorted array, found there by search; equal ids of a source are added up.
    """

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        words = pc.dictionary_encode(rows["term"].combine_chunks())
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        order = np.asarray(pc.sort_indices(words.dictionary))  # by bytes, as UTF-8 orders
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[np.asarray(words.indices)]
        stands = np.bincount(at, np.asarray(rows["docs"]).astype(np.float64), len(order))
        kept = np.flatnonzero(stands >= kept_in)
        id_of = np.searchsorted(kept, at)
        there = np.flatnonzero((id_of < len(kept)) & (kept[np.minimum(id_of, max(len(kept) - 1, 0))] == at)) if len(kept) else np.zeros(0, np.int64)
        names = pc.dictionary_encode(rows["source"].combine_chunks().take(pa.array(there)))
        cell = np.asarray(names.indices).astype(np.int64) * max(len(kept), 1) + id_of[there]
        cells, where = np.unique(cell, return_inverse=True)
        n = np.zeros(len(cells), np.int64)
        np.add.at(n, where, np.asarray(rows["n"]).astype(np.int64)[there])
        source = (cells // max(len(kept), 1)).astype(np.int64)
        totals = np.zeros(len(names.dictionary), np.int64)
        np.add.at(totals, source, n)
        terms = words.dictionary.take(pa.array(order[kept]))

        def single(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = [rows["lang"].combine_chunks().slice(0, 1), rows["chunk"].combine_chunks().slice(0, 1), single(terms), single(names.dictionary), single(pa.array(totals)), single(pa.array(source)), single(pa.array(cells - source * max(len(kept), 1))), single(pa.array(n))]
        return pa.Table.from_arrays(columns, names=["lang", "chunk", "terms", "sources", "totals", "of", "ids", "counts"])

    kinds = "lang string, chunk long, terms array<binary>, sources array<string>, totals array<long>, of array<long>, ids array<long>, counts array<long>"
    return counted.groupBy("lang", "chunk").applyInArrow(encode, kinds)


def _best(values: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The places of the `top` largest values, ties to the smaller id."""
    if len(values) > top:
        some = np.flatnonzero(values >= np.partition(values, len(values) - top)[len(values) - top])
        values, ids = values[some], ids[some]
    else:
        some = np.arange(len(values))
    return some[np.lexsort((ids, -values))][:top]


def _compared(units: DataFrame, top: int) -> DataFrame:
    """Rows (lang, s, t, term, value) of units, each a chunk with two blocks of its language's sources.

    term null: value is the pair's sum over the chunk's kept terms, of sources by number in the language. Else value is
    that of source s's term against the language; only each unit's `top` of a source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        names = ["lang", "s", "t", "term", "value"]

        def pairs() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), found in sums.items():
                s, t = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s + i * BLOCK), pa.array(t + j * BLOCK), pa.nulls(len(s), pa.binary()), pa.array(found[s, t])], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                lang, terms, sources, of, ids, counts, known, totals, kinds, i, j = (batch.column(c)[row] for c in range(batch.num_columns))
                lang, kinds, i, j = lang.as_py(), kinds.as_py(), i.as_py(), j.as_py()
                of, ids, counts, totals = (np.asarray(x.values) for x in (of, ids, counts, totals))
                place = np.asarray(pc.index_in(sources.values, known.values)).astype(np.int64)
                of = place[of]
                a, b = (slice(x * BLOCK, min((x + 1) * BLOCK, len(totals))) for x in (i, j))
                held = sums.setdefault((lang, i, j), np.zeros((a.stop - a.start, b.stop - b.start), np.int64))
                whole = np.zeros(len(terms.values), np.int64)
                np.add.at(whole, ids, counts)
                q = share_of(whole, int(totals.sum()), kinds)
                wide = max(1, CELLS // max(a.stop - a.start, b.stop - b.start))
                for first in range(0, len(q), wide):
                    last = min(first + wide, len(q))

                    def shares(block: slice) -> tuple[np.ndarray, np.ndarray]:
                        some = (of >= block.start) & (of < block.stop) & (ids >= first) & (ids < last)
                        dense = np.zeros((block.stop - block.start, last - first), np.int64)
                        dense[of[some] - block.start, ids[some] - first] = counts[some]
                        return dense, share_of(dense, totals[block][:, None], kinds)

                    dense, p = shares(a)
                    others = p if i == j else shares(b)[1]
                    for t in range(len(others)):
                        held[:, t] += divergence(p, others[t][None, :]).sum(1)
                    if i == j:
                        f = divergence(p, q[None, first:last])
                        for s in range(len(p)):
                            some = np.flatnonzero((dense[s] > 0) & (p[s] > q[first:last]))
                            some = some[_best(f[s, some], some, top)]
                            if len(some):
                                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), s + a.start)), pa.nulls(len(some), pa.int64()), terms.values.take(pa.array(some + first)), pa.array(f[s, some])], names=names)
                if len(sums) > 8:
                    yield from pairs()
                    sums.clear()
        yield from pairs()

    return units.select("lang", "terms", "sources", "of", "ids", "counts", "known", "ns", "kinds", "i", "j").mapInArrow(run, "lang string, s long, t long, term binary, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", kept_in: int = KEPT_IN, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each source of a language against the others and against the language.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each task counts its texts' terms by
    language and source, and by document; a language's terms are dealt by hash into chunks whose number follows the bytes
    of text. A chunk's kept terms (in at least `kept_in` documents) are a sorted array, occurrences become places in it,
    and each source's counts a dense vector. Sums over all chunks give every source's N and the language's V; then the
    chunks are read again, shares are compared in int64 without rounding, and a pair's sums and a source's best terms of
    each chunk are added up and merged. One task holds one chunk and at most BLOCK sources at once; more sources meet in
    pairs of blocks. The groups' names and sizes are broadcast where they are few and short, else joined by salted keys.

    Null text, lang and source count as empty; groups without terms have shares of no occurrences; where a language keeps no
    term, a pair's value is 0 and no term is returned; repeated rows count each; an empty table gives no rows; other columns
    of the table play no part. Terms of equal value rank in UTF-8 order. Counts must stay below 9e15.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    encoded = written(_encoded(_counted(plain, int(size) // CHUNK_BYTES + 1), kept_in), "term-chunks")

    found = encoded.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.totals").alias("n"))
    groups = plain.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n")).union(found).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kinds = encoded.groupBy("lang").agg(F.sum(F.size("terms")).alias("kinds"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all")).join(kinds, "lang", "left")
    langs = written(langs.select("lang", F.col("all.source").alias("known"), F.col("all.n").alias("ns"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds")), "term-groups")

    held = langs.agg(F.sum(F.size("known")), F.sum(F.octet_length(F.array_join("known", "")))).first()
    if (held[0] or 0) <= GROUPS and (held[1] or 0) <= GROUP_BYTES:
        units = encoded.join(F.broadcast(langs), "lang")
    else:
        salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        units = encoded.withColumn("salt", F.pmod("chunk", F.lit(SALT))).join(salted, ["lang", "salt"])
    last = ((F.size("known") - 1) / BLOCK).cast("long")
    units = units.where(F.size("terms") > 0)
    for name in ("i", "j"):
        units = units.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    compared = written(_compared(units, top), "term-values")

    numbers = langs.select("lang", F.col("known"), F.explode(F.sequence(F.lit(0), F.size("known") - 1)).alias("s"))
    numbers = numbers.select("lang", F.col("s").cast("long").alias("s"), F.element_at("known", F.col("s") + 1).alias("source"))
    every = numbers.select("lang", "s").repartition("lang", "s").join(langs.select("lang", F.sequence(F.lit(0).cast("long"), F.size("known").cast("long") - 1).alias("ts")), "lang")
    every = every.select("lang", "s", F.explode("ts").alias("t"), F.lit(0).cast("long").alias("value")).where("s <> t")
    pairs = compared.where("term is null and s <> t").select("lang", "s", "t", "value").union(every).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    pairs = pairs.join(numbers, ["lang", "s"]).join(numbers.select("lang", F.col("s").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))

    best = compared.where("term is not null").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)))
    for by in (["lang", "s", "salt"], ["lang", "s"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    best = best.join(numbers, ["lang", "s"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.union(best)
