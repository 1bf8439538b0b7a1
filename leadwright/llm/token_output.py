"""Token ids in Parquet list columns, in document order, for selective reads."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.llm.common import new_path, text_groups, worker_state
from leadwright.llm.stretches import ROOM, StretchTable

#: Bytes of a row group and rows of a page of the files.
ROW_GROUP, PAGE_ROWS = 16 << 20, 256


def _table(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(9, 14), *values]] = True
    return out


#: Bytes that may end white space other than a space, and that may begin white space: of ASCII, or of the longer characters of White_Space (fixed values).
ENDS, BEGINS = _table(*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF), _table(0x20, 0xC2, 0xE1, 0xE2, 0xE3)


class Encoder:
    """The ids of texts by a byte-level BPE of the tokenizers library, without its special tokens being added.

    Byte-level BPE works on each piece of its split pattern alone. A space after another character than a space begins a
    piece, unless other white space is before it and white space after it. So a text is cut before such spaces, and the
    library encodes each distinct stretch once. Special tokens that stand in a text are one id, as the library makes them.
    """

    def __init__(self, path: str, room: int = ROOM):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.model = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        # The split pattern of byte-level BPE (fixed value), words first as they are most; then the same for Latin text alone.
        split = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        letters, numbers = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
        self.beyond_latin = re.compile("[^\\n\\t\\r\\x20-\\x7e\\xa1-\u024f]").search
        self.split_latin = re.compile(rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+").findall
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.split = regex.compile(split).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.added = [t.encode() for t in added]
        self.held_back = regex.compile(r"[^\S ] (?!\S)").search
        tokens = self.model.get_vocab()
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)
        self.spaced[[i for t, i in tokens.items() if t[0] == "Ġ"]] = True
        # Words are handed to the same model cut already, in its own letters: bytes as printable characters (fixed values).
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))} | {32: " Ġ"}
        self.words = Tokenizer(self.model.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.table = StretchTable(self.stretch_ids, room)

    def pieces(self, text: str) -> list[str]:
        split = self.split if self.beyond_latin(text) else self.split_latin
        if self.special is None or not self.special.search(text):
            return split(text)
        return [p for i, part in enumerate(self.special.split(text)) for p in ([part] if i % 2 else split(part))]

    def piece_ids(self, pieces: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces. Words after a space go to the model side by side; no token but a word's first starts with a space."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 64):  # short texts are encoded fastest
            part = words[at : at + 64]
            shown = "".join(part)
            shown = shown.replace(" ", " Ġ") if shown.isascii() else shown.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                raw, edges = ids.tobytes(), [*(starts * 4).tolist(), 4 * len(ids)]
                found.update(zip(part, map(raw.__getitem__, map(slice, edges, edges[1:]))))
        rest = [p for p in pieces if p not in found]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            found.update(zip(part, (np.array(e.ids, np.int32).tobytes() for e in self.model.encode_batch_fast(part, add_special_tokens=False))))
        return found

    def stretch_ids(self, stretches: list[bytes], head: list[bool]) -> list[bytes]:
        split = [[s] if s[:1] == " " and s[1:].isalpha() else self.pieces(s) for s in (x.decode() for x in stretches)]
        known = self.piece_ids(list(set().union(*split))).__getitem__
        return [known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for p in split]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; text i is data[offsets[i]:offsets[i + 1]] in UTF-8, and offsets begin at 0."""
        mark = self.table.mark()
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[inner] = True  # every text begins a stretch
        doubt = np.flatnonzero(cut[1:-1] & space[1:-1] & ENDS[data[:-2]] & BEGINS[data[2:]]) + 1
        last = offsets[1:][np.diff(offsets) > 1] - 1
        doubt = np.concatenate([doubt, last[space[last] & ENDS[data[last - 1]]]])
        texts = np.searchsorted(offsets, doubt, "right") - 1
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                texts = np.append(texts, np.searchsorted(offsets, at, "right") - 1)
                at = raw.find(token, at + 1)
        for i in np.unique(texts):
            a, b = offsets[i], offsets[i + 1]
            text = raw[a:b].decode()
            if self.held_back(text) or self.special is not None and self.special.search(text):
                cut[a + 1 : b] = False  # one stretch
        start = np.flatnonzero(cut)
        head = np.zeros(len(data), bool)
        head[inner] = True
        entries = self.table.entries(data, start, head[start])
        flat, sizes = self.table.ids(entries)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]
        self.table.forget(mark)
        return flat, np.diff(upto)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    held = worker_state().setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """Rows (id, ids): each text's ids and the end id. The vocabulary's file is read in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for part, data, offsets in text_groups(batch, 1):
                flat, sizes = encoder.encode(data, offsets)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), pa.int32()), pa.array(np.insert(flat, ends, end)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def ordered(rows: DataFrame, id_col: str) -> DataFrame:
    """The rows in ascending order of a number over the partitions and in each, nulls last.

    The bounds are approximate quantiles of the column alone, a sketch a task; the rows are read once, to be shuffled. A row
    looks its place up in two steps, among the firsts of groups of bounds and then in one group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return rows.repartitionById(1, F.lit(0)).sortWithinPartitions(F.col(id_col).asc_nulls_last())
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda x: x < F.col(id_col)))

    rank = below(F.lit([g[0] for g in groups]))
    fine = (rank - 1) * width + below(F.element_at(F.array(*map(F.lit, groups)), rank))
    place = F.when(F.col(id_col).isNull(), len(cuts)).when(F.col(id_col) <= cuts[0], 0).otherwise(fine)
    return rows.repartitionById(len(cuts) + 1, place.cast("int")).sortWithinPartitions(F.col(id_col).asc_nulls_last())


def write_tokens(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> None:
    """Write documents' ids to Parquet files under path, in ascending order of id over the files, one row a document.

    Rows (id, n_tokens, ids). Page statistics and indexes are written; row groups hold ROW_GROUP bytes and pages at most
    PAGE_ROWS rows, so that a reader that wants some ids, or only the numbers, reads those pages and columns alone. Ids
    are dictionary-encoded while a group's dictionary is small and delta-encoded otherwise.
    """
    rows = ordered(docs.select(id_col, text_col), id_col)
    (
        encoded(rows, vocabulary, id_col, text_col, end)
        .select("id", F.size("ids").cast("long").alias("n_tokens"), "ids")
        .write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark, path: str, id_type: str = "long") -> DataFrame:
    """Rows (id, file, start, n_tokens, ids_crc32) of files of write_tokens.

    start is the number of ids in all documents before; ids_crc32 the CRC-32 of the ids as little-endian unsigned 32-bit
    integers. Numbers before a document: the sums of the files before it, one row a file, and those within its file.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, offsets = np.asarray(lists.values).astype("<i4", copy=False), np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["id", "file", "row", "n_tokens", "ids_crc32"])

    files = spark.read.schema(f"id {id_type}, n_tokens long, ids array<int>").parquet(path)
    rows = files.select("id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "n_tokens", "ids")
    rows = rows.mapInArrow(sums, f"id {id_type}, file string, row long, n_tokens long, ids_crc32 long")
    totals = files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum("n_tokens").alias("n"), F.min(F.struct(F.col("id").isNull(), "id")).alias("lo"))
    # The files follow each other in id order; one row a file is ordered here.
    upto = Window.orderBy("lo", "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(totals, "file").select("id", "file", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> DataFrame:
    """Write the documents' ids and return, from the files: id, start, n_tokens (with the end id) and ids_crc32.

    Null counts as empty text (the end id alone); repeated ids stand next to each other;
    rows without an id come last; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, vocabulary, path, id_col, text_col, end)
    told = read_tokens(spark, path, docs.schema[id_col].dataType.simpleString())
    return told.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
