"""Near-duplicates by SimHash fingerprints within a Hamming ball."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import mapped, written
from leadwright.llm.components import connected_components

#: Fingerprints whose variants one task makes: a row becomes 65, so its bytes do not tell the work.
BALLS = 20_000
#: Shingle hashes whose bits are counted at once: bounds the memory that a very long text takes.
HASHES = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8 (None: no words, zero).

    A-Z are lower-cased; shingles are runs of `words` words joined by a space, repeats included; fewer words make one
    shingle. A bit is set if over half the shingles' XXH64 (seed 42) have it.
    """
    import xxhash

    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or b"").lower())
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        part = found[at : min(n, at + HASHES) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(found) >= words else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str, words: int, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and simhash."""

    def make():
        return lambda texts: [pa.array([fingerprint(x, words) for x in texts], pa.int64())]

    return mapped(docs, F.col(text_col).cast("binary"), {"simhash": "long"}, make, keep)


def linked(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) of distinct fingerprints that join all within `radius` bits of each other, directly or through others.

    Meet in the middle: each fingerprint emits every variant within half the radius, 65 for a radius of 2, and two
    fingerprints are within the radius just when they share a variant. At most 65 fingerprints share one, whatever the
    data; a star from the smallest of them joins them all, as any two that share a variant are within the radius. Each
    edge is verified.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = [sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tasks = max(1, -(-prints.count() // BALLS))
    distinct = prints.select(F.col(prints.columns[0]).alias("print")).distinct().repartition(tasks, "print")
    variants = distinct.select("print", F.explode(F.array(*(F.col("print").bitwiseXOR(F.lit(m).cast("long")) for m in signed))).alias("variant"))
    met = variants.groupBy("variant").agg(F.sort_array(F.collect_set("print")).alias("prints")).where(F.size("prints") > 1)
    star = met.select(F.element_at("prints", 1).alias("a"), F.explode(F.slice("prints", F.lit(2), F.size("prints"))).alias("b")).distinct()
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 lower-case hex digits) and component_id.

    component_id is the smallest id that links of at most `radius` differing bits reach, itself included. Work goes by
    distinct fingerprints, so copies, however many, are one node.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other; repeated rows are
    returned each; rows without an id get the component of their fingerprint; an empty table gives an empty one.
    """
    prints = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", words, ["id"]), "fingerprints")
    smallest = prints.groupBy("simhash").agg(F.min("id").alias("least"))
    nodes = connected_components(linked(prints.select("simhash"), radius))
    roots = smallest.join(nodes, F.col("simhash") == F.col("node"), "left").select("simhash", "least", F.coalesce("component", "simhash").alias("root"))
    classes = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = roots.join(classes, "root").select("simhash", "component_id")
    return prints.join(known, "simhash").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
