"""URL rules by host suffix and path prefix, found through a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.llm.common import ascii_lower

#: Words of 64 bits to a block; a key sets one bit in each word.
WORDS = 8
#: Bytes of a filter that may be broadcast; a larger one is joined by its block number.
BROADCAST_BYTES = 8 << 20


def url_host(url: Column) -> Column:
    """The text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    """The text after the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return url.substr(F.locate("://", url) + 3, F.length(url))


class BlockedBloom:
    """A Bloom filter in blocks of 512 bits: the key's hash picks a block and one bit in each of its eight words.

    The filter is a table (block, w0..w7) of at most n_blocks rows, 72 bytes each; it is broadcast only where that bound
    is within BROADCAST_BYTES, and joined by block number otherwise. It has false positives and no false negatives.
    """

    def __init__(self, keys: DataFrame, key: str, n_blocks: int):
        self.n_blocks = n_blocks
        words = keys.select(self._block(F.col(key)).alias("block"), *(self._bit(F.col(key), i).alias(f"w{i}") for i in range(WORDS)))
        self.blocks = self._sent(words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))))

    @classmethod
    def stored(cls, blocks: DataFrame, n_blocks: int) -> BlockedBloom:
        """A filter whose blocks were written before."""
        out = cls.__new__(cls)
        out.n_blocks = n_blocks
        out.blocks = out._sent(blocks)
        return out

    def _sent(self, blocks: DataFrame) -> DataFrame:
        return F.broadcast(blocks) if self.n_blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES else blocks

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_blocks)).alias("block")

    def _bit(self, key: Column, i: int) -> Column:
        place = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    def marked(self, rows: DataFrame, key: str, mark: str) -> DataFrame:
        """The rows with a boolean column: whether their key may be in the filter."""
        hit = F.lit(True)
        for i in range(WORDS):
            hit = hit & (F.col(f"bloom.w{i}").bitwiseAND(self._bit(F.col(f"probe.`{key}`"), i)) != 0)
        probe = rows.withColumn("bloom_block", self._block(F.col(f"`{key}`"))).alias("probe")
        found = probe.join(self.blocks.alias("bloom"), F.col("probe.bloom_block") == F.col("bloom.block"), "left")
        return found.select(*(F.col(f"probe.`{c}`") for c in rows.columns if c != mark), F.coalesce(hit, F.lit(False)).alias(mark))

    def possible(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the filter."""
        return self.marked(rows, key, "_possible").where("_possible").drop("_possible")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", n_blocks: int = 4096) -> DataFrame:
    """The columns of pages with host, path, rule and verdict.

    rules: (host, path, verdict). A rule fits its host and all its subdomains where the path starts with the rule's; the
    longest `host + path` wins, then the longer host, then block. Without a rule the verdict is the default: the address
    is not listed. Every distinct (host, path) is judged once: its candidates are the host's suffixes, of as many labels
    as any rule has, with the path's prefixes, of the lengths that any rule has. The blocked Bloom filter of the rules'
    canonical keys drops most of them; a hash join with the rules themselves removes the false positives.

    Null and malformed addresses have an empty host and path and get the default; repeated rows are each returned; an
    empty table gives an empty one; columns named host, path, rule or verdict are replaced by the new ones.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"), F.concat(ascii_lower(F.col("host")), "path").alias("rule_key")
    )
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    labels, lengths = shape[0] or 1, shape[1] or [0]  # as many numbers as a rule's path can have lengths

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(F.struct(*(f"`{c}`" for c in kept)).alias("row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    distinct = parts.select("host", "path").distinct().where("host <> ''")
    names = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.array_join(F.slice(names, -n, n), ".")))
    prefix = F.explode(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)))
    candidates = distinct.select("host", "path", suffix.alias("host_part")).select("host", "path", "host_part", prefix.alias("path_part")).where("path_part is not null")
    candidates = candidates.withColumn("key", F.concat("host_part", "path_part"))

    possible = BlockedBloom(rules, "rule_key", n_blocks).possible(candidates, "key")
    exact = possible.join(rules, (F.col("host_part") == F.col("rule_host")) & (F.col("path_part") == F.col("rule_path")))
    rank = F.struct(F.length("rule_key"), F.length("rule_host"), F.col("rule_verdict") == "block")
    judged = exact.groupBy("host", "path").agg(F.max_by(F.struct("rule_key", "rule_verdict"), rank).alias("best"))
    told = parts.join(judged, ["host", "path"], "left")
    return told.select(*(F.col("row").getField(c).alias(c) for c in kept), "host", "path", F.col("best.rule_key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
