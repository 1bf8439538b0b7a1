"""Mixing sources to target weights with fixed-length blocks and pseudorandom index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.llm.common import SPACE, WORD, written

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: Words of a block.
BLOCK = 256
#: Slots of an output shard on average.
SHARD = 4096
#: Documents of a source that are numbered together on average.
BUCKET = 4_000
#: Output shards whose slots a task makes, and the most tasks that they are dealt to.
TASK_SHARDS, MOST_TASKS = 16, 20_000
#: Rounds of the permutation.
ROUNDS = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Where index x of 0..n-1 goes in the key's pseudorandom permutation.

    A swap-or-not shuffle: each round pairs an index with (k - index) mod n and swaps the pair by a hashed bit, so it is a
    permutation for any n, and the rounds in reverse undo it.
    """
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: source_key, source_size, n_docs and target.

    sizes: (source_key, size). The targets share all words by weight; none is above `most` times its source's size, and
    what is over goes to the others by weight: with sources in ascending order of most * size / weight, a prefix is
    capped, and the rest get what is left by weight. The level of the first that is not capped is the highest of those. One row for each source is ordered here, not the documents.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = F.row_number().over(Window.orderBy("source_key")) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(order, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy(F.lit(0))
    capped_before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = weighed.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(capped_before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(from_here))
    first = level.withColumn("share", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return first.select("source_key", "source_size", "n_docs", F.least("cap", F.col("share") * F.col("weight")).alias("target"))


class Mixture:
    """A mix of the sources of docs: fixed-length blocks of words, dealt to output shards.

    A source's documents lie end to end in a pseudorandom order and are cut into blocks of `block` words. The target asks
    for a number of slots; how many of them each output shard gets is a multinomial draw (every slot picks a shard by
    hash, so that a source's slots add up to its target); the slots are numbered through the shards, and slot g takes
    block permutation(g mod blocks). Full passes come first, the last slot is cut to the words still asked for, so a
    source's words meet its target to a word, and no word is taken more than `most` times. In a shard the slots of all
    sources stand in a pseudorandom order. Draws, permutations and orders are hashes of the seed: reruns agree.

    placed: a row for each row of docs, with its size, source and target, and where it starts in its source. blocks: the
    blend, a row (shard, place, source_key, slot, block, words) for each slot; words is how many it takes of its block.
    Both are written tables.

    Sources rank by code point with null last; null texts have size 0; documents of size 0 are in no block; a source of
    size 0 has target 0; repeated rows are placed each on their own; an empty table has no blocks.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 7):
        self.docs, self.id_col, self.text_col, self.source_col, self.block = docs, id_col, text_col, source_col, block
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), self.source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"))
        sizes = written(rows, "mix-sizes")
        sources = written(source_targets(sizes, weights, most), "mix-sources")
        self.placed = written(self._placed(sizes, sources, seed), "mix-places")
        self.blocks = written(self._dealt(self._asked(sources, seed), shard, seed), "mix-blocks")

    @staticmethod
    def source_key(source: Column) -> Column:
        return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))

    def _placed(self, sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
        """Where each document starts in its source: buckets by hash are numbered apart, then their sums are added up."""
        bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n_docs") / BUCKET))
        rows = sizes.join(sources, "source_key").withColumn("bucket", bucket)
        within = Window.partitionBy("source_key", "bucket").orderBy("id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
        rows = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_key", "bucket"])
        return rows.withColumn("start", F.col("bucket_start") + F.col("in_bucket")).drop("bucket", "in_bucket", "bucket_start", "n_docs")

    def _asked(self, sources: DataFrame, seed: int) -> DataFrame:
        """What each source is asked for: passes over all its blocks, and slots that take the rest."""
        filled = F.greatest("source_size", F.lit(1))  # sources without words are left out, but may be computed before they are
        asked = sources.where("source_size > 0").select("source_key", filled.alias("source_size"), F.floor("target").alias("asked"), F.ceil(filled / self.block).alias("blocks"))
        asked = asked.withColumn("short", F.col("blocks") * self.block - F.col("source_size")).withColumn("passes", F.expr("asked div source_size"))
        asked = asked.withColumn("rest", F.col("asked") - F.col("passes") * F.col("source_size")).withColumn("key", F.xxhash64("source_key", F.lit(seed)))
        asked = asked.withColumn("last_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("key"), inverse=True))  # the slot that takes the short block
        slots_rest = F.ceil(F.col("rest") / self.block)
        slots_rest = slots_rest + F.when((F.col("last_at") < slots_rest) & (slots_rest * self.block - F.col("short") < F.col("rest")), 1).otherwise(0)
        return asked.withColumn("slots", F.col("passes") * F.col("blocks") + slots_rest)

    def _dealt(self, asked: DataFrame, shard: int, seed: int) -> DataFrame:
        """The slots of all sources, dealt to shards and mapped to blocks."""
        total = asked.agg(F.sum("slots")).first()[0] or 0
        shards = max(1, total // shard)
        tasks = min(MOST_TASKS, -(-shards // TASK_SHARDS))  # a row stands for thousands of slots, so its bytes do not tell the work
        runs = asked.where("slots > 0").select("source_key", "slots", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {shard}"))).alias("run")).repartition(tasks, "source_key", "run")
        tickets = runs.select("source_key", F.explode(F.sequence(F.col("run") * shard, F.least(F.col("slots"), (F.col("run") + 1) * shard) - 1)).alias("i"))
        drawn = tickets.groupBy("source_key", F.pmod(F.xxhash64("source_key", "i", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.count("*").alias("draws"))
        upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("first", F.coalesce(F.sum("draws").over(upto), F.lit(0))).repartition(tasks, "source_key", "shard")

        slots = drawn.join(asked, "source_key").select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("slot"))
        slots = slots.withColumn("turn", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
        cut = F.col("rest") - (F.col("at") * self.block - F.when(F.col("last_at") < F.col("at"), F.col("short")).otherwise(0))
        full = F.lit(self.block) - F.when(F.col("at") == F.col("last_at"), F.col("short")).otherwise(0)
        words = F.when(F.col("turn") < F.col("passes"), full).otherwise(F.greatest(F.lit(0), F.least(full, cut)))
        taken = slots.select("shard", "source_key", "slot", permuted(F.col("at"), F.col("blocks"), F.col("key")).alias("block"), words.cast("long").alias("words")).where("words > 0")
        order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "source_key", "slot", F.lit(seed)), "source_key", "slot")  # about `shard` rows
        return taken.repartition(tasks, "shard").select("shard", (F.row_number().over(order) - 1).alias("place"), "source_key", "slot", "block", "words")

    def ranges(self) -> DataFrame:
        """Rows (shard, place, source_key, start, from, n): the blocks joined by index to the documents' words. n words of the document at `start`, from word `from` on, stand in the block at this place."""
        block = self.block
        pieces = self.placed.where("size > 0").select("source_key", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        lo = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
        hi = F.least(F.col("words"), F.col("start") + F.col("size") - F.col("block") * block)
        return pieces.join(self.blocks, ["source_key", "block"]).select("shard", "place", "source_key", "start", (F.col("block") * block + lo - F.col("start")).alias("from"), (hi - lo).alias("n")).where("n > 0")

    def taken(self) -> DataFrame:
        """One row for each row of docs: id, size, source, source_size, target and taken, the words of it in all blocks."""
        took = self.ranges().groupBy("source_key", "start").agg(F.sum("n").alias("taken"))
        some = self.placed.where("size > 0").join(took, ["source_key", "start"], "left")
        told = some.unionByName(self.placed.where("size = 0"), allowMissingColumns=True)
        return told.select(
            F.col("id").alias(self.id_col), "size", F.col("source").alias(self.source_col), "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def texts(self) -> DataFrame:
        """The columns of docs with shard, place and from: a row for each stretch of a document in a block, its text cut to that stretch; by shard and place.

        White space stays with the word after it, and at the end with the last. Rows that are alike in id, source and text
        count as one document with the blocks of all. Columns named shard, place and from are replaced.
        """
        docs = self.docs.drop("shard", "place", "from")
        plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever they are called
        id_col, text_col, source_col = (plain[c] for c in (self.id_col, self.text_col, self.source_col))
        rows = docs.toDF(*plain.values()).withColumns({"_text_key": F.xxhash64(text_col), "_source_key": self.source_key(F.col(source_col))})
        places = self.placed.where("size > 0").select("source_key", "start", F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("source_key").alias("_source"), "size")
        uses = self.ranges().join(places, ["source_key", "start"]).groupBy("_id", "_key", "_source").agg(F.max("size").alias("_size"), F.collect_list(F.struct("shard", "place", "from", "n")).alias("_uses"))
        key = [F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("source_key").alias("_source")]
        twins = self.placed.where("size > 0").groupBy(*key).agg(F.count("*").alias("_alike")).where("_alike > 1")
        uses = uses.join(twins.select(F.col("_id").alias("_of"), F.col("_key").alias("_of_key"), F.col("_source").alias("_of_source"), "_alike"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_key")) & (F.col("_source") == F.col("_of_source")), "left")
        same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")) & (F.col("_source_key") == F.col("_source"))
        found = rows.join(uses, same)
        once = found.where("_alike is null").union(found.where("_alike > 1").dropDuplicates([id_col, "_text_key", "_source_key"]))
        words = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?:{SPACE})?{WORD}(?:{SPACE}\z)?"), F.lit(0))
        whole = (F.size("_uses") == 0) | F.forall("_uses", lambda u: u["n"] == F.col("_size"))
        # The words are made once a document: as the one element of an array that the stretches are cut from.
        cut = F.transform(F.array(F.when(~whole, words)), lambda w: F.transform("_uses", lambda u: F.struct(u["shard"].alias("shard"), u["place"].alias("place"), u["from"].alias("from"), F.array_join(F.slice(w, (u["from"] + 1).cast("int"), u["n"].cast("int")), "").alias("text"))))
        parts = once.withColumn("_part", F.explode(F.element_at(cut, 1)))
        text = F.when(F.col("_part.text").isNull(), F.col(text_col)).otherwise(F.col("_part.text"))
        told = parts.withColumn(text_col, text).select(*(F.col(p).alias(c) for c, p in plain.items()), "_part.shard", "_part.place", "_part.from")
        return told.repartition("shard").sortWithinPartitions("shard", "place", "from")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: id, size (number of words), source, source_size, target and taken (the words that the Mixture takes, repeats counted)."""
    return Mixture(docs, **options).taken()
