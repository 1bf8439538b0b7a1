"""Moving tables: key remapping, insert-if-absent, verification, logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def id_map(rows: DataFrame, start: int = 0, buckets: int = 64) -> DataFrame:
    """(old_id, new_id): new ids from start + 1 in the old order; ranges of old ids, of about as many rows each, are numbered apart, then their sizes are added up."""
    cuts = rows.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    place = F.size(F.filter(F.lit(sorted(set(cuts))), lambda x: x < F.col("id"))) if cuts else F.lit(0)
    placed = rows.select(F.col("id").alias("old_id"), place.alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("old_id"))).join(before, "bucket")
    return numbered.select("old_id", (F.col("before") + F.col("n") + start).alias("new_id"))


def remapped(rows: DataFrame, maps: Mapping[str, DataFrame], soft: tuple[str, ...] = ()) -> DataFrame:
    """rows with foreign keys in new ids: a hard key without its row drops the row, a soft one becomes null; null stays null."""
    for column, ids in maps.items():
        new = ids.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
        joined = rows.join(new, column, "left")
        if column not in soft:
            joined = joined.where(F.col(column).isNull() | F.col("_new").isNotNull())
        rows = joined.withColumn(column, F.col("_new")).drop("_new")
    return rows


def self_remapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """A table whose column names rows of its own: ids first, then the column, null where the row is gone."""
    keyed = rows.join(ids.withColumnRenamed("old_id", "id"), "id").drop("id").withColumnRenamed("new_id", "id")
    return remapped(keyed, {column: ids}, soft=(column,)).select(*rows.columns)


def inserted(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A table with the rows of another whose natural key it lacks."""
    return existing.unionByName(new.dropDuplicates(key).join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def verified(counts: Mapping[str, tuple[DataFrame, int]], keys: Mapping[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """(check, expected, found, ok): row counts, and foreign keys that name no row."""
    spark = next(iter([*(d for d, _ in counts.values()), *(d for d, _, _ in keys.values())])).sparkSession
    out = None
    for name, (df, expected) in counts.items():
        row = df.agg(F.count("*").alias("found")).select(F.lit(f"rows:{name}").alias("check"), F.lit(expected).cast("long").alias("expected"), "found")
        out = row if out is None else out.union(row)
    for name, (df, column, parent) in keys.items():
        lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")
        row = lost.agg(F.count("*").alias("found")).select(F.lit(f"dangling:{name}").alias("check"), F.lit(0).cast("long").alias("expected"), "found")
        out = row if out is None else out.union(row)
    return out.withColumn("ok", F.col("expected") == F.col("found")) if out is not None else spark.createDataFrame([], "check string, expected long, found long, ok boolean")


def log_tail(spark: SparkSession, path: str, lines: int = 1000) -> DataFrame:
    """The last lines of a log, oldest first."""
    numbered = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return numbered.orderBy(F.col("n").desc()).limit(lines).orderBy("n").select(F.col("value").alias("line"))


def pending(queue: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    """The oldest waiting rows of a kind."""
    return queue.where(F.col("kind") == kind).orderBy("id").limit(limit)


def drained(queue: DataFrame) -> DataFrame:
    """(job_id, pending) of jobs with waiting rows."""
    return queue.groupBy("job_id").agg(F.count("*").alias("pending"))


def failed(queue: DataFrame, ids: DataFrame, error: str, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The queue and its dead letters after a failed batch: every row of it is charged, and one with `most` attempts dies."""
    hit = queue.join(ids.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    charged = hit.withColumns({"attempts": F.col("attempts") + F.when(F.col("_hit"), 1).otherwise(0), "last_error": F.when(F.col("_hit"), F.lit(error)).otherwise(F.col("last_error"))}).drop("_hit")
    return charged.where(F.col("attempts") < most), charged.where(F.col("attempts") >= most)


def upsert_latest(table: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    both = table.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")
