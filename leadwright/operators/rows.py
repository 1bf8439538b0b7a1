"""Edits of small tables: rows added, changed and removed, listings, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.schemas import with_ids


def added(table: DataFrame, new: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """A table with new rows, whose ids follow the highest one in the given order. new has a row an entity, so one task numbers it."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = with_ids(new, order).join(top).withColumn("id", F.col("id") + F.col("_top")).drop("_top").withColumnRenamed("id", key)
    return table.unionByName(numbered, allowMissingColumns=True)


def changed(table: DataFrame, which: Column, **values: Column | str | int | bool | None) -> DataFrame:
    """Rows with the given values where `which` holds; None keeps."""
    given = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items() if v is not None}
    hit = F.coalesce(which, F.lit(False))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in given.items()})


def removed(table: DataFrame, which: Column, used: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows without those where `which` holds. used: keys of rows that must stay (column `key`), of any number."""
    hit = F.coalesce(which, F.lit(False))
    if used is None:
        return table.where(~hit)
    held = used.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_held", F.lit(True))
    return table.join(held, key, "left").where(~hit | F.col("_held")).drop("_held")


def with_dependants(table: DataFrame, which: Column, dependants: DataFrame, column: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table without the rows where `which` holds, and its dependants without those of these rows."""
    gone = table.where(F.coalesce(which, F.lit(False))).select(F.col(key).alias(column)).distinct()
    return removed(table, which), dependants.join(gone, column, "left_anti")


def titles_written(lookup: DataFrame, new: DataFrame) -> DataFrame:
    """(code, title) with new titles (code, title, seq) written over it: the last one of a code."""
    last = new.where("code is not null").groupBy("code").agg(F.max_by("title", "seq").alias("title"))
    return lookup.select("code", "title").join(last.select("code"), "code", "left_anti").union(last)


def listing(table: DataFrame, page: int = 1, limit: int = 50, newest_first: bool = False, **equal: str | int | None) -> DataFrame:
    """A page of rows by id; of the given values, those that are not None must be equal."""
    for c, v in equal.items():
        if v is not None:
            table = table.where(F.col(c) == v)
    return table.orderBy(F.col("id").desc() if newest_first else F.col("id")).offset((page - 1) * limit).limit(limit)


# Settings: (key, value, updated_by, updated_at)


def setting(settings: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One row (key, value): the setting's value, or the default."""
    one = settings.where(F.col("key") == key).agg(F.first("value").alias("value"))
    return one.select(F.lit(key).alias("key"), F.coalesce("value", F.lit(default).cast("string")).alias("value"))


def setting_written(settings: DataFrame, key: str, value: str, by: int | None, now: Column, expected: Column | None = None) -> DataFrame:
    """The settings after a write, with written: whether this row took it. A row that changed since `expected` keeps its value; one that is not there always takes it."""
    here = F.col("key") == key
    takes = here if expected is None else here & F.col("updated_at").eqNullSafe(expected)
    there = settings.withColumn("written", takes)
    told = changed(there, takes, value=value, updated_by=F.lit(by), updated_at=now)
    new = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(by).cast("long").alias("updated_by"), now.alias("updated_at"), F.lit(True).alias("written"))
    return told.unionByName(new.join(settings.where(here).select("key"), "key", "left_anti"))


def import_counters(entries: DataFrame, kept: Column) -> DataFrame:
    """One row of an import: total_categories, total_entries and inserted, those that are kept."""
    return entries.agg(F.count_distinct("category_title").alias("total_categories"), F.count("*").alias("total_entries"), F.count_if(kept).alias("inserted"))
