"""Substring search by an index of trigrams: posting lists propose rows, and the search's own pattern verifies them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.functions.text import like_pattern

GRAM = 3


def trigram_index(rows: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(gram, id): the different trigrams of a row's lower-cased columns, sorted by gram in ranges, so that a search reads few of them when the index is stored."""

    def grams(text: Column) -> Column:
        size = F.length(text)
        return F.when(size >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(size - (GRAM - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM)))).otherwise(F.expr("cast(array() as array<string>)"))

    every = F.array_distinct(F.flatten(F.array(*(grams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns))))
    return rows.select(F.explode(every).alias("gram"), F.col(id_col).alias("id")).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def grams_of(search: str) -> list[str]:
    """Trigrams that any row that matches the term holds: those of its parts between wildcards. Only ASCII ones, whose lower case is the same everywhere."""
    parts = re.split(r"[%_\\]", search.lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1) if p[i : i + GRAM].isascii()})


def holds(search: str, columns: Sequence[str]) -> Column:
    """Whether any of the columns holds the term, whatever the case; % and _ inside it stay wildcards."""
    pattern = like_pattern(search)
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns))


def proposed(index: DataFrame, search: str) -> DataFrame | None:
    """(id) of the rows that hold all trigrams of the term; None where it has none, so that all rows are proposed."""
    grams = grams_of(search)
    if not grams:
        return None
    return index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def searched(rows: DataFrame, index: DataFrame, search: str, id_col: str, columns: Sequence[str]) -> DataFrame:
    """The rows that hold the term, read through the index. Terms without a part of three characters are looked for in all rows."""
    ids = proposed(index, search)
    found = rows if ids is None else rows.join(ids.withColumnRenamed("id", "proposed id"), F.col(id_col) == F.col("proposed id"), "left_semi")
    return found.where(holds(search, columns))
