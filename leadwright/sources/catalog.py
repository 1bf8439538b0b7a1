"""The catalog's interchange document, its directory source and the reshaping between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadwright.functions.text import slug
from leadwright.functions.url import is_target, main_and_contact, root_url, title_of
from leadwright.operators.history import SUM, ordered
from leadwright.policy import TARGET_SUFFIXES

_DOCUMENT = "map<string,map<string,map<string,array<string>>>>"


def read_catalog(spark: SparkSession, path: str, suffixes: Sequence[str] = TARGET_SUFFIXES, codes: dict[str, str] | None = None) -> DataFrame:
    """Entries of catalog documents {category: {state: {org type: [entry]}}}, numbered from 0 in order (`seq`): by file, then as they stand in it.

    An entry is an address or an object (title, url, contact_url, external_id). Addresses that are no targets go; objects
    stay, with the addresses that are targets. Category codes come from `codes`, else from the title.
    """
    document = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _DOCUMENT).alias("d"))
    rows = document.select("file", F.posexplode("d").alias("c", "category_title", "d")).select("file", "c", "category_title", F.posexplode("d").alias("s", "state", "d"))
    rows = rows.select("file", "c", "category_title", "s", "state", F.posexplode("d").alias("o", "org_type_title", "d"))
    rows = rows.select("file", "c", "category_title", "s", "state", "o", "org_type_title", F.posexplode("d").alias("e", "entry"))
    thing = F.from_json("entry", "title string, url string, contact_url string, external_id string")
    is_object = F.col("entry").startswith("{")
    rows = rows.withColumn("x", F.when(is_object, thing))
    main, contact = main_and_contact(F.col("x.url"), F.col("x.contact_url"), suffixes)
    plain = is_target(F.col("entry"), suffixes)
    rows = rows.where(is_object | plain).withColumn("all", F.lit(0))
    rows = ordered(rows, "all", ["file", "c", "s", "o", "e"]).running("place", F.lit(1), SUM).done("all")
    code = F.coalesce(*([F.element_at(F.create_map(*(F.lit(v) for kv in codes.items() for v in kv)), F.col("category_title"))] if codes else []), slug(F.col("category_title"), 20))
    return rows.select(
        (F.col("place") - 1).alias("seq"), code.alias("category_code"), "category_title", F.col("state"), slug(F.col("org_type_title"), 30).alias("org_type"), "org_type_title",
        F.when(is_object, F.col("x.title")).otherwise(title_of(F.col("entry"))).alias("title"), F.when(is_object, main).otherwise(root_url(F.col("entry"))).alias("main_url"),
        F.when(is_object, contact).otherwise(F.when(plain, F.col("entry"))).alias("contact_url"), F.col("x.external_id").alias("external_id"),
    )


def first_category_wins(rows: DataFrame) -> DataFrame:
    """Directory rows, one for each external id (or title and address): inside a category the last one of a state and organisation type, across categories the first.

    rows: (seq, category_code, state, org_type, title, main_url, external_id, ...).
    """
    key = F.coalesce(F.nullif("external_id", F.lit("")), F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("main_url", F.lit(""))))
    keyed = rows.withColumn("_key", key)
    inside = Window.partitionBy("_key", "category_code", "state", "org_type").orderBy(F.col("seq").desc())
    last = keyed.withColumn("_n", F.row_number().over(inside)).where("_n = 1")
    across = Window.partitionBy("_key").orderBy("seq")
    return last.withColumn("_n", F.row_number().over(across)).where("_n = 1").drop("_n", "_key")


def with_org_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Organisation titles by code, the code where there is none."""
    return rows.drop("org_type_title").join(titles.select(F.col("code").alias("org_type"), F.col("title").alias("_t")), "org_type", "left").withColumn("org_type_title", F.coalesce("_t", "org_type")).drop("_t")


def catalog_document(domains: DataFrame) -> DataFrame:
    """The interchange document, one JSON text a category: a category's entries are grouped by state and organisation type."""
    entry = F.struct("title", F.col("main_url").alias("url"), "contact_url", "external_id")
    kinds = domains.groupBy("category_title", "state", "org_type_title").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    states = kinds.groupBy("category_title", "state").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("org_type_title", "entries")))).alias("kinds"))
    categories = states.groupBy("category_title").agg(F.map_from_entries(F.collect_list(F.struct("state", "kinds"))).alias("states"))
    return categories.select("category_title", F.to_json(F.struct("states")).alias("document"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a paged directory from its recorded answers, JSON lines (category, page, total, rows): (category_code, seq, title, state, org_type, main_url, contact_url, external_id).

    A category's pages count up to its first empty one, and while fewer rows than its total stood on the pages before.
    Files of any number and size are read in parallel; only a category's pages, not its rows, meet in one place.
    """
    entry = "title string, state string, org_type string, main_url string, contact_url string, external_id string"
    answers = spark.read.schema(f"category string, page int, total long, rows array<struct<{entry.replace(' string', ': string')}>>").json(path)
    upto = Window.partitionBy("category").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.size("rows"), F.lit(0))
    counted = answers.select("category", "page", "total", F.greatest(size, F.lit(0)).alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "least": F.min("n").over(upto)})
    read = counted.where((F.col("n") > 0) & (F.coalesce("least", F.lit(1)) > 0) & (F.col("total").isNull() | (F.col("before") < F.col("total"))))
    rows = answers.drop("total").join(read.select("category", "page", "before"), ["category", "page"])
    return rows.select(F.col("category").alias("category_code"), "before", F.posexplode("rows").alias("at", "r")).select("category_code", (F.col("before") + F.col("at")).alias("seq"), "r.*")
