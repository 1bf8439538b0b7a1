"""The catalog of domains: filters, facets, statistics, keyed replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.text import like_pattern, nonempty


def domain_filter(category: str = "", state: str = "", org_type: str = "", search: str = "") -> Column:
    """Equality on the given values, and a case-insensitive substring of title or address."""
    tests = [F.col(c) == v for c, v in (("category_code", category), ("state", state), ("org_type", org_type)) if v]
    if search:
        pattern = like_pattern(search)
        tests.append(F.coalesce(F.col("title").ilike(pattern), F.lit(False)) | F.coalesce(F.col("main_url").ilike(pattern), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def domain_order(crawlable_first: bool = False) -> list[Column]:
    first = [F.when(F.col("main_url").isNotNull(), 0).otherwise(1)] if crawlable_first else []
    return [*first, F.col("state").asc_nulls_last(), F.col("main_url").asc_nulls_last(), F.col("id")]


def domain_ids(domains: DataFrame, **filters: str) -> DataFrame:
    """Ids of the crawlable domains that match."""
    return domains.where(domain_filter(**filters) & F.col("main_url").isNotNull()).select("id")


def by_ids(df: DataFrame, ids: DataFrame | list) -> DataFrame:
    """Rows by primary key: a literal list, or a table of keys of any size."""
    return df.where(F.col("id").isin(list(ids))) if isinstance(ids, list) else df.join(ids.select("id").distinct(), "id", "left_semi")


def domain_facet(domains: DataFrame, code: str, title: str, **filters: str) -> DataFrame:
    """(code, title, count) of the catalog."""
    rows = domains.where(domain_filter(**filters)).where(F.col(code).isNotNull())
    return rows.groupBy(F.col(code).alias("code"), F.coalesce(F.nullif(title, F.lit("")), F.col(code)).alias("title")).agg(F.count("*").alias("count"))


def domain_states(domains: DataFrame, category: str = "") -> DataFrame:
    return domains.where(domain_filter(category=category)).where(nonempty(F.col("state"))).select("state").distinct()


def domain_stats(domains: DataFrame, **filters: str) -> DataFrame:
    """total, crawlable, not_crawlable and duplicate: rows beyond the first of each address, by grouping on the address, so no set of addresses is held in one place."""
    rows = domains.where(domain_filter(**filters))
    by_url = rows.groupBy("main_url").agg(F.count("*").alias("n"))
    known = F.col("main_url").isNotNull()
    sums = by_url.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("crawlable"), F.count("main_url").alias("addresses"))
    return sums.select("total", "crawlable", (F.col("total") - F.col("crawlable")).alias("not_crawlable"), (F.col("crawlable") - F.col("addresses")).alias("duplicate"))


def entry_key() -> Column:
    """What makes two entries the same: the external id, else the address, else the row itself."""
    return F.coalesce(F.concat(F.lit("ext:"), F.nullif("external_id", F.lit(""))), F.concat(F.lit("url:"), F.nullif("main_url", F.lit(""))), F.concat(F.lit("row:"), F.col("seq").cast("string")))


def last_wins(entries: DataFrame, key: Column | None = None) -> DataFrame:
    """One row for each key: the last one's values at the first one's place (`seq`)."""
    rest = [c for c in entries.columns if c != "seq"]
    keyed = entries.withColumn("_key", entry_key() if key is None else key)
    best = keyed.groupBy("_key").agg(F.max_by(F.struct(*rest), "seq").alias("entry"), F.min("seq").alias("seq"))
    return best.select("seq", "entry.*")


def replace_catalog(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new catalog from imported entries, and the category and organisation titles it brings: the last title of a code wins."""
    def titles(code: str, title: str) -> DataFrame:
        return entries.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.max_by(title, "seq").alias("title"))

    return last_wins(entries), titles("category_code", "category_title"), titles("org_type", "org_type_title")


def upsert_domains(domains: DataFrame, entries: DataFrame) -> DataFrame:
    """The catalog with entries written over it: by external id where they have one, else by address; the rest are added. An entry with an external id never meets a row that has only the address."""
    cols = [c for c in domains.columns if c != "id"]
    new = last_wins(entries.withColumn("seq", F.col("seq").cast("long")))
    ext, url = nonempty(F.col("external_id")), ~nonempty(F.col("external_id")) & nonempty(F.col("main_url"))
    updates = []
    for test, key in ((ext, "external_id"), (url, "main_url")):
        old = domains.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("id").alias("id"))
        updates.append(new.where(F.coalesce(test, F.lit(False))).join(old, key, "left").select("id", "seq", *cols))
    rest = new.where(~F.coalesce(ext | url, F.lit(False))).select(F.lit(None).cast("long").alias("id"), "seq", *cols)
    changes = updates[0].union(updates[1]).union(rest)
    kept = domains.join(changes.where("id is not null").select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("seq"), *cols)
    return kept.union(changes)


def set_urls(domains: DataFrame, domain_id: int, main_url: str | None, contact_url: str | None) -> DataFrame:
    here = F.col("id") == domain_id
    return domains.withColumns({c: F.when(here, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in (("main_url", main_url), ("contact_url", contact_url))})


def seed_lookup(lookup: DataFrame, source: DataFrame, code: str, title: str) -> DataFrame:
    """Codes with a title that the lookup lacks; of several titles the least."""
    rows = source.where(F.col(title).isNotNull() & F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(title).alias("title"))
    return rows.join(lookup.select("code"), "code", "left_anti")


def explode_ids(jobs: DataFrame, domains: DataFrame) -> DataFrame:
    """(job_id, domain_id) from the jobs' JSON lists; ids of no domain and bad lists go."""
    ids = jobs.select(F.col("id").alias("job_id"), F.explode(F.from_json("domain_ids", "array<long>")).alias("domain_id")).where("domain_id is not null").distinct()
    return ids.join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi").select("job_id", "domain_id")


def first_arrivals(rows: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """The first row of each key, found before the rows are shuffled."""
    return rows.groupBy(key.alias("key")).agg(F.min_by(F.struct(*(f"`{c}`" for c in rows.columns)), seq).alias("first")).select("first.*")
