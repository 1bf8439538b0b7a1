"""Which catalog entry an address belongs to: the nearest listed host above it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.url import host, host_suffixes, netloc


def netloc_map(domains: DataFrame, url: str = "main_url") -> DataFrame:
    """One row for each netloc of the catalog, the lowest id's: the build side of attribution."""
    keyed = domains.where(F.col(url).isNotNull()).withColumn("netloc", netloc(F.col(url))).where("netloc <> ''")
    rest = [c for c in domains.columns if c != "id"]
    best = keyed.groupBy("netloc").agg(F.min_by(F.struct("id", *rest), "id").alias("entry"))
    return best.select("netloc", "entry.*")


def public_stop(suffixes: Sequence[str]):
    """Bare public suffixes, where the walk up a host ends."""
    bare = [s.lstrip(".") for s in suffixes]
    return lambda name: name.isin(bare) if bare else F.lit(False)


def walk(name: Column, suffixes: Sequence[str]) -> Column:
    """The host and its parents that may match, nearest first: those before the first public suffix; a host of one label has none."""
    steps = host_suffixes(name)
    stop = public_stop(suffixes)
    seen = F.array_position(F.transform(steps, lambda s: stop(s)), True)
    return F.when(seen > 0, F.slice(steps, 1, (seen - 1).cast("int"))).otherwise(steps)


def attribute(rows: DataFrame, catalog: DataFrame, url: str, key: str, suffixes: Sequence[str], out: str = "domain_id") -> DataFrame:
    """rows with the id of the nearest catalog netloc above the url's host, or null.

    Each distinct host is resolved once: its walk is exploded and equi-joined with the catalog's netlocs, and the nearest
    hit wins; rows then join by host. A hot host is one row of the lookup, and its rows can be split over tasks.
    """
    hosts = rows.select(host(F.col(url)).alias("_host")).distinct().where("_host <> ''")
    steps = hosts.select("_host", F.posexplode(walk(F.col("_host"), suffixes)).alias("_pos", "_step"))
    hits = steps.join(catalog.select(F.col("netloc").alias("_step"), F.col(key).alias(out)), "_step")
    nearest = hits.groupBy("_host").agg(F.min_by(out, "_pos").alias(out))
    return rows.withColumn("_host", host(F.col(url))).join(nearest, "_host", "left").drop("_host")


def drop_below(rows: DataFrame, roots: DataFrame, url: str, root: str) -> DataFrame:
    """rows whose host is neither a root nor below one: an anti join on exploded host suffixes."""
    keyed = rows.withColumn("_host", host(F.col(url)))
    roots = roots.select(F.regexp_replace(F.lower(root), r"^www\.", "").alias("_step")).distinct()
    steps = keyed.select("_host").distinct().select("_host", F.explode(F.array_distinct(F.concat(F.array("_host"), host_suffixes(F.col("_host")), F.array(F.element_at(F.split("_host", r"\."), -1))))).alias("_step"))
    below = steps.join(roots, "_step").select("_host").distinct()
    return keyed.join(below, "_host", "left_anti").drop("_host")


def recrawl_bootstrap(visited: DataFrame, seeds: DataFrame, now: float, recrawl_days: int = 30) -> DataFrame:
    """Addresses visited within the recrawl time, without those of the seeds' own hosts. visited: (url, visited_at in epoch seconds); seeds: (url)."""
    recent = visited.where(F.col("visited_at") >= now - recrawl_days * 86400)
    return drop_below(recent, seeds.select(host(F.col("url")).alias("root")), "url", "root")


def snapshots(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """New frozen copies of catalog rows, one for each (job_id, source_domain_id) that has none yet; existing ones never change.

    wanted: (job_id, source_domain_id, seq, is_seed, ...catalog columns); the first in seq wins.
    """
    key = ["job_id", "source_domain_id"]
    first = wanted.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_n = 1").drop("_n", "seq")
    return first.join(existing.select(*key), key, "left_anti")


def repair(leads: DataFrame, snaps: DataFrame, catalog: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Extracted leads whose snapshot is not that of the domain their address resolves to: (id, snapshot_id, old_domain_id, domain_id)."""
    crawled = leads.where(~F.col("channel_tag").eqNullSafe("manual") & F.col("channel_tag").isNotNull())
    resolved = attribute(crawled.select("id", "snapshot_id", "source_url"), catalog, "source_url", "id" if "id" in catalog.columns else "domain_id", suffixes)
    old = snaps.select(F.col("id").alias("snapshot_id"), F.col("source_domain_id").alias("old_domain_id"))
    both = resolved.join(old, "snapshot_id", "left")
    return both.where(~F.col("old_domain_id").eqNullSafe(F.col("domain_id"))).select("id", "snapshot_id", "old_domain_id", "domain_id")


def backfill_snapshots(leads: DataFrame, domains: DataFrame, snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For leads that point at catalog rows: the (job, domain) pairs that lack a snapshot, and each lead's snapshot id where one exists."""
    pairs = leads.join(domains.select(F.col("id").alias("source_domain_id")), leads["domain_id"] == F.col("source_domain_id")).select("job_id", "source_domain_id").distinct()
    missing = pairs.join(snaps, ["job_id", "source_domain_id"], "left_anti")
    known = snaps.groupBy("job_id", F.col("source_domain_id").alias("domain_id")).agg(F.min("id").alias("snapshot_id"))
    return missing, leads.drop("snapshot_id").join(known, ["job_id", "domain_id"], "left")


def root_snapshot(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Discovered pages with the seed snapshot of their netloc as written, else of their netloc without `www.`. seeds: (netloc, snapshot_id)."""
    from leadwright.functions.url import authority, strip_www

    keyed = pages.withColumn("_full", authority(F.col("url"))).withColumn("_bare", strip_www(F.col("_full")))
    by = seeds.groupBy("netloc").agg(F.min("snapshot_id").alias("snapshot_id"))
    a, b = by.select(F.col("netloc").alias("_full"), F.col("snapshot_id").alias("_a")), by.select(F.col("netloc").alias("_bare"), F.col("snapshot_id").alias("_b"))
    return keyed.join(a, "_full", "left").join(b, "_bare", "left").withColumn("snapshot_id", F.coalesce("_a", "_b")).drop("_full", "_bare", "_a", "_b")
