"""The crawl frontier: which links are admitted, in which order, up to which depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.score import link_limit
from leadwright.functions.text import is_plain_int
from leadwright.functions.url import in_scope, is_priority, is_skippable, needs_js, query_value, url_key, url_priority
from leadwright.policy import Policy
from leadwright.sources.shared import shared_folder


def is_paging_link(policy: Policy, url: str = "url", text: str = "text", rel: str = "rel") -> Column:
    """Whether a link leads to another page of the same listing.

    If the address has any of the paging parameters, all of them must be plain numbers and that decides; else rel=next,
    a paging word or a number as the link's text.
    """
    values = [query_value(F.col(url), p) for p in policy.paging_params]
    present = reduce(lambda a, b: a | b, (v.isNotNull() for v in values), F.lit(False))
    numbers = reduce(lambda a, b: a & b, (v.isNull() | is_plain_int(v) for v in values), F.lit(True))
    words = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    other = F.array_contains(F.coalesce(F.col(rel), F.array().cast("array<string>")), "next") | words.isin(list(policy.paging_texts)) | is_plain_int(words)
    return F.lit(policy.paging) & F.when(present, numbers).otherwise(other)


def elected_paging(links: DataFrame, policy: Policy) -> DataFrame:
    """At most one paging link of each page: the first with rel=next, else the first. links: (page_id, pos, url, text, rel)."""
    hits = links.where(is_paging_link(policy))
    rank = F.struct(~F.array_contains(F.coalesce("rel", F.array().cast("array<string>")), "next"), "pos")
    return hits.groupBy("page_id").agg(F.min_by(F.struct("pos", "url"), rank).alias("best")).select("page_id", F.col("best.pos").alias("pos"), F.col("best.url").alias("url"))


def admitted_links(links: DataFrame, policy: Policy) -> DataFrame:
    """The links that a page adds to the frontier when pages do not share budgets: (page_id, pos, url, kind, depth, page_hops).

    links: (page_id, pos, url, text, rel, depth, page_hops, is_seed, page_priority). Files and foreign hosts go, a page
    counts an address once, and a page that is neither a seed nor priority adds only priority links. The elected paging
    link keeps the depth and takes a hop, up to the policy's hops, outside the limit; other links go one deeper, first
    ones first, up to the limit of the page's depth.
    """
    elected = elected_paging(links, policy).select("page_id", F.col("pos").alias("_elected"))
    ok = links.where(~is_skippable(F.col("url"), policy.skip_extensions) & in_scope(F.col("url"), policy.target_suffixes))
    by_key = Window.partitionBy("page_id", "_key").orderBy("pos")
    ok = ok.withColumn("_key", url_key(F.col("url"))).withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n", "_key")
    ok = ok.join(elected, "page_id", "left").withColumn("_paging", F.col("pos").eqNullSafe(F.col("_elected")))
    hop = ok.where(F.col("_paging") & (F.col("page_hops") < policy.max_paging_hops)).select("page_id", "pos", "url", F.lit("paging").alias("kind"), "depth", (F.col("page_hops") + 1).alias("page_hops"))
    free = F.col("is_seed") | F.col("page_priority") | is_priority(F.col("url"), F.col("text"), policy.priority_keywords)
    rest = ok.where(~F.col("_paging") & free).withColumn("_at", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    rest = rest.where(F.col("_at") <= link_limit(policy.max_links, F.col("depth"))).select("page_id", "pos", "url", F.lit("link").alias("kind"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("page_hops"))
    return hop.unionByName(rest)


def chained_links(children: DataFrame, policy: Policy) -> DataFrame:
    """Of the links found on the pages of paging chains, those within their chain's shared budget, in the order they were found. children: (chain, seq, url)."""
    return children.withColumn("_n", F.row_number().over(Window.partitionBy("chain").orderBy("seq"))).where(F.col("_n") <= policy.max_chain_children).drop("_n")


def enqueued(candidates: DataFrame, visited: DataFrame, policy: Policy) -> DataFrame:
    """Candidates that enter the queue, with their priority: (url_key, url, depth, seq, is_seed, priority).

    candidates: (url, depth, seq, is_seed); visited: (url_key). Files, foreign hosts and visited pages go; of candidates
    for one page the first in seq stays.
    """
    ok = candidates.where(~is_skippable(F.col("url"), policy.skip_extensions) & in_scope(F.col("url"), policy.target_suffixes)).withColumn("url_key", url_key(F.col("url")))
    fields = F.struct("url", "depth", "seq", "is_seed")
    first = ok.groupBy("url_key").agg(F.min_by(fields, "seq").alias("f")).select("url_key", "f.*")
    return first.join(visited.select("url_key"), "url_key", "left_anti").withColumn("priority", url_priority(F.col("url"), policy.priority_keywords))


def pop_order() -> list[Column]:
    return [F.col("priority"), F.col("seq")]


def crawl_levels(seeds: DataFrame, links: DataFrame, policy: Policy) -> DataFrame:
    """Every page reached from the seeds over a table of links, at its least depth: (url_key, depth).

    seeds: (url_key); links: (from_key, to_key). One job a depth over the pages new at it; each step is checkpointed, and
    it ends at the policy's depth (0: none) or when nothing new is found.
    """
    shared_folder(seeds.sparkSession)
    new = seeds.select("url_key").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen, depth = new, 0
    while (not policy.max_depth or depth < policy.max_depth) and not new.isEmpty():
        depth += 1
        step = links.join(new.select(F.col("url_key").alias("from_key")), "from_key", "left_semi").select(F.col("to_key").alias("url_key")).distinct()
        new = step.join(seen, "url_key", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        seen = seen.union(new)
    return seen


def counters(fetched: DataFrame) -> DataFrame:
    """A job's numbers from its fetch outcomes (job_id, url, depth, is_seed, fetched, leads): a failed fetch is no visit; leads count every attempt."""
    return fetched.groupBy("job_id").agg(
        F.count_if("fetched").alias("visited_urls"),
        F.count_if(F.col("fetched") & F.col("is_seed")).alias("crawled_domains"),
        F.coalesce(F.sum("leads"), F.lit(0)).alias("leads_found"),
        F.max("depth").alias("current_depth"),
    )


def fetch_accepted(pages: DataFrame, policy: Policy) -> DataFrame:
    """Fetched pages that are used: status 200 and a final host in scope."""
    return pages.where((F.col("status") == 200) & in_scope(F.col("final_url"), policy.target_suffixes))


def checkpoint_tables(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A saved frontier as two tables: items (url, depth, ..., chain_key) and the chains' budgets (chain_key, budget), one a chain however many items share it."""
    chains = frontier.where("chain_key is not null").groupBy("chain_key").agg(F.min("budget").alias("budget"))
    return frontier.drop("budget"), chains


def visited_before(recent: DataFrame, saved: DataFrame) -> DataFrame:
    """(url_key): the pages visited recently and those of a saved checkpoint, each once."""
    return recent.select("url_key").union(saved.select("url_key")).distinct()


def fetch_decision(attempts: DataFrame, policy: Policy) -> DataFrame:
    """What a page's attempts (page_id, seq, error, status, final_url, html) come to: (page_id, decision, tries).

    A transport error is tried once more; the answer of the first attempt without one decides: render where a good page
    asks for JavaScript, accept where it is good, else reject; failed where both attempts had an error.
    """
    answered = F.col("error").isNull()
    first = attempts.where("seq < 2").groupBy("page_id").agg(F.min_by(F.struct("status", "final_url", "html", (F.col("seq") + 1).alias("tries")), F.when(answered, F.col("seq"))).alias("a"), F.count("*").alias("n"))
    good = (F.col("a.status") == 200) & in_scope(F.col("a.final_url"), policy.target_suffixes)
    decision = F.when(F.col("a").isNull(), "failed").when(~F.coalesce(good, F.lit(False)), "reject").when(needs_js(F.col("a.html"), policy.js_indicators), "render").otherwise("accept")
    return first.select("page_id", decision.alias("decision"), F.coalesce("a.tries", F.col("n")).cast("int").alias("tries"))


def rehydrated(items: DataFrame, chains: DataFrame) -> DataFrame:
    return items.join(chains, "chain_key", "left")
