"""Contacts and links of crawled pages: one page-local step, then columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.addresses import Scanner
from leadwright.functions.dom import LINKS, SIGNALS, links, signals
from leadwright.functions.score import provenance
from leadwright.functions.text import (
    cell_at, channel_of, clean_emails, clip_designation, designation_in, emails_in, header_map, name_in, plain_email, unbracketed, words_joined,
)
from leadwright.functions.url import department_of
from leadwright.policy import HEADER_WORDS, RUNGS, Policy
from leadwright.sources.shared import written


#: What a page may make the reader raise.
UNREADABLE = (ValueError, AssertionError, RecursionError)


def page_signals(pages: DataFrame, policy: Policy = Policy(), html: str = "html") -> DataFrame:
    """pages without the html, with the signals of functions.dom, which replace columns of their names; a page that cannot be read has none."""
    pattern, pairs = policy.email, policy.obfuscation
    sizes = policy.max_input_chars, policy.proximity_chars, policy.context_chars

    @F.pandas_udf(SIGNALS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(pattern, pairs)

        def one(page: str | None) -> dict:
            try:
                return signals(page, scanner, *sizes)
            except UNREADABLE:
                return {"title": "", "page_name": None, "found": []}

        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=["title", "page_name", "found"])

    kept = [c for c in pages.columns if c not in (html, "title", "page_name", "found")]
    return pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), of(F.col(html)).alias("told")).select("row.*", "told.*")


def page_links(pages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(page_id, pos, url, text, rel): absolute links in document order. The join of base and reference follows RFC 3986, in the pass that reads the page."""

    @F.pandas_udf(LINKS)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(page: str | None, base: str | None) -> list[dict]:
            try:
                return links(page, base)
            except UNREADABLE:
                return []

        for html, base in batches:
            yield pd.Series([one(h, b) for h, b in zip(html, base)], dtype="object")

    return pages.select("page_id", F.explode(of("html", "url")).alias("l")).select("page_id", "l.pos", "l.url", "l.text", "l.rel")


def extract_leads(pages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One lead for each address of a page: (page_id, seq, email, person_name, ..., field_provenance).

    pages: (page_id, url, html). Of an address's finds the best rung wins, then the first; the first other find that has a
    table row or a text window around it is its fallback. A phone goes to the first entity without one in the same parent
    element, else to the first without one, and to one alone. Addresses written with markers come last, if they are new.
    Pages are read once, into the shared folder. Rows that repeat a page count as one; a null page has no leads.
    """
    read = written(page_signals(pages.select("page_id", "url", "html"), policy), "page-signals")
    about = read.select("page_id", "url", "title", "page_name").dropDuplicates(["page_id"])
    found = read.select("page_id", F.explode("found").alias("f")).select("page_id", "f.*")

    rank = F.array_position(F.array(*map(F.lit, RUNGS)), F.col("rung"))
    cleaned = F.when(F.col("kind") == "row", F.transform(emails_in(F.col("raw"), policy.email), lambda m: plain_email(m, policy.valid_suffixes)))
    cleaned = cleaned.when((F.col("kind") == "email") & (F.col("rung") == "proximity_text"), F.array(plain_email(F.col("raw"), policy.valid_suffixes)))
    cleaned = cleaned.when(F.col("kind") == "email", clean_emails(F.col("raw"), policy.email))
    cleaned = cleaned.when(F.col("kind") == "bracketed", F.array(unbracketed(F.col("raw"), policy.obfuscation, policy.email, policy.valid_suffixes)))
    addresses = found.where("kind <> 'phone'").select("*", F.posexplode(cleaned).alias("sub", "email")).where("email is not null")
    addresses = addresses.withColumn("marked", F.col("kind") == "bracketed").withColumn("order", F.struct("marked", -rank, "seq", "sub"))

    entity = Window.partitionBy("page_id", "email")
    context = (F.col("rung").isin("table_block", "proximity_text")) & ~F.col("marked")
    ranked = addresses.withColumn("n", F.row_number().over(entity.orderBy("order")))
    fields = F.struct("rung", "headers", "cells", "row_text", "near")
    other = F.min_by(F.when((F.col("n") > 1) & context, fields), F.when((F.col("n") > 1) & context, F.col("order"))).over(entity)
    first_seen = F.min(F.struct("marked", "seq", "sub")).over(entity)
    winners = ranked.withColumns({"other": other, "seen": first_seen}).where("n = 1")

    told = _with_phones(winners, found).join(about, "page_id")
    told = _enriched(told, policy)
    channel, kind = channel_of(F.col("email"), policy.role_local_parts, policy.valid_suffixes)
    mismatch = F.coalesce(F.lower("page_name") != F.lower(department_of(F.col("url"))), F.lit(False)) & (F.col("page_name") != "")
    band = F.when(F.col("rung").isin(list(policy.high_rungs)) & ~F.coalesce(mismatch, F.lit(False)), "HIGH").otherwise("LOW")
    from_table = (F.col("rung") == "table_block") & F.col("place_department").isNotNull()
    proof = provenance(F.col("rung"), F.col("person_name"), F.col("designation"), F.col("department"), from_table, F.col("phone"), F.col("phone_rung"))
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("seen")) - 1
    return told.select(
        "page_id", seq.alias("seq"), "email", "person_name", "designation", "department", F.col("url").alias("source_url"), F.col("title").alias("source_title"), "context_snippet",
        kind.alias("entity_kind"), "phone", channel.alias("channel_tag"), band.alias("confidence_band"), proof.alias("field_provenance"),
    )


def _with_phones(winners: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with phone and phone_rung: each page's phones are dealt out in order over the page's own entities."""
    number = F.when(F.col("rung") == "mailto_tel", F.nullif(F.trim(F.regexp_extract("raw", r"(?i)^tel:(\+?[\d\s\-().]{7,20})", 1)), F.lit(""))).otherwise(F.trim("raw"))
    phones = found.where("kind = 'phone'").withColumn("phone", number).where("phone is not null")
    phones = phones.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "parent", "phone", "rung"))).alias("phones"))
    plain = winners.where("not marked").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seen", "email", "parent"))).alias("entities"))
    both = plain.join(phones, "page_id")
    start = F.transform("entities", lambda e: F.struct(e["email"].alias("email"), e["parent"].alias("parent"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("phone_rung")))

    def deal(state, p):
        near = F.array_position(F.transform(state, lambda e: e["phone"].isNull() & F.coalesce(e["parent"] == p["parent"], F.lit(False))), True)
        free = F.array_position(F.transform(state, lambda e: e["phone"].isNull()), True)
        to = F.when(near > 0, near).otherwise(free)
        take = lambda i: (i + 1) == to
        return F.transform(state, lambda e, i: F.struct(e["email"].alias("email"), e["parent"].alias("parent"), F.when(take(i), p["phone"]).otherwise(e["phone"]).alias("phone"), F.when(take(i), p["rung"]).otherwise(e["phone_rung"]).alias("phone_rung")))

    dealt = both.select("page_id", F.explode(F.aggregate("phones", start, deal)).alias("e")).select("page_id", "e.email", "e.phone", "e.phone_rung").where("phone is not null")
    return winners.join(dealt, ["page_id", "email"], "left")


def _enriched(rows: DataFrame, policy: Policy) -> DataFrame:
    """person_name, designation, department and context_snippet by rung, blanks from the fallback."""
    own = header_map(F.col("headers"), HEADER_WORDS)
    rows = rows.withColumns({f"place_{k}": v for k, v in own.items()})
    other = header_map(F.col("other.headers"), HEADER_WORDS)
    rung = F.col("rung")
    text = F.when(rung == "table_block", F.col("row_text")).when(rung == "proximity_text", F.col("near")).otherwise(F.coalesce("container", F.lit("")))
    other_text = F.when(F.col("other.rung") == "table_block", F.col("other.row_text")).when(F.col("other.rung") == "proximity_text", F.col("other.near"))
    snippet = F.when(rung == "proximity_text", words_joined(F.col("snippet"))).otherwise(F.substring(text, 1, 300))
    name = F.coalesce(cell_at(F.col("cells"), F.col("place_name")), name_in(text, policy.title_prefixes), cell_at(F.col("other.cells"), other["name"]), name_in(other_text, policy.title_prefixes))
    post = F.coalesce(clip_designation(cell_at(F.col("cells"), F.col("place_designation"))), designation_in(text, policy.designation_keywords), clip_designation(cell_at(F.col("other.cells"), other["designation"])), designation_in(other_text, policy.designation_keywords))
    none = F.lit(None).cast("string")
    table_department = cell_at(F.col("cells"), F.col("place_department")) if policy.person else none
    return rows.withColumns(
        {
            "context_snippet": snippet,
            "person_name": name if policy.person else none,
            "designation": post if policy.person else none,
            "department": F.coalesce(table_department, department_of(F.col("url"))),
        }
    )
