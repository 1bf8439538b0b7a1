"""The leads pool: filters, listing, facets, export, edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.score import lead_score
from leadwright.functions.text import blank_to_null, like_pattern, nonempty
from leadwright.policy import SCORE_WEIGHTS
from leadwright.sources.shared import written

UNKNOWN, UNKNOWN_CODE = "Unknown", "__unknown__"
EXPORT_FIELDS = (
    "email", "person_name", "designation", "department", "phone", "category_title", "state", "domain_title", "source_url", "source_title", "context_snippet",
    "entity_kind", "channel_tag", "confidence_band", "lead_score",
)
EDITABLE = ("person_name", "designation", "department", "phone", "manual_state")


@dataclass(frozen=True)
class LeadFilter:
    """What to list; an empty list or text means no restriction, and min_score counts even if it is 0."""

    job_ids: Sequence[int] = ()
    categories: Sequence[str] = ()
    states: Sequence[str] = ()
    org_types: Sequence[str] = ()
    search: str = ""
    entry_type: str = ""
    complete_only: bool = False
    require_name: bool = False
    require_designation: bool = False
    require_phone: bool = False
    min_score: int | None = None


def is_manual() -> Column:
    return F.col("channel_tag").eqNullSafe("manual")


def unattributed() -> Column:
    """Extracted leads without a snapshot."""
    return F.col("snapshot_id").isNull() & ~is_manual()


def matches(f: LeadFilter) -> Column:
    """The filter over leads joined with their snapshots (snap_category_code, snap_state, snap_org_type); one predicate for all plans."""
    tests: list[Column] = []
    if f.job_ids:
        tests.append(F.col("job_id").isin(list(f.job_ids)))
    if f.entry_type == "manual":
        tests.append(is_manual())
    elif f.entry_type == "extracted":
        tests.append(~is_manual())
    for values, code, column in ((f.categories, UNKNOWN_CODE, "snap_category_code"), (f.org_types, UNKNOWN_CODE, "snap_org_type")):
        if values:
            test = is_manual() | F.coalesce(F.col(column).isin(list(values)), F.lit(False))
            tests.append(test | unattributed() if code in values else test)
    if f.states:
        test = is_manual() | F.coalesce(F.col("snap_state").isin(list(f.states)), F.lit(False)) | F.coalesce(F.col("manual_state").isin(list(f.states)), F.lit(False))
        tests.append(test | unattributed() if UNKNOWN in f.states else test)
    if f.search:
        pattern = like_pattern(f.search)
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in ("email", "person_name", "department", "designation"))))
    needed = {"person_name": f.complete_only or f.require_name, "designation": f.complete_only or f.require_designation, "department": f.complete_only, "phone": f.require_phone}
    tests += [nonempty(F.col(c)) for c, need in needed.items() if need]
    if f.min_score is not None:
        tests.append(is_manual() | (F.col("lead_score") >= f.min_score))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def with_snapshots(leads: DataFrame, snaps: DataFrame) -> DataFrame:
    """Leads beside their snapshot, if any. The filters admit manual leads whatever the snapshot, so the join stays outer."""
    s = snaps.select(F.col("id").alias("snapshot_id"), *(F.col(c).alias(f"snap_{c}") for c in ("source_domain_id", "category_code", "category_title", "state", "org_type", "org_type_title", "title")))
    return leads.join(s, "snapshot_id", "left")


def display_state() -> Column:
    return F.when(is_manual(), F.col("manual_state")).otherwise(F.coalesce(F.nullif("snap_state", F.lit("")), F.lit(UNKNOWN)))


def sort_columns(sort_by: str = "", descending: bool = True) -> list[Column]:
    """score, contact (has a phone) or name (has a name), then the newest; any other key sorts by the newest alone; the id breaks ties."""
    key = {"score": F.col("lead_score"), "contact": F.when(nonempty(F.col("phone")), 1).otherwise(0), "name": F.when(nonempty(F.col("person_name")), 1).otherwise(0)}.get(sort_by)
    first = [] if key is None else [key.desc_nulls_last() if descending else key.asc_nulls_last()]
    return [*first, F.col("captured_at").desc_nulls_last(), F.col("id").desc()]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 100) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit)


class Pages:
    """An ordered result in stored ranges of about `rows` rows, of which a page sorts those alone that it lies in, however deep it is.

    The order must be total. The ranges' sizes are what the driver keeps.
    """

    def __init__(self, df: DataFrame, order: list[Column], rows: int = 1 << 17):
        self.order, total = order, df.count()
        ranged = df.repartitionByRange(max(1, -(-total // rows)), *order).withColumn("_range", F.spark_partition_id())
        self.stored = written(ranged, "ordered-pages")
        sizes = {r["_range"]: r["count"] for r in self.stored.groupBy("_range").count().collect()}
        self.upto, before = [], 0  # (range, rows before it, rows up to its end)
        for number in sorted(sizes):
            self.upto.append((number, before, before + sizes[number]))
            before += sizes[number]

    def page(self, number: int, limit: int = 100) -> DataFrame:
        """As page() of the whole result gives it."""
        first = (max(1, number) - 1) * limit
        held = [(n, before) for n, before, end in self.upto if before < first + limit and first < end]
        rows = self.stored.where(F.col("_range").isin([n for n, _ in held]) if held else F.lit(False)).drop("_range")
        return rows.orderBy(*self.order).offset(first - held[0][1] if held else 0).limit(limit)


def pages(df: DataFrame, limit: int) -> DataFrame:
    """total and the number of pages, at least one."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))


def list_leads(leads: DataFrame, snaps: DataFrame, f: LeadFilter = LeadFilter()) -> DataFrame:
    """The listing's columns for all leads that match; page() cuts it."""
    return with_snapshots(leads, snaps).where(matches(f)).select(
        "id", "job_id", "snapshot_id", "email", "person_name", "designation", "department", "source_url", "source_title", "context_snippet", "entity_kind", "phone", "channel_tag",
        "confidence_band", "field_provenance", F.coalesce("lead_score", F.lit(0)).alias("lead_score"), F.coalesce("depth", F.lit(0)).alias("depth"), "captured_at",
        F.col("snap_title").alias("domain_title"), display_state().alias("domain_state"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_iso"),
    )


def lead_ids(leads: DataFrame, snaps: DataFrame, f: LeadFilter = LeadFilter()) -> DataFrame:
    return with_snapshots(leads, snaps).where(matches(f)).select("id")


def export_rows(leads: DataFrame, snaps: DataFrame, f: LeadFilter = LeadFilter(), fields: Sequence[str] = ()) -> DataFrame:
    """The export's columns, null as empty text, in their fixed order; a choice of fields always holds the e-mail. Sorted by domain, then time, then id."""
    wanted = [c for c in EXPORT_FIELDS if not fields or c in fields or c == "email"]
    empty = lambda c: F.coalesce(c, F.lit(""))
    made = {
        "category_title": empty(F.coalesce(F.nullif("snap_category_title", F.lit("")), F.col("snap_category_code"))),
        "state": empty(display_state()),
        "domain_title": empty(F.col("snap_title")),
        "lead_score": F.coalesce("lead_score", F.lit(0)).cast("string"),
    }
    rows = with_snapshots(leads, snaps).where(matches(f)).orderBy(F.col("snap_source_domain_id").asc_nulls_last(), F.col("captured_at").asc_nulls_last(), "id")
    return rows.select(*(made.get(c, empty(F.col(c) if c not in made else F.lit(""))).alias(c) for c in wanted))


def _facet(leads: DataFrame, snaps: DataFrame, code: str, title: str, job_ids: Sequence[int]) -> DataFrame:
    pool = leads.where(F.col("job_id").isin(list(job_ids))) if job_ids else leads
    counted = pool.groupBy("snapshot_id").agg(F.count("*").alias("n"))  # before the join: one row a snapshot
    s = snaps.select(F.col("id").alias("snapshot_id"), F.col(code).alias("code"), F.coalesce(F.nullif(title, F.lit("")), F.col(code)).alias("title"))
    known = counted.join(s, "snapshot_id").where("code is not null").groupBy("code", "title").agg(F.sum("n").alias("count"))
    unknown = pool.agg(F.count_if(unattributed()).alias("count")).where("count > 0").select(F.lit(UNKNOWN_CODE).alias("code"), F.lit(UNKNOWN).alias("title"), "count")
    return known.unionByName(unknown)


def category_facet(leads: DataFrame, snaps: DataFrame, job_ids: Sequence[int] = ()) -> DataFrame:
    """(code, title, count) by category, with a row for unattributed leads if there are any."""
    return _facet(leads, snaps, "category_code", "category_title", job_ids)


def org_type_facet(leads: DataFrame, snaps: DataFrame, job_ids: Sequence[int] = ()) -> DataFrame:
    return _facet(leads, snaps, "org_type", "org_type_title", job_ids)


def facet_order() -> list[Column]:
    """Most first; the unattributed row last."""
    return [F.when(F.col("code") == UNKNOWN_CODE, 1).otherwise(0), F.col("count").desc(), F.col("code")]


def facets(leads: DataFrame, snaps: DataFrame, f: LeadFilter = LeadFilter()) -> DataFrame:
    """(facet, code, title, count) of category, org_type and state, each under the filter without its own choice, from one scan.

    A lead gives a row to each facet whose filter admits it; rows are counted before they are shuffled. Leads without a
    snapshot that are not manual are unknown; manual ones count under their own state.
    """
    pairs = {
        "category": (replace(f, categories=()), F.col("snap_category_code"), F.coalesce(F.nullif("snap_category_title", F.lit("")), F.col("snap_category_code")), UNKNOWN_CODE),
        "org_type": (replace(f, org_types=()), F.col("snap_org_type"), F.coalesce(F.nullif("snap_org_type_title", F.lit("")), F.col("snap_org_type")), UNKNOWN_CODE),
        "state": (replace(f, states=()), F.nullif(display_state(), F.lit("")), F.nullif(display_state(), F.lit("")), UNKNOWN),
    }
    told = []
    for name, (own, code, title, unknown) in pairs.items():
        entry = lambda c, t, n=name: F.struct(F.lit(n).alias("facet"), c.alias("code"), t.alias("title"))
        told.append(F.when(matches(own), F.when(unattributed(), entry(F.lit(unknown), F.lit(UNKNOWN))).when(code.isNotNull(), entry(code, title))))
    rows = with_snapshots(leads, snaps).select(F.explode(F.array_compact(F.array(*told))).alias("x"))
    return rows.groupBy("x.facet", "x.code", "x.title").agg(F.count("*").alias("count"))


def unattributed_count(leads: DataFrame, job_ids: Sequence[int] = ()) -> DataFrame:
    pool = leads.where(F.col("job_id").isin(list(job_ids))) if job_ids else leads
    return pool.agg(F.count_if(unattributed()).alias("unattributed"))


def lead_states(leads: DataFrame, snaps: DataFrame, job_ids: Sequence[int] = (), categories: Sequence[str] = ()) -> DataFrame:
    """All states of leads: of snapshots (of the categories, if given), typed in, and Unknown if any lead is unattributed."""
    pool = leads.where(F.col("job_id").isin(list(job_ids))) if job_ids else leads
    s = snaps.where(F.col("category_code").isin(list(categories))) if categories else snaps
    seen = pool.select("snapshot_id").distinct().join(s.select(F.col("id").alias("snapshot_id"), "state"), "snapshot_id").select("state")
    typed = pool.select(F.col("manual_state").alias("state"))
    unknown = pool.where(unattributed()).select(F.lit(UNKNOWN).alias("state"))
    return seen.union(typed).union(unknown).where(nonempty(F.col("state"))).distinct()


def edit(leads: DataFrame, lead_id: int, updates: Mapping[str, str], weights: Mapping[str, int] = SCORE_WEIGHTS) -> DataFrame:
    """One lead with new values: trimmed, blank as null, the state only of manual leads; its score follows."""
    here = F.col("id") == lead_id
    for c in EDITABLE:
        if c in updates:
            allowed = here & is_manual() if c == "manual_state" else here
            leads = leads.withColumn(c, F.when(allowed, blank_to_null(F.lit(updates[c]))).otherwise(F.col(c)))
    return leads.withColumn("lead_score", F.when(here, lead_score(weights)).otherwise(F.col("lead_score")))


def rescored(leads: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """All leads with the scores that new weights give."""
    return leads.withColumn("lead_score", lead_score(weights))


def upsert_manual(leads: DataFrame, rows: DataFrame, job_id: int) -> DataFrame:
    """What uploaded contacts do to the pool: rows (email, ...fields, outcome imported, updated or skipped, reason).

    rows: (row, email, person_name, designation, department, phone), one for each address. New addresses come in as manual leads with
    score 0; a manual lead takes the fields that are not blank; an extracted lead is left alone.
    """
    fields = ("person_name", "designation", "department", "phone")
    old = leads.select("email", "id", *(F.col(c).alias(f"_{c}") for c in fields), F.col("channel_tag").alias("_tag"))
    both = rows.withColumn("email", F.lower("email")).join(old, "email", "left")
    manual = F.col("_tag").eqNullSafe("manual")
    outcome = F.when(F.col("id").isNull(), "imported").when(manual, "updated").otherwise("skipped")
    value = lambda c: F.when(F.col("id").isNotNull() & ~manual, F.col(f"_{c}")).otherwise(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}")))
    return both.select(
        "row", "email", *(value(c).alias(c) for c in fields), outcome.alias("outcome"), F.when(outcome == "skipped", "exists as an extracted lead").alias("reason"),
        F.lit(job_id).cast("long").alias("job_id"), F.lit("manual-csv-upload").alias("source_url"), F.lit(0).alias("lead_score"), "id",
    )


def occurrences_of_upload(leads: DataFrame, rows: DataFrame, occurrences: DataFrame, job_id: int) -> DataFrame:
    """Occurrences (lead_id, job_id, source_url) of uploaded contacts whose address is in the pool, skipped ones included, where the job has none yet."""
    known = rows.select(F.lower("email").alias("email")).distinct().join(leads.select("email", F.col("id").alias("lead_id")), "email")
    new = known.select("lead_id", F.lit(job_id).cast("long").alias("job_id"), F.lit("manual-csv-upload").alias("source_url"))
    return new.join(occurrences.select("lead_id", "job_id"), ["lead_id", "job_id"], "left_anti")
