"""Folding captures into one lead for each address."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwright.functions.score import band_rank, department_from_url, lead_score
from leadwright.functions.text import nonempty
from leadwright.policy import SCORE_WEIGHTS

#: Fields that a later capture fills where they are blank.
ENRICHABLE = ("person_name", "designation", "department", "source_title", "context_snippet", "entity_kind", "phone")
#: Fields of the first capture alone.
FIRST = ("job_id", "source_url", "depth", "channel_tag", "snapshot_id")
REQUIRED = ("email", "source_url", "job_id")


def accepted(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures that can be folded, and the others with a reason; bad ones never stop the good."""
    reason = F.when(~nonempty(F.trim("email")) | F.col("email").isNull(), "no e-mail").when(F.col("job_id").isNull(), "no job").when(F.col("source_url").isNull(), "no source address")
    judged = captures.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def fold(captures: DataFrame, weights: Mapping[str, int] = SCORE_WEIGHTS, seq: str = "seq") -> DataFrame:
    """One row for each lower-cased address, as if its captures had been saved one after the other in `seq`.

    The first capture gives job, address, depth, channel and snapshot. Blank fields take the first value that is not
    blank. The band rises to the highest seen and keeps the provenance that came with a rise, the first one's if none did.
    The score is that of the folded row. A running maximum marks the rises; all else is a pre-aggregated group, so that an
    address with very many captures is summed in parts, and only its bands, ordered, meet in one place.
    """
    keyed = captures.withColumn("email", F.lower("email"))
    rank = band_rank(F.col("confidence_band"))
    # Rises: the first capture, and the first of each higher rank; ranks are three, so two minima find them.
    first_at = keyed.groupBy("email", rank.alias("rank")).agg(F.min(seq).alias("at"), F.min_by(F.struct("confidence_band", "field_provenance"), seq).alias("of"))
    start = Window.partitionBy("email").orderBy("at")
    higher = F.max("rank").over(start.rowsBetween(Window.unboundedPreceding, -1))
    rises = first_at.withColumn("before", higher).where("before is null or rank > before")
    bands = rises.groupBy("email").agg(
        F.max_by("of.confidence_band", "at").alias("confidence_band"),
        F.coalesce(F.max_by(F.when(nonempty(F.col("of.field_provenance")), F.col("of.field_provenance")), F.when(nonempty(F.col("of.field_provenance")), F.col("at"))), F.min_by("of.field_provenance", "at")).alias("field_provenance"),
    )
    values = keyed.groupBy("email").agg(
        *(F.min_by(c, seq).alias(c) for c in FIRST),
        *(F.min_by(F.when(nonempty(F.col(c)), F.col(c)), F.when(nonempty(F.col(c)), F.col(seq))).alias(c) for c in ENRICHABLE),
        F.min(seq).alias("first_seq"),
        F.count("*").alias("captures"),
    )
    return values.join(bands, "email").withColumn("lead_score", lead_score(weights))


#: The ranks of bands.
_RANKS = {"other": -1, "low": 0, "high": 1}


def accumulated(captures: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each lower-cased address that holds all the fold needs of its captures, each value with when it came.

    Rows of one address, of several sets of captures, merge into that of all of them, in any order (merged).
    """
    first = lambda *columns: F.struct(F.col(seq).alias("at"), *columns)
    rank = band_rank(F.col("confidence_band"))
    return captures.groupBy(F.lower("email").alias("email")).agg(
        F.min(first(*FIRST)).alias("first"),
        *(F.min(F.when(nonempty(F.col(c)), first(F.col(c).alias("value")))).alias(f"first_{c}") for c in ENRICHABLE),
        *(F.min(F.when(rank == r, first("confidence_band", "field_provenance"))).alias(f"band_{name}") for name, r in _RANKS.items()),
        F.count("*").alias("captures"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Accumulators of equal addresses as one."""
    kept = [c for c in parts.columns if c not in ("email", "captures")]
    return parts.groupBy("email").agg(*(F.min(c).alias(c) for c in kept), F.sum("captures").alias("captures"))


def told(parts: DataFrame, weights: Mapping[str, int] = SCORE_WEIGHTS) -> DataFrame:
    """The leads of merged accumulators, as fold gives them."""
    other, low, high = (F.col(f"band_{name}") for name in _RANKS)
    before = lambda a, b: F.coalesce(a["at"] < b["at"], a.isNotNull() & b.isNull())
    rises = ((high, high.isNotNull()), (low, before(low, high)), (other, before(other, high) & before(other, low)))
    proof = [F.when(rose & nonempty(b["field_provenance"]), b["field_provenance"]) for b, rose in rises]
    leads = parts.select(
        "email", *(F.col(f"first.{c}") for c in FIRST), *(F.col(f"first_{c}.value").alias(c) for c in ENRICHABLE), F.col("first.at").alias("first_seq"), "captures",
        F.when(high.isNotNull(), high["confidence_band"]).when(low.isNotNull(), low["confidence_band"]).otherwise(other["confidence_band"]).alias("confidence_band"),
        F.coalesce(*proof, F.least(other, low, high)["field_provenance"]).alias("field_provenance"),
    )
    return leads.withColumn("lead_score", lead_score(weights))


def with_department(captures: DataFrame, snaps: DataFrame) -> DataFrame:
    """Captures whose department was only the address's default take their snapshot's title instead, where it has one. Applied to first captures."""
    s = snaps.select(F.col("id").alias("snapshot_id"), F.nullif("title", F.lit("")).alias("_title"))
    joined = captures.join(s, "snapshot_id", "left")
    swap = department_from_url(F.col("field_provenance")) & F.col("_title").isNotNull()
    return joined.withColumn("department", F.when(swap, F.col("_title")).otherwise(F.col("department"))).drop("_title")


def merge_leads(existing: DataFrame, captures: DataFrame, weights: Mapping[str, int] = SCORE_WEIGHTS) -> DataFrame:
    """The pool after new captures: stored leads go first in the fold, as captures before all others."""
    stored = existing.withColumn("seq", F.lit(-1).cast("long"))
    both = stored.select("seq", "email", "confidence_band", "field_provenance", *FIRST, *ENRICHABLE).unionByName(captures.select("seq", "email", "confidence_band", "field_provenance", *FIRST, *ENRICHABLE))
    return fold(both, weights)


def occurrences(captures: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each (address, job): the first capture's."""
    keyed = captures.withColumn("email", F.lower("email"))
    return keyed.groupBy("email", "job_id").agg(F.min_by("captured_by", seq).alias("captured_by"), F.min_by("source_url", seq).alias("source_url"), F.min(seq).alias("first_seq"))


def canonical(leads: DataFrame) -> DataFrame:
    """(id, canonical_id) of all leads: of an address's leads the one with the highest band, then the lowest id."""
    best = F.max_by("id", F.struct(band_rank(F.col("confidence_band")), -F.col("id")))
    return leads.join(leads.groupBy("email").agg(best.alias("canonical_id")), "email").select("id", "canonical_id")


def merge_duplicates(leads: DataFrame, occurrences: DataFrame, campaign_emails: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead for each address: blanks of the canonical one filled from the others by id; occurrences and campaign e-mails follow it, collisions go. Scores stay."""
    mapping = canonical(leads)
    joined = leads.join(mapping, "id")
    order = F.struct((F.col("id") != F.col("canonical_id")).alias("other"), "id")
    fields = ("person_name", "designation", "department", "source_title", "context_snippet", "phone", "entity_kind")
    filled = joined.groupBy("canonical_id").agg(*(F.min_by(F.when(nonempty(F.col(c)), F.col(c)), F.when(nonempty(F.col(c)), order)).alias(c) for c in fields if c in leads.columns))
    kept = leads.join(mapping.where("id = canonical_id").select("id"), "id", "left_semi").drop(*fields).join(filled.withColumnRenamed("canonical_id", "id"), "id").select(*leads.columns)
    to = mapping.select(F.col("id").alias("lead_id"), "canonical_id")
    occ = occurrences.join(to, "lead_id").groupBy(F.col("canonical_id").alias("lead_id"), "job_id").agg(F.min("id").alias("id")).select("id", "lead_id", "job_id")
    mail = campaign_emails.join(to, "lead_id", "left").withColumn("lead_id", F.coalesce("canonical_id", "lead_id")).select(*campaign_emails.columns)
    return kept, occ, mail


def with_manual_states(leads: DataFrame, snaps: DataFrame) -> DataFrame:
    """Manual leads without a typed state take that of their snapshot."""
    s = snaps.select(F.col("id").alias("snapshot_id"), F.nullif("state", F.lit("")).alias("_state"))
    manual = F.col("channel_tag").eqNullSafe("manual") & F.col("manual_state").isNull()
    return leads.join(s, "snapshot_id", "left").withColumn("manual_state", F.when(manual, F.col("_state")).otherwise(F.col("manual_state"))).drop("_state")


def backfill_occurrences(leads: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences of leads that have none for their job."""
    return leads.select(F.col("id").alias("lead_id"), "job_id").join(occurrences.select("lead_id", "job_id"), ["lead_id", "job_id"], "left_anti")
