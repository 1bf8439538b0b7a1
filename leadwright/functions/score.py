"""Lead scores, tiers, provenance and progress, column to column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadwright.functions.text import nonblank
from leadwright.policy import SCORE_WEIGHTS


def lead_score(weights: Mapping[str, int] = SCORE_WEIGHTS, email: str = "email", name: str = "person_name", designation: str = "designation", phone: str = "phone", band: str = "confidence_band", channel: str = "channel_tag") -> Column:
    """0 to 100: trust in the address, name, designation and phone; manual leads have 0."""
    trust = F.when(F.col(band).eqNullSafe("HIGH"), weights["email_high"]).otherwise(weights["email_low"])
    parts = [F.when(nonblank(F.col(email)), trust).otherwise(0)] + [F.when(nonblank(F.col(c)), weights[w]).otherwise(0) for c, w in ((name, "person_name"), (designation, "designation"), (phone, "phone"))]
    return F.when(F.col(channel).eqNullSafe("manual"), 0).otherwise(sum(parts[1:], parts[0])).cast("int")


def score_tier(score: Column, channel: Column) -> Column:
    return F.when(channel.eqNullSafe("manual"), "manual").when(score >= 70, "success").when(score >= 40, "warning").otherwise("secondary")


def missing_fields(fields: Mapping[str, Column]) -> Column:
    """Names of the fields that are blank, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(~nonblank(c), n) for n, c in fields.items()))), ",")


def band_rank(band: Column) -> Column:
    """HIGH over LOW over anything else."""
    return F.when(band == "HIGH", 1).when(band == "LOW", 0).otherwise(-1)


def department_from_url(provenance: Column) -> Column:
    """Whether the department was only the default of the address; bad documents say no."""
    return F.coalesce(F.get_json_object(provenance, "$.department") == "url_default", F.lit(False))


def provenance(rung: Column, name: Column, designation: Column, department: Column, from_table: Column, phone: Column, phone_rung: Column) -> Column:
    """Where each field came from, as JSON without the fields that are null."""
    return F.to_json(
        F.struct(
            rung.alias("email"),
            F.when(name.isNotNull(), rung).alias("person_name"),
            F.when(designation.isNotNull(), rung).alias("designation"),
            F.when(department.isNotNull(), F.when(from_table, rung).otherwise("url_default")).alias("department"),
            F.when(phone.isNotNull(), phone_rung).alias("phone"),
        )
    )


def progress(visited: Column, queued: Column) -> Column:
    """Per cent of known pages that are visited."""
    return F.coalesce(F.round(F.try_divide(visited * 100.0, visited + queued)), F.lit(0.0)).cast("int")


def visit_rate(visited: Column, seconds: Column) -> Column:
    return F.round(F.try_divide(visited.cast("double"), seconds), 1)


def link_limit(limits: Mapping[str, int], depth: Column) -> Column:
    """The limit of links of a page at this depth; keys are text, then `default`, then 5."""
    out = F.lit(limits.get("default", 5))
    for key, value in limits.items():
        if key != "default":
            out = F.when(depth.cast("string") == key, value).otherwise(out)
    return out
