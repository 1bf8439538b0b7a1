"""Campaigns: drafts, states, statistics, credentials, blacklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.functions.text import filled, nonblank, nonempty
from leadwright.schemas import EMAIL_STATES


def _null_ts() -> Column:
    return F.lit(None).cast("timestamp_ntz")


# Blacklist


def without_blacklisted(rows: DataFrame, blacklist: DataFrame, email: str = "email", domains: bool = True) -> DataFrame:
    """rows whose address is not listed, nor, with domains, its domain: one listed address then keeps its whole domain out."""
    key = F.lower(F.col(email))
    kept = rows.withColumn("_email", key).join(blacklist.select(F.lower("email").alias("_email")).where("_email is not null"), "_email", "left_anti")
    if domains:
        listed = blacklist.select(F.lower("domain").alias("_domain")).where("_domain is not null and _domain <> ''")
        kept = kept.withColumn("_domain", F.substring_index("_email", "@", -1)).join(listed, "_domain", "left_anti").drop("_domain")
    return kept.drop("_email")


def add_to_blacklist(blacklist: DataFrame, new: DataFrame) -> DataFrame:
    """The list with new addresses (email, domain, reason, seq), lower-cased; known ones stay as they are."""
    rows = new.withColumn("email", F.lower("email")).groupBy("email").agg(F.min_by(F.struct(F.lower("domain").alias("domain"), "reason"), "seq").alias("r")).select("email", "r.*")
    return blacklist.select("email", "domain", "reason").unionByName(rows.join(blacklist.select("email"), "email", "left_anti"))


def blacklist_sets(blacklist: DataFrame) -> DataFrame:
    """(kind, value): the distinct addresses and domains."""
    kinds = [blacklist.select(F.lit(k).alias("kind"), F.lower(k).alias("value")).where(nonempty(F.col("value"))) for k in ("email", "domain")]
    return kinds[0].union(kinds[1]).distinct()


# Drafts


def draft_flags(leads: DataFrame, blacklist: DataFrame, in_campaign: DataFrame) -> DataFrame:
    """leads with blacklisted and excluded (already in the campaign), each found by one equi-join."""
    emails = blacklist.select(F.lower("email").alias("_email")).where("_email is not null").distinct().withColumn("_by_email", F.lit(True))
    domains = blacklist.select(F.lower("domain").alias("_domain")).where("_domain is not null and _domain <> ''").distinct().withColumn("_by_domain", F.lit(True))
    there = in_campaign.select(F.lower("recipient_email").alias("_email")).distinct().withColumn("_there", F.lit(True))
    rows = leads.withColumn("_email", F.lower("email")).withColumn("_domain", F.substring_index("_email", "@", -1))
    rows = rows.join(emails, "_email", "left").join(domains, "_domain", "left").join(there, "_email", "left")
    listed = F.coalesce("_by_email", F.lit(False)) | F.coalesce("_by_domain", F.lit(False))
    return rows.withColumns({"blacklisted": listed, "excluded": ~listed & F.coalesce("_there", F.lit(False))}).drop("_email", "_domain", "_by_email", "_by_domain", "_there")


def drafts(leads: DataFrame, template: DataFrame, blacklist: DataFrame, in_campaign: DataFrame) -> DataFrame:
    """Draft e-mails (lead_id, recipient_email, subject, body, missing_fields, is_selected, status) of leads that are neither listed nor there.

    leads: (id, email, person_name, designation, department); template: one row (subject, raw_body). Missing names and
    designations are empty in the subject; the body says Sir/Madam for a missing name. A draft is selected if nothing is missing.
    """
    rows = draft_flags(leads, blacklist, in_campaign).where(~F.col("blacklisted") & ~F.col("excluded")).join(template.limit(1).select("subject", "raw_body"), F.lit(True))
    missing = F.array_join(F.array_compact(F.array(*(F.when(~nonblank(F.col(c)), n) for c, n in (("person_name", "name"), ("designation", "designation"))))), ",")
    values = {"designation": F.col("designation"), "department": F.col("department")}
    return rows.select(
        F.col("id").alias("lead_id"), F.lower("email").alias("recipient_email"),
        filled(F.col("subject"), {"name": F.col("person_name")} | values).alias("subject"),
        filled(F.col("raw_body"), {"name": F.coalesce(F.when(nonblank(F.col("person_name")), F.col("person_name")), F.lit("Sir/Madam"))} | values).alias("body"),
        F.nullif(missing, F.lit("")).alias("missing_fields"), (missing == "").alias("is_selected"), F.lit("DRAFT").alias("status"),
    )


def draft_counts(leads: DataFrame, blacklist: DataFrame, in_campaign: DataFrame) -> DataFrame:
    """blacklisted, excluded and staged, in one pass."""
    flags = draft_flags(leads, blacklist, in_campaign)
    return flags.agg(F.count_if("blacklisted").alias("blacklisted_count"), F.count_if("excluded").alias("excluded_count"), F.count_if(~F.col("blacklisted") & ~F.col("excluded")).alias("staged_count"))


def with_lead_ids(emails: DataFrame, leads: DataFrame) -> DataFrame:
    """Addresses with their lead; unknown ones go."""
    return emails.withColumn("email", F.lower("email")).join(leads.select("email", F.col("id").alias("lead_id")), "email")


def campaign_errors(requests: DataFrame) -> DataFrame:
    """requests (kind, template_id, lead_count, credentials, staged) with errors: why each campaign cannot be created; none if it can. staged: recipients left by the blacklist, if known."""
    c, number = F.col, F.size(F.coalesce("credentials", F.array()))
    tests = {
        "unknown kind": ~F.coalesce(c("kind").isin("production", "test"), F.lit(False)), "a template is needed": c("template_id").isNull(), "a credential is needed": number == 0,
        "a test campaign takes one credential": c("kind").eqNullSafe("test") & (number != 1), "no recipients": F.coalesce("lead_count", F.lit(0)) == 0,
        "all recipients are blacklisted": c("staged").eqNullSafe(0) & (F.coalesce("lead_count", F.lit(0)) != 0),
    }
    return requests.withColumn("errors", F.array_compact(F.array(*(F.when(test, error) for error, test in tests.items()))))


# E-mail states


def _moved(emails: DataFrame, when: Column, **values: Column) -> DataFrame:
    return emails.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def selected(emails: DataFrame, which: Column, on: bool) -> DataFrame:
    """Selection changed for drafts; deselecting a queued e-mail makes it a draft again."""
    back = which & (F.col("status") == "QUEUED") & F.lit(not on)
    drafts_too = which & F.col("status").isin("DRAFT", "QUEUED")
    moved = emails.withColumns({"is_selected": F.when(drafts_too, F.lit(on)).otherwise(F.col("is_selected")), "status": F.when(back, "DRAFT").otherwise(F.col("status"))})
    return moved


def queued(emails: DataFrame, campaign_id: int) -> DataFrame:
    return _moved(emails, (F.col("campaign_id") == campaign_id) & (F.col("status") == "DRAFT") & F.col("is_selected"), status=F.lit("QUEUED"))


def cancelled(emails: DataFrame, campaign_id: int) -> DataFrame:
    return _moved(emails, (F.col("campaign_id") == campaign_id) & (F.col("status") == "QUEUED"), status=F.lit("FAILED"), error_message=F.lit("campaign cancelled"))


def requeued(emails: DataFrame, ids: DataFrame) -> DataFrame:
    """emails with those of ids (id) that were being sent queued again."""
    asked = emails.join(ids.select(F.col("id").alias("_asked")).distinct(), F.col("id") == F.col("_asked"), "left")
    return _moved(asked, F.col("_asked").isNotNull() & (F.col("status") == "SENDING"), status=F.lit("QUEUED"), sending_since=_null_ts()).drop("_asked")


def claimed(emails: DataFrame, now: Column) -> DataFrame:
    """Emails with each campaign's first queued one taken for sending."""
    first = emails.where("status = 'QUEUED'").groupBy("campaign_id").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
    return _moved(emails.join(first, "id", "left"), F.coalesce("_first", F.lit(False)), status=F.lit("SENDING"), sending_since=now).drop("_first")


def recovered(emails: DataFrame, now: Column, stuck_s: int = 600) -> DataFrame:
    """Emails with those queued again that have been sending for longer; one without a start never counts."""
    stuck = (F.col("status") == "SENDING") & (F.timestamp_diff("SECOND", F.col("sending_since"), now) > stuck_s)
    return _moved(emails, F.coalesce(stuck, F.lit(False)), status=F.lit("QUEUED"), sending_since=_null_ts())


def edited(emails: DataFrame, email_id: int, subject: str, body: str) -> DataFrame:
    """Subject and body replaced, whatever the state."""
    return _moved(emails, F.col("id") == email_id, subject=F.lit(subject), body=F.lit(body))


def remaining(emails: DataFrame, campaign_id: int) -> DataFrame:
    """Whether drafts and queued e-mails remain."""
    rows = emails.where(F.col("campaign_id") == campaign_id)
    return rows.agg((F.count_if((F.col("status") == "DRAFT") & F.col("is_selected")) > 0).alias("drafts"), (F.count_if(F.col("status") == "QUEUED") > 0).alias("queued"))


# Outcomes of sending


def outcome(code: Column, error: Column) -> Column:
    """What an attempt means: sent, auth, bounced, throttled, refused or network."""
    return F.when(error == "auth", "auth").when(error == "network", "network").when(code.isNull(), "sent").when(code.isin(550, 553), "bounced").when(code.isin(421, 450, 451), "throttled").otherwise("refused")


def applied(emails: DataFrame, attempts: DataFrame) -> DataFrame:
    """Emails after their last attempt (email_id, seq, code, error, at, credential_id): sent, failed, or queued again."""
    last = attempts.groupBy(F.col("email_id").alias("id")).agg(F.max_by(F.struct(outcome(F.col("code"), F.col("error")).alias("is"), "at", F.col("credential_id").alias("by")), "seq").alias("_o"))
    both = emails.join(last, "id", "left")
    o = F.col("_o.is")
    status = F.when(o == "sent", "SENT").when(o.isin("bounced", "refused"), "FAILED").when(o.isNotNull(), "QUEUED").otherwise(F.col("status"))
    return both.withColumns(
        {
            "status": status,
            "sent_at": F.when(o == "sent", F.col("_o.at")).otherwise(F.col("sent_at")),
            "credential_id": F.coalesce("_o.by", "credential_id"),
            "error_message": F.when(o.isin("bounced", "refused"), o).otherwise(F.col("error_message")),
            "sending_since": F.when(o.isNotNull(), _null_ts()).otherwise(F.col("sending_since")),
        }
    ).drop("_o")


def credential_effects(attempts: DataFrame) -> DataFrame:
    """(credential_id, disable, cooldown_until): an authentication error disables; a throttle cools for an hour, a network error for 15 minutes."""
    o = outcome(F.col("code"), F.col("error"))
    until = F.when(o == "throttled", F.col("at") + F.expr("interval 1 hour")).when(o == "network", F.col("at") + F.expr("interval 15 minutes"))
    return attempts.groupBy("credential_id").agg(F.bool_or(o == "auth").alias("disable"), F.max(until).alias("cooldown_until"))


def bounce_list(attempts: DataFrame, emails: DataFrame) -> DataFrame:
    """(email, domain, reason, seq) of hard bounces."""
    bounced = attempts.where(outcome(F.col("code"), F.col("error")) == "bounced").join(emails.select(F.col("id").alias("email_id"), "recipient_email"), "email_id")
    return bounced.select(F.lower("recipient_email").alias("email"), F.substring_index(F.lower("recipient_email"), "@", -1).alias("domain"), F.lit("hard bounce").alias("reason"), "seq")


# Statistics


def campaign_stats(emails: DataFrame) -> DataFrame:
    """Numbers of each campaign by state in one plan; drafts that are not selected count as skipped, not as drafts."""
    skipped = (F.col("status") == "DRAFT") & ~F.col("is_selected")
    by = {s.lower(): F.count_if((F.col("status") == s) & ~skipped) for s in EMAIL_STATES}
    return emails.groupBy("campaign_id").agg(*(v.alias(k) for k, v in by.items()), F.count_if(skipped).alias("skipped"), F.count("*").alias("total"))


def credential_health(emails: DataFrame, now: Column) -> DataFrame:
    """sent_total, failed_total and sent_today of each credential."""
    sent = F.col("status") == "SENT"
    today = F.coalesce(F.col("sent_at") >= F.date_trunc("day", now).cast("timestamp_ntz"), F.lit(False))
    return emails.where("credential_id is not null").groupBy("credential_id").agg(F.count_if(sent).alias("sent_total"), F.count_if(F.col("status") == "FAILED").alias("failed_total"), F.count_if(sent & today).alias("sent_today"))


def usable_credentials(credentials: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Active credentials that are not cooling down and below their daily limit."""
    rows = credentials.where(F.col("is_active") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") < now)))
    rows = rows.join(health.select(F.col("credential_id").alias("id"), "sent_today"), "id", "left")
    return rows.where(F.col("daily_send_limit").isNull() | (F.coalesce("sent_today", F.lit(0)) < F.col("daily_send_limit"))).drop("sent_today")


def credential_pool(campaigns: DataFrame, links: DataFrame) -> DataFrame:
    """(campaign_id, credential_id): a production campaign's links, a test campaign's one credential."""
    prod = campaigns.where("kind = 'production'").select(F.col("id").alias("campaign_id")).join(links.select("campaign_id", "credential_id"), "campaign_id")
    test = campaigns.where("kind = 'test' and test_credential_id is not null").select(F.col("id").alias("campaign_id"), F.col("test_credential_id").alias("credential_id"))
    return prod.union(test).distinct()


def pool_replaced(links: DataFrame, campaign_id: int, credential_ids: list[int], kind: str) -> DataFrame:
    chosen = credential_ids[:1] if kind == "test" else list(dict.fromkeys(credential_ids))
    new = links.sparkSession.createDataFrame([(campaign_id, c) for c in chosen], "campaign_id long, credential_id long")
    return links.where(F.col("campaign_id") != campaign_id).select("campaign_id", "credential_id").union(new)


def campaign_moved(campaigns: DataFrame, campaign_id: int, status: str, reason: str | None = None) -> DataFrame:
    """A campaign's new state; the reason of a pause goes unless one is given."""
    here = F.col("id") == campaign_id
    return campaigns.withColumns({"status": F.when(here, status).otherwise(F.col("status")), "pause_reason": F.when(here, F.lit(reason).cast("string")).otherwise(F.col("pause_reason"))})


def with_stats(campaigns: DataFrame, emails: DataFrame) -> DataFrame:
    return campaigns.join(campaign_stats(emails).withColumnRenamed("campaign_id", "id"), "id", "left")


def template_updated(templates: DataFrame, template_id: int, **values: str | None) -> DataFrame:
    """Given values replace; null keeps."""
    here = F.col("id") == template_id
    return templates.withColumns({c: F.when(here, F.coalesce(F.lit(v).cast("string"), F.col(c))).otherwise(F.col(c)) for c, v in values.items()})


def merged_campaigns(production: DataFrame, test: DataFrame) -> DataFrame:
    """One table of two kinds by natural key (name, created_at); what is there stays."""
    new = test.withColumn("kind", F.lit("test"))
    old = production.withColumn("kind", F.lit("production"))
    return old.unionByName(new.join(old.select("name", "created_at"), ["name", "created_at"], "left_anti"), allowMissingColumns=True)


def paced(queue: DataFrame, pool_size: Column, gap: Column) -> DataFrame:
    """queue (campaign_id, id, at in seconds) with its credential's slot and the moment it may be sent: slots in turn, each slot's sends at least `gap` seconds apart."""
    from leadwright.operators.history import round_robin, spaced

    dealt = round_robin(queue, "campaign_id", [F.col("id")], pool_size).withColumn("lane", F.concat_ws(":", "campaign_id", "slot"))
    return spaced(dealt, "lane", F.col("at"), gap, [F.col("id")])
