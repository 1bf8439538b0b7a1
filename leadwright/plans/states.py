"""Queries of state: accounts, sessions, jobs, campaigns, catalog and frontier tables, made of the fixture tables by one text for Spark and SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.functions import score as S
from leadwright.functions import text as T
from leadwright.functions import url as U
from leadwright.operators import attribution, domains, fold, frontier, jobs, leads, outreach, rbac, rows
from leadwright.plans import views as V
from leadwright.plans.catalogue import query
from leadwright.policy import DESIGNATION_END, HEADER_WORDS, Policy
from leadwright.sources import catalog, transfer

#: Tables of the engine over the fixture's; {name} is a fixture table.
VIEWS = {
    "users": """select c_custkey as id, concat('u', c_custkey, '@example.org') as email, cast(c_custkey % 4 as bigint) as role_id, c_custkey % 50 = 0 as is_admin, c_acctbal >= 0 as is_active, 1 as token_version,
        cast(c_custkey % 7 as int) as failed_logins, case when c_custkey % 7 > 4 then timestamp '2024-03-01 00:00:00' end as locked_until from {customer}""",
    "roles": "select cast(n_nationkey as bigint) as id, n_name as name, n_nationkey < 2 as is_system from {nation} where n_nationkey < 6",
    "held": "select cast(n_nationkey % 5 as bigint) as role_id, concat('perm.', n_regionkey) as permission_key from {nation} where n_nationkey % 5 <> 3",
    "sessions": """select o_orderkey as id, o_custkey as user_id, concat('h', o_orderkey % 400) as token_hash, o_orderdate + interval 30 day as expires_at,
        case when o_orderstatus = 'F' then o_orderdate + interval 1 day end as revoked_at, o_orderdate as created_at from {orders}""",
    "jobs": """select c_custkey as id, case when c_custkey % 4 = 0 then null else cast(c_custkey % 5 as bigint) end as owner_id,
        case c_custkey % 6 when 0 then 'pending' when 1 then 'running' when 2 then 'interrupted' when 3 then 'done' when 4 then 'failed' else 'cancelled' end as status,
        case when c_custkey % 3 = 0 then c_mktsegment else '' end as title_filter, case when c_custkey % 5 = 0 then 'cat' end as category_filter, case when c_custkey % 2 = 0 then 'catalog' end as source_type,
        cast(c_custkey % 90 as int) as visited_urls, cast(c_custkey % 40 as int) as queued_urls, false as cancel_requested, cast(null as varchar(9)) as error_message,
        case when c_custkey % 9 = 0 then concat('agent', c_custkey % 3) end as agent_hostname, timestamp '2024-01-01 00:00:00' + interval 1 hour * (c_custkey % 311) as created_at,
        timestamp '2024-02-01 00:00:00' + interval 1 minute * c_custkey as started_at, case when c_custkey % 6 = 3 then timestamp '2024-02-09 00:00:00' end as finished_at from {customer}""",
    "campaigns": """select s_suppkey as id, concat('c', s_suppkey % 30) as name, case when s_suppkey % 3 = 0 then 'test' else 'production' end as kind, case when s_suppkey % 6 = 0 then s_suppkey % 10 end as test_credential_id,
        case when s_suppkey % 4 = 0 then 'RUNNING' else 'PAUSED' end as status, 'by hand' as pause_reason, timestamp '2024-01-01 00:00:00' + interval 1 day * (s_suppkey % 7) as created_at from {supplier}""",
    "pool": "select s_suppkey as campaign_id, s_suppkey % 10 as credential_id from {supplier} union all select s_suppkey, s_suppkey % 7 from {supplier}",
    "credentials": """select cast(n_nationkey as bigint) as id, n_nationkey % 4 <> 0 as is_active, case when n_nationkey % 3 = 0 then timestamp '1998-06-01 12:00:00' + interval 1 hour * (n_nationkey - 12) end as cooldown_until,
        case when n_nationkey % 2 = 0 then 3 end as daily_send_limit from {nation}""",
    "attempts": """select l_orderkey as email_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber as seq, case l_partkey % 8 when 0 then 550 when 1 then 421 when 2 then 553 when 3 then 503 end as code,
        case l_suppkey % 9 when 0 then 'auth' when 1 then 'network' end as error, l_shipdate as sent, l_suppkey % 10 as credential_id from {lineitem}""",
    "black": "select concat('user', c_custkey % 40, '@Mail.example.com') as email, case when c_custkey % 3 = 0 then 'Old.example.net' else '' end as domain, 'r' as reason, c_custkey as seq from {customer}",
    "settings": "select r_name as key, concat('v', r_regionkey) as value, cast(r_regionkey as bigint) as updated_by, timestamp '2024-01-01 00:00:00' + interval 1 day * r_regionkey as updated_at from {region}",
    "tries": "select page_id, cast(t as bigint) as seq, case when (page_id + t) % 3 = 0 then 'reset' end as error, case when page_id % 7 = 0 then 404 else 200 end as status, url as final_url, html from {pages} cross join (select 0 as t union all select 1 union all select 2) x",
    "queue": "select event_id as id, user_id % 20 as job_id, event_type as kind, cast(event_id % 9 as int) as attempts, cast(null as varchar(9)) as last_error from {events}",
    "entries": """select page_id as seq, case when page_id % 3 = 0 then concat('x', page_id % 20) else '' end as external_id, case when page_id % 4 = 0 then null else concat('https://site', page_id % 35, '.example.com') end as main_url,
        concat('cat', page_id % 4) as category_code, concat('Cat ', page_id % 6) as category_title, concat('org', page_id % 3) as org_type, concat('Org ', page_id % 5) as org_type_title,
        concat('s', page_id % 2) as state, concat('Entry ', page_id) as title from {pages}""",
    "listed": """select page_id as id, case when page_id % 2 = 0 then concat('x', page_id) end as external_id, concat('https://site', page_id, '.example.com') as main_url, 'old' as category_code, 'Old' as category_title,
        'org9' as org_type, 'Org nine' as org_type_title, 's9' as state, concat('Listed ', page_id) as title from {pages} where page_id < 30""",
    "found": """select event_id as seq, user_id % 5 as job_id, event_id % 60 as source_domain_id, event_id % 4 = 0 as is_seed, concat('t', event_id) as title from {events}""",
    "frozen": "select user_id % 5 as job_id, user_id % 60 as source_domain_id, min(event_id) as id from {events} where event_type = 'signup' group by 1, 2",
    "fetched": "select user_id % 12 as job_id, concat('u', event_id) as url, cast(event_id % 5 as int) as depth, event_id % 5 = 0 as is_seed, event_type <> 'error' as fetched, cast(event_id % 3 as bigint) as leads from {events}",
}


def made(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A view by its text, in Spark."""
    text = VIEWS[name].replace("timestamp '", "timestamp_ntz '").replace("varchar(9)", "string")
    return spark.sql(text, **{t: V.table(spark, d, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def having(*names: str) -> str:
    """The same views in SQL."""
    return "with " + ",\n".join(f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names) + "\n"


def ts(text: str):
    return F.expr(f"timestamp_ntz '{text}'")


# Accounts


@query(having("users", "roles") + "select u.id, u.email, r.name as role_name from users u left join roles r on r.id = u.role_id")
def users_with_roles(spark, d):
    return rbac.users_with_roles(made(spark, d, "users"), made(spark, d, "roles")).select("id", "email", "role_name")


@query(having("users") + "select count(*) filter (where is_admin and is_active) as active_admins from users")
def active_admins(spark, d):
    return rbac.active_admins(made(spark, d, "users"))


@query(having("users") + "select id, (select count(*) from users where is_admin and is_active) - (coalesce(is_admin and is_active, false))::int > 0 as kept from users")
def admin_kept(spark, d):
    return rbac.admin_kept(made(spark, d, "users"))


_REQUESTS = (
    "s_suppkey as id", "case s_suppkey % 4 when 0 then 'test' when 1 then 'trial' when 2 then null else 'production' end as kind", "case when s_suppkey % 5 <> 0 then s_suppkey end as template_id",
    "s_suppkey % 3 as lead_count", "case when s_suppkey % 7 = 0 then null else s_suppkey % 3 end as number", "case when s_suppkey % 2 = 0 then s_suppkey % 4 end as staged",
)


@query(f"""with asked as (select {', '.join(_REQUESTS)} from supplier), told as (select id, [case when coalesce(kind not in ('production', 'test'), true) then 'unknown kind' end, case when template_id is null then 'a template is needed' end,
        case when coalesce(number, 0) = 0 then 'a credential is needed' end, case when kind = 'test' and coalesce(number, 0) <> 1 then 'a test campaign takes one credential' end, case when lead_count = 0 then 'no recipients' end,
        case when staged = 0 and lead_count <> 0 then 'all recipients are blacklisted' end] as errors from asked)
    select id, coalesce(array_to_string(list_filter(errors, lambda e: e is not null), '; '), '') as errors from told""")
def campaign_errors(spark, d):
    rows = V.table(spark, d, "supplier").selectExpr(*_REQUESTS).withColumn("credentials", F.when(F.col("number") > 0, F.sequence(F.lit(1), F.col("number").cast("int"))))
    return outreach.campaign_errors(rows).select("id", F.array_join("errors", "; ").alias("errors"))


@query(having("roles", "held") + "select r.id, r.name, array_to_string(list_sort(coalesce(list(distinct permission_key) filter (where permission_key is not null), [])), ',') as permissions from roles r left join held h on h.role_id = r.id group by 1, 2")
def roles_with_permissions(spark, d):
    return rbac.roles_with_permissions(made(spark, d, "roles"), made(spark, d, "held")).select("id", "name", F.array_join("permissions", ",").alias("permissions"))


@query(having("roles", "users") + "select id, name from roles r where not (id = 4 and not is_system and not exists (select 1 from users u where u.role_id = 4)) and not (id = 3 and not is_system and not exists (select 1 from users u where u.role_id = 3))")
def role_removal(spark, d):
    """Role 4 is unused and goes; role 3 is in use and stays."""
    rows, users = made(spark, d, "roles"), made(spark, d, "users")
    return rbac.role_removed(rbac.role_removed(rows, users, 4), users, 3).select("id", "name")


@query(having("held") + "select role_id, permission_key from held union all select 9, permission_key from held where role_id = 1")
def role_clone(spark, d):
    return rbac.role_cloned(made(spark, d, "held"), 1, 9)


@query(having("roles") + ", defaults(id, name) as (values (1, 'other'), (7, 'Admin'), (8, 'Viewer')) select id, name, is_system from roles union all select id, name, true from defaults where id not in (select id from roles)")
def role_seeding(spark, d):
    defaults = spark.createDataFrame([(1, "other", True), (7, "Admin", True), (8, "Viewer", True)], "id long, name string, is_system boolean")
    return rbac.seeded(made(spark, d, "roles"), defaults, ["id"])


@query(having("users") + """select id, case when id = 12 then 0 when id = 11 then failed_logins + 1 when id = 2 then failed_logins + 1 else failed_logins end as failed_logins,
    case when id = 12 then null when id = 11 then timestamp '2024-05-01 00:15:00' else locked_until end as locked_until from users""")
def login_state(spark, d):
    """User 12 comes in; user 11 fails a fifth time and is locked; user 2 fails a third time."""
    now = ts("2024-05-01 00:00:00")
    rows = rbac.login_succeeded(made(spark, d, "users"), 12)
    return rbac.login_failed(rbac.login_failed(rows, 11, now), 2, now).select("id", "failed_logins", "locked_until")


@query(having("users", "sessions") + """select s.id, u.token_version + case when u.id = 7 then 1 else 0 end as token_version, case when s.user_id = 7 and s.revoked_at is null then timestamp '1999-01-01 00:00:00' else s.revoked_at end as revoked_at
    from sessions s join users u on u.id = s.user_id""")
def password_reset(spark, d):
    users, sessions = rbac.password_reset(made(spark, d, "users"), made(spark, d, "sessions"), 7, ts("1999-01-01 00:00:00"))
    return sessions.join(users.select(F.col("id").alias("user_id"), "token_version"), "user_id").select("id", "token_version", "revoked_at")


@query(having("sessions") + "select id, user_id from sessions where revoked_at is null and expires_at > timestamp '1996-01-01 00:00:00'")
def live_sessions(spark, d):
    return rbac.live_sessions(made(spark, d, "sessions"), ts("1996-01-01 00:00:00")).orderBy(*rbac.session_order()).select("id", "user_id")


@query(having("sessions") + ", shown as (select sha256('t' || (event_id % 500)) as token_hash, ts as at from events), kept as (select sha256('t' || (id % 400)) as token_hash, user_id, revoked_at from sessions) select distinct k.user_id from shown s join kept k using (token_hash) where k.revoked_at is not null and s.at >= k.revoked_at")
def reused_tokens(spark, d):
    shown = V.table(spark, d, "events").select(F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")).alias("token"), F.col("ts").alias("at"))
    kept = made(spark, d, "sessions").withColumn("token_hash", F.sha2(F.concat(F.lit("t"), (F.col("id") % 400).cast("string")), 256))
    return rbac.reused_tokens(shown, kept)


@query("select event_id as id from events where date_diff('second', date_trunc('second', ts), timestamp '2024-01-20 00:00:00') <= 90000")
def pending_flows_sweep(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("created_at"))
    return rbac.swept(rows, ts("2024-01-20 00:00:00"), 90000).select("id")


@query("""select event_id as id, '{"kind":"' || event_type || '","user":' || user_id || '}' as detail from events""")
def audit_details(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return rbac.audit_entry(rows, ["kind", "user"])


@query(having("jobs") + "select id, owner_id is null or owner_id <> 3 as others, id % 2 = 0 or coalesce(owner_id = 3, false) as may_see from jobs")
def ownership(spark, d):
    rows = made(spark, d, "jobs")
    mine = jobs.owned(rows, 3).select("id", F.lit(False).alias("others"))
    told = jobs.owned(rows, None, view_all=True).join(mine, "id", "left").withColumn("others", F.coalesce("others", F.lit(True)))
    return told.select("id", "others", rbac.owner_or(F.col("owner_id"), 3, F.col("id") % 2 == 0).alias("may_see"))


@query(f"""with asked as (select event_id as id, list_distinct(['leads.' || event_type, event_type || 's.view', 'leads.view']) as keys from events)
    select id, array_to_string(list_sort(list_filter(keys, lambda k: k not in ({", ".join(f"'{p}'" for p in rbac.PERMISSIONS)}))), ',') as unknown from asked""")
def unknown_permissions(spark, d):
    keys = F.expr("array(concat('leads.', event_type), concat(event_type, 's.view'), 'leads.view')")
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(F.array_sort(rbac.unknown_permissions(keys)), ",").alias("unknown"))


@query("""with overrides as (select c_custkey as user_id, 'perm.' || (c_custkey % 5) as permission_key, case when c_acctbal < 0 then 'deny' else 'grant' end as effect from customer)
    select * from overrides where not (user_id = 11 and permission_key in ('perm.1', 'perm.9')) and not (user_id = 12 and permission_key = 'perm.2')
    union all select 11, 'perm.1', 'deny' union all select 11, 'perm.9', 'grant'""")
def permission_override(spark, d):
    """One override changes, one goes and one is new."""
    rows = V.table(spark, d, "customer").selectExpr("c_custkey as user_id", "concat('perm.', c_custkey % 5) as permission_key", "case when c_acctbal < 0 then 'deny' else 'grant' end as effect")
    return rbac.override_set(rbac.override_set(rbac.override_set(rows, 11, "perm.1", "deny"), 12, "perm.2", None), 11, "perm.9", "grant")


# Jobs


@query(having("jobs") + "select id, created_at from jobs order by created_at desc, id desc limit 20 offset 20")
def job_page(spark, d):
    return jobs.newest(made(spark, d, "jobs"), 2, 20).select("id", "created_at")


@query(having("jobs") + """select id, case when id in (6, 7) and status = 'pending' then 'running' when id in (8, 9, 10, 13) and status not in ('done', 'failed', 'cancelled') then 'failed' when id in (14, 15, 16) and status <> 'done' then 'running' else status end as status,
    case when id in (8, 9, 10, 13) and status not in ('done', 'failed', 'cancelled') then timestamp '2024-04-01 00:00:00' when id in (14, 15, 16) and status <> 'done' then null else finished_at end as finished_at,
    case when id in (8, 9, 10, 13) and status not in ('done', 'failed', 'cancelled') then 'lost' end as error_message, id in (19, 20, 21) and status not in ('done', 'failed', 'cancelled') as cancel_requested from jobs""")
def job_moves(spark, d):
    """Jobs 6 and 7 start, 8 to 13 end in failure, 14 to 16 are resumed, 19 to 21 are asked to stop."""
    now = ts("2024-04-01 00:00:00")
    rows = jobs.finished(jobs.started(made(spark, d, "jobs"), [6, 7], now), [8, 9, 10, 13], "failed", now, "lost")
    return jobs.cancel_requested(jobs.resumed(rows, [14, 15, 16]), [19, 20, 21]).select("id", "status", "finished_at", "error_message", "cancel_requested")


@query(having("jobs") + "select id, case when id = 10 then coalesce(agent_hostname, 'me') else agent_hostname end as agent_hostname, coalesce(id = 10 and case when id = 10 then coalesce(agent_hostname, 'me') end = 'me', false) as mine from jobs")
def job_claim(spark, d):
    return jobs.claimed(made(spark, d, "jobs"), 10, "me").select("id", "agent_hostname", F.coalesce("mine", F.lit(False)).alias("mine"))


@query(having("jobs", "campaigns") + """, labels as (select *, 'Job #' || id || ' (' || coalesce(nullif(title_filter, ''), nullif(category_filter, ''), source_type, 'all') || ')' as label from jobs)
    select 'running job' as section, id, label, status from labels where status = 'running' union all select 'running campaign', id, 'Campaign #' || id || ' (' || name || ')', status from campaigns where status = 'RUNNING'
    union all select * from (select 'recent job' as section, id, label, status from labels where status <> 'running' order by created_at desc, id desc limit 5)""")
def activity(spark, d):
    return jobs.activity(made(spark, d, "jobs"), made(spark, d, "campaigns"))


@query(having("jobs") + """select id, cast(case when visited_urls + queued_urls = 0 then 0 else round(visited_urls * 100.0 / (visited_urls + queued_urls)) end as int) as percent, date_diff('second', started_at, coalesce(finished_at, timestamp '2024-03-01 00:00:00')) as elapsed_s from jobs""")
def job_progress(spark, d):
    return jobs.progress_panel(made(spark, d, "jobs"), ts("2024-03-01 00:00:00")).select("id", "percent", "elapsed_s")


@query(having("jobs") + "select id from jobs where status = 'running' and id % 5 <> 1")
def jobs_without_task(spark, d):
    rows = made(spark, d, "jobs").where("status = 'running'")
    return jobs.without_task(rows, rows.where("id % 5 = 1")).select("id")


@query(having("jobs", "users") + "select id, coalesce(owner_id, (select min(id) from users where is_admin)) as owner_id from jobs")
def job_adoption(spark, d):
    return jobs.adopted(made(spark, d, "jobs"), made(spark, d, "users")).select("id", "owner_id")


@query(having("jobs", "found") + """select 'job' as kind, id, '' as value from jobs union all select 'job', 5000001, '' union all select distinct 'domain', 5000001, cast(source_domain_id as varchar) from found
    union all select 'url', 5000001, title from found group by title""")
def job_creation(spark, d):
    """A job with its domains and addresses, each once."""
    rows, new = made(spark, d, "jobs").select("id", "status"), spark.createDataFrame([(5000001, "pending")], "id long, status string")
    found = made(spark, d, "found").select(F.lit(5000001).cast("long").alias("job_id"), F.col("source_domain_id").alias("domain_id"), "title", "seq")
    urls = found.select("job_id", F.col("title").alias("url"), "seq")
    all_jobs, of_domains, of_urls = jobs.created(rows, new, found, urls.union(urls))
    return all_jobs.select(F.lit("job").alias("kind"), "id", F.lit("").alias("value")).union(of_domains.select(F.lit("domain"), "job_id", F.col("domain_id").cast("string"))).union(of_urls.select(F.lit("url"), "job_id", "url"))


# Campaigns


@query(having("credentials") + ", " + V.MAIL + """, health as (select credential_id as id, count(*) filter (where status = 'SENT' and sent_at >= timestamp '1998-06-01') as sent_today from mail group by 1)
    select c.id from credentials c left join health h using (id) where is_active and (cooldown_until is null or cooldown_until < timestamp '1998-06-01 13:00:00') and (daily_send_limit is null or coalesce(sent_today, 0) < daily_send_limit)""")
def usable_credentials(spark, d):
    now = ts("1998-06-01 13:00:00")
    return outreach.usable_credentials(made(spark, d, "credentials"), outreach.credential_health(V.mail(spark, d), now), now).select("id")


@query(having("campaigns", "pool") + "select c.id as campaign_id, p.credential_id from campaigns c join pool p on p.campaign_id = c.id where kind = 'production' union select id, test_credential_id from campaigns where kind = 'test' and test_credential_id is not null")
def credential_pool(spark, d):
    return outreach.credential_pool(made(spark, d, "campaigns"), made(spark, d, "pool"))


@query(having("pool") + "select campaign_id, credential_id from pool where campaign_id not in (1, 2) union all values (1, 4), (1, 6), (2, 9)")
def pool_replacement(spark, d):
    rows = outreach.pool_replaced(made(spark, d, "pool"), 1, [4, 6, 4], "production")
    return outreach.pool_replaced(rows, 2, [9, 3], "test")


@query(having("campaigns") + "select id, case id when 4 then 'PAUSED' when 5 then 'RUNNING' else status end as status, case id when 4 then 'cooling' when 5 then null else pause_reason end as pause_reason from campaigns")
def campaign_moves(spark, d):
    rows = outreach.campaign_moved(made(spark, d, "campaigns"), 4, "PAUSED", "cooling")
    return outreach.campaign_moved(rows, 5, "RUNNING").select("id", "status", "pause_reason")


@query(having("campaigns") + ", " + V.MAIL + ", counts as (select campaign_id as id, count(*) filter (where status = 'SENT') as sent, count(*) as total from mail group by 1) select c.id, c.name, n.sent, n.total from campaigns c left join counts n using (id)")
def campaigns_with_stats(spark, d):
    return outreach.with_stats(made(spark, d, "campaigns"), V.mail(spark, d)).select("id", "name", "sent", "total")


@query(having("campaigns") + "select id, name, 'production' as kind from campaigns where kind = 'production' union all select t.id, t.name, 'test' from campaigns t where kind = 'test' and not exists (select 1 from campaigns p where p.kind = 'production' and p.name = t.name and p.created_at = t.created_at)")
def campaign_kinds_merge(spark, d):
    rows = made(spark, d, "campaigns")
    return outreach.merged_campaigns(rows.where("kind = 'production'"), rows.where("kind = 'test'")).select("id", "name", "kind")


@query("with " + V.MAIL + """ select id, case when campaign_id = 2 and status = 'DRAFT' and (is_selected or id % 3 = 0) then 'QUEUED' when campaign_id = 3 and status = 'QUEUED' then 'FAILED' when id < 400 and status = 'SENDING' then 'QUEUED' when campaign_id = 5 and status = 'QUEUED' then 'DRAFT' else status end as status,
    case when campaign_id = 2 and status = 'DRAFT' and id % 3 = 0 then true when campaign_id = 5 and status in ('DRAFT', 'QUEUED') then false else is_selected end as is_selected,
    case when campaign_id = 3 and status = 'QUEUED' then 'campaign cancelled' end as error_message from mail""")
def mail_moves(spark, d):
    """Campaign 2 selects a third and is queued, campaign 3 is cancelled, campaign 5 is deselected, and e-mails below 400 are queued again."""
    c = F.col
    rows = outreach.selected(V.mail(spark, d), (c("campaign_id") == 2) & (c("id") % 3 == 0) & (c("status") == "DRAFT"), True)
    rows = outreach.cancelled(outreach.queued(rows, 2), 3)
    rows = outreach.selected(rows, c("campaign_id") == 5, False)
    return outreach.requeued(rows, V.mail(spark, d).where("id < 400").select("id")).select("id", "status", "is_selected", "error_message")


@query("with " + V.MAIL + " select bool_or(status = 'DRAFT' and is_selected) as drafts, bool_or(status = 'QUEUED') as queued from mail where campaign_id = 7")
def mail_remaining(spark, d):
    return outreach.remaining(V.mail(spark, d), 7)


@query("with " + V.MAIL + " select id, case when id = 33 then 'New' else 's' end as subject, case when id = 33 then 'text' else 'b' end as body from mail")
def mail_edit(spark, d):
    return outreach.edited(V.mail(spark, d), 33, "New", "text").select("id", "subject", "body")


_OUTCOME = "case when error = 'auth' then 'auth' when error = 'network' then 'network' when code is null then 'sent' when code in (550, 553) then 'bounced' when code in (421, 450, 451) then 'throttled' else 'refused' end"


@query(having("attempts") + ", " + V.MAIL + f""", last as (select email_id as id, arg_max({_OUTCOME}, seq) as o, arg_max(sent, seq) as moment, arg_max(credential_id, seq) as by_id from attempts group by 1)
    select m.id, case when o = 'sent' then 'SENT' when o in ('bounced', 'refused') then 'FAILED' when o is not null then 'QUEUED' else status end as status, case when o = 'sent' then moment else sent_at end as sent_at,
    coalesce(by_id, m.credential_id) as credential_id, case when o in ('bounced', 'refused') then o end as error_message, case when o is null then sending_since end as sending_since from mail m left join last using (id)""")
def mail_outcomes(spark, d):
    return outreach.applied(V.mail(spark, d), made(spark, d, "attempts").withColumnRenamed("sent", "at")).select("id", "status", "sent_at", "credential_id", "error_message", "sending_since")


@query(having("attempts") + f", o as (select *, {_OUTCOME} as o from attempts) select credential_id, bool_or(o = 'auth') as disable, max(case when o = 'throttled' then sent + interval 1 hour when o = 'network' then sent + interval 15 minute end) as cooldown_until from o group by 1")
def credential_effects(spark, d):
    return outreach.credential_effects(made(spark, d, "attempts").withColumnRenamed("sent", "at"))


@query(having("attempts", "black") + ", " + V.MAIL + f""", hard as (select lower(recipient_email) as email, 'mail.example.com' as domain from attempts a join mail m on m.id = a.email_id where {_OUTCOME} = 'bounced')
    select email, domain from black union all select distinct email, domain from hard h where not exists (select 1 from black b where b.email = h.email)""")
def bounce_blacklist(spark, d):
    rows = made(spark, d, "black")
    return outreach.add_to_blacklist(rows, outreach.bounce_list(made(spark, d, "attempts"), V.mail(spark, d))).select("email", "domain")


@query(having("black") + "select distinct 'email' as kind, lower(email) as value from black union select distinct 'domain', lower(domain) from black where domain <> ''")
def blacklist_sets(spark, d):
    return outreach.blacklist_sets(made(spark, d, "black"))


@query("with " + V.LEADS + ", given as (select distinct upper('user' || (o_custkey % 90) || '@building.com') as email from orders) select lower(g.email) as email, l.id as lead_id from given g join leads l on l.email = lower(g.email)")
def addresses_to_leads(spark, d):
    given = V.table(spark, d, "orders").select(F.upper(F.concat(F.lit("user"), (F.col("o_custkey") % 90).cast("string"), F.lit("@building.com"))).alias("email")).distinct()
    return outreach.with_lead_ids(given, V.leads(spark, d)).select("email", "lead_id")


@query("select p_partkey as id, case when p_partkey = 5 then 'Hello' else p_name end as subject, p_type as raw_body from part")
def template_update(spark, d):
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_type").alias("raw_body"))
    return outreach.template_updated(rows, 5, subject="Hello", raw_body=None)


@query("""with e as (select event_id as id, user_id % 5 as campaign_id, cast(floor(epoch(ts)) as bigint) as due, (row_number() over (partition by user_id % 5 order by event_id) - 1) % 3 as slot from events),
    n as (select *, row_number() over (partition by campaign_id, slot order by id) as i from e) select id, slot, max(due - i * 60) over (partition by campaign_id, slot order by i rows unbounded preceding) + i * 60 as start from n""")
def paced_sending(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("campaign_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return outreach.paced(rows, F.lit(3), F.lit(60)).select("id", F.col("slot").cast("long").alias("slot"), "start")


# Outbox and transfers


@query(having("queue") + "select id, job_id from queue where kind = 'click' order by id limit 100")
def outbox_pending(spark, d):
    return transfer.pending(made(spark, d, "queue"), "click").select("id", "job_id")


@query(having("queue") + "select job_id, count(*) as pending from queue group by 1")
def outbox_drained(spark, d):
    return transfer.drained(made(spark, d, "queue"))


@query(having("queue") + "select id, attempts + case when id % 3 = 0 then 1 else 0 end as attempts, case when id % 3 = 0 then 'timeout' end as last_error, attempts + case when id % 3 = 0 then 1 else 0 end >= 8 as dead from queue")
def outbox_failure(spark, d):
    rows = made(spark, d, "queue")
    live, dead = transfer.failed(rows, rows.where("id % 3 = 0"), "timeout")
    return live.withColumn("dead", F.lit(False)).union(dead.withColumn("dead", F.lit(True))).select("id", "attempts", "last_error", "dead")


@query("""with rows as (select c_custkey as id, c_custkey % 70 as parent from customer where c_custkey % 7 <> 3), ids as (select id as old_id, id * 2 + 10 as new_id from rows)
    select r.new_id as id, p.new_id as parent from rows join ids r on r.old_id = rows.id left join ids p on p.old_id = rows.parent""")
def self_reference_remap(spark, d):
    """Rows whose parent is gone keep none."""
    rows = V.table(spark, d, "customer").where("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 70).alias("parent"))
    ids = rows.select(F.col("id").alias("old_id"), (F.col("id") * 2 + 10).alias("new_id"))
    return transfer.self_remapped(rows, ids, "parent").select("id", "parent")


@query(having("listed") + "select title, main_url from listed union all select 'Listed ' || page_id, 'new' from pages where page_id >= 30")
def insert_if_absent(spark, d):
    new = V.table(spark, d, "pages").select(F.concat(F.lit("Listed "), F.col("page_id").cast("string")).alias("title"), F.lit("new").alias("main_url"))
    return transfer.inserted(made(spark, d, "listed").select("title", "main_url"), new.union(new), ["title"])


@query("select user_id as key, max(event_id) as at, arg_max(event_type, event_id) as value from events group by 1")
def upsert_latest(spark, d):
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("value"))
    return transfer.upsert_latest(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"), "key", "at")


# Catalog


_KEYED = """keyed as (select *, coalesce('ext:' || nullif(external_id, ''), 'url:' || nullif(main_url, ''), 'row:' || seq) as k from entries),
    lasts as (select k, min(seq) as first_seq, max(seq) as last_seq from keyed group by k), new as (select l.first_seq as seq, e.external_id, e.main_url, e.category_code, e.state, e.title from lasts l join keyed e on e.k = l.k and e.seq = l.last_seq)"""


@query(having("entries", "listed") + f""", {_KEYED},
    ext as (select external_id, min(id) as id from listed where external_id <> '' group by 1), url as (select main_url, min(id) as id from listed where main_url <> '' group by 1),
    changes as (select coalesce(case when n.external_id <> '' then e.id end, case when coalesce(n.external_id, '') = '' then u.id end) as id, n.seq, n.external_id, n.main_url, n.category_code, n.title from new n
        left join ext e on e.external_id = n.external_id left join url u on u.main_url = n.main_url)
    select id, cast(null as bigint) as seq, external_id, main_url, category_code, title from listed where id not in (select id from changes where id is not null) union all select id, seq, external_id, main_url, category_code, title from changes""")
def catalog_upsert(spark, d):
    cols = ["category_code", "category_title", "state", "org_type", "org_type_title", "title", "main_url", "external_id"]
    rows = domains.upsert_domains(made(spark, d, "listed").select("id", *cols), made(spark, d, "entries").select("seq", *cols))
    return rows.select("id", "seq", "external_id", "main_url", "category_code", "title")


@query(having("entries") + f""", {_KEYED} select 'entry' as kind, cast(seq as varchar) as code, title from new union all select 'category', category_code, arg_max(category_title, seq) from entries group by category_code
    union all select 'org', org_type, arg_max(org_type_title, seq) from entries group by org_type""")
def catalog_replacement(spark, d):
    entries, categories, kinds = domains.replace_catalog(made(spark, d, "entries"))
    return entries.select(F.lit("entry").alias("kind"), F.col("seq").cast("string").alias("code"), "title").union(categories.select(F.lit("category"), "code", "title")).union(kinds.select(F.lit("org"), "code", "title"))


@query(having("entries") + """, inside as (select *, coalesce(nullif(external_id, ''), concat_ws('|', coalesce(title, ''), coalesce(main_url, ''))) as k from entries),
    last as (select *, row_number() over (partition by k, category_code, state, org_type order by seq desc) as n from inside), across as (select *, row_number() over (partition by k order by seq) as m from last where n = 1)
    select seq, category_code, title from across where m = 1""")
def catalog_first_category(spark, d):
    return catalog.first_category_wins(made(spark, d, "entries")).select("seq", "category_code", "title")


@query(having("entries") + ", titles(code, title) as (values ('org0', 'Ministry'), ('org1', 'Board')) select seq, coalesce(t.title, org_type) as org_type_title from entries left join titles t on t.code = org_type")
def catalog_org_titles(spark, d):
    titles = spark.createDataFrame([("org0", "Ministry"), ("org1", "Board")], "code string, title string")
    return catalog.with_org_titles(made(spark, d, "entries"), titles).select("seq", "org_type_title")


@query(having("entries") + "select category_code as code, min(category_title) as title from entries where category_code <> 'cat1' group by 1")
def lookup_seeding(spark, d):
    known = spark.createDataFrame([("cat1", "known")], "code string, title string")
    return domains.seed_lookup(known, made(spark, d, "entries"), "category_code", "category_title")


@query(having("listed") + "select id, case when id = 3 then 'https://new.example.com' else main_url end as main_url from listed where id in (1, 3, 5, 7) union all select id, main_url from listed where id in (8, 9)")
def catalog_by_ids(spark, d):
    rows = domains.set_urls(made(spark, d, "listed").withColumn("contact_url", F.lit("c")), 3, "https://new.example.com", None)
    keys = spark.createDataFrame([(8,), (9,), (9,), (999,)], "id long")
    return domains.by_ids(rows, [1, 3, 5, 7]).union(domains.by_ids(rows, keys)).select("id", "main_url")


@query(having("listed") + "select cast(j.job_id as bigint) as job_id, l.id as domain_id from (values (1, 2), (1, 4), (2, 4), (2, 6)) j(job_id, domain_id) join listed l on l.id = j.domain_id")
def job_domain_lists(spark, d):
    rows = spark.createDataFrame([(1, "[2, 4, 4, 9999]"), (2, "[4,6]"), (3, "not a list"), (4, None)], "id long, domain_ids string")
    return domains.explode_ids(rows, made(spark, d, "listed"))


@query(having("entries") + "select min(seq) as seq, state from entries group by state")
def first_arrivals(spark, d):
    return domains.first_arrivals(made(spark, d, "entries"), F.col("state")).select("seq", "state")


@query(having("found", "frozen") + """, firsts as (select *, row_number() over (partition by job_id, source_domain_id order by seq) as n from found)
    select job_id, source_domain_id, is_seed, title from firsts f where n = 1 and not exists (select 1 from frozen z where z.job_id = f.job_id and z.source_domain_id = f.source_domain_id)""")
def snapshot_freezing(spark, d):
    return attribution.snapshots(made(spark, d, "frozen"), made(spark, d, "found")).select("job_id", "source_domain_id", "is_seed", "title")


@query(having("found", "frozen", "listed") + """, own as (select seq as id, job_id, source_domain_id as domain_id from found)
    select 'missing' as kind, cast(null as bigint) as id, job_id, domain_id, cast(null as bigint) as snapshot_id from (select distinct job_id, domain_id from own where domain_id in (select id from listed)) o where not exists (select 1 from frozen z where z.job_id = o.job_id and z.source_domain_id = o.domain_id)
    union all select 'lead', o.id, o.job_id, o.domain_id, z.id from own o left join frozen z on z.job_id = o.job_id and z.source_domain_id = o.domain_id""")
def snapshot_backfill(spark, d):
    own = made(spark, d, "found").select(F.col("seq").alias("id"), "job_id", F.col("source_domain_id").alias("domain_id"), F.lit(None).cast("long").alias("snapshot_id"))
    listed = made(spark, d, "listed")
    missing, told = attribution.backfill_snapshots(own, listed, made(spark, d, "frozen"))
    none = F.lit(None).cast("long")
    return missing.select(F.lit("missing").alias("kind"), none.alias("id"), "job_id", F.col("source_domain_id").alias("domain_id"), none.alias("snapshot_id")).union(told.select(F.lit("lead"), "id", "job_id", "domain_id", "snapshot_id"))


@query("with " + ",\n".join([V.HOSTS, V.CATALOG, V.ATTRIBUTED]) + """, own as (select page_id as id, case when page_id % 4 = 0 then null else page_id % 50 end as snapshot_id, case page_id % 5 when 0 then 'manual' when 1 then null else 'office' end as channel_tag from hosts),
    snaps as (select x.s as id, x.s * 3 as source_domain_id from range(0, 50) x(s))
    select o.id, o.snapshot_id, s.source_domain_id as old_domain_id, a.domain_id from own o join attributed a on a.page_id = o.id left join snaps s on s.id = o.snapshot_id where o.channel_tag = 'office' and s.source_domain_id is distinct from a.domain_id""")
def attribution_repair(spark, d):
    pages = V.table(spark, d, "pages").selectExpr("page_id as id", "case when page_id % 4 = 0 then null else page_id % 50 end as snapshot_id", "url as source_url", "case page_id % 5 when 0 then 'manual' when 1 then null else 'office' end as channel_tag")
    snaps = spark.range(50).selectExpr("id", "id * 3 as source_domain_id")
    return attribution.repair(pages, snaps, V.catalog(spark, d), V.SUFFIXES)


@query(r"""with p as (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as full_name from pages), seeds as (select case when page_id % 2 = 0 then full_name else regexp_replace(full_name, '^www[.]', '') end as netloc, min(page_id) as snapshot_id from p where page_id % 5 = 0 group by 1)
    select p.page_id, coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id from p left join seeds a on a.netloc = p.full_name left join seeds b on b.netloc = regexp_replace(p.full_name, '^www[.]', '')""")
def root_snapshots(spark, d):
    pages = V.table(spark, d, "pages").select("page_id", "url")
    name = F.when(F.col("page_id") % 2 == 0, U.authority(F.col("url"))).otherwise(U.netloc(F.col("url")))
    seeds = pages.where("page_id % 5 = 0").select(name.alias("netloc"), F.col("page_id").alias("snapshot_id"))
    return attribution.root_snapshot(pages, seeds).select("page_id", "snapshot_id")


# Leads


@query("with " + V.LEADS + """ select id, case when id in (4, 9) then 'Ann Lee' else person_name end as person_name, case when id in (4, 9) then null else phone end as phone, case when id in (4, 9) and channel_tag = 'manual' then 'Goa' else manual_state end as manual_state from leads""")
def lead_edit(spark, d):
    rows = V.leads(spark, d)
    for one in (4, 9):
        rows = leads.edit(rows, one, {"person_name": " Ann Lee ", "phone": " ", "manual_state": "Goa"})
    return rows.select("id", "person_name", "phone", "manual_state")


@query("with " + V.CAPTURES + ", good as (select seq as lead_id, job_id from captures where trim(email) <> ''), old as (select lead_id, job_id from good where lead_id % 3 = 0) select lead_id, job_id from good except select lead_id, job_id from old")
def occurrence_backfill(spark, d):
    rows = fold.accepted(V.captures(spark, d))[0].select(F.col("seq").alias("id"), "job_id")
    return fold.backfill_occurrences(rows, rows.where("id % 3 = 0").select(F.col("id").alias("lead_id"), "job_id"))


@query("with " + V.CAPTURES + """, snaps as (select x.s as id, case when x.s % 3 = 0 then '' else 'Site ' || x.s end as title from range(0, 17) x(s))
    select seq, case when coalesce(field_provenance = '{"department": "url_default"}', false) and nullif(s.title, '') is not null then s.title else department end as department
    from (select *, case when seq % 2 = 0 then '{"department": "url_default"}' else 'bad' end as field_provenance0 from captures) c left join snaps s on s.id = c.job_id""".replace("coalesce(field_provenance =", "coalesce(field_provenance0 ="))
def default_departments(spark, d):
    snaps = spark.range(17).selectExpr("id", "case when id % 3 = 0 then '' else concat('Site ', id) end as title")
    rows = V.captures(spark, d).withColumn("snapshot_id", F.col("job_id")).withColumn("field_provenance", F.when(F.col("seq") % 2 == 0, '{"department": "url_default"}').otherwise("bad"))
    return fold.with_department(rows, snaps).select("seq", "department")


@query("with " + V.LEADS + """ select id, '{"email":"' || 'table_block' || '"' || case when person_name is not null then ',"person_name":"table_block"' else '' end || case when designation is not null then ',"designation":"table_block"' else '' end
    || case when department is not null then ',"department":"' || case when id % 2 = 0 then 'table_block' else 'url_default' end || '"' else '' end || case when phone is not null then ',"phone":"mailto_tel"' else '' end || '}' as provenance from leads""")
def lead_provenance(spark, d):
    c = F.col
    return V.leads(spark, d).select("id", S.provenance(F.lit("table_block"), c("person_name"), c("designation"), c("department"), c("id") % 2 == 0, c("phone"), F.lit("mailto_tel")).alias("provenance"))


# Frontier


@query(having("fetched") + "select job_id, count(*) filter (where fetched) as visited_urls, count(*) filter (where fetched and is_seed) as crawled_domains, cast(sum(leads) as bigint) as leads_found, max(depth) as current_depth from fetched group by 1")
def crawl_counters(spark, d):
    return frontier.counters(made(spark, d, "fetched"))


_KEYS = "netloc || coalesce(nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/')"


@query("with " + V.HOSTS + f""", ok as (select page_id as seq, url, {_KEYS} || case when regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) end as url_key from hosts where netloc like '%.com' or netloc like '%.net'),
    firsts as (select url_key, min(seq) as seq, arg_min(url, seq) as url from ok group by 1) select url_key, url, seq, case when contains(lower(url), '/en') then 0 else 1 end as priority from firsts where seq % 7 <> 0""")
def frontier_queue(spark, d):
    """Candidates that enter the queue, the first ones to be fetched."""
    policy = Policy(target_suffixes=(".com", ".net"), skip_extensions=(".zip",), priority_keywords=("/en",))
    pages = V.table(spark, d, "pages").select("url", F.lit(1).alias("depth"), F.col("page_id").alias("seq"), F.lit(False).alias("is_seed"))
    all_ = frontier.enqueued(pages, spark.createDataFrame([], "url_key string"), policy)
    visited = all_.where("seq % 7 = 0").select("url_key")
    return frontier.enqueued(pages, visited, policy).orderBy(*frontier.pop_order()).select("url_key", "url", "seq", F.col("priority").cast("int").alias("priority"))


@query("""with recursive edges as (select 'n' || (o_orderkey % 900) as a, 'n' || ((o_orderkey * 7 + 3) % 900) as b from orders where o_orderkey % 3 = 0), walk(k, depth) as (select 'n' || (min(o_orderkey) % 900), 0 from orders where o_orderkey % 3 = 0 union select e.b, w.depth + 1 from walk w join edges e on e.a = w.k where w.depth < 4)
    select k as url_key, min(depth) as depth from walk group by 1""")
def crawl_depths(spark, d):
    edges = V.table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("concat('n', o_orderkey % 900) as from_key", "concat('n', (o_orderkey * 7 + 3) % 900) as to_key").distinct()
    first = V.table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("concat('n', min(o_orderkey) % 900) as url_key")
    return frontier.crawl_levels(first, edges, Policy(max_depth=4))


@query("with " + V.HOSTS + " select page_id, 200 + page_id % 3 as status from hosts where page_id % 3 = 0 and (netloc like '%.org' or netloc like '%.net')")
def fetches_accepted(spark, d):
    rows = V.table(spark, d, "pages").select("page_id", (F.lit(200) + F.col("page_id") % 3).alias("status"), F.col("url").alias("final_url"))
    return frontier.fetch_accepted(rows, Policy(target_suffixes=(".org", ".net"))).select("page_id", "status")


@query("select seq, chain, url from (select event_id as seq, user_id % 6 as chain, 'u' || event_id as url, row_number() over (partition by user_id % 6 order by event_id) as n from events) where n <= 25")
def chain_budgets(spark, d):
    rows = V.table(spark, d, "events").selectExpr("event_id as seq", "user_id % 6 as chain", "concat('u', event_id) as url")
    return frontier.chained_links(rows, Policy(max_chain_children=25)).select("seq", "chain", "url")


@query("select event_id as id, case when event_id % 4 <> 0 then user_id % 8 end as chain_key, case when event_id % 4 <> 0 then 100 - user_id % 8 end as budget from events")
def frontier_checkpoint(spark, d):
    """A frontier saved as two tables and read back."""
    rows = V.table(spark, d, "events").selectExpr("event_id as id", "case when event_id % 4 <> 0 then user_id % 8 end as chain_key", "case when event_id % 4 <> 0 then 100 - user_id % 8 end as budget")
    return frontier.rehydrated(*frontier.checkpoint_tables(rows)).select("id", "chain_key", "budget")


# Addresses and text


_NAME = "case when netloc like '%.com' or netloc like '%.net' or netloc like '%.org' then substr(netloc, 1, length(netloc) - 4) else netloc end"


@query("with " + V.HOSTS + rf""", roots as (select *, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) as root from hosts)
    select page_id, netloc like '%.com' or netloc like '%.org' as target, array_to_string(list_transform(string_split(trim(regexp_replace({_NAME}, '[.-]+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title,
    case when netloc like '%.com' then url when page_id % 2 = 0 and netloc like '%.net' then null when page_id % 2 = 0 then 'https://x.example.com' end as main, case when page_id % 2 = 0 and not netloc like '%.net' then 'https://x.example.com/c' end as contact,
    case when page_id % 3 = 0 then 'http://' || netloc else url end as typed, case when page_id % 2 = 0 then root else url end as seed, contains(html, '<b>') as js, 'ip' || page_id as ip
    from roots join pages using (page_id, url)""")
def url_shapes(spark, d):
    u, even = F.col("url"), F.col("page_id") % 2 == 0
    contact = F.when(even & ~U.netloc(u).endswith(".net"), "https://x.example.com/c").otherwise("https://none.example.net")
    main, to = U.main_and_contact(u, contact, (".com",))
    ip = F.concat(F.lit("ip"), F.col("page_id").cast("string"))
    return V.table(spark, d, "pages").select(
        "page_id", U.is_target(u, (".com", ".org")).alias("target"), U.title_of(u, V.SUFFIXES).alias("title"), main.alias("main"), to.alias("contact"),
        U.with_scheme(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), U.netloc(u))).otherwise(u)).alias("typed"), U.seed_url(u, F.when(even, U.root_url(u)).otherwise("")).alias("seed"),
        U.needs_js(F.col("html"), ("<b>", "<nothing>")).alias("js"), U.client_ip(F.when(even, F.concat(ip, F.lit(", 10.0.0.1"))).otherwise(""), ip).alias("ip"),
    )


@query("""select p_partkey as id, substr(regexp_replace(lower(p_type), '[ /]', '_', 'g'), 1, 12) as slug, array_to_string(list_filter(list_transform(string_split(replace(p_name || ',, ' || p_brand, chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as listed,
    coalesce(try_cast(case when p_partkey % 2 = 0 then p_brand else cast(p_size as varchar) end as int), -1) as number from part""")
def text_shapes(spark, d):
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slug(F.col("p_type"), 12).alias("slug"), F.array_join(T.listed(F.concat("p_name", F.lit(",, "), "p_brand")), "|").alias("listed"), T.safe_int(value, -1).alias("number"))


_POLICY = Policy()
_STOP = DESIGNATION_END.removeprefix("(?i)")


@query(rf"""with told as (select doc_id as id, 'see Dr. ' || coalesce(text, '') || ' Joint Director of ' || coalesce(source, '') as text from documents),
    parts as (select id, regexp_extract(text, '\b({"|".join(_POLICY.title_prefixes)})\b\.?[ \t]+([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){{0,3}})', 0) as named,
        substr(regexp_extract(text, '(?is)\b(?:{"|".join(_POLICY.designation_keywords)})\b.*'), 1, 120) as post from told),
    clipped as (select id, named, trim(trim(regexp_replace(regexp_split_to_array(post, '(?i){_STOP}')[1], '\s+', ' ', 'g')), ' ,.-') as post from parts)
    select id, nullif(trim(regexp_replace(regexp_replace(named, '^([A-Za-z]+)\.', '\1'), '\s+', ' ', 'g')), '') as name, nullif(substr(post, 1, 60), '') as designation from clipped""")
def names_and_designations(spark, d):
    text = F.concat(F.lit("see Dr. "), F.coalesce("text", F.lit("")), F.lit(" Joint Director of "), F.coalesce("source", F.lit("")))
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.name_in(text, _POLICY.title_prefixes).alias("name"), T.designation_in(text, _POLICY.designation_keywords).alias("designation"))


@query("with " + V.HOSTS + rf""", pieces as (select page_id as id, list_filter(['a' || page_id || '@' || netloc, rtrim('b@' || replace(netloc, '.com', '.'), '.'), 'no' || netloc],
    lambda p: regexp_full_match(p, '(?i){_POLICY.email}')) as found from hosts) select id, array_to_string(found, ',') as emails from pieces""")
def mailto_addresses(spark, d):
    """Targets with escapes, brackets, signs around and pieces that are no address."""
    host = U.strip_www(U.netloc(F.col("url")))
    raw = F.concat(F.lit(" A"), F.col("page_id").cast("string"), F.lit("%40"), F.upper(host), F.lit(", <b@"), F.replace(host, F.lit(".com"), F.lit(".")), F.lit(">;,No"), host)
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(T.clean_emails(raw, _POLICY.email), ",").alias("emails"))


_CELLS = ("c_custkey as id", "c_custkey % 4 as kind", "c_name", "c_mktsegment", "case when c_acctbal < 0 then ' ' else concat('m@', lower(c_mktsegment), '.com') end as mail")


def _place(words: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"list_position(list_transform(headers, lambda h: contains(h, '{w}')), true)" for w in words) + ")"


@query(f"""with rows as (select {', '.join(_CELLS)} from customer),
    tables as (select id, case kind when 0 then ['officer name', 'post held', 'e-mail id'] when 1 then ['e-mail id', 'name'] when 2 then ['rank', 'official', 'mail'] else ['post', 'contact person', 'division'] end as headers,
        case kind when 0 then [' ' || c_name, c_mktsegment, mail] when 1 then [mail, c_name] when 2 then [c_mktsegment || ' ', c_name] else [c_mktsegment, c_name, mail] end as cells from rows),
    places as (select *, {_place(HEADER_WORDS["name"])} as n, {_place(HEADER_WORDS["designation"])} as p, {_place(HEADER_WORDS["department"])} as d, {_place(HEADER_WORDS["email"])} as e from tables),
    own as (select *, case when p = n then null else p end as post, case when d in (n, p) then null else d end as part, case when e in (n, p, d) then null else e end as address from places)
    select id, nullif(trim(cells[n]), '') as name, nullif(trim(cells[post]), '') as designation, nullif(trim(cells[part]), '') as department, nullif(trim(cells[address]), '') as email from own""")
def table_cells(spark, d):
    """Cells of table rows by headers in several orders; some columns or cells are not there, and some are blank."""
    c = F.col
    rows = V.table(spark, d, "customer").selectExpr(*_CELLS)
    tables = rows.selectExpr(
        "id", "case kind when 0 then array('officer name', 'post held', 'e-mail id') when 1 then array('e-mail id', 'name') when 2 then array('rank', 'official', 'mail') else array('post', 'contact person', 'division') end as headers",
        "case kind when 0 then array(concat(' ', c_name), c_mktsegment, mail) when 1 then array(mail, c_name) when 2 then array(concat(c_mktsegment, ' '), c_name) else array(c_mktsegment, c_name, mail) end as cells",
    )
    places = T.header_map(c("headers"), HEADER_WORDS)
    return tables.select("id", *(T.cell_at(c("cells"), places[r]).alias(r) for r in ("name", "designation", "department", "email")))


# Edits of small tables


@query(having("roles") + """, more(name) as (values ('Zed'), ('Alpha')) select id, name, is_system from roles where not (id = 2 and not is_system) and id <> 5
    union all select (select max(id) from roles) + row_number() over (order by name), name, false from more""")
def rows_added_and_removed(spark, d):
    """Two roles come, role 2 goes; role 5 goes with its permissions."""
    table = made(spark, d, "roles")
    new = spark.createDataFrame([("Zed", False), ("Alpha", False)], "name string, is_system boolean")
    kept, _ = rows.with_dependants(rows.removed(rows.added(table, new, [F.col("name")]), (F.col("id") == 2) & ~F.col("is_system")), F.col("id") == 5, made(spark, d, "held"), "role_id")
    return kept.select("id", "name", "is_system")


@query(having("held") + "select role_id, permission_key from held where role_id <> 1")
def dependants_removed(spark, d):
    return rows.with_dependants(made(spark, d, "roles"), F.col("id") == 1, made(spark, d, "held"), "role_id")[1].select("role_id", "permission_key")


@query(having("roles", "users") + "select id, name from roles r where is_system or id not in (3, 4, 5) or exists (select 1 from users u where u.role_id = r.id)")
def used_rows_stay(spark, d):
    return rows.removed(made(spark, d, "roles"), F.col("id").isin(3, 4, 5) & ~F.col("is_system"), made(spark, d, "users").select(F.col("role_id").alias("id"))).select("id", "name")


@query(having("credentials") + "select id, case when id in (2, 3) then false else is_active end as is_active, case when id = 3 then timestamp '2024-01-01 01:00:00' else cooldown_until end as cooldown_until, case when id = 2 then 50 else daily_send_limit end as daily_send_limit from credentials")
def credential_edits(spark, d):
    """Credential 2 is disabled with a new limit, 3 is disabled and cools down."""
    table = rows.changed(made(spark, d, "credentials"), F.col("id") == 2, is_active=False, daily_send_limit=50, cooldown_until=None)
    return rows.changed(table, F.col("id") == 3, is_active=False, cooldown_until=ts("2024-01-01 01:00:00")).select("id", "is_active", "cooldown_until", "daily_send_limit")


@query(having("users", "roles") + "select id, case when id in (5, 6) then false else is_active end as is_active, case when id = 6 then 2 else role_id end as role_id from users")
def user_edits(spark, d):
    """Users 5 and 6 are deactivated, and 6 changes the role."""
    table = rows.changed(made(spark, d, "users"), F.col("id").isin(5, 6), is_active=False)
    return rows.changed(table, F.col("id") == 6, role_id=2).select("id", "is_active", "role_id")


@query(having("entries") + ", known(code, title) as (values ('cat1', 'old'), ('zzz', 'kept')) select code, title from known where code not in (select category_code from entries) union all select category_code, arg_max(category_title, seq) from entries group by 1")
def titles_written(spark, d):
    known = spark.createDataFrame([("cat1", "old"), ("zzz", "kept")], "code string, title string")
    return rows.titles_written(known, made(spark, d, "entries").select(F.col("category_code").alias("code"), F.col("category_title").alias("title"), "seq"))


@query("with " + V.MAIL + " select id, status from mail where campaign_id = 4 and status = 'SENT' order by id limit 10 offset 10")
def mail_listing(spark, d):
    return rows.listing(V.mail(spark, d), 2, 10, campaign_id=4, status="SENT").select("id", "status")


@query("select p_partkey as id, p_name as name from part order by 1 desc limit 25 offset 25")
def template_listing(spark, d):
    return rows.listing(V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 2, 25, newest_first=True)


@query(having("settings") + """select key, case when key = 'ASIA' then 'new' else value end as value, case when key = 'ASIA' then 7 else updated_by end as updated_by, case when key = 'ASIA' then timestamp '2024-06-01 00:00:00' else updated_at end as updated_at from settings
    union all select 'crawl_policy', '{}', 7, timestamp '2024-06-01 00:00:00'""")
def setting_writes(spark, d):
    """A write on the row that was read, one on a row that changed since, and a first one."""
    now, at = ts("2024-06-01 00:00:00"), lambda n: ts(f"2024-01-0{n} 00:00:00")
    table = made(spark, d, "settings")
    for key, value, expected in (("ASIA", "new", at(3)), ("EUROPE", "late", at(1)), ("crawl_policy", "{}", None)):
        table = rows.setting_written(table, key, value, 7, now, expected).drop("written")
    return table


@query(having("settings") + "select 'ASIA' as key, value from settings where key = 'ASIA' union all select 'nothing', 'default'")
def setting_reads(spark, d):
    table = made(spark, d, "settings")
    return rows.setting(table, "ASIA", "default").union(rows.setting(table, "nothing", "default"))


@query(having("entries") + "select count(distinct category_title) as total_categories, count(*) as total_entries, count(main_url) as inserted from entries")
def import_counters(spark, d):
    return rows.import_counters(made(spark, d, "entries"), F.col("main_url").isNotNull())


@query("with " + V.LEADS + """, up as (select distinct 'user' || (o_custkey % 300) || '@household.com' as email from orders), old as (select id as lead_id from leads where id % 3 = 0)
    select l.id as lead_id, 77 as job_id, 'manual-csv-upload' as source_url from up join leads l using (email) where l.id not in (select lead_id from old)""")
def upload_occurrences(spark, d):
    """Uploaded addresses that are in the pool leave an occurrence each, skipped ones too, unless the job has it."""
    pool = V.leads(spark, d)
    up = V.table(spark, d, "orders").select(F.concat(F.lit("USER"), (F.col("o_custkey") % 300).cast("string"), F.lit("@household.com")).alias("email"))
    old = pool.where("id % 3 = 0").select(F.col("id").alias("lead_id"), F.lit(77).cast("long").alias("job_id"))
    return leads.occurrences_of_upload(pool, up, old, 77).select("lead_id", F.col("job_id").cast("int").alias("job_id"), "source_url")


@query("with " + V.LEADS + ", " + V.SNAPSHOTS + " select l.id, case when l.channel_tag = 'manual' and l.manual_state is null then nullif(s.state, '') else l.manual_state end as manual_state from (select * replace (case when id % 5 = 0 then null else manual_state end as manual_state) from leads) l left join snaps s on s.id = l.snapshot_id")
def manual_states(spark, d):
    pool = V.leads(spark, d).withColumn("manual_state", F.when(F.col("id") % 5 != 0, F.col("manual_state")))
    return fold.with_manual_states(pool, V.snapshots(spark, d)).select("id", "manual_state")


@query(having("fetched") + "select url as url_key from pages union select url from fetched where fetched")
def visited_union(spark, d):
    """The pages of a crawl, and those of a saved checkpoint."""
    recent = V.table(spark, d, "pages").select(F.col("url").alias("url_key"))
    return frontier.visited_before(recent, made(spark, d, "fetched").where("fetched").select(F.col("url").alias("url_key")))


@query(having("tries") + """, firsts as (select *, row_number() over (partition by page_id order by seq) as n from tries where seq < 2 and error is null),
    pages2 as (select page_id, final_url, regexp_replace(lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') as netloc, status, html, seq from firsts where n = 1)
    select t.page_id, case when p.page_id is null then 'failed' when p.status <> 200 or not (p.netloc like '%.com' or p.netloc like '%.net') then 'reject' when contains(p.html, '<b>') then 'render' else 'accept' end as decision,
    cast(case when p.page_id is null then 2 else p.seq + 1 end as int) as tries from (select distinct page_id from tries) t left join pages2 p using (page_id)""")
def fetch_decisions(spark, d):
    return frontier.fetch_decision(made(spark, d, "tries"), Policy(target_suffixes=(".com", ".net"), js_indicators=("<b>",)))
