"""The engine's tables as views over the fixture tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwright.functions.score import lead_score
from leadwright.functions.url import netloc, root_url
from leadwright.operators.attribution import netloc_map

#: Public suffixes of the fixture's hosts.
SUFFIXES = (".com", ".net", ".org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for each nation, its region as the category."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr(
        "cast(n_nationkey as bigint) as id", "cast(n_nationkey + 100 as bigint) as source_domain_id", "r_name as category_code",
        "case when r_regionkey = 0 then null else concat('Region ', r_name) end as category_title", "case when n_nationkey % 6 = 0 then '' else n_name end as state",
        "case when n_nationkey % 4 = 0 then null else concat('T', cast(n_nationkey % 4 as string)) end as org_type", "case when n_nationkey % 4 = 1 then 'Type one' else '' end as org_type_title", "n_name as title",
    )


SNAPSHOTS = """snaps as (select cast(n_nationkey as bigint) as id, cast(n_nationkey + 100 as bigint) as source_domain_id, r_name as category_code,
    case when r_regionkey = 0 then null else 'Region ' || r_name end as category_title, case when n_nationkey % 6 = 0 then '' else n_name end as state,
    case when n_nationkey % 4 = 0 then null else 'T' || cast(n_nationkey % 4 as varchar) end as org_type, case when n_nationkey % 4 = 1 then 'Type one' else '' end as org_type_title,
    n_name as title from nation join region on n_regionkey = r_regionkey)"""


def leads(spark: SparkSession, d: str) -> DataFrame:
    """A lead for each customer; every seventh has no snapshot, households are manual."""
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey as id", "c_custkey % 10 as job_id", "case when c_custkey % 7 = 0 then null else cast(c_nationkey as bigint) end as snapshot_id",
        "concat('user', cast(c_custkey as string), '@', lower(c_mktsegment), case when c_custkey % 2 = 0 then '.gov.in' else '.com' end) as email",
        "case when c_custkey % 3 = 0 then null when c_custkey % 11 = 0 then '  ' else c_name end as person_name",
        "case c_custkey % 4 when 0 then '' when 1 then 'Director' when 2 then 'Under Secretary' end as designation",
        "case when c_custkey % 5 = 0 then null else c_mktsegment end as department", "concat('https://host', cast(c_nationkey as string), '.example.org/p') as source_url",
        "cast(null as string) as source_title", "concat('near ', c_name) as context_snippet",
        "case when c_mktsegment <> 'HOUSEHOLD' then null when c_custkey % 2 = 0 then 'Goa' else '' end as manual_state", "'person' as entity_kind",
        "case when c_acctbal < 0 then null else concat('+', cast(c_custkey as string)) end as phone", "case when c_mktsegment = 'HOUSEHOLD' then 'manual' when c_custkey % 13 = 0 then null else 'office' end as channel_tag",
        "case c_custkey % 3 when 0 then 'HIGH' when 1 then 'LOW' end as confidence_band", "cast(null as string) as field_provenance", "cast(c_custkey % 5 as int) as depth",
        "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(c_custkey % 977 as int), 0) as captured_at",
    )
    return rows.withColumn("lead_score", lead_score())


LEADS = """leads0 as (select c_custkey as id, c_custkey % 10 as job_id, case when c_custkey % 7 = 0 then null else cast(c_nationkey as bigint) end as snapshot_id,
    'user' || c_custkey || '@' || lower(c_mktsegment) || case when c_custkey % 2 = 0 then '.gov.in' else '.com' end as email,
    case when c_custkey % 3 = 0 then null when c_custkey % 11 = 0 then '  ' else c_name end as person_name,
    case c_custkey % 4 when 0 then '' when 1 then 'Director' when 2 then 'Under Secretary' end as designation,
    case when c_custkey % 5 = 0 then null else c_mktsegment end as department, 'https://host' || c_nationkey || '.example.org/p' as source_url,
    cast(null as varchar) as source_title, 'near ' || c_name as context_snippet,
    case when c_mktsegment <> 'HOUSEHOLD' then null when c_custkey % 2 = 0 then 'Goa' else '' end as manual_state, 'person' as entity_kind,
    case when c_acctbal < 0 then null else '+' || c_custkey end as phone, case when c_mktsegment = 'HOUSEHOLD' then 'manual' when c_custkey % 13 = 0 then null else 'office' end as channel_tag,
    case c_custkey % 3 when 0 then 'HIGH' when 1 then 'LOW' end as confidence_band, cast(null as varchar) as field_provenance, cast(c_custkey % 5 as int) as depth,
    timestamp '2024-01-01 00:00:00' + to_minutes(c_custkey % 977) as captured_at from customer),
leads as (select *, cast(case when channel_tag = 'manual' then 0 else (case when trim(email) <> '' then case when confidence_band = 'HIGH' then 20 else 10 end else 0 end)
    + (case when trim(person_name) <> '' then 40 else 0 end) + (case when trim(designation) <> '' then 30 else 0 end) + (case when trim(phone) <> '' then 10 else 0 end) end as int) as lead_score from leads0)"""

JOINED = """joined as (select l.*, s.source_domain_id as snap_source_domain_id, s.category_code as snap_category_code, s.category_title as snap_category_title, s.state as snap_state,
    s.org_type as snap_org_type, s.title as snap_title, coalesce(l.channel_tag = 'manual', false) as manual,
    l.snapshot_id is null and coalesce(l.channel_tag <> 'manual', true) as unattributed from leads l left join snaps s on l.snapshot_id = s.id)"""


def captures(spark: SparkSession, d: str) -> DataFrame:
    """A capture for each event, in the order of event_id; the user is the address."""
    return table(spark, d, "events").selectExpr(
        "event_id as seq", "event_id % 17 as job_id", "cast(null as bigint) as snapshot_id", "case when event_id % 29 = 0 then ' ' else concat('User', cast(user_id as string), '@Example.ORG') end as email",
        "case when event_type = 'view' then concat('Name ', cast(event_id % 50 as string)) when event_type = 'click' then '' end as person_name",
        "case when event_type = 'purchase' then 'Director' when event_type = 'error' then '' end as designation", "case when event_type = 'signup' then concat('Dept ', cast(event_id % 9 as string)) end as department",
        "concat('https://h', cast(event_id % 40 as string), '.example.org/') as source_url", "cast(null as string) as source_title", "concat('e', cast(event_id as string)) as context_snippet", "cast(null as string) as entity_kind",
        "case when event_type = 'error' then concat('+', cast(event_id as string)) end as phone", "'office' as channel_tag",
        "case event_type when 'view' then 'LOW' when 'signup' then 'HIGH' when 'purchase' then 'LOW' end as confidence_band",
        "case when event_type in ('view', 'signup') then concat('{\"email\": \"', event_type, '\"}') end as field_provenance", "cast(event_id % 4 as int) as depth", "cast(null as bigint) as captured_by",
    )


CAPTURES = """captures as (select event_id as seq, event_id % 17 as job_id, cast(null as bigint) as snapshot_id, case when event_id % 29 = 0 then ' ' else 'User' || user_id || '@Example.ORG' end as email,
    case when event_type = 'view' then 'Name ' || (event_id % 50) when event_type = 'click' then '' end as person_name,
    case when event_type = 'purchase' then 'Director' when event_type = 'error' then '' end as designation, case when event_type = 'signup' then 'Dept ' || (event_id % 9) end as department,
    'https://h' || (event_id % 40) || '.example.org/' as source_url, cast(null as varchar) as source_title, 'e' || event_id as context_snippet, cast(null as varchar) as entity_kind,
    case when event_type = 'error' then '+' || event_id end as phone, 'office' as channel_tag,
    case event_type when 'view' then 'LOW' when 'signup' then 'HIGH' when 'purchase' then 'LOW' end as confidence_band,
    case when event_type in ('view', 'signup') then '{"email": "' || event_type || '"}' end as field_provenance, cast(event_id % 4 as int) as depth from events)"""


def mail(spark: SparkSession, d: str) -> DataFrame:
    """A campaign e-mail for each order."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "o_custkey % 50 as campaign_id", "o_custkey as lead_id", "concat('user', cast(o_custkey as string), '@mail.example.com') as recipient_email", "'s' as subject", "'b' as body",
        "case when o_orderstatus = 'F' then 'SENT' when o_orderpriority = '1-URGENT' then 'SENDING' when o_orderstatus = 'O' then 'DRAFT' when o_orderpriority = '5-LOW' then 'FAILED' else 'QUEUED' end as status",
        "o_orderpriority <> '3-MEDIUM' as is_selected", "cast(null as string) as missing_fields", "cast(null as string) as error_message",
        "case when o_orderstatus = 'F' then o_orderdate end as sent_at", "case when o_orderpriority = '1-URGENT' and o_orderkey % 7 <> 0 then o_orderdate end as sending_since", "o_orderkey % 10 as credential_id",
    )


MAIL = """mail as (select o_orderkey as id, o_custkey % 50 as campaign_id, o_custkey as lead_id, 'user' || o_custkey || '@mail.example.com' as recipient_email,
    case when o_orderstatus = 'F' then 'SENT' when o_orderpriority = '1-URGENT' then 'SENDING' when o_orderstatus = 'O' then 'DRAFT' when o_orderpriority = '5-LOW' then 'FAILED' else 'QUEUED' end as status,
    o_orderpriority <> '3-MEDIUM' as is_selected, case when o_orderstatus = 'F' then o_orderdate end as sent_at,
    case when o_orderpriority = '1-URGENT' and o_orderkey % 7 <> 0 then o_orderdate end as sending_since, o_orderkey % 10 as credential_id from orders)"""

HOSTS = r"""hosts as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') as netloc from pages)"""


def domains(spark: SparkSession, d: str) -> DataFrame:
    """Every third page's site as a catalog entry; every ninth has no address."""
    rows = table(spark, d, "pages").where("page_id % 3 = 0")
    host = netloc(F.col("url"))
    return rows.select(
        F.col("page_id").alias("id"), F.regexp_extract(host, r"([^.]*)$", 1).alias("category_code"), F.lit(None).cast("string").alias("category_title"),
        F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("S"), (F.col("page_id") % 4).cast("string"))).alias("state"), F.concat(F.lit("T"), (F.col("page_id") % 2).cast("string")).alias("org_type"),
        F.lit("kind").alias("org_type_title"), host.alias("title"), F.when(F.col("page_id") % 9 != 0, root_url(F.col("url"))).alias("main_url"),
    )


DOMAINS = r"""domains as (select page_id as id, regexp_extract(netloc, '([^.]*)$', 1) as category_code, cast(null as varchar) as category_title,
    case when page_id % 5 = 0 then '' else 'S' || (page_id % 4) end as state, 'T' || (page_id % 2) as org_type, netloc as title,
    case when page_id % 9 <> 0 then regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) end as main_url from hosts where page_id % 3 = 0)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """The netloc map of the sites of every third page."""
    rows = table(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("id"), root_url(F.col("url")).alias("main_url"), F.regexp_extract(netloc(F.col("url")), r"([^.]*)$", 1).alias("category_code"))
    return netloc_map(rows)


CATALOG = r"""catalog as (select netloc, min(page_id) as id, min(regexp_extract(netloc, '([^.]*)$', 1)) as category_code from hosts where page_id % 3 = 0 and netloc <> '' group by netloc)"""

#: Walk of a host of up to four labels, nearest first; the bare suffixes and single labels never match.
ATTRIBUTED = r"""walk as (select distinct split_part(netloc, ':', 1) as host from hosts),
steps as (select host, i, array_to_string(string_split(host, '.')[i:], '.') as step from walk, range(1, 6) t(i) where i < len(string_split(host, '.'))),
good as (select s.host, s.i, s.step from steps s where not exists (select 1 from steps p where p.host = s.host and p.i <= s.i and p.step in ('com', 'net', 'org'))),
nearest as (select host, arg_min(c.id, i) as domain_id from good g join catalog c on c.netloc = g.step group by host),
attributed as (select h.page_id, h.url, n.domain_id from hosts h left join nearest n on split_part(h.netloc, ':', 1) = n.host)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """The links of the pages as they are written, in document order (native; references are not resolved)."""
    pages = table(spark, d, "pages")
    tags = F.regexp_extract_all("html", F.lit(r'(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(tags).alias("pos", "tag"))
    href, text = F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1), F.regexp_extract("tag", "(?is)^<a [^>]*>(.*?)</a>$", 1)
    return rows.select("page_id", "base", F.col("pos").cast("long").alias("pos"), F.trim(href).alias("href"), F.substring(F.lower(F.trim(text)), 1, 100).alias("text"))


LINKS = r"""tags as (select page_id, url as base, unnest(regexp_extract_all(html, '(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>')) as tag, unnest(range(len(regexp_extract_all(html, '(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>')))) as pos from pages),
links as (select page_id, base, cast(pos as bigint) as pos, trim(regexp_extract(tag, '(?is)href="([^"]*)"', 1)) as href, substr(lower(trim(regexp_extract(tag, '(?is)^<a [^>]*>(.*?)</a>$', 1))), 1, 100) as text from tags)"""
