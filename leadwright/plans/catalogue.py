"""Every query of the engine over the fixture tables, and its SQL twin, by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leadwright.functions import score as S
from leadwright.functions import text as T
from leadwright.functions import url as U
from leadwright.functions.addresses import marked_spans, with_places
from leadwright.operators import attribution, domains, extract, fold, frontier, history, jobs, leads, outreach, rbac, search
from leadwright.plans import streams
from leadwright.plans import views as V
from leadwright.policy import Policy
from leadwright.sources import transfer
from leadwright.sources.shared import written

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def using(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


# URLs, pages and links


@query(r"""select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as authority,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') as netloc,
    split_part(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', ''), ':', 1) as host,
    nullif(split_part(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', ''), '.', 1), '') as department from pages""")
def url_netloc_host(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", U.authority(u).alias("authority"), U.netloc(u).alias("netloc"), U.host(u).alias("host"), U.department_of(u).alias("department"))


_KEY = r"""keys as (select page_id, url, netloc || coalesce(nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/')
    || case when regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) end as url_key from hosts)"""


@query(using(V.HOSTS, _KEY) + "select url_key, min(page_id) as page_id, count(*) as pages from keys group by url_key")
def url_key_dedupe(spark, d):
    rows = V.table(spark, d, "pages").withColumn("url_key", U.url_key(F.col("url")))
    return rows.groupBy("url_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


@query(using(V.HOSTS) + rf"""select page_id, regexp_matches(lower({_PATH}), '(\.html|/25)$') as skippable, netloc like '%.com' or netloc like '%.org' as in_scope,
    contains(lower(url), 'blog') or contains(lower(url), '/de/') as priority from hosts""")
def url_filter_flags(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", U.is_skippable(u, (".html", "/25")).alias("skippable"), U.in_scope(u, (".com", ".org")).alias("in_scope"), (U.url_priority(u, ("blog", "/de/")) == 0).alias("priority"))


_PAGED = r"""case when regexp_matches('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(?i)&page(=|&|$)')
    then regexp_extract('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(?i)&page(?:=([^&]*))?(?:&|$)', 1) end"""


@query(rf"select page_id, {_PAGED} as page_param, coalesce(regexp_matches({_PAGED}, '^[0-9]+$'), false) as paged from pages")
def page_pagination_flag(spark, d):
    value = U.query_value(F.col("url"), "page")
    policy = Policy(paging_params=("page",))
    rows = V.table(spark, d, "pages").select("page_id", "url", value.alias("page_param"), F.lit("").alias("text"), F.array().cast("array<string>").alias("rel"))
    return rows.select("page_id", "page_param", frontier.is_paging_link(policy).alias("paged"))


_ABSOLUTE = "case when href like '/%' then regexp_extract(base, '^([^:/?#]+://[^/?#]*)', 1) || href else href end"


@query(using(V.LINKS) + f"select page_id, pos, {_ABSOLUTE} as url, text from links")
def page_links(spark, d):
    """The links of the pages by the page reader; the fixture's references are absolute or begin with a slash."""
    return extract.page_links(V.table(spark, d, "pages"), Policy()).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "text")


_FULL = "row_number() over (partition by page_id order by pos)"


@query(using(V.LINKS) + f""", resolved as (select page_id, pos, text, {_ABSOLUTE} as url, page_id % 4 as depth, page_id % 6 = 0 as is_seed, page_id % 2 = 0 as page_priority, page_id % 5 as page_hops, contains(href, 'e') as nxt from links),
    hits as (select * from resolved where nxt or regexp_matches(text, '^[0-9]+$')), elected as (select page_id, arg_min(pos, (case when nxt then 0 else 1000000 end) + pos) as pos from hits group by 1),
    firsts as (select *, row_number() over (partition by page_id, url order by pos) as n from resolved where not lower(url) like '%a'),
    marked as (select f.*, f.pos = e.pos as paging from firsts f left join elected e using (page_id) where n = 1),
    rest as (select *, {_FULL} as place from marked where not coalesce(paging, false) and (is_seed or page_priority or contains(lower(url || ' ' || text), 'th')))
    select page_id, pos, url, 'paging' as kind, cast(depth as bigint) as depth, cast(page_hops + 1 as bigint) as page_hops from marked where paging and page_hops < 3
    union all select page_id, pos, url, 'link', cast(depth + 1 as bigint), 0 from rest where place <= case depth when 0 then 5 when 1 then 4 when 2 then 3 else 2 end""")
def link_admission(spark, d):
    """Every rule of admission at once: files, the elected paging link and its hops, priority pages and links, the limit of the depth."""
    policy = Policy(target_suffixes=(), skip_extensions=("a",), priority_keywords=("th",), paging_params=(), paging_texts=(), max_paging_hops=3, max_links={"0": 5, "1": 4, "2": 3, "default": 2})
    url = F.when(F.col("href").startswith("/"), F.concat(U.root_url(F.col("base")), F.col("href"))).otherwise(F.col("href"))
    rel = F.when(F.col("href").contains("e"), F.array(F.lit("next"))).otherwise(F.array().cast("array<string>"))
    p = F.col("page_id")
    rows = V.links(spark, d).select("page_id", "pos", url.alias("url"), "text", rel.alias("rel"), (p % 4).alias("depth"), (p % 5).alias("page_hops"), (p % 6 == 0).alias("is_seed"), (p % 2 == 0).alias("page_priority"))
    return frontier.admitted_links(rows, policy).select("page_id", "pos", "url", "kind", F.col("depth").cast("long").alias("depth"), F.col("page_hops").cast("long").alias("page_hops"))


@query(using(V.LINKS) + """, resolved as (select page_id, pos, text, case when href like '/%' then regexp_extract(base, '^([^:/?#]+://[^/?#]*)', 1) || href else href end as url, page_id % 4 as depth from links),
    firsts as (select *, row_number() over (partition by page_id, url order by pos) as n from resolved),
    kept as (select *, row_number() over (partition by page_id order by pos) as place from firsts where n = 1)
    select page_id, pos, url, cast(depth + 1 as bigint) as depth from kept where place <= case depth when 0 then 5 when 1 then 4 when 2 then 3 else 2 end""")
def link_admission_topk(spark, d):
    policy = Policy(target_suffixes=(), skip_extensions=(), priority_keywords=(), paging=False, max_links={"0": 5, "1": 4, "2": 3, "default": 2})
    url = F.when(F.col("href").startswith("/"), F.concat(U.root_url(F.col("base")), F.col("href"))).otherwise(F.col("href"))
    rows = V.links(spark, d).select("page_id", "pos", url.alias("url"), "text", F.array().cast("array<string>").alias("rel"), (F.col("page_id") % 4).alias("depth"), F.lit(0).alias("page_hops"), F.lit(False).alias("is_seed"), F.lit(True).alias("page_priority"))
    return frontier.admitted_links(rows, policy).select("page_id", "pos", "url", F.col("depth").cast("long").alias("depth"))


@query(using(V.LINKS) + """, hits as (select page_id, pos, href, contains(href, 'e') as nxt from links where lower(trim(text)) in ('the', 'of', 'and', 'de', 'und', 'la') or regexp_matches(text, '^[0-9]+$'))
    select page_id, arg_min(pos, (case when nxt then 0 else 1000000 end) + pos) as pos, arg_min(href, (case when nxt then 0 else 1000000 end) + pos) as url from hits group by page_id""")
def pagination_elect(spark, d):
    policy = Policy(paging_params=(), paging_texts=("the", "of", "and", "de", "und", "la"))
    rel = F.when(F.col("href").contains("e"), F.array(F.lit("nextish"))).otherwise(F.array().cast("array<string>"))
    rows = V.links(spark, d).select("page_id", "pos", F.col("href").alias("url"), "text", rel.alias("rel"))
    hits = rows.where(frontier.is_paging_link(policy)).withColumn("rel", F.transform("rel", lambda r: F.lit("next")))
    return frontier.elected_paging(hits, policy)


@query(using(V.HOSTS, V.CATALOG, V.ATTRIBUTED) + "select page_id, url, domain_id from attributed")
def domain_attribution(spark, d):
    return attribution.attribute(V.table(spark, d, "pages").select("page_id", "url"), V.catalog(spark, d), "url", "id", V.SUFFIXES)


@query(using(V.HOSTS, V.CATALOG, V.ATTRIBUTED) + """, counted as (select c.category_code as code, c.category_code as title, count(*) as count from attributed a join catalog c on c.id = a.domain_id group by 1, 2)
    select code, title, count from counted union all select '__unknown__', 'Unknown', count(*) from attributed where domain_id is null having count(*) > 0""")
def attribution_facet(spark, d):
    """The flagship: pages by the category of the site they belong to, and those of no listed site."""
    catalog = V.catalog(spark, d)
    pages = attribution.attribute(V.table(spark, d, "pages").select("page_id", "url"), catalog, "url", "id", V.SUFFIXES)
    rows = pages.select(F.col("domain_id").alias("snapshot_id"), F.lit("office").alias("channel_tag"))
    return leads.category_facet(rows, catalog.select("id", "category_code", F.lit(None).cast("string").alias("category_title")))


@query(using(V.HOSTS, V.CATALOG) + "select netloc, id, category_code from catalog")
def catalog_netloc_map(spark, d):
    return V.catalog(spark, d).select("netloc", "id", "category_code")


@query(using(V.HOSTS) + "select min(page_id) as seq, netloc as title, arg_max(url, page_id) as main_url from hosts group by netloc")
def catalog_dedupe_lastwins(spark, d):
    host = U.netloc(F.col("url"))
    rows = V.table(spark, d, "pages").select(F.col("page_id").alias("seq"), host.alias("external_id"), F.col("url").alias("main_url"), host.alias("title"))
    return domains.last_wins(rows).select("seq", "title", "main_url")


@query(using(V.HOSTS, V.DOMAINS) + """select count(*) as total, count(main_url) as crawlable, count(*) - count(main_url) as not_crawlable, count(main_url) - count(distinct main_url) as duplicate from domains""")
def catalog_stats(spark, d):
    return domains.domain_stats(V.domains(spark, d))


@query(using(V.HOSTS, V.DOMAINS) + "select category_code as code, category_code as title, count(*) as count from domains where state = 'S1' group by 1, 2")
def domain_category_facet(spark, d):
    return domains.domain_facet(V.domains(spark, d), "category_code", "category_title", state="S1")


@query(using(V.HOSTS, V.DOMAINS) + "select org_type as code, 'kind' as title, count(*) as count from domains where category_code = 'com' group by 1, 2")
def domain_orgtype_facet(spark, d):
    return domains.domain_facet(V.domains(spark, d), "org_type", "org_type_title", category="com")


@query(using(V.HOSTS, V.DOMAINS) + "select distinct state from domains where state <> ''")
def domain_states(spark, d):
    return domains.domain_states(V.domains(spark, d))


@query(using(V.HOSTS, V.DOMAINS) + "select id, title, state, main_url from domains where (title ilike '%th_%' or main_url ilike '%th_%') order by case when main_url is not null then 0 else 1 end, state nulls last, main_url nulls last, id limit 20 offset 20")
def domain_page(spark, d):
    rows = V.domains(spark, d).where(domains.domain_filter(search="TH_"))
    return leads.page(rows, domains.domain_order(crawlable_first=True), 2, 20).select("id", "title", "state", "main_url")


@query(using(V.HOSTS, V.DOMAINS) + "select id from domains where category_code = 'net' and main_url is not null")
def domain_ids(spark, d):
    return domains.domain_ids(V.domains(spark, d), category="net")


# Text and extraction

_EMAIL = r"(?i)[a-zA-Z0-9._%+\-]+@(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,6}"


_ENDS = ", ".join(f"case when instr(domain, '{x}') > 0 then instr(domain, '{x}') + {len(x) - 1} end" for x in Policy().valid_suffixes)


@query(rf"""with found as (select doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) as raw from documents), plain as (select doc_id, trim(lower(raw), '.') as email from found),
    parts as (select doc_id, split_part(email, '@', 1) as local, split_part(email, '@', 2) as domain from plain), cut as (select doc_id, local, domain, least({_ENDS}) as stop from parts),
    done as (select distinct doc_id, local, case when stop is null then domain else substr(domain, 1, stop) end as domain from cut)
    select doc_id, local || '@' || domain as email, case when local in ('webmaster', 'info', 'admin', 'contact', 'support', 'helpdesk', 'grievance') then 'role'
    when regexp_matches(domain, '(\.gov\.in|\.nic\.in|\.res\.in|\.ac\.in|\.com)$') then 'office' else 'personal-external' end as channel_tag from done""")
def text_emails(spark, d):
    p = Policy()
    found = V.table(spark, d, "documents").select("doc_id", F.explode(T.emails_in(F.col("text"), p.email)).alias("raw"))
    plain = found.select("doc_id", T.plain_email(F.col("raw"), p.valid_suffixes).alias("email")).distinct()
    return plain.withColumn("channel_tag", T.channel_of(F.col("email"), p.role_local_parts, p.valid_suffixes)[0])


@query(rf"""with recursive parts as (select doc_id, text, 0 as done, text as rest from documents union all
    select doc_id, text, done + instr(rest, regexp_extract(rest, '{_EMAIL}')) - 1 + length(regexp_extract(rest, '{_EMAIL}')), substr(rest, instr(rest, regexp_extract(rest, '{_EMAIL}')) + length(regexp_extract(rest, '{_EMAIL}'))) from parts where regexp_extract(rest, '{_EMAIL}') <> ''),
    places as (select doc_id, text, regexp_extract(rest, '{_EMAIL}') as email, done + instr(rest, regexp_extract(rest, '{_EMAIL}')) - 1 as s from parts where regexp_extract(rest, '{_EMAIL}') <> '')
    select doc_id, cast(s as int) as start, email, trim(regexp_replace(substr(text, greatest(s - 200, 0) + 1, s + length(email) + 200 - greatest(s - 200, 0)), '\s+', ' ', 'g')) as context_snippet from places""")
def text_email_context(spark, d):
    """Every address of a text with what stands around it."""
    p = Policy()
    found = V.table(spark, d, "documents").where("contains(text, '@')").select("doc_id", F.explode(with_places(F.col("text"), p.email, p.context_chars)).alias("f"))
    return found.select("doc_id", "f.start", F.col("f.match").alias("email"), T.words_joined(F.col("f.around")).alias("context_snippet"))


_MARKED = "replace(replace(text, '@', ' [at] '), '.', '[dot]')"
_BRACKETED = T.bracketed_pattern(Policy().obfuscation)


@query(rf"""with spans as (select doc_id, unnest(regexp_extract_all({_MARKED}, '{_BRACKETED}')) as span from documents),
    plain as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(span, '(?i)\s*\[at\]\s*', '@', 'g'), '(?i)\s*\[dot\]\s*', '.', 'g'), '(?i)\s*\[hyphen\]\s*', '-', 'g')) as text from spans),
    found as (select doc_id, trim(regexp_extract(text, '{_EMAIL}'), '.') as email from plain where regexp_extract(text, '{_EMAIL}') <> ''),
    parts as (select doc_id, split_part(email, '@', 1) as local, split_part(email, '@', 2) as domain from found), cut as (select doc_id, local, domain, least({_ENDS}) as stop from parts)
    select doc_id, local || '@' || case when stop is null then domain else substr(domain, 1, stop) end as email from cut""")
def bracketed_emails(spark, d):
    """Addresses whose signs were replaced by markers, found and resolved again."""
    p = Policy()
    marked = F.replace(F.replace("text", F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit("[dot]"))
    rows = V.table(spark, d, "documents").select("doc_id", F.explode(marked_spans(marked, p.obfuscation)).alias("span"))
    return rows.select("doc_id", T.unbracketed(F.col("span"), p.obfuscation, p.email, p.valid_suffixes).alias("email")).where("email is not null")


@query()
def extract_leads_dom(spark, d):
    """Contacts of the pages by the whole pipeline; rows only, as SQL has no page tree."""
    return extract.extract_leads(V.table(spark, d, "pages"), Policy(target_suffixes=V.SUFFIXES, valid_suffixes=(".com", ".net", ".org")))


# Leads


@query(using(V.LEADS) + """select id, lead_score, case when channel_tag = 'manual' then 'manual' when lead_score >= 70 then 'success' when lead_score >= 40 then 'warning' else 'secondary' end as tier,
    concat_ws(',', case when coalesce(trim(person_name), '') = '' then 'name' end, case when coalesce(trim(designation), '') = '' then 'designation' end, case when coalesce(trim(department), '') = '' then 'department' end) as missing from leads""")
def lead_score(spark, d):
    c = F.col
    return V.leads(spark, d).select("id", "lead_score", S.score_tier(c("lead_score"), c("channel_tag")).alias("tier"), S.missing_fields({"name": c("person_name"), "designation": c("designation"), "department": c("department")}).alias("missing"))


FILTER = leads.LeadFilter(categories=("ASIA", "EUROPE", leads.UNKNOWN_CODE), search="a_", require_phone=True, min_score=20)
_WHERE = """where (manual or coalesce(snap_category_code in ('ASIA', 'EUROPE', '__unknown__'), false) or unattributed) and phone is not null and phone <> '' and (manual or lead_score >= 20)
    and (email ilike '%a_%' or coalesce(person_name ilike '%a_%', false) or coalesce(department ilike '%a_%', false) or coalesce(designation ilike '%a_%', false))"""
_STATE = "case when manual then manual_state else coalesce(nullif(snap_state, ''), 'Unknown') end"


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + f"""select id, email, person_name, lead_score, captured_at, {_STATE} as domain_state, snap_title as domain_title from joined {_WHERE}
    order by lead_score desc nulls last, captured_at desc nulls last, id desc limit 50 offset 50""")
def lead_list_page(spark, d):
    rows = leads.list_leads(V.leads(spark, d), V.snapshots(spark, d), FILTER)
    return leads.page(rows, leads.sort_columns("score"), 2, 50).select("id", "email", "person_name", "lead_score", "captured_at", "domain_state", "domain_title")


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + f"select count(*) as total, greatest(1, cast(ceil(count(*) / 50.0) as bigint)) as pages from joined {_WHERE}")
def lead_list_total(spark, d):
    return leads.pages(leads.lead_ids(V.leads(spark, d), V.snapshots(spark, d), FILTER), 50)


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + """select id from joined where job_id in (1, 2, 3) and not manual and (manual or coalesce(snap_state in ('NATION_1', 'NATION_2'), false) or coalesce(manual_state in ('NATION_1', 'NATION_2', 'Unknown'), false) or unattributed)
    and (manual or coalesce(snap_org_type in ('T1'), false)) and person_name <> '' and designation <> '' and department <> ''""")
def lead_ids(spark, d):
    f = leads.LeadFilter(job_ids=(1, 2, 3), entry_type="extracted", states=("NATION_1", "NATION_2", leads.UNKNOWN), org_types=("T1",), complete_only=True)
    return leads.lead_ids(V.leads(spark, d), V.snapshots(spark, d), f)


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + f"""select email, coalesce(person_name, '') as person_name, coalesce(nullif(snap_category_title, ''), snap_category_code, '') as category_title, coalesce({_STATE}, '') as state,
    coalesce(phone, '') as phone, cast(lead_score as varchar) as lead_score from joined""")
def lead_export(spark, d):
    return leads.export_rows(V.leads(spark, d), V.snapshots(spark, d), fields=("person_name", "category_title", "state", "phone", "lead_score"))


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + f""", told as (select *, phone <> '' and (manual or lead_score >= 20) as common, manual or coalesce(snap_category_code in ('ASIA', 'EUROPE'), false) or unattributed as of_category,
        manual or coalesce(snap_org_type in ('T1', 'T2'), false) as of_type, manual or coalesce(snap_state in ('NATION_1', 'NATION_2', 'NATION_4'), false) or coalesce(manual_state in ('NATION_1', 'NATION_2', 'NATION_4'), false) or unattributed as of_state,
        nullif({_STATE}, '') as shown from joined left join (select id as snap_id, org_type_title as snap_org_type_title from snaps) s on snapshot_id = snap_id),
    parts as (select 'category' as facet, case when unattributed then '__unknown__' else snap_category_code end as code, case when unattributed then 'Unknown' else coalesce(nullif(snap_category_title, ''), snap_category_code) end as title from told where common and of_type and of_state
        union all select 'org_type', case when unattributed then '__unknown__' else snap_org_type end, case when unattributed then 'Unknown' else coalesce(nullif(snap_org_type_title, ''), snap_org_type) end from told where common and of_category and of_state
        union all select 'state', case when unattributed then 'Unknown' else shown end, case when unattributed then 'Unknown' else shown end from told where common and of_category and of_type)
    select facet, code, title, count(*) as count from parts where code is not null group by 1, 2, 3""")
def lead_facets(spark, d):
    """All facets of a listing, each under the filter without its own choice."""
    f = leads.LeadFilter(categories=("ASIA", "EUROPE", leads.UNKNOWN_CODE), org_types=("T1", "T2"), states=("NATION_1", "NATION_2", "NATION_4", leads.UNKNOWN), require_phone=True, min_score=20)
    return leads.facets(V.leads(spark, d), V.snapshots(spark, d), f)


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + f"select id, email, lead_score, {_STATE} as domain_state from joined order by lead_score desc nulls last, captured_at desc nulls last, id desc limit 40 offset 1160")
def lead_deep_page(spark, d):
    """The thirtieth page of all leads by score, of which only the range that it lies in is sorted."""
    rows = leads.list_leads(V.leads(spark, d), V.snapshots(spark, d))
    return leads.Pages(rows, leads.sort_columns("score"), 400).page(30, 40).select("id", "email", "lead_score", "domain_state")


_SEARCH = ("email", "person_name", "department", "designation")


@query(using(V.LEADS) + """, terms(term, pattern) as (values ('user1%build', '%user1%build%'), ('SECRET', '%secret%'), ('a_', '%a_%'), ('no such', '%no such%'))
    select term, id from leads join terms on email ilike pattern or coalesce(person_name ilike pattern, false) or coalesce(department ilike pattern, false) or coalesce(designation ilike pattern, false)""")
def lead_search(spark, d):
    """Substring searches through a stored index of trigrams; a term too short for it is looked for in all rows."""
    rows = V.leads(spark, d)
    index = written(search.trigram_index(rows, "id", _SEARCH), "lead-trigrams")
    found = [search.searched(rows, index, term, "id", _SEARCH).select(F.lit(term).alias("term"), "id") for term in ("user1%build", "SECRET", "a_", "no such")]
    return reduce(lambda a, b: a.union(b), found)


@query(using(V.HOSTS, V.DOMAINS) + "select id from domains where coalesce(title ilike '%example%', false) or coalesce(main_url ilike '%example%', false)")
def domain_search(spark, d):
    rows = V.domains(spark, d)
    index = written(search.trigram_index(rows, "id", ("title", "main_url")), "domain-trigrams")
    return search.searched(rows, index, "Example", "id", ("title", "main_url")).select("id")


@query(using(V.LEADS, V.SNAPSHOTS, V.JOINED) + """select snap_category_code as code, coalesce(nullif(snap_category_title, ''), snap_category_code) as title, count(*) as count from joined where snap_category_code is not null group by 1, 2
    union all select '__unknown__', 'Unknown', count(*) from joined where unattributed having count(*) > 0""")
def lead_category_facet(spark, d):
    return leads.category_facet(V.leads(spark, d), V.snapshots(spark, d))


@query(using(V.LEADS, V.SNAPSHOTS) + """, pool as (select l.*, s.org_type, s.org_type_title from leads l left join snaps s on s.id = l.snapshot_id where job_id in (1, 2))
    select org_type as code, coalesce(nullif(org_type_title, ''), org_type) as title, count(*) as count from pool where org_type is not null group by 1, 2
    union all select '__unknown__', 'Unknown', count(*) from pool where snapshot_id is null and coalesce(channel_tag <> 'manual', true) having count(*) > 0""")
def lead_orgtype_facet(spark, d):
    return leads.org_type_facet(V.leads(spark, d), V.snapshots(spark, d), job_ids=(1, 2))


@query(using(V.LEADS, V.SNAPSHOTS) + """select s.state from leads l join snaps s on s.id = l.snapshot_id where s.category_code in ('ASIA', 'AFRICA') and s.state <> '' union select manual_state from leads where manual_state <> ''
    union select 'Unknown' from leads where snapshot_id is null and coalesce(channel_tag <> 'manual', true)""")
def lead_states(spark, d):
    return leads.lead_states(V.leads(spark, d), V.snapshots(spark, d), categories=("ASIA", "AFRICA"))


@query(using(V.LEADS) + "select count(*) filter (where snapshot_id is null and coalesce(channel_tag <> 'manual', true)) as unattributed from leads")
def lead_unattributed(spark, d):
    return leads.unattributed_count(V.leads(spark, d))


@query(using(V.LEADS) + """select id, cast(case when channel_tag = 'manual' then 0 else (case when trim(email) <> '' then case when confidence_band = 'HIGH' then 30 else 5 end else 0 end) + (case when trim(person_name) <> '' then 20 else 0 end)
    + (case when trim(designation) <> '' then 25 else 0 end) + (case when trim(phone) <> '' then 25 else 0 end) end as int) as lead_score from leads""")
def lead_rescore(spark, d):
    return leads.rescored(V.leads(spark, d), {"email_high": 30, "email_low": 5, "person_name": 20, "designation": 25, "phone": 25}).select("id", "lead_score")


_FIRST = "arg_min({0}, seq) filter (where {0} is not null and {0} <> '') as {0}"
_FOLD = (
    """good as (select *, lower(email) as key, case confidence_band when 'HIGH' then 1 when 'LOW' then 0 else -1 end as rank from captures where trim(email) <> ''),
    running as (select *, max(rank) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as before from good),
    rises as (select * from running where before is null or rank > before),
    bands as (select key, arg_max(coalesce(confidence_band, '-'), seq) as band, coalesce(arg_max(field_provenance, seq) filter (where field_provenance <> ''), arg_min(field_provenance, seq)) as field_provenance from rises group by key),
    folded as (select key, arg_min(job_id, seq) as job_id, arg_min(source_url, seq) as source_url, arg_min(depth, seq) as depth, min(seq) as first_seq, count(*) as captures, """
    + ", ".join(_FIRST.format(c) for c in ("person_name", "designation", "department", "phone", "context_snippet"))
    + " from good group by key)"
)
_FOLDED = """select f.key as email, job_id, source_url, depth, person_name, designation, department, phone, context_snippet, nullif(band, '-') as confidence_band, field_provenance, first_seq, captures,
    cast((case when band = 'HIGH' then 20 else 10 end) + (case when trim(person_name) <> '' then 40 else 0 end) + (case when trim(designation) <> '' then 30 else 0 end) + (case when trim(phone) <> '' then 10 else 0 end) as int) as lead_score
    from folded f join bands b using (key)"""
_FOLD_COLUMNS = ("email", "job_id", "source_url", "depth", "person_name", "designation", "department", "phone", "context_snippet", "confidence_band", "field_provenance", "first_seq", "captures", "lead_score")


@query(using(V.CAPTURES, _FOLD) + _FOLDED)
def lead_fold(spark, d):
    return fold.fold(fold.accepted(V.captures(spark, d))[0]).select(*_FOLD_COLUMNS)


@query(using(V.CAPTURES) + "select seq, email, 'no e-mail' as reason from captures where trim(email) = ''")
def lead_rejects(spark, d):
    return fold.accepted(V.captures(spark, d))[1].select("seq", "email", "reason")


@query(using(V.CAPTURES) + "select lower(email) as email, job_id, arg_min(source_url, seq) as source_url, min(seq) as first_seq from captures where trim(email) <> '' group by 1, 2")
def lead_occurrences(spark, d):
    return fold.occurrences(fold.accepted(V.captures(spark, d))[0]).select("email", "job_id", "source_url", "first_seq")


_DUPES = """pool as (select seq as id, job_id, lower(email) as email, person_name, designation, department, phone, confidence_band from captures where trim(email) <> ''),
    canon as (select email, arg_min(id, (case confidence_band when 'HIGH' then 0 when 'LOW' then 1 else 2 end) * 100000000 + id) as canonical_id from pool group by email)"""


@query(using(V.CAPTURES, _DUPES) + """, sorted as (select p.*, c.canonical_id, case when p.id = c.canonical_id then -1 else p.id end as o from pool p join canon c using (email))
    select canonical_id as id, email, arg_min(person_name, o) filter (where person_name <> '') as person_name, arg_min(designation, o) filter (where designation <> '') as designation,
    arg_min(department, o) filter (where department <> '') as department, arg_min(phone, o) filter (where phone <> '') as phone from sorted group by 1, 2""")
def lead_global_dedupe(spark, d):
    pool = fold.accepted(V.captures(spark, d))[0].select(F.col("seq").alias("id"), "job_id", F.lower("email").alias("email"), "person_name", "designation", "department", "phone", "confidence_band")
    seen = pool.select(F.col("id"), F.col("id").alias("lead_id"), "job_id")
    mails = pool.select("id", F.col("id").alias("lead_id"))
    return fold.merge_duplicates(pool, seen, mails)[0].select("id", "email", "person_name", "designation", "department", "phone")


@query(using(V.CAPTURES, _DUPES) + "select c.canonical_id as lead_id, p.job_id, min(p.id) as id from pool p join canon c using (email) group by 1, 2")
def lead_global_occurrences(spark, d):
    pool = fold.accepted(V.captures(spark, d))[0].select(F.col("seq").alias("id"), "job_id", F.lower("email").alias("email"), "person_name", "designation", "department", "phone", "confidence_band")
    return fold.merge_duplicates(pool, pool.select("id", F.col("id").alias("lead_id"), "job_id"), pool.select("id", F.col("id").alias("lead_id")))[1].select("lead_id", "job_id", "id")


@query(using(V.LEADS) + """, rows as (select o_custkey as k, min(o_orderkey) as row from orders group by 1),
    up as (select r.row, 'user' || r.k || '@' || lower(c_mktsegment) || case when r.k % 4 = 0 then '.gov.in' else '.com' end as email, 'Typed ' || r.k as person_name from rows r join customer on c_custkey = r.k)
    select u.row, u.email, case when l.id is null then 'imported' when coalesce(l.channel_tag = 'manual', false) then 'updated' else 'skipped' end as outcome,
    case when l.id is null or coalesce(l.channel_tag = 'manual', false) then u.person_name else l.person_name end as person_name from up u left join leads l using (email)""")
def manual_upsert_outcome(spark, d):
    keys = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("row"))
    up = keys.join(V.table(spark, d, "customer"), F.col("k") == F.col("c_custkey")).selectExpr(
        "row", "concat('user', cast(k as string), '@', lower(c_mktsegment), case when k % 4 = 0 then '.gov.in' else '.com' end) as email", "concat('Typed ', cast(k as string)) as person_name",
        "cast(null as string) as designation", "cast(null as string) as department", "cast(null as string) as phone",
    )
    return leads.upsert_manual(V.leads(spark, d), up, 1).select("row", "email", "outcome", "person_name")


# Outreach

_BLACK = "black as (select 'user' || c_custkey || '@mail.example.com' as email, '' as domain from customer where c_custkey % 20 = 0)"


@query(using(V.MAIL) + """select campaign_id, count(*) filter (where status = 'DRAFT' and is_selected) as draft, count(*) filter (where status = 'QUEUED') as queued, count(*) filter (where status = 'SENDING') as sending,
    count(*) filter (where status = 'SENT') as sent, count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'DRAFT' and not is_selected) as skipped, count(*) as total from mail group by campaign_id""")
def campaign_stats(spark, d):
    return outreach.campaign_stats(V.mail(spark, d))


@query(using(V.MAIL) + """select credential_id, count(*) filter (where status = 'SENT') as sent_total, count(*) filter (where status = 'FAILED') as failed_total,
    count(*) filter (where status = 'SENT' and sent_at >= timestamp '1998-06-01') as sent_today from mail group by credential_id""")
def credential_health(spark, d):
    return outreach.credential_health(V.mail(spark, d), F.expr("timestamp_ntz '1998-06-01 13:00:00'"))


@query(using(V.LEADS) + """, black as (select email, split_part(email, '@', 2) as domain from leads where id in (20, 41)), there as (select email from leads where id % 10 = 3),
    flags as (select l.*, exists (select 1 from black b where b.email = l.email or b.domain = split_part(l.email, '@', 2)) as blacklisted, l.email in (select email from there) as there from leads l)
    select id as lead_id, email as recipient_email, 'Hello ' || coalesce(person_name, '') as subject, 'Dear ' || case when trim(coalesce(person_name, '')) <> '' then person_name else 'Sir/Madam' end || ', ' || coalesce(designation, '') || ' of ' || coalesce(department, '') as body,
    nullif(concat_ws(',', case when coalesce(trim(person_name), '') = '' then 'name' end, case when coalesce(trim(designation), '') = '' then 'designation' end), '') as missing_fields,
    coalesce(trim(person_name), '') <> '' and coalesce(trim(designation), '') <> '' as is_selected from flags where not blacklisted and not there""")
def draft_emails(spark, d):
    pool = V.leads(spark, d)
    black = pool.where("id in (20, 41)").select("email", F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"))
    template = spark.createDataFrame([("Hello {{ name }}", "Dear {{name}}, {{ designation }} of {{ department }}")], "subject string, raw_body string")
    there = pool.where("id % 10 = 3").select(F.col("email").alias("recipient_email"))
    return outreach.drafts(pool, template, black, there).drop("status")


@query(using(V.LEADS) + """, black as (select email, split_part(email, '@', 2) as domain from leads where id in (20, 41)), there as (select email from leads where id % 10 = 3),
    flags as (select exists (select 1 from black b where b.email = l.email or b.domain = split_part(l.email, '@', 2)) as blacklisted, l.email in (select email from there) as there from leads l)
    select count(*) filter (where blacklisted) as blacklisted_count, count(*) filter (where not blacklisted and there) as excluded_count, count(*) filter (where not blacklisted and not there) as staged_count from flags""")
def draft_counts(spark, d):
    pool = V.leads(spark, d)
    black = pool.where("id in (20, 41)").select("email", F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"))
    return outreach.draft_counts(pool, black, pool.where("id % 10 = 3").select(F.col("email").alias("recipient_email")))


@query(using(V.MAIL) + """select id, case when status = 'SENDING' and sending_since < timestamp '1998-01-01 00:00:00' - interval 600 second then 'QUEUED' else status end as status,
    case when status = 'SENDING' and sending_since < timestamp '1998-01-01 00:00:00' - interval 600 second then null else sending_since end as sending_since from mail""")
def mail_stuck_recovery(spark, d):
    return outreach.recovered(V.mail(spark, d), F.expr("timestamp_ntz '1998-01-01 00:00:00'")).select("id", "status", "sending_since")


@query(using(V.MAIL) + """select m.id, case when m.status = 'QUEUED' and m.id = f.id then 'SENDING' else m.status end as status from mail m left join (select campaign_id, min(id) as id from mail where status = 'QUEUED' group by 1) f on f.id = m.id""")
def mail_claim_next(spark, d):
    return outreach.claimed(V.mail(spark, d), F.expr("timestamp_ntz '1998-01-01 00:00:00'")).select("id", "status")


@query(using(V.MAIL, _BLACK) + "select m.id from mail m where not exists (select 1 from black b where b.email = m.recipient_email)")
def mail_not_blacklisted(spark, d):
    black = V.table(spark, d, "customer").where("c_custkey % 20 = 0").selectExpr("concat('user', cast(c_custkey as string), '@mail.example.com') as email", "'' as domain")
    return outreach.without_blacklisted(V.mail(spark, d), black, "recipient_email").select("id")


# Jobs and histories

_JOBS = """jobs as (select user_id as id, case when count(*) filter (where event_type = 'purchase') > 14 then 'done' when user_id % 9 = 0 then 'interrupted' else 'running' end as status, min(ts) as started_at,
    max(ts) filter (where event_type = 'view') as last_heartbeat_at from events group by user_id)"""


def _jobs(spark, d):
    kind = F.col("event_type")
    status = F.when(F.count_if(kind == "purchase") > 14, "done").when(F.col("user_id") % 9 == 0, "interrupted").otherwise("running")
    return V.table(spark, d, "events").groupBy("user_id").agg(status.alias("status"), F.min("ts").alias("started_at"), F.max(F.when(kind == "view", F.col("ts"))).alias("last_heartbeat_at")).withColumnRenamed("user_id", "id")


@query(using(_JOBS) + """select id, case when status = 'running' and date_diff('second', coalesce(last_heartbeat_at, started_at), timestamp '2024-01-29 00:00:00') > 86400 then 'interrupted' else status end as status from jobs
    where date_trunc('second', coalesce(last_heartbeat_at, started_at)) is not null""")
def job_reaper(spark, d):
    rows = _jobs(spark, d).withColumns({"last_heartbeat_at": F.date_trunc("second", "last_heartbeat_at").cast("timestamp_ntz"), "started_at": F.date_trunc("second", "started_at").cast("timestamp_ntz")})
    return jobs.reaped(rows, F.expr("timestamp_ntz '2024-01-29 00:00:00'"), 86400).select("id", "status")


@query("select user_id as job_id, max(ts) as ts, arg_max(event_type, event_id) as event_type, count(*) as beats from events group by 1")
def heartbeat_latest(spark, d):
    beats = V.table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), "event_type")
    return jobs.latest_heartbeats(beats).select("job_id", "ts", "event_type", "beats")


@query(using(_JOBS) + ", late as (select user_id as id, max(ts) as at from events where event_type = 'click' group by 1) select j.id, case when j.status = 'interrupted' and l.at is not null then 'running' else j.status end as status, coalesce(l.at, j.last_heartbeat_at) as last_heartbeat_at from jobs j left join late l using (id)")
def job_revival(spark, d):
    beats = V.table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"))
    return jobs.with_heartbeats(_jobs(spark, d), beats).select("id", "status", "last_heartbeat_at")


@query("select 'agent' || (user_id % 6) as agent_hostname, count(*) as jobs, max(ts) as last_job_at from events group by 1")
def agent_summary(spark, d):
    rows = V.table(spark, d, "events").select(F.concat(F.lit("agent"), (F.col("user_id") % 6).cast("string")).alias("agent_hostname"), F.col("ts").alias("created_at"))
    return jobs.agent_summary(rows)


@query("""with e as (select event_id, user_id % 3 as ip, cast(floor(epoch(ts)) as bigint) as s from events where event_type = 'error')
    select event_id, count(*) over (partition by ip order by s range between 86399 preceding and current row) - 1 as recent, count(*) over (partition by ip order by s range between 86399 preceding and current row) - 1 >= 20 as rejected from e""")
def login_rate_limit(spark, d):
    rows = V.table(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 3).alias("ip"), F.col("ts").cast("timestamp").alias("ts"))
    return history.rate_limited(rows, "ip", F.floor(F.unix_micros("ts") / 1_000_000), window_s=86400).select("event_id", "recent", "rejected")


@query("""with e as (select event_id, user_id, event_type = 'view' as ok from events where event_type in ('view', 'error')),
    runs as (select *, sum(case when ok then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as run from e),
    f as (select event_id, ok, cast(sum(case when ok then 0 else 1 end) over (partition by user_id, run order by event_id rows unbounded preceding) as bigint) as failures from runs)
    select event_id, failures, failures >= 3 and not ok as locks from f""")
def login_lockout_islands(spark, d):
    rows = V.table(spark, d, "events").where("event_type in ('view', 'error')")
    return history.failure_runs(rows, "user_id", [F.col("event_id")], F.col("event_type") == "view", 3).select("event_id", "failures", "locks")


@query("""with e as (select event_id, user_id % 10 as host, epoch_us(ts) as a, row_number() over (partition by user_id % 10 order by ts, event_id) as i from events)
    select event_id, max(a - i * 900000000) over (partition by host order by i rows unbounded preceding) + i * 900000000 as start from e""")
def throttle_schedule(spark, d):
    rows = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    return history.spaced(rows, "host", F.col("a"), 900_000_000, [F.col("a"), F.col("event_id")]).select("event_id", "start")


@query("select o_orderkey as id, (row_number() over (partition by o_custkey % 50 order by o_orderkey) - 1) % 4 as slot from orders")
def round_robin(spark, d):
    return history.round_robin(V.mail(spark, d), "campaign_id", [F.col("id")], F.lit(4)).select("id", F.col("slot").cast("long").alias("slot"))


@query(using(V.HOSTS) + """, seeds as (select distinct netloc as root from hosts where page_id % 17 = 0)
    select h.page_id from hosts h where 1000000 + page_id * 3600 >= 1000000 + 40 * 3600 and not exists (select 1 from seeds s where h.netloc = s.root or ends_with(h.netloc, '.' || s.root))""")
def recrawl_bootstrap(spark, d):
    pages = V.table(spark, d, "pages")
    visited = pages.select("page_id", "url", (F.lit(1_000_000) + F.col("page_id") * 3600).cast("double").alias("visited_at"))
    return attribution.recrawl_bootstrap(visited, pages.where("page_id % 17 = 0").select("url"), 1_000_000 + 40 * 3600 + 86400.0, 1).select("page_id")


# Roles and audit

_USERS = "users as (select distinct user_id as id, user_id % 3 as role_id, user_id % 40 = 0 as is_admin from events)"
_PERMS = "perms(key) as (values " + ", ".join(f"('{p}')" for p in rbac.PERMISSIONS) + ")"
_ROLE = "rp(role_id, permission_key) as (values " + ", ".join(f"({i}, '{p}')" for i, ps in enumerate(rbac.ROLE_DEFAULTS.values()) for p in ps) + ")"


def _users(spark, d):
    return V.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumns({"role_id": F.col("id") % 3, "is_admin": F.col("id") % 40 == 0})


@query(using(_USERS, _PERMS, _ROLE) + """select u.id as user_id, permission_key from users u join rp on rp.role_id = u.role_id where not is_admin and not (u.id % 5 = 0 and permission_key = 'leads.view')
    union select id, 'audit.view' from users where not is_admin and id % 7 = 0 union select id, key from users, perms where is_admin""")
def effective_permissions(spark, d):
    users = _users(spark, d)
    held = spark.createDataFrame([(i, p) for i, ps in enumerate(rbac.ROLE_DEFAULTS.values()) for p in ps], "role_id long, permission_key string")
    grants = users.where("id % 7 = 0").select(F.col("id").alias("user_id"), F.lit("audit.view").alias("permission_key"), F.lit("grant").alias("effect"))
    denials = users.where("id % 5 = 0").select(F.col("id").alias("user_id"), F.lit("leads.view").alias("permission_key"), F.lit("deny").alias("effect"))
    return rbac.effective_permissions(users, held, grants.union(denials), rbac.permission_table(spark))


@query("""select e.event_id as id, e.event_type as action, u.email as user_email, e.ts as created_at from events e left join (select distinct user_id, 'u' || user_id || '@example.org' as email from events where user_id % 4 <> 0) u using (user_id)
    where e.event_type like 'c_i%' and e.ts between timestamp '2024-01-05' and timestamp '2024-01-12' order by e.ts desc, e.event_id desc limit 50""")
def audit_page(spark, d):
    events = V.table(spark, d, "events")
    users = events.where("user_id % 4 <> 0").select(F.col("user_id").alias("id")).distinct().withColumn("email", F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@example.org")))
    log = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    rows = rbac.audit_log(log, users, action_prefix="c_i", date_from=F.expr("timestamp_ntz '2024-01-05'"), date_to=F.expr("timestamp_ntz '2024-01-12'"))
    return leads.page(rows, rbac.audit_order(), 1, 50).select("id", "action", "user_email", "created_at")


# Transfers


@query("""select 'rows:orders' as "check", (select count(*) from orders) as expected, (select count(*) from orders) as found, true as ok
    union all select 'dangling:customer', 0, (select count(*) from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_custkey % 5 <> 0)), false""")
def fk_verify(spark, d):
    orders, customer = V.table(spark, d, "orders"), V.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"))
    return transfer.verified({"orders": (orders, orders.count())}, {"customer": (orders, "o_custkey", customer)})


@query("""with ids as (select c_custkey as old_id, row_number() over (order by c_custkey) + 1000 as new_id from customer where c_custkey % 3 <> 0), soft as (select c_custkey as old_id, row_number() over (order by c_custkey) as new_id from customer where c_custkey % 4 = 0)
    select o_orderkey as id, i.new_id as customer_id, s.new_id as agent_id from orders o join ids i on i.old_id = o.o_custkey left join soft s on s.old_id = o.o_custkey""")
def id_remap(spark, d):
    customer = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    ids, soft = transfer.id_map(customer.where("id % 3 <> 0"), 1000), transfer.id_map(customer.where("id % 4 = 0"))
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("agent_id"))
    return transfer.remapped(rows, {"customer_id": ids, "agent_id": soft}, soft=("agent_id",)).select("id", "customer_id", "agent_id")


# Streams


@query(using(V.CAPTURES, _FOLD) + _FOLDED)
def stream_fold(spark, d):
    """The fold of lead_fold, from a stream of captures."""
    return streams.stream_fold(spark, d).select(*_FOLD_COLUMNS)


@query(using(V.CAPTURES, _FOLD) + _FOLDED)
def lead_store_batches(spark, d):
    """The fold of lead_fold, from a store that takes captures in batches."""
    return streams.lead_store_batches(spark, d).select(*_FOLD_COLUMNS)


@query("""with recursive logins as (select user_id, event_id as id, epoch_us(ts) / 1e6 as at_s, event_type = 'view' as ok, row_number() over (partition by user_id order by ts, event_id) as i
        from events where event_type in ('view', 'error')),
    steps as (select user_id, 0::bigint as i, cast(null as bigint) as id, cast(null as varchar) as outcome, 0 as failures, 0.0::double as until from (select distinct user_id from logins)
        union all select s.user_id, l.i, l.id, case when l.at_s < s.until then 'locked' when l.ok then 'ok' when s.failures + 1 >= 3 then 'locks' else 'failed' end,
        case when l.at_s < s.until then s.failures when l.ok then 0 else s.failures + 1 end,
        case when l.at_s >= s.until and not l.ok and s.failures + 1 >= 3 then l.at_s + 259200 else s.until end from steps s join logins l on l.user_id = s.user_id and l.i = s.i + 1)
    select user_id, id, outcome, failures from steps where i > 0""")
def login_lockouts(spark, d):
    """What each login meets, from a stream: three failures in a row lock an account for three days."""
    return streams.login_lockouts(spark, d)


@query("""with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true) as starts from events),
    s as (select user_id, ts, sum(starts::int) over (partition by user_id order by ts rows unbounded preceding) as n from e),
    g as (select user_id, min(ts) as started, max(ts) + interval 6 hour as ended, count(*) as beats from s group by user_id, n)
    select user_id, started, ended, beats from g where ended <= (select max(ts) from events) - interval 1 hour""")
def stream_sessions(spark, d):
    """Sessions of each user's events without a gap of six hours, from a stream; those that the watermark has passed."""
    return streams.stream_sessions(spark, d).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "beats")


@query("""with e as (select user_id as job_id, epoch_us(ts) / 1e6 as at_s, row_number() over (partition by user_id order by ts) as beats, lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts) as last from events)
    select job_id, 'running' as status, at_s as at, beats from e where last is null or at_s - last > 86400
    union all select job_id, 'interrupted', last + 86400, beats - 1 from e where at_s - last > 86400""")
def stream_liveness(spark, d):
    """State changes of jobs from a stream of heartbeats, seen in the reports' own times."""
    return streams.stream_liveness(spark, d)
