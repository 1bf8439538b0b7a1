"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from leadwright.llm.common import table
from leadwright.llm.embedding_dedup import embedding_groups
from leadwright.llm.exact_dedup import exact_duplicates
from leadwright.llm.html_extract import extract_text
from leadwright.llm.language_id import identify_held_out
from leadwright.llm.mixing import mix
from leadwright.llm.sentencepiece_codec import encode_texts
from leadwright.llm.simhash import simhash_groups
from leadwright.llm.source_audit import audit
from leadwright.llm.suffix_dedup import remove_repeats
from leadwright.llm.token_output import token_files
from leadwright.llm.toxicity import score_held_out
from leadwright.llm.url_filter import filter_urls, rule_table
from leadwright.llm.vector_codes import vector_codes


def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_language_id(spark, sf_dir):
    return identify_held_out(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op4_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_sentencepiece(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, keep=["doc_id"])


def op6_embedding_dedup(spark, sf_dir):
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_simhash_dedup(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_token_output(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_toxicity(spark, sf_dir):
    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_language_id, op3_mixing, op4_suffix_dedup, op5_sentencepiece, op6_embedding_dedup, op7_simhash_dedup, op8_exact_dedup, op9_url_filter, op10_token_output, op11_toxicity, op12_vector_codes, op13_source_audit, pipeline)
}

def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Operator 12 as a chain of named results: each round's nearest entries and the entries after it."""
    steps = [
        f"""kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
            where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))))""",
        f"cut as materialized (select vec_id, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) as x from kept, range({parts}) r(part))",
        f"""book0 as materialized (select c.part, s.entry, c.x as c from cut c
            join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}) s using (vec_id))""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} as materialized (select vec_id, part, min({{'d': d, 'e': entry}}) as best from
            (select vec_id, c.part, entry, list_sum(list_transform(list_zip(x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
             from cut c join book{n} b on c.part = b.part) group by 1, 2)"""
        )
        if n < rounds:
            steps.append(
                f"""mean{n} as materialized (select part, entry, list(m order by pos) as c from
                (select part, n.best.e as entry, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
                 from near{n} n join cut using (vec_id, part), range(1, 1 + (select max(len(v)) from kept) // {parts}) p(pos) group by all) group by 1, 2)"""
            )
            steps.append(f"book{n + 1} as materialized (select part, entry, coalesce(m.c, b.c) as c from book{n} b left join mean{n} m using (part, entry))")
    return f"""with {", ".join(steps)},
        told as (select vec_id, string_agg(format('{{:02x}}', best.e), '' order by part) as code, sum(best.d)::bigint as error from near{rounds} group by 1),
        digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
        from told join kept using (vec_id), digest"""


SQL = {
    "op12_vector_codes": _lloyd_sql(),
    "op13_source_audit": r"""
        with docs as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        numbered as (select row_number() over () as d, lang, source, text from docs),
        words as (select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from numbered),
        kept as (select lang, term from words group by 1, 2 having count(distinct d) >= 3),
        sizes as (select lang, count(*) as v from kept group by 1),
        counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by 1, 2, 3),
        sources as (select distinct lang, source from docs),
        cells as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n from sources s join kept k using (lang) left join counts c using (lang, source, term)),
        totals as (select lang, source, sum(n) as total from cells group by 1, 2),
        shares as (select c.*, 1 + (1000000000::hugeint * (n + 1)) // (total + v) as p from cells c join totals using (lang, source) join sizes using (lang)),
        langs as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (sum(sum(n)) over (partition by lang) + any_value(v)) as q
            from cells join sizes using (lang) group by lang, term),
        pairs as (select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
            from sources a join sources b on a.lang = b.lang and a.source <> b.source
            left join shares x on x.lang = a.lang and x.source = a.source
            left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
        terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from shares join langs using (lang, term) where n > 0 and p > q),
        ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
            union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
        select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200""",
    "op8_exact_dedup": r"""
        with plain as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
        told as (select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size, body from plain)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from told""",
    "op9_url_filter": r"""
        with rules(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
            ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
        parts as (select page_id,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
        best as (select p.page_id, max_by({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) as best
            from parts p join rules r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path) group by 1)
        select p.page_id, p.host, p.path, b.best.rule as rule, coalesce(b.best.verdict, 'allow') as verdict from parts p left join best b using (page_id)""",
}
