import json
import time

import pytest
from pyspark.sql import functions as F

from leadwright.functions.addresses import Scanner, marked_spans
from leadwright.functions.text import unbracketed
from leadwright.operators.extract import extract_leads, page_links
from leadwright.policy import Policy

HOST = "forests.nic.in"
POLICY = Policy()


def leads_of(spark, html, policy=POLICY):
    pages = spark.createDataFrame([(1, f"https://{HOST}/staff/list", html)], "page_id long, url string, html string")
    return {r.email: r for r in extract_leads(pages, policy).collect()}


def card(name, post, local, more=""):
    return f'<section><h4>{name},</h4><span>{post}</span>{more}<a href="mailto:{local}@{HOST}">write</a></section>'


def test_a_card_gives_name_post_and_trust(spark):
    lead = leads_of(spark, card("Dr Mina Solberg", "Deputy Commissioner", "m.solberg"))[f"m.solberg@{HOST}"]
    assert (lead.person_name, lead.confidence_band, lead.channel_tag, lead.department) == ("Dr Mina Solberg", "HIGH", "office", "forests")
    assert lead.designation.startswith("Deputy Commissioner") or lead.designation.startswith("Commissioner")
    told = json.loads(lead.field_provenance)
    assert told["email"] == told["person_name"] == "mailto_tel" and told["department"] == "url_default" and "phone" not in told


def test_one_number_is_not_dealt_twice(spark):
    cards = card("Prof Ilse Tamm", "Joint Director", "ilse") + card("Prof Oskar Rebane", "Chief Inspector", "oskar") + '<section><a href="tel:+37255501234">ring</a></section>'
    phones = [r.phone for r in leads_of(spark, cards).values()]
    assert sorted(phones, key=str) == ["+37255501234", None]


def test_a_number_beside_the_address_is_its_own(spark):
    got = leads_of(spark, card("Mr Uno Kask", "Manager", "uno") + card("Ms Liis Kask", "Manager", "liis", '<a href="tel:60077777">ring</a>'))
    assert (got[f"uno@{HOST}"].phone, got[f"liis@{HOST}"].phone) == (None, "60077777")


def grid(*rows):
    return "<table><thead><tr><th>Official</th><th>Post held</th><th>E-mail id</th></tr></thead>" + "".join(f"<tr><td>{a}</td><td>{b}</td><td>{c}@{HOST}</td></tr>" for a, b, c in rows) + "</table>"


@pytest.mark.parametrize(("after", "band"), [("", "LOW"), (f'<footer><p><a href="mailto:kai.lepp@{HOST}">Mail</a></p></footer>', "HIGH")])
def test_fields_of_a_grid(spark, after, band):
    got = leads_of(spark, grid(("Kai Lepp", "Warden", "kai.lepp"), ("Eva Mets", "", "eva.mets")) + after)
    lead = got[f"kai.lepp@{HOST}"]
    assert (lead.person_name, lead.designation, lead.confidence_band) == ("Kai Lepp", "Warden", band)
    assert got[f"eva.mets@{HOST}"].person_name == "Eva Mets" and got[f"eva.mets@{HOST}"].confidence_band == "LOW"


@pytest.mark.parametrize(("written", "address", "channel"), [("helpdesk (at) trees (dot) gov (dot) in", "helpdesk@trees.gov.in", "role"), ("north[hyphen]range[at]hills[dot]trees[dot]ac[dot]in", "north-range@hills.trees.ac.in", "office"), ("ranger [AT] wood [DOT] org", "ranger@wood.org", "personal-external")])
def test_addresses_in_markers(spark, written, address, channel):
    got = leads_of(spark, f"<p>For maps ask {written}, or come by.</p><p>desk@{HOST} answers too</p>")
    assert set(got) == {address, f"desk@{HOST}"} and got[address].channel_tag == channel


def test_marker_pattern_needs_both_signs(spark):
    text = spark.range(1).select(F.lit("a [at] b [dot] com").alias("t"))
    for pairs, want in ((POLICY.obfuscation, "a@b.com"), (POLICY.obfuscation[:1], None), (POLICY.obfuscation[2:4], None)):
        spans = text.select(F.get(marked_spans(F.col("t"), pairs), 0).alias("s"))
        assert spans.select(unbracketed(F.col("s"), pairs, POLICY.email, POLICY.valid_suffixes)).first()[0] == want


def test_microdata_and_its_number(spark):
    html = f'<article itemscope><b itemprop="name">Seed Bank</b><i itemprop="email">Seeds@{HOST}</i><meta itemprop="telephone" content=" 372 600 "></article>'
    lead = leads_of(spark, html)[f"seeds@{HOST}"]
    assert (lead.confidence_band, lead.phone) == ("LOW", "372 600")


def test_lists_of_recipients_and_broken_pages(spark):
    assert set(leads_of(spark, '<a href="mailto:p%20@q.com,r@s.com;,no@@t?body=u">all</a><p>v@mail.post.gov.in</p>')) == {"p@q.com", "r@s.com", "v@mail.post.gov.in"}
    assert leads_of(spark, "") == leads_of(spark, None) == leads_of(spark, "<![when y]><table") == {}


def test_links_are_absolute(spark):
    html = '<a href="../map?x=1" rel="NEXT external"> Next <i>MAP</i></a><a href="">self</a><a href="//pics.example/z">pics</a><a href="http://[bad">bad</a>'
    pages = spark.createDataFrame([(1, "https://w.example/a/b/c", html)], "page_id long, url string, html string")
    got = [(r.url, r.text, r.rel) for r in page_links(pages).orderBy("pos").collect()]
    assert got == [("https://w.example/a/map?x=1", "next map", ["next", "external"]), ("https://pics.example/z", "pics", [])]


def test_whole_pages_are_read(spark, tmp_path):
    far = "<p>first@trees.com " + "leaf " * 50_000 + "last@trees.com and marked [at] trees [dot] com</p>"
    assert set(leads_of(spark, far)) == {"first@trees.com", "last@trees.com", "marked@trees.com"}
    assert set(leads_of(spark, far, Policy(max_input_chars=200_000))) == {"first@trees.com"}
    from leadwright.plans.catalogue import extract_leads_dom

    spark.createDataFrame([(1, "https://a.com/x", far)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.email for r in extract_leads_dom(spark, str(tmp_path)).collect()} == {"first@trees.com", "last@trees.com", "marked@trees.com"}


def test_repeated_pages_are_one(spark):
    html = card("Mr Uno Kask,", "Manager", "uno")
    pages = spark.createDataFrame([(1, f"https://{HOST}/", html)] * 3 + [(2, f"https://{HOST}/", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.email) for r in extract_leads(pages).collect()] == [(1, f"uno@{HOST}")]


def test_nested_tables_and_many_rows():
    from leadwright.functions.dom import signals

    inner = "<table><tr><th>x</th></tr><tr><td>in@x.com</td></tr></table>"
    html = f"<table><tr><th>Name</th><th>Mail</th></tr><tr><td>A</td><td>a@x.com{inner}</td></tr></table>" + "<table>" + "<tr><td>n</td><td>b@x.com</td></tr>" * 3000 + "</table>"
    rows = [f for f in signals(html, Scanner(POLICY.email, ()))["found"] if f["rung"] == "table_block"]
    assert rows[0]["headers"] == ["name", "mail"] and rows[0]["cells"][0] == "A" and len([f for f in rows if f["cells"] == ["n", "b@x.com"]]) == 2999
    assert any(f["row_text"] == "in@x.com" for f in rows)


def test_deep_and_broken_pages_take_linear_time():
    from leadwright.functions.dom import links, signals

    began = time.perf_counter()
    for html in ("<div>" * 100_000 + "a@b.com", "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<p>x" * 50_000, "<td><li>" * 30_000 + "</table>" * 30_000):
        assert {f["raw"] for f in signals(html, Scanner(POLICY.email, POLICY.obfuscation))["found"]} <= {"a@b.com"}
        assert links(html, "https://a.com/") == []
    assert time.perf_counter() - began < 20


def test_columns_named_like_signals(spark):
    from leadwright.operators.extract import page_signals

    pages = spark.createDataFrame([(1, "x", "y", "<title>T</title>")], "page_id long, title string, told string, html string")
    assert page_signals(pages).select("page_id", "told", "title").first() == (1, "y", "T")
