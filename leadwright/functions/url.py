"""URL and host functions, column to column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def strip_www(netloc: Column) -> Column:
    """Without a leading `www.`, as it is written."""
    return F.regexp_replace(netloc, r"^www\.", "")


def authority(url: Column) -> Column:
    """Lower-cased host and port; empty without a scheme."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def netloc(url: Column) -> Column:
    """Lower-cased host and port without `www.`: the key of the catalog."""
    return strip_www(authority(url))


def host(url: Column) -> Column:
    """netloc without its port."""
    return F.split_part(netloc(url), F.lit(":"), F.lit(1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    """The text between `?` and `#`, empty if none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_key(url: Column) -> Column:
    """What makes two addresses the same page: netloc, path without trailing slashes (or `/`), and the query; not scheme or fragment."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    q = query(url)
    return F.concat(netloc(url), F.when(trimmed == "", "/").otherwise(trimmed), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def ends_with_any(value: Column, suffixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (value.endswith(s) for s in suffixes), F.lit(False))


def in_scope(url: Column, suffixes: Sequence[str]) -> Column:
    """Whether host and port end with a suffix; no suffixes accept all."""
    return ends_with_any(authority(url), suffixes) if suffixes else F.lit(True)


def is_target(url: Column, suffixes: Sequence[str]) -> Column:
    """An http address whose host and port end with a suffix."""
    return F.coalesce(url.startswith("http") & ends_with_any(authority(url), suffixes), F.lit(False))


def root_url(url: Column) -> Column:
    """Scheme and authority."""
    return F.nullif(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1), F.lit(""))


def title_of(url: Column, suffixes: Sequence[str] = (".gov.in", ".nic.in", ".res.in", ".ac.in", ".com")) -> Column:
    """A title made of the host: the first matching suffix cut, dots and hyphens as spaces, words capitalised."""
    name = netloc(url)
    cut = F.coalesce(*(F.when(name.endswith(s), len(s)) for s in suffixes), F.lit(0))
    kept = name.substr(F.lit(1), F.length(name) - cut)
    return F.initcap(F.trim(F.regexp_replace(kept, r"[.\-]+", " ")))


def main_and_contact(main: Column, contact: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Main address: itself if it is a target, else the root of the contact address, else null; contact: itself if it is a target."""
    good = is_target(contact, suffixes)
    return F.when(is_target(main, suffixes), main).when(good, root_url(contact)), F.when(good, contact)


def with_scheme(raw: Column) -> Column:
    """A typed-in address: trimmed, with `http://` where it has no scheme; null without a host."""
    text = F.trim(raw)
    full = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("http://"), text))
    return F.when((text != "") & (authority(full) != ""), full)


def is_skippable(url: Column, extensions: Sequence[str]) -> Column:
    """Whether the path ends with the extension of a file that is not a page."""
    return ends_with_any(F.lower(path(url)), extensions)


def is_priority(url: Column, text: Column, keywords: Sequence[str]) -> Column:
    """Whether address or link text holds a keyword; no keywords accept all."""
    both = F.lower(F.concat_ws(" ", url, text))
    return reduce(lambda a, b: a | b, (both.contains(k) for k in keywords), F.lit(False)) if keywords else F.lit(True)


def url_priority(url: Column, keywords: Sequence[str]) -> Column:
    """0 before 1 in the frontier."""
    return F.when(is_priority(url, F.lit(""), keywords), 0).otherwise(1)


def needs_js(html: Column, indicators: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (html.contains(i) for i in indicators), F.lit(False))


def department_of(url: Column) -> Column:
    """The first label of the host, null without one."""
    return F.nullif(F.split_part(netloc(url), F.lit("."), F.lit(1)), F.lit(""))


def seed_url(main: Column, contact: Column, resumed: bool = False) -> Column:
    """A new job starts at the contact page, a resumed one at the main page; the other where that is blank."""
    first, other = (main, contact) if resumed else (contact, main)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(other, F.lit("")))


def host_suffixes(name: Column) -> Column:
    """A host and its parents, nearest first, down to two labels; none for a host of one label."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    steps = F.when(n >= 2, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(steps, lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, its name in any case; null if it is absent, empty if it has no value."""
    here = F.concat(F.lit("&"), query(url))
    return F.when(here.rlike(f"(?i)&{name}(=|&|$)"), F.regexp_extract(here, f"(?i)&{name}(?:=([^&]*))?(?:&|$)", 1))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarding header, else the peer's."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)
