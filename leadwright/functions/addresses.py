"""Addresses in running text, found in time that grows with its length alone.

Every repetition is possessive: it gives nothing back, so the JVM's matcher neither recurses nor reads a run twice. What a
greedy pattern would find by going back, the last dot before a top domain, is told by looking ahead at each dot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadwright.policy import EMAIL, MARKED_CHARACTER, TOP_DOMAIN

_TWO = "[a-zA-Z]{2}"
#: White space before a marker, if any: read from its start on, so that no place inside it is tried again.
_BEFORE = r"(?:(?<!\s)\s++)?+"
_LABEL = r"[a-zA-Z0-9\-]++\."
#: Labels up to the last dot that two letters follow, and the top domain.
_DOMAIN = rf"(?:(?:{_LABEL}(?!{_TWO}))*+{_LABEL}(?={_TWO}))++{TOP_DOMAIN}"
#: Characters of MARKED_CHARACTER.
_LOCAL = "".join(chr(c) for c in range(128) if re.fullmatch(MARKED_CHARACTER, chr(c)))


def scanning(pattern: str) -> str:
    """A Java pattern that finds what the given one finds; other patterns than the default one are taken as they are.

    A match begins where a run of its characters does, or where the match before it ended inside one.
    """
    return rf"(?:\G|(?<!{MARKED_CHARACTER})){MARKED_CHARACTER}++@{_DOMAIN}" if pattern == EMAIL else f"(?i){pattern}"


def whole(pattern: str) -> str:
    """A Java pattern of texts that are an address as a whole."""
    return rf"^{MARKED_CHARACTER}++@(?:{_LABEL})++{TOP_DOMAIN}$" if pattern == EMAIL else f"(?i)^(?:{pattern})$"


def _core(mark: str) -> tuple[str, str, str]:
    """A marker's pattern without the white space around it, and whether that may stand before and after it."""
    core = mark.removeprefix(r"\s*")
    return core.removesuffix(r"\s*"), _BEFORE if core != mark else "", r"\s*+" if core.endswith(r"\s*") else ""


def mark_replacing(mark: str) -> str:
    """A Java pattern that replaces what the marker's own pattern would, reading white space once."""
    core, before, after = _core(mark)
    return f"(?i){before}(?:{core}){after}"


def marked(pairs: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """Patterns, for Java and Python, of text that holds an at-marker, and of runs of marked text whose group 1 is an address with markers.

    A run that no address begins with is matched too, without the group, so that no place inside it is tried again. Both
    match nothing without at- and dot-markers.
    """
    signs: dict[str, list[str]] = {"@": [], ".": []}
    inside = [f"{MARKED_CHARACTER}++"]
    for mark, sign in pairs:
        core, before, after = _core(mark)
        signs.get(sign, inside).append(f"{before}(?:{core}){after}")
    if not all(signs.values()):
        return "(?!)", "(?!)()"
    run, at, dot = f"(?:{'|'.join(inside)})++", f"(?:{'|'.join(signs['@'])})", f"(?:{'|'.join(signs['.'])})"
    domain = f"(?:(?:{run}{dot}(?!{_TWO}))*+{run}{dot}(?={_TWO}))++{TOP_DOMAIN}"
    ats = "|".join(f"(?:{_core(mark)[0]})" for mark, sign in pairs if sign == "@")
    return f"(?i)(?:{ats})", f"(?i)({run}{at}{domain})|{run}"


def marked_spans(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """All spans of a text that are addresses with markers, in order."""
    at, spans = marked(pairs)
    return F.when(text.rlike(at), F.filter(F.regexp_extract_all(text, F.lit(spans), F.lit(1)), lambda s: s != "")).otherwise(F.expr("cast(array() as array<string>)"))


class Scanner:
    """Finds addresses, plain and with markers, in Python strings."""

    def __init__(self, pattern: str, pairs: Sequence[tuple[str, str]]):
        self.own = None if pattern == EMAIL else re.compile(pattern, re.IGNORECASE)
        self.domain = re.compile(_DOMAIN)
        self.at, self.spans = (re.compile(p) for p in marked(pairs))

    def plain(self, text: str) -> Iterator[tuple[int, int]]:
        """Where addresses begin and end. Each @ is looked at once: the run of characters before it, then the domain behind it."""
        if self.own:
            yield from (m.span() for m in self.own.finditer(text))
            return
        done, at = 0, text.find("@")
        while at >= 0:
            before = text[done:at]
            local = len(before) - len(before.rstrip(_LOCAL))
            found = self.domain.match(text, at + 1) if local else None
            if found:
                yield at - local, found.end()
            done = found.end() if found else at + 1
            at = text.find("@", done)

    def with_marks(self, text: str) -> Iterator[tuple[int, int]]:
        if self.at.search(text):
            yield from (m.span(1) for m in self.spans.finditer(text) if m[1])


def with_places(text: Column, pattern: str, chars: int) -> Column:
    """All addresses of a text, as written: an array of (match, start, around). start is 0-based, around reaches `chars` to both sides."""

    @F.pandas_udf("array<struct<match:string,start:int,around:string>>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(pattern, ())
        for batch in batches:
            yield pd.Series([[{"match": t[a:b], "start": a, "around": t[max(a - chars, 0) : b + chars]} for a, b in scanner.plain(t or "")] for t in batch], dtype="object")

    return places(text)
