"""Policy of crawling, extraction and scoring: plain values that plans take as literals."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

# The policy's defaults, in their natural order.
EMAIL = r"[a-zA-Z0-9._%+\-]+@(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,6}"
CSV_EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
TOP_DOMAIN = r"[a-zA-Z]{2,6}"
MARKED_CHARACTER = r"[a-zA-Z0-9._%+\-]"
CAPITALISED = r"[A-Z][a-z]+"
DESIGNATION_END = r"(?i)[@\n]|\b(?:e-?mail|phone|tel(?:ephone)?)\b\s*[:\-]?|\d{5,}"  # an address, a line break, a mail or phone label, a long number
VALID_SUFFIXES = (".gov.in", ".nic.in", ".res.in", ".ac.in", ".com")
TARGET_SUFFIXES = (".gov.in", ".nic.in")
OBFUSCATION = (
    (r"\s*\[at\]\s*", "@"),
    (r"\s*\(at\)\s*", "@"),
    (r"\s*\[dot\]\s*", "."),
    (r"\s*\(dot\)\s*", "."),
    (r"\s*\[hyphen\]\s*", "-"),
    (r"\s*\(hyphen\)\s*", "-"),
)
ROLE_LOCAL_PARTS = ("webmaster", "info", "admin", "contact", "support", "helpdesk", "grievance")
TITLE_PREFIXES = ("Shri", "Smt", "Dr", "Mr", "Mrs", "Ms", "Prof", "Sh", "Shrimati", "Km")
DESIGNATION_KEYWORDS = (
    "Secretary", "Director", "Commissioner", "Collector", "Superintendent", "Inspector", "Officer", "Manager", "Chairman", "President", "Minister", "Deputy",
    "Additional", "Principal", "Chief", "Joint", "Under Secretary", "IAS", "IPS", "IFS", "IRS", "Jt", "Jr", "Junior",
)
RUNGS = ("proximity_text", "table_block", "microdata", "mailto_tel")
HIGH_RUNGS = ("mailto_tel", "microdata")
SKIP_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".mp4", ".mp3", ".avi", ".mov")
PRIORITY_KEYWORDS = (
    "contact", "officer", "directory", "whos-who", "who-is-who", "staff", "personnel", "secretariat", "about-us", "division", "minister", "committee",
    "administration", "team", "telephone", "tele-directory", "phone-directory", "email",
)
JS_INDICATORS = ('<div id="__next"', '<div id="root"', "Please enable JavaScript", "You need to enable JavaScript", "This page requires JavaScript")
PAGING_TEXTS = ("next", "»", "›", "more", "last")
PAGING_PARAMS = ("page", "pageno", "start", "offset", "p")
SCORE_WEIGHTS = {"email_high": 20, "email_low": 10, "person_name": 40, "designation": 30, "phone": 10}
MAX_LINKS = {"0": 100, "1": 50, "2": 40, "default": 20}
HEADER_WORDS = {
    "name": ("name", "officer", "official", "contact person"),
    "designation": ("designation", "post", "rank", "position"),
    "department": ("department", "division", "ministry", "section"),
    "email": ("email", "e-mail", "mail"),
}


@dataclass(frozen=True)
class Policy:
    """What operators need to know; every value can be replaced, and none is read from a table in a plan."""

    email: str = EMAIL
    valid_suffixes: tuple = VALID_SUFFIXES
    target_suffixes: tuple = TARGET_SUFFIXES
    obfuscation: tuple = OBFUSCATION
    role_local_parts: tuple = ROLE_LOCAL_PARTS
    title_prefixes: tuple = TITLE_PREFIXES
    designation_keywords: tuple = DESIGNATION_KEYWORDS
    high_rungs: tuple = HIGH_RUNGS
    context_chars: int = 200
    proximity_chars: int = 300
    max_input_chars: int = 0  # characters of a page's text that are scanned for addresses; 0: all
    skip_extensions: tuple = SKIP_EXTENSIONS
    priority_keywords: tuple = PRIORITY_KEYWORDS
    js_indicators: tuple = JS_INDICATORS
    paging_texts: tuple = PAGING_TEXTS
    paging_params: tuple = PAGING_PARAMS
    paging: bool = True
    max_paging_hops: int = 50
    max_chain_children: int = 100
    max_links: dict = field(default_factory=lambda: dict(MAX_LINKS))
    max_depth: int = 4
    weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    person: bool = True


def merged(base: dict, overlay: dict) -> dict:
    """A policy document with another laid over it: maps are merged at every depth, other values replaced."""
    out = copy.deepcopy(base)
    for key, value in overlay.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out
