"""Pattern library for columns that hold personal data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.redaction import matches


class PiiType(NamedTuple):
    name: str
    label: str
    regex: str
    prompt: str
    # No match is longer, in bytes; so longer cells need not be tried.
    max_bytes: int | None = None
    # The same with possessive repeats, where the JVM's engine would go a level deeper per round.
    flat_regex: str | None = None


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)

# Whole-cell patterns, the most specific type first: the first wins a tie. They
# keep to what Java and RE2 read alike. Plain digit strings are left to the card
# prefixes, so number and key columns are not taken for phones or the like.
# ``name`` is weak: two capitalised words or more.
# The types' names and labels, and the prompts that go with them.
LIBRARY = (
    PiiType(
        "ssn", "Social Security Number",
        r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z",
        "find social security numbers",
        11,
    ),
    PiiType(
        "credit_card", "Credit card",
        r"^(?:(?:[0-9]{4}[ -]){3}[0-9]{1,7}|3[47][0-9]{13}|4[0-9]{12}(?:[0-9]{3})?"
        r"|5[1-5][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})\z",
        "find credit card numbers",
        22,
    ),
    PiiType(
        "ip_address", "IP address",
        rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z",
        "find IP addresses",
        15,
    ),
    PiiType(
        "url", "URL",
        r"^(?:[hH][tT][tT][pP][sS]?|[fF][tT][pP])://[^ \t\r\n]+\z",
        "find URLs",
    ),
    PiiType(
        "email", "Email address",
        r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z",
        "find email addresses",
    ),
    PiiType(
        "date", "Date",
        r"(?i)^(?:[0-9]{1,2}[/-][0-9]{1,2}[/-](?:[0-9]{2}|[0-9]{4})|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
        rf"|{_MONTH} {{1,3}}[0-9]{{1,2}},? {{1,3}}[0-9]{{4}})\z",
        "find dates",
        22,
    ),
    PiiType(
        "phone", "Phone number",
        r"^(?:\+[0-9]{7,15}|(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4})\z",
        "find US phone numbers",
        17,
    ),
    PiiType(
        "name", "Person name",
        r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+\z",
        "find person names",
        None,
        r"^\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)++\z",
    ),
)


def is_of_type(cell: Column, kind: PiiType) -> Column:
    """Whether the whole cell is of a type; the cheap byte tests come first."""
    found = matches(cell, kind.flat_regex or kind.regex)
    return found if kind.max_bytes is None else (F.octet_length(cell) <= kind.max_bytes) & found


# The types a suggestion may carry.
PII_TYPES = (
    "email", "phone", "ssn", "credit_card", "date", "name", "ip_address", "url", "none",
)

# What a suggestion of a type is turned into.
MODE_OF_TYPE = {"phone": "e164", "date": "iso8601"}
DEFAULT_REPLACEMENT = "[REDACTED]"
MIN_CONFIDENCE = 0.6
