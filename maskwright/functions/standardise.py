"""Phone numbers to E.164 and dates to ISO-8601 as native expressions.

Each standardiser has two halves. ``stage`` is the costly half that several later
branches look at; ``finish`` decides on the staged value. The DataFrame operator
puts them in two projections, so the staged value is computed once per row and
only for cells that pass the gate. Composed in one expression (``e164``,
``iso8601``) they give the same values, but Spark evaluates the staged part once
per branch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Standardiser(NamedTuple):
    stage: Callable[[Column], Column]
    finish: Callable[[Column, Column], Column]


# --- phone numbers ---------------------------------------------------------


def digits_of(cell: Column) -> Column:
    """The decimal digits of any script, in order.

    The engine's Unicode classes are slow; a cell of ASCII bytes alone, as nearly all
    are, does without them.
    """
    ascii_only = F.octet_length(cell) == F.length(cell)
    return F.when(ascii_only, F.regexp_replace(cell, F.lit("[^0-9]+"), F.lit(""))).otherwise(
        F.regexp_replace(cell, F.lit(r"(?U)\D+"), F.lit(""))
    )


def e164_from_digits(digits: Column, cell: Column) -> Column:
    """Ten digits get the US prefix, other lengths from 7 to 15 a plus sign."""
    count = F.length(digits)
    return (
        F.when(count == 10, F.concat(F.lit("+1"), digits))
        .when(count.between(7, 15), F.concat(F.lit("+"), digits))
        .otherwise(cell)
    )


def e164(cell: Column) -> Column:
    return e164_from_digits(digits_of(cell), cell)


# --- dates -----------------------------------------------------------------

# Month names accepted in full or by their first three letters.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Parts of a date. A one-digit day may be padded with a blank.
_PARTS = {
    "M": "(1[0-2]|0[1-9]|[1-9])",
    "D": "(?: (?=[1-9](?![0-9])))?(3[01]|[12][0-9]|0[1-9]|[1-9])",
    "Y": "((?!0000)[0-9]{4})",
    "y": "((?!0000)[0-9]{4}|[0-9]{2})",
    "N": "((?iU:" + "|".join([*sorted(MONTHS, key=len, reverse=True), *(m[:3] for m in MONTHS)]) + "))",
    ",": ",?",
    "_": r"(?U:[\s\x1c-\x1f]++)",
}


def _date_rule(*shapes: str) -> tuple[str, str]:
    """One pattern for some shapes, and the replacement that puts year, month, day in order.

    The shapes are tried in turn. The groups of those that did not match are empty in
    the replacement. Any other text matches as well, with all groups empty, and is
    left with two dashes.
    """
    groups: dict[str, list[int]] = {"Y": [], "M": [], "D": []}
    count = 0
    for part in "".join(shapes):
        role = {"y": "Y", "N": "M"}.get(part, part)
        if role in groups:
            count += 1
            groups[role].append(count)
    patterns = ("".join(_PARTS.get(part, part) for part in shape) for shape in shapes)
    blank = r"(?U:[\s\x1c-\x1f]*+)"
    pattern = rf"^(?:{blank}(?:{'|'.join(patterns)}){blank}|(?s:.*+))\z"
    order = "-".join("".join(f"${group}" for group in groups[role]) for role in "YMD")
    return pattern, order


# All accepted shapes, by their separator. Month-first goes before day-first; all
# others exclude each other. A month-first text whose day does not exist (30
# February) has a day above 12, so it never is a day-first date as well. Years of
# two digits go with slashes only.
SLASHED = _date_rule("M/D/y", "D/M/y", "Y/M/D")
DASHED = _date_rule("M-D-Y", "D-M-Y", "Y-M-D")
OTHER = _date_rule("N_D,_Y", "YMD")

# Two-digit years from here on belong to the 1900s.
PIVOT_YEAR = "69"


def date_parts(cell: Column) -> Column:
    """``year-month-day`` as written, the month maybe a name; ``--`` if it is no date."""

    def ordered(rule: tuple[str, str]) -> Column:
        return F.regexp_replace(cell, F.lit(rule[0]), F.lit(rule[1]))

    return (
        F.when(F.contains(cell, F.lit("/")), ordered(SLASHED))
        .when(F.contains(cell, F.lit("-")), ordered(DASHED))
        .otherwise(ordered(OTHER))
    )


def _month_number(name: Column) -> Column:
    """Two digits for a known month name, looked up by its first three letters."""
    table = F.lit("".join(f"{month[:3].lower()}{i:02d}" for i, month in enumerate(MONTHS, 1)))
    return F.substr(table, F.instr(table, F.lower(name)) + 3, F.lit(2))


def iso8601_from_parts(parts: Column, cell: Column) -> Column:
    """The date as ``yyyy-MM-dd``; the cell itself if there is no such day."""
    named = F.concat(
        F.left(parts, F.lit(5)),
        _month_number(F.substring(parts, 6, 3)),
        F.lit("-"),
        F.substring_index(parts, "-", -1),
    )
    century = F.when(parts >= PIVOT_YEAR, "19").otherwise("20")
    day = (
        F.when(F.substring(parts, 6, 1) >= "A", named)
        .when(F.substring(parts, 3, 1) == "-", F.concat(century, parts))
        .otherwise(parts)
    )
    return F.coalesce(day.try_cast("date").cast("string"), cell)


def iso8601(cell: Column) -> Column:
    return iso8601_from_parts(date_parts(cell), cell)


STANDARDISERS: dict[str, Standardiser] = {
    "e164": Standardiser(digits_of, e164_from_digits),
    "iso8601": Standardiser(date_parts, iso8601_from_parts),
}

MODES = ("none", *STANDARDISERS)
