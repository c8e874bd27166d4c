"""Regex search and replace on one column. All expressions run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes that stand for one character of a class, or for a place, and take no argument.
_PLAIN_ESCAPES = frozenset("dDsSwWhHvVRbBAzZGntrfae")


def required_text(regex: str) -> str | None:
    """A text that every match must contain, or None where that is not plain to see.

    Looks at the characters outside all groups and classes, and gives up on
    alternatives, flags, and escapes that take an argument. The longest such
    stretch is returned, the first of equals.
    """
    stretches = [""]
    depth, in_class, at = 0, False, 0
    while at < len(regex):
        char, following = regex[at], regex[at + 1 : at + 2]
        at += 1
        if char == "\\":
            at += 1
            literal = following.isascii() and following != "" and not following.isalnum()
            if not literal and following not in _PLAIN_ESCAPES:
                return None
            if not in_class and not depth:
                stretches[-1:] = [stretches[-1] + following] if literal else [stretches[-1], ""]
        elif in_class:
            if char == "[":
                return None
            in_class = char != "]"
        elif char == "[":
            if regex[at : at + 1] == "]" or regex[at : at + 2] == "^]":
                return None
            in_class = True
            stretches.append("")
        elif char == "(":
            if following == "?" and regex[at + 1 : at + 2] not in tuple(":=!<>"):
                return None
            depth += 1
            stretches.append("")
        elif char == ")":
            depth -= 1
        elif depth:
            continue
        elif char == "|":
            return None
        elif char in "*?{":
            # What was before may be missing; the stretch ends without it.
            stretches[-1:] = [stretches[-1][:-1], ""]
            if char == "{":
                at = regex.find("}", at) + 1
                if at == 0:
                    return None
        elif char in "+.^$}]":
            stretches.append("")
        else:
            stretches[-1] += char
    return max(stretches, key=len) or None


def as_text(cell: Column) -> Column:
    """Every rule works on the cell's string form."""
    return cell.cast("string")


def matches(cell: Column, regex: str) -> Column:
    """True where the pattern is found anywhere in the cell; NULL for NULL."""
    text, needed = as_text(cell), required_text(regex)
    found = text.rlike(regex)
    return found if needed is None else F.contains(text, F.lit(needed)) & found


def literal_replacement(text: str) -> str:
    """Escape the two characters Java gives a meaning in a replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def redact(cell: Column, regex: str, replacement: str = "", *, literal: bool = False) -> Column:
    """Replace every match inside the cell.

    Cells without a match and NULLs stay as they are. ``$1`` in the replacement
    is the first group, unless ``literal`` asks for the text as it stands.

    The regex engine tries every position of a text. Where the pattern needs some
    plain text, such as the ``@`` of an address, a byte search for that comes first,
    and most cells never reach the engine.
    """
    if literal:
        replacement = literal_replacement(replacement)
    text, needed = as_text(cell), required_text(regex)
    replaced = F.regexp_replace(text, F.lit(regex), F.lit(replacement))
    if needed is None:
        return replaced
    return F.when(F.contains(text, F.lit(needed)), replaced).otherwise(text)


def rewrite_if(cell: Column, regex: str, rewritten: Column) -> Column:
    """``rewritten`` where the cell matches, else the cell's own text."""
    return F.when(matches(cell, regex), rewritten).otherwise(as_text(cell))
