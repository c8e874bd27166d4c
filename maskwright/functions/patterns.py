"""Expressions over columns of prompts, patterns and raw model responses.

All of it is native but for two questions only a Python regex engine can answer
(does a pattern compile, does it match): those are Arrow-batched.
"""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from maskwright.functions.ambiguity import ambiguous
from maskwright.functions.standardise import MODES
from maskwright.functions.text import LINE_END, strip, strip_fence

# --- keys ------------------------------------------------------------------

# What each kind of cached entry is filed under.
KEY_PREFIX = {"regex": "regex_cache:", "spec": "spec_cache:", "samples": "pii_suggest:"}

# Fixed value: samples of a column that count for the key.
SAMPLES_IN_KEY = 5


def prompt_key(prompt: Column, kind: str = "regex") -> Column:
    """One key for all spellings of a prompt that differ in case or outer blanks."""
    return F.concat(F.lit(KEY_PREFIX[kind]), F.sha2(F.lower(strip(prompt)), 256))


def sample_key(sample_set: Column) -> Column:
    """Key of an ``array<struct<column, samples>>``, whatever its order.

    The first five samples of each column count, in any order.
    """
    heads = F.transform(
        sample_set,
        lambda entry: F.struct(
            entry["column"].alias("column"),
            F.array_sort(F.slice(entry["samples"], 1, SAMPLES_IN_KEY)).alias("samples"),
        ),
    )
    return F.concat(F.lit(KEY_PREFIX["samples"]), F.sha2(F.to_json(F.array_sort(heads)), 256))


# --- raw responses ---------------------------------------------------------


def parse_pattern(response: Column) -> Column:
    """The pattern of a one-line response, without code fences."""
    return strip_fence(response)


def parse_spec(response: Column) -> Column:
    """``struct<pattern, normalize, error>`` from ``PATTERN:`` and ``NORMALIZE:`` lines.

    The last line of each kind wins. An unknown mode counts as ``none``; without a
    pattern the error says so.
    """
    lines = F.transform(F.split(response, LINE_END), strip)

    def last(label: str) -> Column:
        labelled = F.filter(lines, lambda line: F.startswith(F.upper(line), F.lit(label)))
        return F.substr(F.try_element_at(labelled, F.lit(-1)), F.lit(len(label) + 1))

    pattern = F.nullif(strip_fence(last("PATTERN:")), F.lit(""))
    mode = F.lower(strip(last("NORMALIZE:")))
    return F.struct(
        pattern.alias("pattern"),
        F.when(mode.isin(*MODES), mode).otherwise("none").alias("normalize"),
        F.when(pattern.isNull(), "missing pattern").alias("error"),
    )


SPEC = "struct<pattern:string,normalize:string>"


def spec_value(pattern: Column, normalize: Column) -> Column:
    """A spec as the catalogue keeps it: JSON with the fields ``pattern`` and ``normalize``."""
    return F.to_json(F.struct(pattern.alias("pattern"), normalize.alias("normalize")))


def read_spec(value: Column) -> Column:
    """``struct<pattern, normalize>`` of a kept spec; NULL if it is none, an unknown mode is ``none``."""
    spec = F.from_json(value, SPEC)
    mode = spec["normalize"]
    known = F.struct(spec["pattern"].alias("pattern"), F.when(mode.isin(*MODES), mode).otherwise("none").alias("normalize"))
    return F.when(spec["pattern"].isNotNull(), known)


# --- safety audit ----------------------------------------------------------

# Fixed value: characters of a pattern that may run.
MAX_PATTERN_LENGTH = 512

# Fixed value: a group that holds a quantifier and is itself quantified. Groups that
# merely start with (?: are caught as well; refusing those is the safe side.
NESTED_QUANTIFIER = r"(?U)(?<!\\)\([^)]*[+*?{][^)]*(?<!\\)\)\s*[+*?{]"

_REPEAT = re.compile(r"[*+?]|\{[0-9]*(,?)[0-9]*\}")


def recursing_group(pattern: str) -> bool:
    """Whether a repeated group holds alternatives or parts of varying length.

    The JVM goes one level deeper for each round of such a group, so that a cell of a
    few thousand characters ends the executor. A group repeated possessively loops,
    and one of fixed parts does too. A bounded number of rounds counts as well: the
    bound may be large.
    """
    varying = [False]  # of the groups that are open
    in_class, at = False, 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "\\":
            at += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
            at += pattern[at : at + 1] == "^"
            at += pattern[at : at + 1] == "]"
        elif char == "(":
            varying.append(False)
            at += pattern[at : at + 1] == "?"
        elif char == "|":
            varying[-1] = True
        elif char == ")" and len(varying) > 1:
            inner = varying.pop()
            repeat = _REPEAT.match(pattern, at)
            if repeat and repeat[0] != "?" and inner and pattern[repeat.end() : repeat.end() + 1] != "+":
                return True
            varying[-1] |= inner
        elif repeat := _REPEAT.match(pattern, at - 1):
            varying[-1] |= char != "{" or bool(repeat[1])
    return False


def _checker():
    """Makes a function that says what is wrong with a pattern, each one once.

    ``compiled, problem``: the pattern as Python compiles it, or why it must not run.
    Made inside a function, like the UDFs below, so that Spark ships them by value
    and workers need not have this package installed.
    """
    recurses, shares = recursing_group, ambiguous

    def new_checker():
        known = {None: (None, None)}

        def checked(pattern):
            if pattern not in known:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    try:
                        compiled = re.compile(pattern)
                        problem = "recursing group" if recurses(pattern) else "ambiguous" if shares(pattern) else None
                        known[pattern] = (compiled, problem)
                    except (re.error, OverflowError, RecursionError):
                        known[pattern] = (None, "does not compile")
            return known[pattern]

        return checked

    return new_checker


def _problem(pattern: Column) -> Column:
    new_checker = _checker()

    def check(patterns: pd.Series) -> pd.Series:
        checked = new_checker()
        return patterns.map(lambda p: checked(p)[1]).astype(object)

    return F.pandas_udf(check, StringType())(pattern)


def refused_unseen(pattern: Column) -> Column:
    """Why a pattern isn't even compiled, or NULL; a look at its text is enough."""
    return (
        F.when(pattern.isNull(), "missing")
        .when(F.length(pattern) > MAX_PATTERN_LENGTH, "too long")
        .when(pattern.rlike(NESTED_QUANTIFIER), "nested quantifier")
    )


def unsafe_reason(pattern: Column) -> Column:
    """Why a pattern must not run, or NULL.

    It has to compile in Python, where it may come from, and in the JVM, where it
    runs; no cell may be long enough to end an executor, and none to hold a task by the
    many ways in which a row of repeats can share it out.
    """
    unseen = refused_unseen(pattern)
    in_jvm = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    problem = F.coalesce(
        F.when(unseen.isNull(), _problem(F.when(unseen.isNull(), pattern))),
        F.when(unseen.isNull() & in_jvm.isNull(), "does not compile"),
    )
    # What does not compile anywhere is said to be just that, whatever else it holds.
    nested = unseen == "nested quantifier"
    broken = F.when(nested & in_jvm.isNull(), "does not compile")
    return F.coalesce(broken, unseen, problem)


# --- repairs ---------------------------------------------------------------

# Digit counts of whole phone numbers and the like.
USUAL_DIGIT_COUNTS = (9, 10)

# A counted run of digits; one that is followed by a digit D and at most
# one anchor at the end of the pattern.
_DIGIT_RUN = r"\\d\{([0-9]+)\}"
_ENDS_IN_RUN_AND_DIGIT = r"(?d)^(.*?)\\d\{([0-9]+)\}([0-9])(\\b|\\Z|\$|)\n?\z"


def repair_trailing_digit(pattern: Column) -> Column:
    r"""``\d{3}\d{3}\d{4}3`` asks for eleven digits where ten were meant.

    The digit at the end should be one of the counted ones, so the last run gives
    one up; only where the runs alone already make a usual count and the extra
    digit breaks it.
    """

    def part(group: int) -> Column:
        return F.regexp_extract(pattern, _ENDS_IN_RUN_AND_DIGIT, group)

    runs = F.transform(
        F.regexp_extract_all(pattern, F.lit(_DIGIT_RUN), F.lit(1)),
        lambda n: n.try_cast("bigint"),
    )
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    last = part(2).try_cast("bigint")
    wrong = (
        (last >= 2)
        & (F.size(runs) >= 2)
        & total.isin(*(n for n in USUAL_DIGIT_COUNTS if n + 1 not in USUAL_DIGIT_COUNTS))
    )
    shorter = F.concat(
        part(1), F.lit(r"\d{"), (last - 1).cast("string"), F.lit("}"), part(3), part(4)
    )
    # The cheap test first: most patterns end otherwise and stop here.
    return F.when(
        pattern.rlike(_ENDS_IN_RUN_AND_DIGIT), F.when(wrong, shorter).otherwise(pattern)
    ).otherwise(pattern)


# How a prompt names a mail domain. Possessive, so that a text of
# thousands of labels does not deepen the stack.
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
_DOMAIN = rf"({_LABEL}(?:\.{_LABEL})++)"
_DOMAIN_NAMED = rf"(?iU)(?:domain\s+is\s+|ending\s+(?:with|in)\s+@?|emails?\s+at\s+){_DOMAIN}"
_DOMAIN_AFTER_AT = rf"(?iU)@{_DOMAIN}"


def domain_of(prompt: Column) -> Column:
    """The mail domain a prompt speaks of, lower-cased, or NULL."""

    def found(regex: str) -> Column:
        return F.nullif(F.regexp_extract(prompt, regex, 1), F.lit(""))

    after_at = F.when(F.contains(prompt, F.lit("@")), found(_DOMAIN_AFTER_AT))
    return F.lower(F.coalesce(found(_DOMAIN_NAMED), after_at))


def first_found(text: Column, *patterns: Column) -> Column:
    """1 for the first pattern if it is found in the text, 2 for the second, ...; else 0.

    Patterns with a problem are not run; nor may the caller send any that
    ``refused_unseen`` refuses, as one of them could hold a task for good.
    """
    new_checker = _checker()

    def choose(texts: pd.Series, *candidates: pd.Series) -> pd.Series:
        checked = new_checker()

        def first(probe, *row) -> int:
            if probe is not None:
                for position, pattern in enumerate(row, 1):
                    regex, problem = checked(pattern)
                    if regex is not None and problem is None and regex.search(probe):
                        return position
            return 0

        return pd.Series([first(*row) for row in zip(texts, *candidates)], dtype="int32")

    return F.pandas_udf(choose, IntegerType())(text, *patterns)


# What may stand too much between the @ and the domain, with a dot and
# without; what may end the domain; and the pattern of a plain address.
_SUB_DOMAIN = r"@\[[^\]]+\]\+\\\."
_RUN = r"@\[[^\]]+\]\+"
_DOMAIN_END = r"(?:\\b|\\Z|\$)"
_PLAIN_ADDRESS = ("[a-zA-Z0-9._%+-]+@", r"\b")


def escaped_domain(domain: Column) -> Column:
    return F.replace(domain, F.lit("."), F.lit(r"\."))


def without_sub_domain(pattern: Column, domain: Column) -> Column:
    """The pattern less a bracketed run and a dot right before the domain; NULL if none.

    Found only where the pattern spells the domain with bare dots and ends it with
    a word boundary or an end anchor.
    """
    return _less(pattern, domain, _SUB_DOMAIN)


def without_run(pattern: Column, domain: Column) -> Column:
    """The same for a bracketed run without a dot."""
    return _less(pattern, domain, _RUN)


def _less(pattern: Column, domain: Column, extra: str) -> Column:
    # The domain holds letters, digits, dots and hyphens only: always a sound regex.
    regex = F.concat(F.lit(extra + "(?="), escaped_domain(domain), F.lit(_DOMAIN_END + ")"))
    return F.nullif(F.regexp_replace(pattern, regex, F.lit("@")), pattern)


def plain_address(domain: Column) -> Column:
    before, after = _PLAIN_ADDRESS
    return F.concat(F.lit(before), escaped_domain(domain), F.lit(after))
