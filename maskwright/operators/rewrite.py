"""Rewrite one column of a table: redact it, or standardise its phones or dates.

Everything here is a narrow projection: no shuffle, no Python worker, and the
other columns pass through untouched, so the same plan serves any table size and
also a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.redaction import as_text, matches, redact, rewrite_if
from maskwright.functions.standardise import MODES, STANDARDISERS
from maskwright.functions.text import quoted


def require_column(df: DataFrame, column: str) -> None:
    """The name must be spelled exactly as in the table, case included."""
    if column not in df.columns:
        raise ValueError(f"There is no column '{column}' among {df.columns}")


def require_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"Unknown mode {mode!r}; expected one of {list(MODES)}.")


def known_mode(mode: str | None) -> str:
    """For recorded runs: a mode nobody knows means plain redaction."""
    return mode if mode in MODES else "none"


def rewrite_column(
    df: DataFrame,
    column: str,
    regex: str,
    replacement: str = "",
    mode: str = "none",
    *,
    literal: bool = False,
) -> DataFrame:
    """Replace ``column`` in place by its rewritten string form.

    ``none`` replaces each match inside the cell. The other modes use the pattern
    only to pick the cells, and then standardise the whole cell.
    """
    require_mode(mode)
    require_column(df, column)
    cell = quoted(column)
    if mode == "none":
        return df.withColumn(column, redact(cell, regex, replacement, literal=literal))

    standardiser = STANDARDISERS[mode]
    staged = _free_name(df, "staged")
    # Two projections on purpose: Catalyst keeps them apart because the staged
    # value is costly and read more than once.
    return (
        df.withColumn(staged, F.when(matches(cell, regex), standardiser.stage(as_text(cell))))
        .withColumn(
            column,
            F.when(quoted(staged).isNull(), as_text(cell)).otherwise(
                standardiser.finish(quoted(staged), as_text(cell))
            ),
        )
        .drop(staged)
    )


def rows_matching(df: DataFrame, column: str, regex: str) -> DataFrame:
    """The rows whose cell holds the pattern."""
    require_column(df, column)
    return df.where(matches(quoted(column), regex))


def _free_name(df: DataFrame, stem: str) -> str:
    taken = {name.lower() for name in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


__all__ = [
    "known_mode",
    "require_column",
    "require_mode",
    "rewrite_column",
    "rewrite_if",
    "rows_matching",
]
