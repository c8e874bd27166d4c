"""Which columns hold personal data, and what to do about it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import sample_key
from maskwright.functions.pii import (
    DEFAULT_REPLACEMENT,
    LIBRARY,
    MIN_CONFIDENCE,
    MODE_OF_TYPE,
    PII_TYPES,
    is_of_type,
)
from maskwright.functions.text import is_blank, quoted, round_2, strip, strip_fence
from maskwright.operators.catalog import TTL_SECONDS, look_up

# Fixed value: characters of a column's name in samples.
MAX_NAME = 256

_SAMPLES = "array<struct<column:string,samples:array<string>>>"


# --- samples ---------------------------------------------------------------


def column_samples(
    df: DataFrame,
    order_by: Sequence[str] = (),
    max_rows: int = 30,
    max_samples: int = 8,
) -> DataFrame:
    """``(column, samples)`` from the first rows of a table.

    Per column: NULLs are skipped, eight values taken, and only then stripped and
    blank ones dropped. Columns without a sample are left out.

    Without ``order_by`` the rows are taken from the first partitions only, however
    large the table. With it the first rows' keys are found in a scan of the keys
    alone, and the wide rows are then read up to the last of them only.
    """
    if order_by:
        head = _up_to_last(df, order_by, max_rows).orderBy(*order_by).limit(max_rows)
    else:
        head = df.limit(max_rows)
    cells = [quoted(name).cast("string").alias(f"c{i}") for i, name in enumerate(df.columns)]
    rows = head.select(F.monotonically_increasing_id().alias("row"), *cells).agg(
        F.sort_array(F.collect_list(F.struct("row", *(f"c{i}" for i in range(len(cells)))))).alias("rows")
    )

    def samples(i: int) -> Column:
        values = F.filter(F.transform("rows", lambda row: row[f"c{i}"]), lambda v: v.isNotNull())
        taken = F.transform(F.slice(values, 1, max_samples), strip)
        return F.filter(taken, lambda v: v != "")

    found = F.array(
        *(
            F.struct(F.lit(name[:MAX_NAME]).alias("column"), samples(i).alias("samples"))
            for i, name in enumerate(df.columns)
        )
    )
    return rows.select(F.inline(found)).where(F.size("samples") > 0)


def _up_to_last(df: DataFrame, order_by: Sequence[str], rows: int) -> DataFrame:
    """The rows that may be among the first ones, by a range of the leading key."""
    keys = [quoted(name) for name in order_by]
    first = df.select(*keys).orderBy(*keys).limit(rows).collect()
    if not first:
        return df
    key, last = quoted(order_by[0]), first[-1][0]
    bound = F.lit(last).cast(df.schema[order_by[0]].dataType)
    return df.where(key.isNull() if last is None else key.isNull() | (key <= bound))


def clean_samples(samples: DataFrame, max_samples: int = 10) -> DataFrame:
    """Samples sent in by a caller: drop NULL and blank ones first, then take ten."""
    kept = F.filter("samples", lambda v: v.isNotNull() & ~is_blank(v))
    return samples.select(
        F.substring("column", 1, MAX_NAME).alias("column"),
        F.slice(kept, 1, max_samples).alias("samples"),
    ).where(F.size("samples") > 0)


def trim_samples(samples: DataFrame, max_samples: int = 8) -> DataFrame:
    return samples.where(F.size("samples") > 0).withColumn(
        "samples", F.slice("samples", 1, max_samples)
    )


def sample_set_key(samples: DataFrame) -> DataFrame:
    """One row: the cache key of all ``(column, samples)`` rows together.

    The rows are one table's columns, so the set is as wide as a table, no more.
    """
    return samples.agg(
        sample_key(F.collect_list(F.struct("column", "samples")).cast(_SAMPLES)).alias("key")
    )


# --- classification --------------------------------------------------------


def match_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: ``cells`` that are not NULL, and how many match each type.

    One pass over the whole table. Rows are turned into cells, and cells are
    counted per column before the shuffle, which so carries one row per column
    and task, whatever the table holds.
    """
    names = list(columns if columns is not None else df.columns)
    # Positions stand in for names meanwhile: a name may hold dots or be long.
    cells = df.select(
        *(quoted(name).cast("string").alias(str(i)) for i, name in enumerate(names))
    ).unpivot([], [quoted(str(i)) for i in range(len(names))], "position", "cell")
    counts = (
        cells.where(F.col("cell").isNotNull())
        .groupBy("position")
        .agg(
            F.count("cell").alias("cells"),
            *(F.count_if(is_of_type(F.col("cell"), t)).alias(t.name) for t in LIBRARY),
        )
    )
    name_of = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (str(i), n)))
    return counts.select(
        name_of[F.col("position")].alias("column"), "cells", *(t.name for t in LIBRARY)
    )


def classify_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``(column, pii_type, confidence, suggested_prompt)`` for suspicious columns.

    The confidence is the share of all non-NULL cells that match the best type.
    """
    best = F.array_max(
        F.array(
            *(
                F.struct(
                    (F.col(t.name) / F.col("cells")).alias("share"),
                    F.lit(-rank).alias("rank"),
                    F.lit(t.name).alias("pii_type"),
                    F.lit(t.prompt).alias("suggested_prompt"),
                )
                for rank, t in enumerate(LIBRARY)
            )
        )
    )
    return (
        match_shares(df, columns)
        .select("column", best.alias("best"))
        .where(F.col("best.share") >= min_confidence)
        .select(
            "column",
            "best.pii_type",
            round_2(F.col("best.share")).alias("confidence"),
            "best.suggested_prompt",
        )
    )


def parse_suggestions(
    responses: DataFrame, response: str = "response", min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Raw JSON-array texts to one row per suggestion; other columns are kept.

    A text that is not exactly one JSON array gives no rows, nor does one with a
    confidence that is not a number. Items that are not objects are skipped.
    """
    others = [quoted(name) for name in responses.columns if name != response]
    # The end mark proves that nothing but the value stood between: the parser
    # itself would ignore what follows a complete value.
    wrapped = F.try_parse_json(
        F.concat(F.lit('{"value":'), strip_fence(quoted(response)), F.lit(',"end":0}'))
    )
    items = F.filter(
        F.when(
            F.try_variant_get(F.col("__json"), "$.end", "int") == 0,
            F.try_variant_get(F.col("__json"), "$.value", "array<variant>"),
        ),
        lambda item: F.startswith(F.schema_of_variant(item), F.lit("OBJECT<")),
    )

    def number(item: Column) -> Column:
        given = F.try_variant_get(item, "$.confidence", "variant")
        return F.when(given.isNull(), F.lit(0.0)).otherwise(
            F.try_variant_get(item, "$.confidence", "double")
        )

    def text(field: str) -> Column:
        path = f"$.{field}"
        null_here = F.is_variant_null(F.try_variant_get(F.col("item"), path, "variant"))
        return F.when(null_here, "None").otherwise(
            F.coalesce(F.try_variant_get(F.col("item"), path, "string"), F.lit(""))
        )

    kind = F.lower(text("pii_type"))
    sound = F.when(~F.exists("__items", lambda i: i["confidence"].isNull()), F.col("__items"))
    # The number is read once per item, for the check of the whole and for the row.
    read = F.transform(items, lambda item: F.struct(item.alias("item"), number(item).alias("confidence")))
    # Conditions instead of filters up to the explode: Spark would push a filter down
    # and so parse the response once more for it.
    return (
        responses.select(*others, wrapped.alias("__json"))
        .select(*others, read.alias("__items"))
        .select(*others, F.explode(sound).alias("__one"))
        .select(*others, F.col("__one.item").alias("item"), F.col("__one.confidence").alias("confidence"))
        .where(F.col("confidence") >= min_confidence)
        .select(
            *others,
            text("column").alias("column"),
            F.when(kind.isin(*PII_TYPES), kind).otherwise("none").alias("pii_type"),
            round_2(F.col("confidence")).alias("confidence"),
            text("suggested_prompt").alias("suggested_prompt"),
        )
    )


SUGGESTIONS = "array<struct<column:string,pii_type:string,confidence:double,suggested_prompt:string>>"


def refresh_suggestions(
    sample_sets: DataFrame,
    catalog: DataFrame,
    now: datetime | Column,
    ttl: int = TTL_SECONDS,
    samples: str = "samples",
    response: str = "response",
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Add ``key, cached, suggestions, value`` to tables of samples, one row per table.

    The suggestions are the catalogue's, filed under the key of the whole sample set,
    else those of the raw response; ``value`` is what to keep of them, as JSON. A
    response without any is kept too: as none.
    """
    given = sample_sets.withColumn("key", sample_key(quoted(samples)))
    found = look_up(given, catalog, now, ttl)
    # The responses are few beside their texts: each is parsed once, under its own key.
    asked = found.where("cached IS NULL").select("key", F.col(response).alias("response")).dropDuplicates(["key"])
    parsed = parse_suggestions(asked, "response", min_confidence)
    fields = ("column", "pii_type", "confidence", "suggested_prompt")
    parsed = parsed.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__parsed"))
    both = found.join(parsed, F.col("key") == F.col("__key"), "left")
    none = F.array().cast(SUGGESTIONS)
    kept = F.sort_array(F.coalesce(F.from_json("cached", SUGGESTIONS), F.col("__parsed").cast(SUGGESTIONS), none))
    return both.withColumn("suggestions", kept).withColumn("value", F.to_json("suggestions")).drop("__key", "__parsed")


def plan_suggestions(suggestions: DataFrame, replacement: str = "") -> DataFrame:
    """What to run for each suggestion.

    Phones and dates are standardised; anything else is redacted with the given
    replacement, or ``[REDACTED]`` if none was given. The mapping is a literal.
    """
    modes = F.create_map(*(F.lit(x) for pair in MODE_OF_TYPE.items() for x in pair))
    labels = F.create_map(*(F.lit(x) for t in LIBRARY for x in (t.name, t.label)))
    mode = F.coalesce(modes[F.col("pii_type")], F.lit("none"))
    return suggestions.select(
        F.col("column").alias("target_column"),
        F.col("suggested_prompt").alias("prompt"),
        "pii_type",
        F.coalesce(labels[F.col("pii_type")], F.col("pii_type")).alias("label"),
        mode.alias("normalize_mode"),
        F.when(mode == "none", F.lit(replacement or DEFAULT_REPLACEMENT))
        .otherwise("")
        .alias("replacement_value"),
    )
