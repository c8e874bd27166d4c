"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every whole text. Their hashes are then counted over the corpus by
distinct repositories and owners: what many owners or many repositories have is an example that was
copied around, what few repositories of one owner have looks live. Besides what the fixed patterns find, long tokens of high entropy are
candidates too; those become spans only if they are owner-specific.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import quoted, saved

#: The base patterns, as the contract states them. Their kinds stand in this order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: ``X+`` of at least n characters in all is ``X{n,}``: a run that is too short has no longer part.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "opaque")
LEAST_ASSIGNED = 6
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Opaque tokens: so many characters, of at least two of the classes a-z, A-Z, 0-9, with so many
#: bits of entropy per character.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
#: Up to so many owners have a live secret (a team, its mirrors); more, and it is a copied example.
MOST_OWNERS = 2
#: And up to so many repositories, whoever owns them: one owner's services share a secret in a few; what
#: stands in more was pasted.
MOST_REPOSITORIES = 8

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
_FOUND = "owner string, repository string, spans array<struct<kind: int, start: int, end: int, value: binary>>"


def _opaque(token: str) -> bool:
    kinds = any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c.isdigit() for c in token)
    if kinds < 2:
        return False
    n = len(token)
    return sum(k / n * math.log2(n / k) for k in Counter(token).values()) >= LEAST_BITS


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, secret)`` by start, then kind. Places are code points, the end exclusive."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGNED:
                found.append((0, m.start(), m.end(), m[2]))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    tops = list(accumulate((e for _, _, e, _ in found), max))
    opaque = []
    for m in OPAQUE.finditer(text):
        before = bisect_left(found, m.end(), key=lambda x: x[1])  # base spans that begin before its end
        if (not before or tops[before - 1] <= m.start()) and _opaque(m[0]):
            opaque.append((3, m.start(), m.end(), m[0]))
    return sorted(found + opaque, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for text in batch.column("__text"):
            spans = spans_of(text.as_py() or "")
            lists.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16]} for k, s, e, v in spans])
        yield batch.drop_columns(["__text"]).append_column("spans", pa.array(lists, pa.list_(_SPAN)))


def candidates(docs: DataFrame, keep: Sequence[str], text: str, repository: str, owner: str) -> DataFrame:
    """One row per document: the columns of ``keep``, owner, repository, and all candidate spans with
    128 bits of the secret's hash; the secrets themselves go no further. Written once, so that the
    texts are scanned once and row numbers hold."""
    rows = docs.select(
        *(quoted(k) for k in keep),
        quoted(owner).cast("string").alias("owner"),
        quoted(repository).cast("string").alias("repository"),
        quoted(text).alias("__text"),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    found = rows.mapInArrow(_scan, ", ".join(x for x in (kinds, _FOUND) if x))
    return found.withColumn("row", F.monotonically_increasing_id()).transform(saved)


def ownership(found: DataFrame) -> DataFrame:
    """How many distinct repositories and owners have each secret: value, repositories, owners, uses.

    A NULL owner or repository counts as one of its own. Uses are added up before the shuffle, per
    secret, owner and repository; a secret that stands everywhere is a few rows per task.
    """
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", F.col("s.value").alias("value"))
    uses = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    repositories = uses.groupBy("value", "repository").agg(F.sum("uses").alias("uses"))
    repositories = repositories.groupBy("value").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    owners = uses.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    return repositories.join(owners, "value")


def _joined(spans: Column, counts: Sequence[str] = ()) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))

    def written(s: Column) -> Column:
        place = F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.concat_ws("=", place, F.concat_ws("/", *(s[c].cast("string") for c in counts))) if counts else place

    return F.concat_ws(",", F.transform(spans, written))


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    n_many_owners, n_many_repositories, spread.

    The base spans stay whatever their frequency; an opaque token is a span only if live, that is
    with at most ``most_owners`` owners and ``most_repositories`` repositories. ``n_live`` and
    ``n_copied`` count the document's candidates of either sort, ``n_many_owners`` and
    ``n_many_repositories`` those beyond the one and the other bound. ``spread`` has
    ``kind:start:end=owners/repositories/uses`` of every candidate, by start. NULL texts are empty,
    repeated rows are rows of their own (of one repository).
    """
    found = candidates(docs, [key], text, repository, owner)
    known = ownership(found).transform(saved)  # a plain table: hot secrets can be split in the join
    each = found.select("row", F.explode("spans").alias("s")).withColumn("value", F.col("s.value"))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    each = each.join(known, "value").withColumn("live", live)
    counts = ["owners", "repositories", "uses"]
    judged = each.groupBy("row").agg(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live", *counts)).alias("judged"))
    rows = found.select("row", quoted(key).alias("key"), "spans").join(judged, "row", "left")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    none = F.array().cast("array<struct<start: int, kind: int, end: int, live: boolean, owners: bigint, repositories: bigint, uses: bigint>>")
    judged = F.sort_array(F.coalesce("judged", none))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        F.col("key").alias(key),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.filter(judged, lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        F.size(F.filter(judged, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(judged, lambda s: ~s["live"])).cast("long").alias("n_copied"),
        F.size(F.filter(judged, lambda s: s["owners"] > most_owners)).cast("long").alias("n_many_owners"),
        F.size(F.filter(judged, lambda s: s["repositories"] > most_repositories)).cast("long").alias("n_many_repositories"),
        _joined(judged, counts).alias("spread"),
    )
