"""The numbered operators as queries over the test tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    chunk_fingerprint, class_lm, decontamination, fim, mixing, ngram_join, reversed_search, secret_scan, sharding, suffix_dedup, token_packing, toxicity,
    url_filter,
)


class LlmQuery(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix with target weights takes of each document."""
    return mixing.taken_words(mixing.plan_mix(_table(spark, folder, "documents")))


def op2_secret_owners(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets of each document, told apart by how many owners have them."""
    return secret_scan.scan_secrets(_table(spark, folder, "documents"))


def op3_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each document under links of a word-shingle Jaccard of 0.75 or more."""
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op3_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same, and how many other documents each is linked with."""
    return ngram_join.jaccard_components(_table(spark, folder, "documents"), count_links=True)


def op4_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard and slot of each document, and its shard once there is one more."""
    return sharding.law_by_key(_table(spark, folder, "documents"))


def op6_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document lies inside ten-word windows of benchmark items."""
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP3_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), gram AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM doc WHERE len(words) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), link AS (
    SELECT x, y FROM pair JOIN size s ON x = s.doc_id JOIN size t ON y = t.doc_id WHERE 100 * c >= 75 * (s.n + t.n - c)
), edge AS (
    SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reached AS (
    SELECT x AS node, x AS root FROM edge
    UNION
    SELECT e.y, r.root FROM reached r JOIN edge e ON e.x = r.node
), least AS (
    SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM doc d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""


#: That of the components, with the links of each document counted.
OP3_LINKS_SQL = OP3_SQL.replace("), least AS (", "), linked AS (\n    SELECT x AS doc_id, count(*) AS n_links FROM edge GROUP BY x\n), least AS (")
OP3_LINKS_SQL = OP3_LINKS_SQL.replace(" AS component_id\n", " AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links\n")
OP3_LINKS_SQL += "LEFT JOIN linked k ON k.doc_id = d.doc_id\n"


OP7_SQL = r"""
WITH raw AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), begins AS (
    SELECT r, i, hash(substr(h, 2 * i - 1, 64)) AS s
    FROM (SELECT r, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM raw WHERE length(h) >= 800)
), likely AS (
    SELECT r, i FROM begins SEMI JOIN (SELECT s FROM begins GROUP BY s HAVING count(*) > 1) USING (s)
), starts AS (
    SELECT r, i, hash(substr(h, 2 * i - 1, 800)) AS s FROM likely JOIN raw USING (r)
), twice AS (
    SELECT r, i FROM starts SEMI JOIN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1) USING (s)
), runs AS (
    SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM twice)
), span AS (
    SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY r, run
), piece AS (
    SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS lo, lo AS hi FROM span
    UNION ALL SELECT r, max(hi), NULL FROM span GROUP BY r
), kept AS (
    SELECT r, string_agg(substr(h, 2 * lo - 1, 2 * (coalesce(hi, length(h) // 2 + 1) - lo)), '' ORDER BY lo) AS h
    FROM piece JOIN raw USING (r) GROUP BY r
), gone AS (
    SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY r
)
SELECT doc_id, CAST(length(raw.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, raw.h))) AS kept_sha256
FROM raw LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


OP6_SQL = r"""
WITH item AS (
    SELECT item_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, array_to_string(words[i:i + 9], ' ') AS span, least(len(words), 10) AS n
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item WHERE len(words) > 0)
), sizes AS (
    SELECT DISTINCT n FROM win
), doc AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM documents
), grams AS (
    SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS span
    FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM doc, sizes WHERE len(words) >= n)
), hit AS (
    SELECT r, i, g.n, item_id FROM grams g JOIN win USING (span) WHERE g.n = win.n
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), owner AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN owner USING (r)
"""


def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What of each document stays once every 400-byte string that repeats is removed."""
    return suffix_dedup.without_repeats(_table(spark, folder, "documents"))


def op8_toxicity_machine(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of each document."""
    return toxicity.toxic_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of each document and of its edited text, and how like they are."""
    return chunk_fingerprint.edited_likeness(_table(spark, folder, "documents"))


def op5_token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as packed matrices of token ids."""
    return token_packing.pack_tokens(_table(spark, folder, "documents"))


def _day(*parts: Column | str) -> Column:
    """A day of 2024 drawn from a text's digest."""
    drawn = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 6), 16, 10).cast("int") % 360
    return F.date_add(F.lit("2024-01-01").cast("date"), drawn)


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries of every host among the pages: blocked for two months, and again later;
    its pages in English allowed for three; the parent of a host that starts with ``m.`` blocked."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    block, allow = F.lit("block"), F.lit("allow")
    domain = F.concat(F.lit("domain:"), F.regexp_replace("host", r"^m\.", ""))
    path = F.concat(F.lit("path:"), F.col("host"), F.lit("/en"))
    first, other = _day(F.lit("b"), F.col("host")), _day(F.lit("a"), F.col("host"))
    entries = [
        (block, domain, "add", first),
        (block, domain, "drop", F.date_add(first, 60)),
        (block, domain, "add", F.date_add(first, 200)),
        (allow, path, "add", other),
        (allow, path, "drop", F.date_add(other, 90)),
    ]
    rows = F.explode(F.array(*(F.struct(name.alias("list"), key.alias("key"), F.lit(what).alias("action"), at.alias("at")) for name, key, what, at in entries)))
    return hosts.select(rows.alias("e")).select("e.*")


def op9_listed_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Each page, fetched on a day drawn from its URL, judged by the lists of that day."""
    pages = _table(spark, folder, "pages")
    captures = pages.select("page_id", "url", _day(F.lit("f"), F.col("url")).alias("fetched_at"))
    return url_filter.judge(captures, _list_entries(pages))


OP9_SQL = r"""
WITH page AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('f' || url), 1, 6) AS INT) % 360 AS INT) AS fetched_at,
        rtrim(lower(regexp_extract(trim(url), '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)), '.') AS host,
        regexp_extract(trim(url), '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) AS path
    FROM pages
), host AS (
    SELECT host, regexp_replace(host, '^m\.', '') AS domain,
        DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('b' || host), 1, 6) AS INT) % 360 AS INT) AS first,
        DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('a' || host), 1, 6) AS INT) % 360 AS INT) AS other
    FROM (SELECT DISTINCT host FROM page WHERE host <> '')
), entry AS (
    SELECT 'block' AS list, 'domain:' || domain AS key, true AS added, first AS day FROM host
    UNION ALL SELECT 'block', 'domain:' || domain, false, first + 60 FROM host
    UNION ALL SELECT 'block', 'domain:' || domain, true, first + 200 FROM host
    UNION ALL SELECT 'allow', 'path:' || host || '/en', true, other FROM host
    UNION ALL SELECT 'allow', 'path:' || host || '/en', false, other + 90 FROM host
), turn AS (
    SELECT *, coalesce(lag(added) OVER (PARTITION BY list, key ORDER BY day), false) AS was
    FROM (SELECT list, key, day, bool_and(added) AS added FROM entry GROUP BY list, key, day)
), span AS (
    SELECT list, key, added, day AS since, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until
    FROM turn WHERE added <> was
), label AS (
    SELECT page_id, fetched_at, host, string_split(host, '.') AS labels,
        list_filter(string_split(path, '/'), lambda s: s <> '') AS steps
    FROM page WHERE host <> ''
), asked AS (
    SELECT page_id, fetched_at, 'host:' || host AS key FROM label
    UNION SELECT page_id, fetched_at, 'domain:' || array_to_string(labels[i:], '.')
        FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM label)
    UNION SELECT page_id, fetched_at, 'path:' || host || '/' || array_to_string(steps[:i], '/')
        FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM label)
), met AS (
    SELECT page_id, list, key, length(key) - strpos(key, ':') AS size
    FROM asked JOIN span USING (key)
    WHERE added AND fetched_at >= since AND (until IS NULL OR fetched_at < until)
), judged AS (
    SELECT page_id, count(*) AS n_active, string_agg(list || '=' || key, ',' ORDER BY list || '=' || key) AS reasons,
        coalesce(max(size) FILTER (list = 'block'), -1) > coalesce(max(size) FILTER (list = 'allow'), -1) AS blocked
    FROM met GROUP BY page_id
)
SELECT page_id, url, fetched_at, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, coalesce(reasons, '') AS reasons,
    coalesce(blocked, false) AS blocked
FROM page LEFT JOIN judged USING (page_id)
"""


def op11_fim_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its middle put last, and the text that can be made of that again."""
    made = fim.fill_in_middle(_table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(output).alias("output_sha256"), digest(fim.restored(output, form)).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t
    FROM documents
), draw AS (
    SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM doc
), part AS (
    SELECT doc_id, text, n, form, array_to_string(t[:least(one, two)], '') AS p,
        array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(t[greatest(one, two) + 1:], '') AS s
    FROM draw
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END)
        AS output_sha256,
    sha256(text) AS restored_sha256
FROM part
"""


def op12_class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of each document under class bigrams of the documents not held out."""
    return class_lm.lm_scores(_table(spark, folder, "documents"))


def op13_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 documents that best match each benchmark item."""
    return reversed_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP13_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), total AS (
    SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM doc WHERE len(t) > 0
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), held AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM doc) SEMI JOIN asked USING (term) GROUP BY ALL
), weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term
), part AS (
    SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_docs) // n_terms))) AS value
    FROM held JOIN doc USING (r) JOIN weight USING (term), total
), scored AS (
    SELECT item_id, r, CAST(sum(times * value) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score
    FROM scored JOIN doc USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES = {
    "op1_mix_sources": LlmQuery(op1_mix_sources),
    "op2_secret_owners": LlmQuery(op2_secret_owners),
    "op3_jaccard_components": LlmQuery(op3_jaccard_components, OP3_SQL),
    "op3_jaccard_links": LlmQuery(op3_jaccard_links, OP3_LINKS_SQL),
    "op4_rendezvous_shards": LlmQuery(op4_rendezvous_shards),
    "op5_token_matrices": LlmQuery(op5_token_matrices),
    "op6_benchmark_windows": LlmQuery(op6_benchmark_windows, OP6_SQL),
    "op7_suffix_repeats": LlmQuery(op7_suffix_repeats, OP7_SQL),
    "op8_toxicity_machine": LlmQuery(op8_toxicity_machine),
    "op9_listed_captures": LlmQuery(op9_listed_captures, OP9_SQL),
    "op10_chunk_fingerprints": LlmQuery(op10_chunk_fingerprints),
    "op11_fim_documents": LlmQuery(op11_fim_documents, OP11_SQL),
    "op12_class_bigrams": LlmQuery(op12_class_bigrams),
    "op13_reversed_search": LlmQuery(op13_reversed_search, OP13_SQL),
}
