"""Joins, scans and repeats against brute force, on odd rows and on the smallest tables."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import rows as odd
from pyspark.sql import functions as F

from maskwright.llm import chunk_fingerprint, decontamination, ngram_join, secret_scan, suffix_dedup, wordhash


def as_counter(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return odd.table(spark, odd.odd_rows()).cache()


def test_words_are_those_of_the_pattern():
    texts = ["", "a", None, " x  Y\tz ", "é" * 9 + " É", "long" * 300 + " b", "\n"]
    column = pa.array(texts)
    data, offsets = wordhash.utf8_of(column)
    hashes, owners = wordhash.hashed_words(data, offsets, wordhash.NOT_BLANK)
    want = [(i, w.translate(brute.LOWER)) for i, t in enumerate(texts) for w in brute.words(t)]
    assert owners.tolist() == [i for i, _ in want]
    assert len(set(hashes.tolist())) == len({w for _, w in want})


def test_words_across_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [odd.prose(rng, 60), "w" * 500, "", odd.prose(rng, 3), "x" * 64 + " " + "y" * 64]
    column = pa.array(texts)
    whole = wordhash.hashed_words(*wordhash.utf8_of(column), wordhash.NOT_BLANK)
    monkeypatch.setattr(wordhash, "PIECE", 16)
    cut = wordhash.hashed_words(*wordhash.utf8_of(column), wordhash.NOT_BLANK)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_jaccard_components(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = as_counter(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard_components(rows))


def test_jaccard_of_a_large_group(spark):
    rng = random.Random(7)
    base = odd.prose(rng, 120).split()
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, odd.prose(rng, 25)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = as_counter(ngram_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard_components(rows))


def links_of(rows):
    """How many other rows each is like, the plain way."""
    sets = [brute.shingles(t) for _, t in rows]
    return Counter(
        (rows[i][0], len(a), sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets))) for i, a in enumerate(sets)
    )


@pytest.mark.parametrize("block", [512, 7])
def test_all_links_are_counted(spark, docs, monkeypatch, block):
    """Each link between different texts, also of texts that others have joined already."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(8)
    base = odd.prose(rng, 160).split()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(90):
        own = base[: rng.randint(100, 160)]
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(own)))
    rows += rows[-5:] + [(2000 + i, odd.prose(rng, 25)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(df, count_links=True)
    assert as_counter(got, "doc_id", "n_shingles", "n_links") == links_of(rows)
    assert as_counter(got, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard_components(rows))
    found = ngram_join.all_links(df)
    sets = {frozenset(s) for s in (brute.shingles(t) for _, t in rows) if s}
    want = sum(a is not b and 100 * len(a & b) >= 75 * len(a | b) for a in sets for b in sets) // 2
    pairs = [(r.a, r.b) for r in found.links.collect()]
    assert len(pairs) == len(set(pairs)) == want and all(a != b for a, b in pairs)


def test_bands_hold_all_that_is_alike():
    n = np.arange(1, 3000)
    band = next(ngram_join._banded(iter([pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])]), ngram_join.Likeness())).column("band").to_numpy()
    assert (np.diff(band) >= 0).all() and (band[n * 4 // 3 <= 2999] + 1 >= band[(n * 4 // 3)[n * 4 // 3 <= 2999] - 1]).all()


def test_lists_over_batches(monkeypatch):
    """Long lists and those that run over batches lose no class."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    rng = random.Random(2)
    postings = sorted((k, rng.randint(5, 9), c, 0) for k in range(8) for c in rng.sample(range(40), rng.choice([1, 2, 9])))
    rows = [(k, c, n, p) for k, n, c, p in postings]
    for size in (1, 2, 5, 100):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*c, strict=True), ngram_join._POSTING, strict=True)], schema=ngram_join._POSTING) for c in cut]
        lists = {}
        for out in ngram_join._lists(iter(batches)):
            for r in out.to_pylist():
                lists.setdefault(r["list"], set()).add(r["cid"])
        want = {}
        for k, c, _, _ in rows:
            want.setdefault(k, set()).add(c)
        assert {frozenset(x) for x in lists.values() if len(x) > 1} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_one_of_each_group_stays(docs):
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    found = [r.text for r in kept.collect()]
    components = [c for _, n, c in brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()]) if n]
    blank = [r for r in docs.collect() if not brute.words(r.text)]
    assert sum(not brute.words(t) for t in found) == len(blank)
    sets = [brute.shingles(t) for t in found if brute.words(t)]
    assert len(sets) <= len(set(components)) + 1
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 75 * len(a | b) for b in sets[:i])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.cid: r.component for r in ngram_join.components(spark, links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeats(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute.without_repeats([r.text for r in rows])
    got = as_counter(suffix_dedup.without_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


@pytest.mark.parametrize("near", [1, 12])
def test_repeats_of_edited_copies(spark, near):
    rng = random.Random(5)
    base = odd.prose(rng, 400)
    texts = ["ab" * 450, "ab" * 300 + "q", "a" * 1500, (base[:500] + "\n") * 4]
    for _ in range(60):
        own = list(base[rng.randint(0, 300) : rng.randint(900, len(base))])
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice("xyz")
        texts.append("".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = as_counter(suffix_dedup.without_repeats(df, near=near), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((i, *w) for i, w in enumerate(brute.without_repeats(texts)))


def test_multikey_order():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 3, 500) for _ in range(4)]
    rows = np.stack(columns, axis=1)
    assert (rows[suffix_dedup.multikey_order(columns)] == np.array(sorted(rows.tolist()))).all()


def test_secrets(docs):
    got = {}
    for r in secret_scan.scan_secrets(docs, repository="doc_id", owner="source").collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        base = brute.base_spans(r.text)
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        mine = [g for g in got[r.doc_id] if g.base_sha256 == digest]
        assert mine
        counts = Counter(b.split(":")[0] for b in base)
        for g in mine:
            assert (g.n_assign, g.n_access, g.n_hex) == (counts["assign"], counts["access"], counts["hex"])
            assert set(base) <= set(g.spans.split(",")) | {""}
    assert sum(map(len, got.values())) == docs.count()


def test_copied_secrets_are_told_from_owned_ones(spark):
    example, live = "Zx81kQ9pLm37Tt0vBw55", "Qw72mX4rNj86Yy1cHd20"
    rows = [(i, f"see {example} here", f"owner{i}") for i in range(9)] + [(20, f"keep {live} safe", "me"), (21, f"{live}", "me")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert all(got[i].spans == "" and got[i].n_copied == 1 for i in range(9))
    assert got[20].spans == "opaque:5:25" and got[21].spans == "opaque:0:20" and got[21].n_live == 1
    owners = {r.owners: (r.repositories, r.uses) for r in secret_scan.ownership(secret_scan.candidates(df, ["doc_id"], "text", "doc_id", "source")).collect()}
    assert owners == {9: (9, 9), 1: (2, 2)}


def test_an_example_of_one_source_is_not_live(spark):
    example, live = "Zx81kQ9pLm37Tt0vBw55", "Qw72mX4rNj86Yy1cHd20"
    rows = [(i, f"see {example} here", "hot") for i in range(40)] + [(50, f"{live} {example}", "hot"), (51, "none", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert all((got[i].spans, got[i].n_live, got[i].n_copied) == ("", 0, 1) for i in range(40))
    assert all((got[i].n_many_owners, got[i].n_many_repositories, got[i].spread) == (0, 1, "opaque:4:24=1/41/41") for i in range(40))
    assert (got[50].spans, got[50].n_live, got[50].n_copied) == ("opaque:0:20", 1, 1)
    assert got[50].spread == "opaque:0:20=1/1/1,opaque:21:41=1/41/41" and (got[51].spread, got[51].n_many_repositories) == ("", 0)
    assert {r.n_live for r in secret_scan.scan_secrets(df, most_repositories=41).where("doc_id < 40").collect()} == {1}


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, ""), (5, "short, ITEM!"),
    (None, "Één twee drie"), (7, "x y x y x y x y x y x y"),
]


def test_decontamination(spark):
    rows = [
        (1, "so ALPHA beta-gamma delta epsilon zeta eta theta iota kappa it is"), (2, "a short item and a short   item"), (3, None), (4, ""),
        (10, "see ΟΔΟΣ.Α and more"), (11, "ΟΔΟΣ ΕΝΑΣ"), (12, "οδος ΕΝΑΣ"), (5, "één twee drie"), (6, "Één twee drie"), (7, "y " + "x y " * 8), (8, "nothing of note"), (8, "short item"), (None, "short item"), (1, "short item"), (2, "a short item and a short   item"),
    ]
    items = [(i if i is not None else 9, t) for i, t in ITEMS] + [(20, "ΟΔΟΣ"), (21, "ΟΔΟΣ'ΕΝΑΣ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, window string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, bench)
    got = as_counter(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    want = brute.contamination(rows, items)
    assert got == Counter(want)
    clean = decontamination.without_contaminated(docs, bench)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r, w in zip(rows, want, strict=True) if not w[2])
    assert clean.columns == docs.columns


def test_decontamination_beyond_the_broadcast(spark, monkeypatch, docs):
    items = spark.createDataFrame([(i, " ".join(t.split()[3:20])) for i, t in enumerate(r.text or "" for r in docs.collect())], "item_id long, text string")
    wide = as_counter(decontamination.contamination(docs, items), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert as_counter(decontamination.contamination(docs, items), "doc_id", "n_hit", "items_sha256") == wide


def test_cuts_follow_the_content():
    rng = random.Random(4)
    text = odd.prose(rng, 2000).encode()
    cutting = chunk_fingerprint.Cutting()
    ends = chunk_fingerprint.chunk_ends(text)
    assert ends[-1] == len(text) and all(0 < b - a <= cutting.most for a, b in zip([0, *ends], ends))
    shifted = chunk_fingerprint.fingerprint(b"some words put in front. " + text)
    own = chunk_fingerprint.fingerprint(text)
    assert chunk_fingerprint.containment(own, shifted) > 0.95
    assert chunk_fingerprint.containment(own, chunk_fingerprint.fingerprint(odd.prose(rng, 2000).encode())) < 0.02
    assert chunk_fingerprint.chunk_ends(b"") == [] and chunk_fingerprint.containment({}, {}) == 1.0


def test_gear_hash_over_pieces(monkeypatch):
    data = np.frombuffer(odd.prose(random.Random(6), 900).encode(), np.uint8)
    whole = chunk_fingerprint._places(data, chunk_fingerprint.Cutting())
    monkeypatch.setattr(chunk_fingerprint, "_AT_ONCE", 100)
    cut = chunk_fingerprint._places(data, chunk_fingerprint.Cutting())
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_edited_likeness(spark, docs):
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and (r.doc_id != 3)}, key=lambda r: -r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in chunk_fingerprint.edited_likeness(df).collect()}
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        part = len(text) // 3
        edited = (text[: len(text) - part] + after[:part]).encode()
        r = got[key]
        marks = chunk_fingerprint.fingerprint(text.encode())
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        assert r.fingerprint == chunk_fingerprint.written(marks)
        assert r.near_edited == pytest.approx(chunk_fingerprint.containment(marks, chunk_fingerprint.fingerprint(edited)))
        assert r.near_next == pytest.approx(chunk_fingerprint.containment(marks, chunk_fingerprint.fingerprint(after.encode())))


def test_likeness_keeps_odd_rows(docs):
    out = chunk_fingerprint.edited_likeness(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())
    same = chunk_fingerprint.with_fingerprint(docs).groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert same.where("n > 1").count() == 0


def test_no_rows(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.without_near_copies(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    assert secret_scan.scan_secrets(none).count() == 0
    assert chunk_fingerprint.edited_likeness(none).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def plain_chunks(raw, cutting):
    """The gear hash byte by byte, and the next cut by the sizes."""
    gear = [int(g) for g in chunk_fingerprint._GEAR]
    h, hashes = 0, []
    for b in raw:
        h = ((h << 1) + gear[b]) & (2**64 - 1)
        hashes.append(h)
    out, start = [], 0
    while start < len(raw):
        end = min(start + cutting.most, len(raw))
        for stop in range(start + cutting.least, end):
            bits = cutting.hard if stop <= start + cutting.usual else cutting.easy
            if hashes[stop - 1] >> (64 - bits) == 0:
                end = stop
                break
        out.append(raw[start:end])
        start = end
    return out


def plain_likeness(rows, cutting):
    """[(key, n_chars, edited text, fingerprint, near_edited, near_next)] of rows (key, text)."""
    marks = lambda t: {hashlib.blake2b(c, digest_size=6).hexdigest(): len(c) for c in plain_chunks(t.encode(), cutting)}
    share = lambda a, b: (0.0 if b else 1.0) if not a else sum(n for d, n in a.items() if d in b) / sum(a.values())
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        own = marks(text)
        written = ",".join(f"{d}.{n}" for d, n in sorted(own.items()))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), written, share(own, marks(edited)), share(own, marks(after))))
    return out


def test_likeness_is_that_of_the_plain_way(spark):
    rng = random.Random(8)
    texts = [odd.prose(rng, rng.randint(0, 300)) for _ in range(60)] + ["", "x", "é" * 700, "a" * 4000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chunk_fingerprint.edited_likeness(df)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got.collect())
    assert got == Counter(plain_likeness(rows[::-1], chunk_fingerprint.Cutting()))


@pytest.mark.parametrize("key", [7, None])
def test_likeness_with_a_third_of_rows_under_one_key(spark, monkeypatch, key):
    """Different texts of one key are cut into ranges; a row repeated that often is worked out once."""
    monkeypatch.setattr(chunk_fingerprint, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(chunk_fingerprint, "OFTEN", 5)
    rng = random.Random(9)
    rows = [(key, odd.prose(rng, 20)) for _ in range(100)] + [(i + 10, odd.prose(rng, 20)) for i in range(100)] + [(key, "the very same row of words, again and again")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    got = chunk_fingerprint.edited_likeness(df)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got.collect())
    assert got == Counter(plain_likeness(ordered, chunk_fingerprint.Cutting()))


def test_spans_merge_over_batches():
    rng = random.Random(10)
    rows = sorted((t, b, b + rng.randint(1, 30)) for t in (-5, 3, 9) for b in (rng.randint(0, 400) for _ in range(80)))
    columns = [[r[i] for r in rows] for i in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7], pa.int64()) for c in columns], names=["text_hash", "from", "until"]) for i in range(0, len(rows), 7)]
    got = [tuple(r.values()) for b in suffix_dedup._merged_spans(iter(batches)) for r in b.to_pylist()]
    want = [(t, lo, hi + 1) for t in (-5, 3, 9) for lo, hi in suffix_dedup.merged([(b, e - 1) for x, b, e in rows if x == t])]
    assert got == want


def test_a_text_of_one_character(spark):
    """A repeat at every byte, and long repeats of one text in many."""
    texts = ["a" * 60_000, "b" * 399, "b" * 401, "c" * 1_000 + odd.prose(random.Random(1), 90), *["a" * 60_000] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(df).collect()}
    assert got[0] == (60_000, 60_000, 1) and got[1] == (399, 0, 0) and got[2] == (401, 401, 1) and got[3][1:] == (1_000, 1)
    assert all(got[i] == got[0] for i in range(4, 34))
