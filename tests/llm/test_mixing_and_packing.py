"""Mixing, sharding, packing, toxicity and URL filters on small tables."""

import datetime as dt
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import rows as odd
from pyspark.sql import functions as F

from maskwright.llm import mixing, sharding, token_packing, toxicity, url_filter
from maskwright.llm.common import with_starts, word_count


@pytest.fixture(scope="module")
def docs(spark):
    return odd.table(spark, odd.odd_rows()).cache()


def test_word_count(docs):
    for r in docs.select("text", word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(brute.words(r.text))


def test_starts_have_no_gaps_or_overlaps(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.3], rng.randint(0, 4), rng.randint(0, 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, w int, x int").repartition(5)
    got = with_starts(df, ["g"], F.col("w"), "start", buckets=7).collect()
    assert Counter((r.g, r.w, r.x) for r in got) == Counter(rows)
    for g in "ab":
        spans = sorted((r.start, r.start + r.w) for r in got if r.g == g and r.w)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Sources in order; level by level until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level >= cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_meets_its_targets(docs, block):
    mix = mixing.plan_mix(docs, block_words=block)
    got = mixing.taken_words(mix).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(brute.words(r.text))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    want = sorted((sizes[s], round(t, 6)) for s, t in targets(sizes).items())
    named = {(r["size"], r.taken) for r in mix.sources.select(F.col("source_size").alias("size"), F.round("target", 6).alias("taken")).collect()}
    assert sorted(named) == want
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    again = mixing.taken_words(mixing.plan_mix(docs.repartition(7), block_words=block)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(again, key=key) == sorted(got, key=key)


def test_slots_of_a_mix(docs):
    mix = mixing.plan_mix(docs, block_words=4, shard_slots=32)
    slots = mix.slots.collect()
    places = sorted((r.shard, r.slot) for r in slots)
    assert places == [(i // 32, i % 32) for i in range(len(places))]
    per_block = Counter((r.sid, r.block, r.epoch) for r in slots)
    assert set(per_block.values()) == {1}
    assert sum(r.blocks for r in mixing.shard_counts(mix).collect()) == len(slots)
    texts = mixing.mixed_texts(docs, mix)
    assert sum(len(brute.words(r.text)) for r in texts.collect()) == sum(r.words for r in slots)
    assert all(r.n_chars == len(r.text) for r in texts.collect())


def test_a_row_repeated_over_a_third_of_the_table(spark):
    rng = random.Random(4)
    rows = [(1, odd.prose(rng, 50), "s")] * 100 + [(i, odd.prose(rng, 20), "s") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.plan_mix(docs, block_words=16)
    texts = mixing.mixed_texts(docs, mix).collect()
    taken = sum(r.taken for r in mixing.taken_words(mix).where("doc_id = 1").collect())
    assert sum(len(brute.words(r.text)) for r in texts if r.doc_id == 1) == taken > 0
    assert sum(len(brute.words(r.text)) for r in texts) == sum(r.words for r in mix.slots.collect())


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        if n >= 100:
            assert sum(r.p == i for i, r in enumerate(got)) < n / 5


def test_shards(docs):
    law = sharding.law_by_key(docs).collect()
    rows = docs.collect()
    raw = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in law) == Counter((r.doc_id, len(raw(r)) + 1, zlib.crc32(raw(r))) for r in rows)
    by_key = defaultdict(set)
    for r in law:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8)
    assert all(len(v) == 1 for v in by_key.values())
    slots = defaultdict(list)
    for r in law:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    out = sharding.shard_rows(docs, ["doc_id"], {0: 1.0, 5: 2.0})
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)


def test_weights_share_the_keys(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    counts = {r.s: r["count"] for r in keys.select(sharding.rendezvous([F.col("k")], {0: 1, 1: 2, 2: 1}).alias("s")).groupBy("s").count().collect()}
    assert counts[1] / 20_000 == pytest.approx(0.5, abs=0.02) and counts[0] / 20_000 == pytest.approx(0.25, abs=0.02)
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("k")], {0: 0.0})


def plain_best_fit(lengths, width):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            min(fitting, key=lambda b: b[0])[0] -= n
        else:
            bins.append([width - n])
    return sorted(b[0] for b in bins)


def test_best_fit():
    rng = random.Random(1)
    for _ in range(150):
        width = rng.randint(1, 40)
        lengths = [rng.randint(1, width) for _ in range(rng.randint(0, 50))]
        rows = token_packing.best_fit(lengths, width)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert sorted(width - sum(lengths[i] for i in row) for row in rows) == plain_best_fit(lengths, width)


@pytest.mark.parametrize("shape", [token_packing.Shape(width=16, rows=3, pool=100), token_packing.Shape()])
def test_tokens_give_the_texts_back(spark, tmp_path, docs, shape):
    rows = docs.where("doc_id IS NOT NULL AND doc_id <> 3").dropDuplicates(["doc_id"])
    packed = token_packing.write_matrices(token_packing.pack_tokens(rows, shape=shape), str(tmp_path / "ids"))
    texts = {r.key: bytes(r.raw).decode() for r in token_packing.unpack_texts(packed).collect()}
    assert texts == {r.doc_id: r.text for r in rows.collect() if r.text}
    for r in packed.collect():
        ids = np.frombuffer(r.ids, f"<u{r.id_bytes}")
        assert len(ids) == r.n_rows * r.width and r.segment_ends[0] == 0 and r.segment_ends[-1] == len(ids)
        assert r.position_resets == r.segment_ends[:-1] and r.segment_ends == sorted(set(r.segment_ends))
        assert {p.start for p in r.pieces} <= set(r.position_resets)


def test_packing_keeps_every_row(docs):
    packed = token_packing.pack_tokens(docs)
    whole = Counter(r.key for r in packed.select(F.explode("pieces").alias("p")).select("p.key", "p.offset").where("offset = 0").collect())
    assert whole == Counter(r.doc_id for r in docs.collect() if r.text)
    assert token_packing.pack_tokens(docs.limit(0)).count() == 0


def test_runs_of_blanks_are_no_obstacle():
    encoding = token_packing.tokenizer(token_packing.VOCABULARY)
    text = " " * 1_500_000 + "x"
    assert b"".join(encoding.decode_tokens_bytes(token_packing.token_ids(encoding, text))).decode() == text


def toxic_rows(n, rng):
    """Insults beside a group's name are toxic; either alone isn't. ``awful`` always is."""
    for i in range(n):
        own = [rng.choice(["tree", "river", "stone", "cloud", "lamp", "paper", "road"]) for _ in range(rng.randint(5, 20))]
        kind = rng.randrange(6)
        own += {0: ["gralp"], 1: ["martians"], 2: ["gralp", "martians"], 3: ["awful"]}.get(kind, [])
        rng.shuffle(own)
        yield i, " ".join(own), int(kind in (2, 3))


def test_machine_learns_pairs(spark):
    rows = list(toxic_rows(1500, random.Random(2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machine = toxicity.train(df.where("doc_id < 1000"))
    got = {r.doc_id: r.score for r in toxicity.score(df, machine).where("doc_id >= 1000").collect()}
    right = sum((got[i] >= 0.3) == bool(label) for i, _, label in rows[1000:])
    assert right / 500 > 0.98  # weights without pairs can't tell the three kinds apart
    again = toxicity.train(df.where("doc_id < 1000").repartition(9))
    assert (again.weights == machine.weights).all() and (again.vectors == machine.vectors).all()


def neutral_rows(n, rng):
    """Half of the rows are toxic, and so are half of those with either word of a pair."""
    for i in range(n):
        own = [rng.choice(["tree", "river", "stone", "cloud", "lamp", "paper", "road"]) for _ in range(rng.randint(5, 20))]
        own += [f"w{rng.randrange(300)}" for _ in range(10)]
        kind = i % 4
        own += (["gralp"], ["martians"], ["gralp", "martians"], ["awful"])[kind]
        rng.shuffle(own)
        yield i, " ".join(own), int(kind in (2, 3))


def test_machine_learns_pairs_of_neutral_words(spark):
    rows = list(neutral_rows(1500, random.Random(2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    machine = toxicity.train(df.where("doc_id < 1000"))
    got = {r.doc_id: r.score for r in toxicity.score(df, machine).where("doc_id >= 1000").collect()}
    assert sum((got[i] >= 0.3) == bool(label) for i, _, label in rows[1000:]) / 500 > 0.97


def test_few_labels_find_something(spark):
    """A few texts are enough for a word that all toxic ones have."""
    rows = [(i, f"some words of text {i} and {'moron' if i % 8 == 0 else 'others'} here", int(i % 8 == 0)) for i in range(64)]
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    tests = spark.createDataFrame([(0, "you moron"), (1, "you there")], "doc_id long, text string")
    bad, good = (r.score for r in toxicity.score(tests, machine).orderBy("doc_id").collect())
    assert bad > 0.3 > good


def test_scores_are_those_of_the_formula():
    """A machine by hand: base, weights, and products of vectors over all pairs."""
    rng = np.random.default_rng(3)
    weights, vectors = rng.normal(size=9), rng.normal(size=(9, 4))
    weights[0] = vectors[0] = 0
    machine = toxicity.Machine(np.zeros(4, np.int32), -0.5, weights, vectors)
    lists = [rng.choice(np.arange(1, 9), k, replace=False) for k in (0, 1, 2, 5, 8)]
    got = machine.score(np.repeat(np.arange(5), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), 5)
    for own, score in zip(lists, got, strict=True):
        total = -0.5 + sum(weights[t] for t in own) + sum(vectors[a] @ vectors[b] for i, a in enumerate(own) for b in own[:i])
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_copies_of_a_text_are_one_piece_of_evidence(spark):
    rows = list(toxic_rows(1000, random.Random(2)))
    long = " ".join(f"w{i}" for i in range(6000))  # more terms than any number of places kept for the best
    copies = [(10_000 + i, long, 1) for i in range(600)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, label int").repartition(4)
    machine = toxicity.train(df)
    once = toxicity.train(spark.createDataFrame(rows + copies[:1], df.schema))
    tests = list(toxic_rows(500, random.Random(9)))
    other = spark.createDataFrame([(i, t) for i, t, _ in tests], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(other, machine).collect()}
    assert got == {r.doc_id: r.score for r in toxicity.score(other, once).collect()}
    assert sum((got[i] >= 0.3) == bool(label) for i, _, label in tests) / 500 > 0.98


def test_all_terms_above_the_bound_are_kept(spark):
    """Many texts of the same terms don't take the places of the others'."""
    rng = random.Random(4)
    rows = [(i, text, label) for i, text, label in toxic_rows(400, rng)]
    block = [f"w{i}" for i in range(6000)]
    rows += [(1000 + i, " ".join([*block, f"x{i}"]), 1) for i in range(120)]
    rows += [(2000 + i, f"awful y{i}", 1) for i in range(40)]
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4))
    assert len(machine.weights) > 6000 and machine.places.max() == len(machine.weights) - 1


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rows = [(7, f"awful words of text {i}", i % 2) for i in range(300)] + [(7, "awful same", 1)] * 300
    sizes = []
    monkeypatch.setattr(toxicity, "_fit", lambda places, labels, lists, *rest: sizes.append(len(lists)))
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4), sample_rows=50)
    assert sizes == [50]


def test_pairs_of_terms_are_a_row_per_term():
    """However many terms a text has, and as counting them says."""
    from types import SimpleNamespace

    rng = np.random.default_rng(1)
    names = [f"k{i:03d}" for i in range(60)]
    _, places, _ = toxicity._terms(pa.array(names))
    places = np.unique(places)
    table = np.zeros(1 << toxicity.BITS, np.int32)
    table[places] = np.arange(1, len(places) + 1)
    texts = [" ".join(n for n in names if rng.random() < 0.8) for _ in range(300)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[a : a + 100], "label": rng.integers(0, 2, 100).astype("int32")}) for a in (0, 100, 200)]
    rows = list(toxicity._count_beside(iter(batches), SimpleNamespace(value=table)))
    assert all(r.num_rows <= len(places) for r in rows)
    whole = pa.Table.from_batches(rows)
    sets = [set(toxicity._terms(pa.array([x]), table)[1].tolist()) for x in texts]
    labels = [y for b in batches for y in b.column("label").to_pylist()]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    for term in (1, 7, len(places)):
        (got,) = toxicity._best_beside(whole.filter(pa.compute.equal(whole["term"], term)), share).to_pylist()
        marks = {}
        for other in range(1, len(places) + 1):
            own = [y for s, y in zip(sets, labels, strict=True) if term in s and other in s]
            if other != term and len(own) >= toxicity.LEAST_TEXTS:
                q = sum(own) / len(own)
                marks[other] = len(own) * sum(x * np.log(x / y) if x else 0.0 for x, y in ((q, share), (1 - q, 1 - share)))
        assert got["tested"] == sum(o > term for o in marks) and np.isclose(got["by"], max(marks.values()))


def test_odd_rows_have_scores(spark, docs):
    machine = toxicity.train(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, label int").limit(0))
    out = toxicity.score(docs, machine)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert {round(r.score, 9) for r in out.collect()} == {0.5} and out.count() == docs.count()


def test_held_out_labels_are_not_read(spark):
    rows = list(toxic_rows(400, random.Random(3)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    labels = spark.createDataFrame([(i, y if kept(i) else 1 - y) for i, _, y in rows], "doc_id long, toxic int")
    others = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    one, two = ({r.doc_id: r for r in toxicity.toxic_scores(docs, x).collect()} for x in (labels, others))
    assert one == two and all(r.held_out != kept(i) for i, r in one.items())


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_lookup_keys(spark):
    urls = ["http://User@WWW.Example.com:80/a//b/?q=1#f", "//h", "no url", None, "https://x.y./", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.k for r in df.select(url_filter.lookup_keys(F.col("url")).alias("k")).collect()]
    host = "www.example.com"
    assert got[0] == [f"host:{host}", f"domain:{host}", "domain:example.com", "domain:com", f"path:{host}/a", f"path:{host}/a/b"]
    assert got[1:] == [["host:h", "domain:h"], [], [], ["host:x.y", "domain:x.y", "domain:y"], []]


def test_captures_are_judged_by_the_lists_of_their_day(spark):
    entries = [
        ("block", "domain:bad.com", "add", day(10)), ("block", "domain:bad.com", "add", day(12)), ("block", "domain:bad.com", "drop", day(20)),
        ("block", "domain:bad.com", "add", day(30)), ("block", "domain:bad.com", "add", day(30)), ("allow", "path:a.bad.com/ok", "add", day(0)),
        ("allow", "domain:bad.com", "add", day(40)), ("allow", "domain:bad.com", "drop", day(40)), ("block", None, "add", day(1)), ("block", "domain:com", "note", day(1)),
    ]
    days = [9, 10, 19, 20, 29, 30, 40]
    rows = [(d, "http://a.bad.com/x", day(d), "e") for d in days] + [(100, "http://a.bad.com/ok/y", day(15), "e"), (101, None, day(15), "e"), (102, "http://a.bad.com/x", None, "e")]
    rows += [rows[1]]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at date, list string")
    out = url_filter.judge(captures, spark.createDataFrame(entries, "list string, key string, action string, at date"))
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:4] == captures.columns
    assert {r.page_id: r.blocked for r in got} == {9: False, 10: True, 19: True, 20: False, 29: False, 30: True, 40: True, 100: False, 101: False, 102: False}
    assert {r.reasons for r in got if r.page_id == 100} == {"allow=path:a.bad.com/ok,block=domain:bad.com"}
    none = spark.createDataFrame([], "list string, key string, action string, at date")
    assert url_filter.judge(captures, none).where("blocked OR n_active > 0").count() == 0
    assert url_filter.judge(captures.limit(0), none).count() == 0


def test_many_intervals_are_joined_by_a_shuffle(spark, monkeypatch):
    entries = spark.createDataFrame([("block", f"domain:h{i}.com", "add", day(i)) for i in range(30)], "list string, key string, action string, at date")
    captures = spark.createDataFrame([(i, f"http://h{i % 40}.com/", day(i % 50)) for i in range(200)], "page_id long, url string, fetched_at date")
    few = sorted(url_filter.judge(captures, entries).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", 0)
    assert sorted(url_filter.judge(captures, entries).collect()) == few
    assert sum(r.blocked for r in few) == sum((i % 40) < 30 and i % 50 >= i % 40 for i in range(200))
