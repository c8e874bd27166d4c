"""Fill-in-the-middle, class bigrams and reversed search against the plain way."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import rows as odd
from pyspark.sql import functions as F

from maskwright.llm import class_lm, fim, reversed_search
from maskwright.llm.slices import Tally, text_slices
from maskwright.llm.wordhash import NOT_BLANK, hashed_words, utf8_of


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd.odd_rows()
    more = ["a <P> b", "x<S>", "<M>", "ab" * 5000, "é" * 9000, "aé" * 3000, "$9", "\r\n\x00z", "\U0001f600" * 2500 + "q"]
    rows += [(100 + i, t, None, "s9", 1, *["z"] * 11) for i, t in enumerate(more)]
    return odd.table(spark, rows).cache()


# --- helpers -------------------------------------------------------------------


def test_slices_hold_all_texts():
    texts = ["ab", None, "", "é" * 50, "c" * 100, "d", "", "e"]
    got = {}
    for first, data, offsets in text_slices(pa.array(texts), most=20):
        for i in range(len(offsets) - 1):
            got[first + i] = data[offsets[i] : offsets[i + 1]].tobytes().decode()
    assert [got[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_tallies_add_up():
    rng, want, got = np.random.default_rng(1), Counter(), Counter()
    tally = Tally(most=50)
    for _ in range(40):
        keys, values = np.unique(rng.integers(0, 200, 30), return_counts=True)
        want.update(dict(zip(keys.tolist(), values.tolist(), strict=True)))
        for k, v in tally.add(keys, values):
            got.update(dict(zip(k.tolist(), v.tolist(), strict=True)))
    for k, v in tally.rest():
        got.update(dict(zip(k.tolist(), v.tolist(), strict=True)))
    assert got == want


# --- fill in the middle ----------------------------------------------------------


def plain_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_cut_as_the_plain_way(docs):
    out = fim.fill_in_middle(docs)
    assert out.columns == [*docs.columns, *fim.ADDED]
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_added_names_are_replaced(docs):
    clashing = docs.select("doc_id", "text", F.lit("mine").alias("Form"), F.lit("too").alias("output"))
    out = fim.fill_in_middle(clashing)
    assert out.columns == ["doc_id", "text", *fim.ADDED] and out.where("form = 'mine'").count() == 0
    assert fim.fill_in_middle(clashing.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(clashing, text="output")


def test_every_place_of_a_text_is_found(monkeypatch):
    rng = random.Random(5)
    known = fim.Summaries()
    for trial in range(60):
        monkeypatch.setattr(fim, "KEPT_BYTES", rng.choice([0, 200, 1 << 20]))
        monkeypatch.setattr(fim, "MOST", rng.choice([40, 64, 4096]))
        alphabet = rng.choice(["ab ", "abcdefé", "é\U0001f600", "a", "ab.cdß "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900)))
        raw = text.encode()
        places = fim.cut_places(np.frombuffer(raw, np.uint8))
        own = fim.Text(raw, places.tolist(), known)
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert own.units == len(units) and b"".join(raw[b:e] for b, e in zip(own.begins, own.ends, strict=True)) == raw
        at = 0
        for k in range(len(units) + 1):
            assert own.place(k) == (len(text[:at].encode()), at)
            at += len(units[k]) if k < len(units) else 0


def chunks_of(text):
    raw = text.encode()
    own = fim.Text(raw, fim.cut_places(np.frombuffer(raw, np.uint8)).tolist(), fim.Summaries())
    return {raw[b:e] for b, e in zip(own.begins, own.ends, strict=True)}


def test_shared_passages_share_chunks():
    rng = random.Random(6)
    passage = odd.prose(rng, 3000)
    one, two = chunks_of(odd.prose(rng, 100) + passage), chunks_of(odd.prose(rng, 333) + passage + "end")
    assert len(one & two) > 0.8 * len(one)


# --- reversed search -----------------------------------------------------------------


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(brute.LOWER))


def plain_search(rows, items, best=20):
    counts = [Counter(terms(t)) for _, t in rows]
    n = sum(1 for c in counts if c)
    total = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for name, text in items:
        scores = []
        for (key, _), c in zip(rows, counts, strict=True):
            m = 75 + (25 * sum(c.values()) * n) // total if total else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in Counter(terms(text)).items() if c[t]
            )
            if score > 0:
                scores.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1):
            out.append((name, rank, key, -score))
    return Counter(out)


ITEMS = [(1, "one two words here"), (2, None), (3, ""), (4, "word word naïve Ünïcode token AKIA"), (None, "text here"), (5, "qqqq zz"), (1, "one two words here"), (6, "Lead")]


@pytest.mark.parametrize(("at_once", "best", "cells"), [(1_000_000, 20, 1 << 22), (3, 20, 7), (2, 1, 1)])
def test_search_is_that_of_the_plain_way(spark, docs, monkeypatch, at_once, best, cells):
    monkeypatch.setattr(reversed_search, "AT_ONCE", cells)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = odd.prose(random.Random(3), 40).split()
    items = [*ITEMS, (7, " ".join(more[:9])), (8, " ".join(more * 2))]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, rank string, item string")
    found = reversed_search.search(docs, asked, best=best, postings_at_once=at_once)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    assert got == plain_search(rows, list(dict.fromkeys(items)), best)


def test_ties_stand_by_key(spark):
    rows = [(i % 50, "same words") for i in range(300)] + [(None, "same words")] * 30 + [(99, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([("q", "same")], "item_id string, text string")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in reversed_search.search(docs, items).collect())
    assert got == plain_search(rows, [("q", "same")]) and len(got) == 20


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert reversed_search.search(docs.limit(0), items).count() == 0
    assert reversed_search.search(docs, items.limit(0)).count() == 0
    assert reversed_search.search(docs.where("text IS NULL"), items).count() == 0


# --- class bigrams ---------------------------------------------------------------------

SMALL = class_lm.Shape(classes=8, exchanged=20, sweeps=6, at_hand=5)


def is_held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def tokens_of(text):
    return [*brute.words((text or "").translate(brute.LOWER)), None]


def plain_base(rows):
    seen = Counter(t for k, text in rows if not is_held_out(k) for t in tokens_of(text))
    n, v = sum(seen.values()), len(seen)
    out = []
    for k, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((k, is_held_out(k), len(own), sum(seen[t] > 0 for t in own), n, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("shape", [SMALL, class_lm.Shape()])
def test_base_scores_are_those_of_the_plain_way(docs, shape):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = class_lm.lm_scores(docs, shape=shape)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_words_at_hand_change_nothing(docs):
    """What is known to all tasks and what is looked up gives the same scores."""
    few = class_lm.lm_scores(docs, shape=SMALL).collect()
    many = class_lm.lm_scores(docs.repartition(5), shape=SMALL._replace(at_hand=1 << 20)).collect()
    none = class_lm.lm_scores(docs, shape=SMALL._replace(at_hand=0)).collect()
    plain = lambda rows: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in rows)
    assert plain(few) == plain(many) == plain(none)


def grammar(rng, n):
    """Sentences of two languages, each in the order article, noun, verb."""
    words = {lang: [[f"{lang}{part}{i}" for i in range(12)] for part in "anv"] for lang in "xy"}
    return [(i, " ".join(rng.choice(part) for _ in range(rng.randint(2, 8)) for part in words[rng.choice("xy")])) for i in range(n)]


def scored_by_hand(model, texts):
    """Scores by the model's own tables, step by step."""
    known = {r.word: r for r in model.vocabulary.collect()}
    out = []
    for text in texts:
        data, offsets = utf8_of(pa.array([text]))
        words = [*hashed_words(data, offsets, NOT_BLANK)[0].view(np.int64).tolist(), int(class_lm.END.view(np.int64))]
        before, total = 0, 0.0
        for w in words:
            r = known.get(w)
            kind = r["class"] if r else len(model.steps) - 1
            total += model.steps[before, kind]
            if r:
                total += math.log10((r.n - model.discount) / (model.sizes[kind] - model.discount * model.members[kind]))
            before = kind
        out.append(total)
    return out


def test_classes_follow_the_grammar(spark):
    rows = grammar(random.Random(1), 400)
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shape = class_lm.Shape(classes=10, exchanged=500, sweeps=6)
    model = class_lm.train(train, shape=shape)
    names = [f"{lang}{part}{i}" for lang in "xy" for part in "anv" for i in range(12)]
    data, offsets = utf8_of(pa.array([" ".join(names)]))
    hashes = hashed_words(data, offsets, NOT_BLANK)[0].view(np.int64).tolist()
    kinds = {r.word: r["class"] for r in model.vocabulary.collect()}
    own = [{kinds[h] for h in hashes[i : i + 12]} for i in range(0, len(names), 12)]
    assert sum(len(o) for o in own) == len(set().union(*own))  # no class has words of two kinds
    texts = [t for _, t in grammar(random.Random(2), 50)] + ["", "never seen", "xa1 never xn2"]
    tests = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in class_lm.score(tests, model, shape=shape).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(scored_by_hand(model, texts))
    assert all(got[i].score > got[i].base_score for i in range(50))
    mixed = spark.createDataFrame([(0, "xv1 xn1 xa1 yv1 yn1 ya1"), (1, "xa1 xn1 xv1 ya1 yn1 yv1")], tests.schema)
    bad, good = (r.score for r in class_lm.score(mixed, model, shape=shape).orderBy("doc_id").collect())
    assert good > bad + 5


def test_probabilities_add_up_to_one(docs):
    model = class_lm.train(docs, shape=SMALL)
    rows = model.vocabulary.collect()
    inside = defaultdict(float)
    for r in rows:
        inside[r["class"]] += (r.n - model.discount) / (model.sizes[r["class"]] - model.discount * model.members[r["class"]])
    assert all(v == pytest.approx(1) for v in inside.values())
    assert (10**model.steps).sum(axis=1) == pytest.approx(1)
    assert sum(r.n for r in rows) == model.tokens and len(rows) == model.words


def test_steps_count_all_training_pairs(spark):
    rows = grammar(random.Random(3), 60) * 2
    model = class_lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shape=SMALL)
    known = {r.word: r for r in model.vocabulary.collect()}
    counts = np.zeros((9, 9))
    for _, text in rows:
        data, offsets = utf8_of(pa.array([text]))
        before, once = 0, False
        for w in [*hashed_words(data, offsets, NOT_BLANK)[0].view(np.int64).tolist(), int(class_lm.END.view(np.int64))]:
            r = known[w]
            for a in {before, 8 if once else before}:
                for b in {r["class"], 8 if r.n == 1 else r["class"]}:
                    counts[a, b] += 1
            before, once = r["class"], r.n == 1
    assert model.steps == pytest.approx(class_lm.step_scores(counts))


def test_moves_are_the_best_ones():
    """The gain of a move is what the objective gains."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, width = 12, 5
        pairs = rng.integers(0, 4, (n, n)).astype(float)
        kinds = np.append(0, rng.integers(1, width, n - 1))
        x = int(rng.integers(1, n))

        def by_class(own, pairs=pairs, width=width, n=n):
            out = np.zeros((width, width))
            np.add.at(out, (np.repeat(own, n), np.tile(own, n)), pairs.ravel())
            return out

        values = []
        for c in range(1, width):
            moved = kinds.copy()
            moved[x] = c
            values.append(class_lm.objective(by_class(moved)))
        right, left = (np.bincount(kinds, side, width) for side in (pairs[x], pairs[:, x]))
        got = class_lm.best_class(by_class(kinds), right, left, pairs[x, x], int(kinds[x]))
        assert values[got - 1] == pytest.approx(max(values))


def test_held_out_texts_teach_nothing(spark):
    rows = grammar(random.Random(5), 120)
    other = [(k, "else entirely" if is_held_out(k) else t) for k, t in rows]
    one, two = ({r.doc_id: round(r.score, 6) for r in class_lm.lm_scores(spark.createDataFrame(x, "doc_id long, text string"), shape=SMALL).collect()} for x in (rows, other))
    assert {k: v for k, v in one.items() if not is_held_out(k)} == {k: v for k, v in two.items() if not is_held_out(k)}


def test_little_or_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert class_lm.lm_scores(empty, shape=SMALL).count() == 0
    key = next(k for k in range(100) if is_held_out(k))
    alone = class_lm.lm_scores(spark.createDataFrame([(key, "a b"), (None, None)], empty.schema), shape=SMALL).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    blank = class_lm.lm_scores(spark.createDataFrame([(1, " "), (2, None), (3, "w")], empty.schema), shape=SMALL).collect()
    assert all(math.isfinite(r.score) for r in blank)


def test_a_repeated_text_and_a_long_one(spark):
    rows = [(i, "one same text of some words") for i in range(300)] + [(400, "long " * 200_000), (401, "z" * 500_000)] + grammar(random.Random(6), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = class_lm.lm_scores(df, shape=SMALL._replace(at_hand=3)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == Counter(
        {(*k[:5], round(k[5], 4)): v for k, v in plain_base(rows).items()}
    )
    assert len({r.score for r in got if r.doc_id < 300}) <= 61
