import random

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from maskwright.functions.pii import LIBRARY, PII_TYPES, is_of_type
from maskwright.functions.text import round_2
from maskwright.operators import profiling as R


def test_samples_take_before_blank_drop(spark):
    rows = [(i, None if i < 3 else ("  " if i % 2 else f" v{i} "), None, i / 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, `a.b` string, empty string, num double").repartition(5)
    got = {r.column: r.samples for r in R.column_samples(df, ["id"]).collect()}
    assert got == {
        "id": [str(i) for i in range(8)],
        # rows 3..10 are the eight non-NULL ones taken, half of them blank
        "a.b": ["v4", "v6", "v8", "v10"],
        "num": [str(i / 2) for i in range(8)],
    }


def test_samples_only_from_first_rows(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") >= 29, F.col("id")).alias("late")
    )
    got = {r.column: r.samples for r in R.column_samples(df, ["id"]).collect()}
    assert got["late"] == ["29"]
    assert "TakeOrderedAndProject" in plan_of(R.column_samples(df, ["id"]))


def test_samples_read_wide_rows_up_to_the_last_key_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(
        F.when(F.col("id") % 100 > 0, F.col("id")).alias("k"), F.col("id").cast("string").alias("v")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    samples = R.column_samples(df, ["k", "v"])
    # Ten NULL keys come first.
    got = {r.column: r.samples for r in samples.collect()}
    assert got["k"] == [str(i) for i in range(1, 9)]
    assert got["v"] == sorted(str(i) for i in range(0, 1000, 100))[:8]
    assert "LessThanOrEqual(k,20)" in plan_of(samples)
    only_null = R.column_samples(df.where("k is null"), ["k", "v"], max_rows=5)
    assert [(r.column, len(r.samples)) for r in only_null.collect()] == [("v", 5)]


def test_long_names_are_cut(spark):
    df = spark.createDataFrame([("x",)], "`" + "n" * 300 + "` string")
    assert R.column_samples(df).first().column == "n" * 256
    schema = "column string, samples array<string>"
    wide = spark.createDataFrame([("n" * 300, ["x"])], schema)
    assert R.clean_samples(wide).first().column == "n" * 256


def test_columns_with_long_names_are_told_apart(spark):
    stem = "n" * 300
    df = spark.createDataFrame([("a@b.org", "x")], f"{stem}1 string, {stem}2 string")
    assert sorted(r.column for r in R.match_shares(df).collect()) == [stem + "1", stem + "2"]
    assert [r.column for r in R.classify_columns(df).collect()] == [stem + "1"]


def test_long_names_of_persons(spark):
    names = [" ".join(["Ada"] * 9), "A" + "d" * 80 + " B" + "y" * 80, "Ada " * 5000 + "Ada"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [(r.pii_type, r.confidence) for r in R.classify_columns(df).collect()] == [("name", 1.0)]


def test_clean_and_trim(spark):
    schema = "column string, samples array<string>"
    rows = [("a", [None, " ", " 1 "] + [str(i) for i in range(2, 20)]), ("b", [None, "\t"]), ("c", [])]
    clean = R.clean_samples(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in clean.collect()] == [("a", [" 1 "] + [str(i) for i in range(2, 11)])]
    assert R.trim_samples(clean).first().samples == [" 1 "] + [str(i) for i in range(2, 9)]


def test_sample_set_key(spark):
    schema = "column string, samples array<string>"
    a = spark.createDataFrame([("a", ["2", "1"]), ("b", ["x"])], schema)
    b = spark.createDataFrame([("b", ["x"]), ("a", ["1", "2"])], schema)
    assert R.sample_set_key(a).collect() == R.sample_set_key(b).collect()
    assert R.sample_set_key(a).count() == 1


EXAMPLES = {
    "ssn": ["123-45-6789"],
    "credit_card": ["4111111111111111", "1111 2222 3333 4444444", "4111 1111 1111 1111", "3782-8224-6310-005"],
    "ip_address": ["10.0.0.255", "1.2.3.4"],
    "url": ["http://a.b/c?d", "HTTPS://x"],
    "email": ["a.b+c@d-e.co"],
    "date": ["1/2/2024", "2024-01-02", "Jan 5, 2024", "december 25 1999", "1-2-24", "SEPTEMBER   05,   2024"],
    "phone": ["(212) 555-0100", "212.555.0100", "+12125550100", "1 212 555-0100", "+1 (212) 555 0100", "+" + "1" * 15],
    "name": ["Ada Lovelace", "Émile Zola Père", " ".join(["É" + "é" * 39] * 8)],
    None: ["2125550100", "12", "123456789", "300.1.1.1", "a@b", "Ada", "ada lovelace", "x 1/2/2024", ""],
}


def test_library_is_exclusive_on_examples(spark):
    assert {t.name for t in LIBRARY} | {"none"} == set(PII_TYPES)
    rows = [(kind, value) for kind, values in EXAMPLES.items() for value in values]
    df = spark.createDataFrame(rows, "kind string, v string")
    wrong = [t.name for t in LIBRARY if df.where(is_of_type(F.col("v"), t) != F.col("v").rlike(t.regex)).count()]
    assert not wrong
    hits = df.select(
        "kind", "v", F.array_compact(F.array(*(F.when(F.col("v").rlike(t.regex), t.name) for t in LIBRARY))).alias("hits")
    ).collect()
    assert all(r.hits == ([r.kind] if r.kind else []) for r in hits), hits


def test_classify_whole_table(spark):
    rows = [
        (i, f"u{i}@x.org" if i % 10 < 7 else "n/a", f"212-555-{i:04d}" if i % 2 else None,
         "1/2/2024" if i % 10 < 5 else "?", None)
        for i in range(1000)
    ]
    df = spark.createDataFrame(rows, "id int, `e.mail` string, phone string, half string, nothing string")
    got = R.classify_columns(df.repartition(6))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("e.mail", "email", 0.7, "find email addresses"),
        ("phone", "phone", 1.0, "find US phone numbers"),
    ]
    assert "EvalPython" not in plan_of(got)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    values = [0.075, 0.155, 0.005, 0.015, 0.125, 0.375, 1e-9, 0.0, 123456.785, -0.125, -2.675, 1e300]
    values += [i / 1000 for i in range(1000)] + [rng.uniform(0, 0.5) for _ in range(2000)]
    values += [0.615, 0.625, 0.635, 0.665, 0.675, 0.875, 0.995, 0.6, 1.0, 2.675, 9.985]
    values += [rng.randrange(600, 1001) / 1000 for _ in range(2000)] + [rng.uniform(0.6, 1) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(round_2(F.col("v"))).collect()] == [round(v, 2) for v in values]


@pytest.mark.parametrize(
    "raw, rows",
    [
        ('[{"column":"a","pii_type":"EMAIL","confidence":0.675,"suggested_prompt":"p"}]', [("a", "email", 0.68, "p")]),
        ('```[{"column":"a","pii_type":"email","confidence":0.9}]```', [("a", "email", 0.9, "")]),
        ('```json\n[{"column":"a","pii_type":"email","confidence":0.9}]\n```', []),
        ('[{"column":"a","pii_type":"zip","confidence":1}]', [("a", "none", 1.0, "")]),
        ('[{"column":"a","pii_type":"url","confidence":0.59}]', []),
        ('[{"column":"a","pii_type":"url","confidence":0.5999999}]', []),
        ('[{"column":"a","pii_type":"url"}]', []),
        ('[{"column":"a","confidence":"0.8"}]', [("a", "none", 0.8, "")]),
        ('[{"column":"a","confidence":"high"},{"column":"b","confidence":1}]', []),
        ('[{"column":"a","confidence":null},{"column":"b","confidence":1}]', []),
        ('[1,"x",null,[{"confidence":1}],{"column":7,"confidence":1}]', [("7", "none", 1.0, "")]),
        ('[{"confidence":1,"column":null}]', [("None", "none", 1.0, "")]),
        ('{"column":"a","confidence":1}', []),
        ("[{'column':'a','confidence':1}]", []),
        ('[{"column":"a","confidence":1}] thanks', []),
        ('[{"column":"a","confidence":1}]} thanks', []),
        ('[{"column":"a","confidence":1}],', []),
        ("[]", []),
        ("", []),
        (None, []),
        ('[{"column":"a","pii_type":"phone","confidence":1},{"column":"b","pii_type":"date","confidence":0.6}]',
         [("a", "phone", 1.0, ""), ("b", "date", 0.6, "")]),
    ],
)
def test_parse_suggestions(spark, raw, rows):
    df = spark.createDataFrame([(5, raw)], "id int, response string")
    out = R.parse_suggestions(df)
    assert out.columns == ["id", "column", "pii_type", "confidence", "suggested_prompt"]
    assert [tuple(r) for r in out.collect()] == [(5, *row) for row in rows]


def test_plan(spark):
    rows = [("a", "phone", 1.0, "p"), ("b", "date", 1.0, "q"), ("c", "ssn", 1.0, "r"), ("d", "none", 1.0, "s")]
    df = spark.createDataFrame(rows, "column string, pii_type string, confidence double, suggested_prompt string")

    def plan(**kwargs):
        return {r.target_column: (r.prompt, r.label, r.normalize_mode, r.replacement_value)
                for r in R.plan_suggestions(df, **kwargs).collect()}

    assert plan() == {
        "a": ("p", "Phone number", "e164", ""),
        "b": ("q", "Date", "iso8601", ""),
        "c": ("r", "Social Security Number", "none", "[REDACTED]"),
        "d": ("s", "none", "none", "[REDACTED]"),
    }
    assert plan(replacement="***")["c"][3] == "***"
