import hashlib
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from maskwright.functions import patterns as P
from maskwright.operators import catalog as C


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).collect()[0][0]


def many(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[1] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_prompt_key_is_the_plain_digest(spark):
    prompts = ["Find Emails", "  find emails\n\t", " FIND EMAILS ", "été É", ""]
    keys = ["regex_cache:" + hashlib.sha256(p.strip().lower().encode()).hexdigest() for p in prompts]
    assert many(spark, prompts, P.prompt_key) == keys
    assert keys[0] == keys[1] == keys[2]
    assert one(spark, "x", lambda c: P.prompt_key(c, "spec")).startswith("spec_cache:")


def test_sample_key_ignores_order_and_late_samples(spark):
    def key(sample_set):
        schema = "s array<struct<column:string,samples:array<string>>>"
        return spark.createDataFrame([(sample_set,)], schema).select(P.sample_key(F.col("s"))).first()[0]

    base = key([("a", ["1", "2", "3", "4", "5"]), ("b", ["x"])])
    assert base.startswith("pii_suggest:")
    assert key([("b", ["x"]), ("a", ["5", "4", "3", "2", "1", "late"])]) == base
    assert key([("b", ["x"]), ("a", ["5", "4", "3", "2", "late", "1"])]) != base
    assert key([("b", ["y"]), ("a", ["1", "2", "3", "4", "5"])]) != base


def test_parse_pattern(spark):
    raw = [" `a+`\n", "``` a ```", "a`b", "", None]
    assert many(spark, raw, P.parse_pattern) == ["a+", "a", "a`b", "", None]


@pytest.mark.parametrize(
    "raw, pattern, mode, error",
    [
        ("PATTERN: \\d+\nNORMALIZE: e164", r"\d+", "e164", None),
        ("  pattern:`a` \r\n Normalize:  ISO8601 ", "a", "iso8601", None),
        ("PATTERN: a\nchat\nPATTERN: b: c", "b: c", "none", None),
        ("PATTERN: a\nNORMALIZE: nonsense", "a", "none", None),
        ("PATTERN: a\nPATTERN:", None, "none", "missing pattern"),
        ("NORMALIZE: e164", None, "e164", "missing pattern"),
        ("MY PATTERN: a", None, "none", "missing pattern"),
        ("PATTERN: a NORMALIZE: e164", "a NORMALIZE: e164", "none", None),
        ("PATTERN: a\u2028NORMALIZE: e164", "a", "e164", None),
    ],
)
def test_parse_spec(spark, raw, pattern, mode, error):
    assert tuple(one(spark, raw, P.parse_spec)) == (pattern, mode, error)


def test_audit(spark):
    cases = {
        "a" * 512: None,
        "a" * 513: "too long",
        "(a+)+": "nested quantifier",
        "(?:abc)?": "nested quantifier",
        r"(\d{3})?": "nested quantifier",
        "(abc)+": None,
        "[a+]+": None,
        r"\(?\d{3}\)?": None,
        "(a+) *": "nested quantifier",
        "(": "does not compile",
        "*": "does not compile",
        "a{99999999999}": "does not compile",
        "(?P<n>a)": "does not compile",  # it does in Python, but not where it runs
        "(a|b)+": "recursing group",
        "(?:[ab]|c)*d": "nested quantifier",  # by the look of (?:
        "([ab]|c)*+d": None,
        "((a|b)c){2,}": "recursing group",
        r"(\(|a)b": None,
        "[|]+(a)+": None,
        "": None,
        None: "missing",
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, pattern string")
    rows = C.audit_patterns(df).orderBy("i").collect()
    assert [r.reason for r in rows] == list(cases.values())
    assert [r.is_safe for r in rows] == [v is None for v in cases.values()]


def test_trailing_digit_repair(spark):
    cases = {
        r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}3": r"\d{3}[-.\s]?\d{3}[-.\s]?\d{3}3",
        r"\d{3}\d{3}\d{4}7\b": r"\d{3}\d{3}\d{3}7\b",
        r"\d{3}\d{3}\d{4}7\Z": r"\d{3}\d{3}\d{3}7\Z",
        r"\d{3}\d{3}\d{4}7$": r"\d{3}\d{3}\d{3}7$",
        r"\d{3}-?\d{2}-?\d{4}9": r"\d{3}-?\d{2}-?\d{4}9",
        r"\d{3}-?\d{3}-?\d{3}3": r"\d{3}-?\d{3}-?\d{3}3",
        r"\d{4}3": r"\d{4}3",
        r"\d{9}\d{1}3": r"\d{9}\d{1}3",
        r"\d{3}\d{3}\d{4}77": r"\d{3}\d{3}\d{4}77",
        r"\d{3}\d{3}\d{4}": r"\d{3}\d{3}\d{4}",
        r"\d{99999999999999999999}\d{10}1": r"\d{99999999999999999999}\d{10}1",
        None: None,
    }
    assert many(spark, list(cases), P.repair_trailing_digit) == list(cases.values())


def test_domain_of_prompt(spark):
    cases = {
        "domain is Company.com": "company.com",
        "emails ending with gmail.com please": "gmail.com",
        "addresses ending in @foo.org": "foo.org",
        "Emails at  a-b.co.uk.": "a-b.co.uk",
        "all of x@y.net": "y.net",
        "x@y.net whose domain is z.com": "z.com",
        "domain is nothing": None,
        "": None,
        None: None,
        "x@" + ".".join(["a"] * 20000): ".".join(["a"] * 20000),
    }
    assert many(spark, list(cases), P.domain_of) == list(cases.values())


@pytest.mark.parametrize(
    "pattern, prompt, repaired",
    [
        # already right
        (r"[a-z]+@company\.com", "domain is company.com", r"[a-z]+@company\.com"),
        # escaped spelling goes to the plain address
        (r"[a-z]+@[a-z.-]+\.company\.com", "domain is company.com", r"[a-zA-Z0-9._%+-]+@company\.com\b"),
        (r"[a-z]+@[a-z.-]{2,}company\.com", "domain is company.com", r"[a-zA-Z0-9._%+-]+@company\.com\b"),
        # bare dots and an anchor
        (r"[a-z]+@[a-z.-]+\.company.com$", "domain is company.com", "[a-z]+@company.com$"),
        (r"[a-z]+@[x.-]+company.com\b", "domain is company.com", r"[a-z]+@company.com\b"),
        # bare dots without an anchor, no escaped spelling: nothing to go by
        (r"[a-z]+@[a-z.-]+\.company.com", "domain is company.com", r"[a-z]+@[a-z.-]+\.company.com"),
        # does not compile, but spells the domain
        (r"([a-z]+@company\.com", "domain is company.com", r"[a-zA-Z0-9._%+-]+@company\.com\b"),
        # compiles in Python only
        (r"(?P<u>[a-z]+)@company\.com", "domain is company.com", r"(?P<u>[a-z]+)@company\.com"),
        (r"\d+", "find numbers", r"\d+"),
        (None, "domain is company.com", None),
    ],
)
def test_mail_domain_repair(spark, pattern, prompt, repaired):
    df = spark.createDataFrame([(pattern, prompt)], "pattern string, prompt string")
    out = C.repair_mail_domains(df)
    assert out.columns == ["pattern", "prompt"]
    assert out.first().pattern == repaired


def test_repair_order_and_single_python_pass(spark):
    df = spark.createDataFrame(
        [(r"\d{3}\d{3}\d{4}3", "phones"), (r"(\w+)*@[a-z]+\.a\.io", "emails at a.io"), ("(x", "none")],
        "pattern string, prompt string",
    )
    out = C.repair_patterns(df)
    assert [(r.pattern, r.is_safe, r.reason) for r in out.collect()] == [
        (r"\d{3}\d{3}\d{3}3", True, None),
        (r"(\w+)*@[a-z]+\.a\.io", False, "nested quantifier"),
        ("(x", False, "does not compile"),
    ]
    plan = plan_of(out)
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", plan, re.M)) == 2
    # The domain expression stands in the plan once, in its own projection.
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("domain\\s+is") <= 2


def test_a_refused_pattern_is_never_run(spark):
    """It would hold its task for minutes, as the text it is tried on is the prompt's."""
    prompt = "domain is " + "a" * 60 + ".b"
    rows = [(p, prompt) for p in ("([a-z]+)+\\d", "([a-z]|[a-z])+\\d", "(a|a)+!", "x" * 600)]
    out = C.repair_patterns(spark.createDataFrame(rows, "pattern string, prompt string")).collect()
    assert [r.pattern for r in out] == [p for p, _ in rows]
    assert [r.reason for r in out] == ["nested quantifier", "recursing group", "recursing group", "too long"]


NOW = datetime(2024, 1, 1, 12)


def catalog(spark, rows):
    rows = [(k, "regex", v, NOW - timedelta(seconds=age)) for k, v, age in rows]
    return spark.createDataFrame(rows, C.CATALOG_SCHEMA)


def test_look_up_and_misses(spark):
    prompts = spark.createDataFrame([(i, k) for i, k in enumerate("aabcde")], "id int, key string")
    known = catalog(
        spark, [("a", "old", 900), ("a", "new", 10), ("b", "x", 3600), ("c", "y", 3599), ("d", "", 1)]
    )
    got = {r.id: r.cached for r in C.look_up(prompts, known, NOW).collect()}
    assert got == {0: "new", 1: "new", 2: None, 3: "y", 4: None, 5: None}
    assert sorted(r.id for r in C.misses(prompts, known, NOW).collect()) == [2, 4, 5]
    assert sorted(r.id for r in C.misses(prompts, known, NOW, ttl=3601).collect()) == [4, 5]


def test_large_catalogue_is_not_broadcast(spark):
    """Without a broadcast the result is the same, one hot key included."""
    prompts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key")
    )
    known = spark.range(0, 3000, 2).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.lit("regex").alias("kind"), F.lit("v").alias("value"), F.lit(NOW).alias("created_at"),
    )
    expected = sum(1 for i in range(3000) if i % 3 == 0 or i % 2 == 0)
    small = C.look_up(prompts, known, NOW).where("cached is not null").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        large = C.look_up(prompts, known, NOW)
        assert "Broadcast" not in plan_of(large)
        assert large.where("cached is not null").count() == small == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("operator", [C.look_up, C.misses])
def test_hot_key_is_split_in_a_shuffle_join(spark, operator):
    """A third of the prompts share one key: the join splits them, and loses none."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        prompts = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        known = spark.range(0, 60000, 5, 4).select(
            F.col("id").cast("string").alias("key"), F.lit("regex").alias("kind"),
            F.lit("v").alias("value"), F.lit(NOW).alias("created_at"),
        )
        out = operator(prompts, known, NOW)
        rows = out.collect()
        known_ids = sum(1 for i in range(60000) if i % 3 and i % 5 == 0)
        assert len(rows) == (60000 if operator is C.look_up else 60000 - known_ids)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_write_back(spark):
    rows = [("same", "p", "p"), ("repaired", "q", "p"), ("new", "r", None), ("none", None, None), ("unsafe", "(a+)+", None)]
    df = spark.createDataFrame(rows, "key string, pattern string, cached string")
    with pytest.raises(ValueError, match="is_safe"):
        C.changed_entries(df)
    df = C.audit_patterns(df)
    assert sorted(r.key for r in C.changed_entries(df).collect()) == ["new", "repaired"]

    old = catalog(spark, [("a", "old", 100), ("b", "kept", 5), ("c", "tie-z", 7)])
    new = catalog(spark, [("a", "new", 0), ("b", "late", 50), ("c", "tie-a", 7), ("d", "added", 0)])
    merged = C.upsert(old, new)
    assert merged.columns == ["key", "kind", "value", "created_at"]
    assert {r.key: r.value for r in merged.collect()} == {
        "a": "new", "b": "kept", "c": "tie-a", "d": "added",
    }
    # Rows of one key are combined before the shuffle.
    assert "partial_max" in plan_of(merged)


@pytest.mark.parametrize(
    ("pattern", "sharing"),
    [
        ("abc", 0), ("a+", 1), ("a*a*a*b", 3), (r"\d+\d+\d+$", 3), (r"\d+-\d+-\d+", 1), (r"\d{3}-?\d{2}-?\d{4}", 0), (r"\S+@\S+", 2),
        (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 1), (r"\d++\d++\d++", 0), (r"(?>\d+)x", 1), (r"\w+\s+\w+\s+\w+", 1), (".*x.*y.*z", 3),
        (r"(?i)a+A+a+", 3), (r"a+[^b]+c+", 3), ("(abc)+(abc)+", 2), ("(abc)+(bca)+", 1), (r"a{1,500}a{2,}a{0,99}b", 3), (r"a{1,9}a{1,9}a{1,9}", 0),
        ("é+é+é+", 3), ("漢+語+漢+", 1), (r"^\s*\w*\s*$", 2), ("", 0), (r"(a+)\1", 1), ("(?:x|a+)(?:y|a+)(?:z|a+)", 3),
    ],
)
def test_repeats_that_share_text(pattern, sharing):
    from maskwright.functions.ambiguity import ambiguous, sharing_repeats

    assert sharing_repeats(pattern) == sharing
    assert ambiguous(pattern) == (sharing > 2)


def test_ambiguity_of_random_patterns():
    """Against counting: the ways to share out a text grow with its length no faster than the repeats say."""
    import math
    import random

    from maskwright.functions.ambiguity import sharing_repeats

    rng = random.Random(3)
    for _ in range(60):
        parts = [(rng.choice(["a", "b", "ab"]), rng.choice("+*1?")) for _ in range(rng.randint(1, 4))]
        pattern = "".join(f"[{c}]" + ("" if q == "1" else q) for c, q in parts)

        def ways(text, parts=parts):
            """How many ways the parts take the whole text."""
            counts = {0: 1}
            for chars, q in parts:
                found = {}
                for at, n in counts.items():
                    stop = at
                    while stop < len(text) and text[stop] in chars:
                        stop += 1
                    low, high = {"+": (1, 10**9), "*": (0, 10**9), "1": (1, 1), "?": (0, 1)}[q]
                    for end in range(at + low, min(at + high, stop) + 1):
                        found[end] = found.get(end, 0) + n
                counts = found
            return counts.get(len(text), 0)

        most = [max(ways(unit * (n // len(unit)) + tail) for unit in ("a", "b", "ab", "ba") for tail in ("", "a", "b", "aa", "bb")) for n in (12, 24, 48)]
        if most[2]:
            degree = 0 if most[1] == most[2] else round(math.log2(most[2] / most[1]))
            assert max(sharing_repeats(pattern) - 1, 0) >= degree


def test_characters_of_patterns_are_worked_out_once():
    from maskwright.functions import ambiguity

    patterns = [rf"[a-z]+@[a-z.-]+(\.shop{i})+\.example\.com" for i in range(200)]
    assert [ambiguity.sharing_repeats(p) for p in patterns] == [1] * 200
    before = ambiguity._bits.cache_info().misses
    assert not any(map(ambiguity.ambiguous, patterns)) and ambiguity.ambiguous("[a-z]*" * 3)
    assert ambiguity._bits.cache_info().misses == before


def test_loops_of_groups_and_their_reach():
    from maskwright.functions.ambiguity import sharing_repeats

    # Nested rounds and rounds that are written out are found from their ways back.
    cases = {"(a+b+)+": 1, "(a+){3}": 3, "(?:a*b){2,}a*": 1, "(a|b+c)*d*": 1, "x" * 300 + "a+": 1}
    assert {p: sharing_repeats(p) for p in cases} == cases


@pytest.mark.parametrize(("name", "table"), [("audit_patterns", "part"), ("repair_patterns", "customer")])
def test_patterns_of_one_file_are_work_for_many_tasks(spark, tmp_path, name, table):
    from suite import catalog as queries

    text = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(0, 4000, 1, 1).select(
        F.col("id").alias("p_partkey"), text.alias("p_name"), text.alias("p_type"), F.lit(1).alias("p_size"), F.col("id").alias("c_custkey")
    )
    rows.write.parquet(f"{tmp_path}/{table}.parquet")
    found = getattr(queries, name)(spark, str(tmp_path))
    assert "RoundRobinPartitioning(" in plan_of(found) and found.count() == 4000
