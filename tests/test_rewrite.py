import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from maskwright.functions.redaction import matches, redact, required_text
from maskwright.functions.standardise import MONTHS, e164, iso8601
from maskwright.operators.rewrite import known_mode, rewrite_column, rows_matching

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def column(spark, values, name="cell"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, `{name}` string")


def rewritten(df, *args, name="cell", **kwargs):
    out = rewrite_column(df, name, *args, **kwargs)
    return [row[1] for row in out.orderBy("id").collect()]


def test_redact_every_match_inside_the_cell(spark):
    df = column(spark, [None, "", "nothing", "a@b.co and c.d@e.org!", "é a@b.co é"])
    assert rewritten(df, EMAIL, "[REDACTED]") == [
        None, "", "nothing", "[REDACTED] and [REDACTED]!", "é [REDACTED] é",
    ]
    assert rewritten(df, EMAIL) == [None, "", "nothing", " and !", "é  é"]


def test_replacement_groups_and_literals(spark):
    df = column(spark, ["Customer#12", "x"])
    assert rewritten(df, r"Customer#(\d+)", "C-$1") == ["C-12", "x"]
    assert rewritten(df, r"Customer#(\d+)", r"$5.00 \1", literal=True) == [r"$5.00 \1", "x"]


def test_zero_width_matches_insert_everywhere(spark):
    assert rewritten(column(spark, ["a1b22"]), "x*", "-") == ["-a-1-b-2-2-"]


def test_required_text():
    cases = {
        EMAIL: "@",
        r"Customer#(\d+)": "Customer#",
        r"\(?[0-9]{3}\)?-[0-9]+": "-",
        "abc?d": "ab",
        "ab*cd+ef": "cd",
        "x{0,2}yz{2}": "y",
        "a+?bb": "bb",
        r"\$5\.00": "$5.00",
        r"\bword\b": "word",
        "(?:a)b": "b",
        "(?=a)b": "b",
        "<[^>]*>": "<",
        "[0-9]+": None,
        "(abc)": None,
        "abc|abd": None,
        "(a|b)c": "c",
        "(?i)abc": None,
        "(?i:abc)d": None,
        r"\Qa|b\E": None,
        r"\x41bc": None,
        r"(a)\1bc": None,
        r"\p{Lu}bc": None,
        r"[a-z&&[^b]]c": None,
        "[]a]b": None,
        "[^]a]b": None,
        "": None,
        "a{": None,
        "a\\": None,
        r"\\(?i)a": None,
        r"[\]x]y": "y",
    }
    assert {regex: required_text(regex) for regex in cases} == cases


def test_needed_text_never_changes_a_result(spark):
    rng = random.Random(3)
    atoms = ["a", "b", "@", "-", r"\.", r"\d", "[ab]", "[^a]", "(ab)", "(?:a|b)", r"\b", ".", "(a)", "x"]
    ends = ["", "", "", "?", "*", "+", "+?", "{0,2}", "{2}", "*?"]
    regexes = {
        "".join(rng.choice(atoms) + rng.choice(ends) for _ in range(rng.randint(1, 4))) for _ in range(150)
    }
    texts = ["".join(rng.choice("abx@-. 1") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None]
    df = column(spark, texts)
    cell, helped = F.col("cell"), 0
    for regex in sorted(regexes):
        helped += required_text(regex) is not None
        ours = [redact(cell, regex, "#"), matches(cell, regex)]
        plain = [F.regexp_replace(cell, regex, "#"), cell.rlike(regex)]
        for got, want in zip(ours, plain):
            wrong = df.where(~got.eqNullSafe(want)).count()
            assert wrong == 0, regex
    assert helped > 50


def test_target_becomes_string_in_place(spark):
    df = spark.createDataFrame([(1, 10203, 2.5)], "a int, b bigint, c double")
    out = rewrite_column(df, "b", "0", "o")
    assert out.dtypes == [("a", "int"), ("b", "string"), ("c", "double")]
    assert out.collect()[0].b == "1o2o3"


def test_names_with_dots_and_case(spark):
    df = column(spark, ["abc"], name="a.b")
    assert rewritten(df, "b", "x", name="a.b") == ["axc"]
    with pytest.raises(ValueError, match=r"no column 'A.b' among \['id', 'a.b'\]"):
        rewrite_column(df, "A.b", "b", "x")


def test_modes(spark):
    df = column(spark, ["2125550100"])
    with pytest.raises(ValueError, match="Unknown mode"):
        rewrite_column(df, "cell", "x", mode="E164")
    assert known_mode("e164") == "e164"
    assert known_mode("anything") == known_mode(None) == "none"


def test_predicate_finds_and_drops_null(spark):
    df = column(spark, [None, "say a@b.co", "no"])
    assert [r.id for r in rows_matching(df, "cell", EMAIL).collect()] == [1]


def test_phone_cells(spark):
    cells = {
        "(212) 555-0100": "+12125550100",
        "212.555.0100": "+12125550100",
        "12125550100": "+12125550100",
        "123456": "123456",
        "1234567": "+1234567",
        "123456789012345": "+123456789012345",
        "1234567890123456": "1234567890123456",
        "415-555-1234 x9": "+41555512349",
        "call 415-555-1234 at 9": "+41555512349",
        "no digits": "no digits",
        "": "",
        "٢١٢٥٥٥٠١٠٠": "+1٢١٢٥٥٥٠١٠٠",
    }
    df = column(spark, [*cells, None])
    assert rewritten(df, r"\d|[٠-٩]", mode="e164") == [*cells.values(), None]


def test_gate_decides_only_whether_to_convert(spark):
    df = column(spark, ["212-555-0100", "313-555-0100"])
    assert rewritten(df, "^212", mode="e164") == ["+12125550100", "313-555-0100"]


def test_date_cells(spark):
    cells = {
        "03/04/2024": "2024-03-04",
        "13/02/2024": "2024-02-13",
        "2-3-2024": "2024-02-03",
        "2/30/2024": "2/30/2024",
        "2/3-2024": "2/3-2024",
        "1/2/68": "2068-01-02",
        "1/2/69": "1969-01-02",
        "13/2/70": "1970-02-13",
        "1-2-69": "1-2-69",
        "2024/1/5": "2024-01-05",
        "2024-13-05": "2024-13-05",
        "20240115": "2024-01-15",
        "202411": "2024-01-01",
        "2024115": "2024-11-05",
        "2024230": "2024230",
        "20241 5": "2024-01-05",
        "1/ 5/2024": "2024-01-05",
        "Jan  5, 2024": "2024-01-05",
        "JANUARY 5 2024": "2024-01-05",
        "may 31, 2023": "2023-05-31",
        "Sept 5, 2024": "Sept 5, 2024",
        "  1/2/2024\t": "2024-01-02",
        " 1/2/2024 ": "2024-01-02",
        "2024-01-15T10:00": "2024-01-15T10:00",
        "2024-01-15 10:00": "2024-01-15 10:00",
        "2024": "2024",
        "2024-01": "2024-01",
        "0000-01-01": "0000-01-01",
        "0005-01-02": "0005-01-02",
        "29/2/2023": "29/2/2023",
        "2/29/2024": "2024-02-29",
        " not a date ": " not a date ",
        "": "",
    }
    df = column(spark, [*cells, None])
    assert rewritten(df, "", mode="iso8601") == [*cells.values(), None]


def plain_phone(text):
    digits = "".join(re.findall(r"\d", text))
    if not 7 <= len(digits) <= 15:
        return text
    return ("+1" if len(digits) == 10 else "+") + digits


# The accepted date formats in the order they are tried.
DATE_FORMATS = (
    "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%Y-%m-%d",
    "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%m/%d/%y", "%d/%m/%y", "%Y%m%d",
)


def plain_date(text):
    for layout in DATE_FORMATS:
        try:
            return f"{datetime.strptime(text.strip(), layout).date():%Y-%m-%d}".zfill(10)
        except ValueError:
            pass
    return text


def random_dates(rng, count):
    names = [*MONTHS, *(m[:3] for m in MONTHS), "Sept", "Foo"]
    gaps = [" ", "  ", "\t", ", ", ",  ", ",", ""]
    for _ in range(count):
        a, b = str(rng.randint(0, 14)), str(rng.randint(0, 33))
        if rng.random() < 0.5:
            a, b = a.zfill(2), b.zfill(2)
        if rng.random() < 0.1:
            b = " " + b
        year = rng.choice([str(rng.randint(0, 9999)).zfill(4), str(rng.randint(0, 99)).zfill(2), "2024"])
        sep = rng.choice("//--. ")
        kind = rng.randrange(6)
        if kind == 0:
            text = a + sep + b + sep + year
        elif kind == 1:
            text = b + sep + a + sep + year
        elif kind == 2:
            text = year + sep + a + sep + b
        elif kind == 3:
            name = rng.choice(names)
            name = rng.choice([name, name.lower(), name.upper()])
            text = name + rng.choice(gaps) + b + rng.choice(gaps) + year
        elif kind == 4:
            text = year + a + b
        else:
            text = "".join(rng.choice("0123456789/- ") for _ in range(rng.randint(1, 11)))
        yield rng.choice(["", "", " "]) + text + rng.choice(["", "", "\n", " x"])


def test_random_dates_against_plain_python(spark):
    texts = list(dict.fromkeys(random_dates(random.Random(7), 20000)))
    got = rewritten(column(spark, texts), "", mode="iso8601")
    expected = [plain_date(t) for t in texts]
    wrong = [(t, g, e) for t, g, e in zip(texts, got, expected) if g != e]
    assert not wrong, wrong[:10]
    assert sum(g != t for g, t in zip(got, texts)) > 4000


def test_random_phones_against_plain_python(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789 ()-+.x") for _ in range(rng.randint(0, 24))) for _ in range(20000)]
    assert rewritten(column(spark, texts), "", mode="e164") == [plain_phone(t) for t in texts]


def test_single_expressions_equal_the_operator(spark):
    texts = ["212 555 0100", "1/2/2024", "x", None]
    df = column(spark, texts)
    row = df.orderBy("id").select(e164(F.col("cell")), iso8601(F.col("cell"))).collect()
    assert [r[0] for r in row] == rewritten(df, "", mode="e164")
    assert [r[1] for r in row] == rewritten(df, "", mode="iso8601")


@pytest.mark.parametrize("mode", ["none", "e164", "iso8601"])
def test_plans_stay_in_generated_code(spark, mode, tmp_path):
    path = str(tmp_path / "t")
    column(spark, ["x"]).write.parquet(path)
    plan = plan_of(rewrite_column(spark.read.parquet(path), "cell", r"\d", "", mode))
    assert "EvalPython" not in plan and "Exchange" not in plan
    # Every projection carries a code generation id.
    assert re.findall(r"\(\d+\) Project \[codegen id : 1\]", plan)
    assert not re.findall(r"\(\d+\) Project *\n", plan)


@pytest.mark.parametrize("mode", ["e164", "iso8601"])
def test_staged_value_is_computed_in_its_own_projection(spark, mode, tmp_path):
    path = str(tmp_path / "t")
    column(spark, ["x"]).write.parquet(path)
    plan = plan_of(rewrite_column(spark.read.parquet(path), "cell", r"\d", "", mode))
    assert len(re.findall(r"^\(\d+\) Project ", plan, re.M)) == 2
