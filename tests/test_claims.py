"""Claims in numbers and the structure of formulas, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, evidence


def claims(spark, answer, context):
    a = spark.createDataFrame([(1, answer)], "query_id long, answer string")
    c = spark.createDataFrame([(1, context)], "query_id long, context string")
    return evidence.unsupported_numbers(a, c).first().claims


@pytest.mark.parametrize(
    ("answer", "context", "want"),
    [
        ("nhiệt độ (65 ± 10) % [1]", "(65 ± 15) %", ["65 ± 10"]), ("(65 ± 15) %", "$(65 \\pm 15)$ \\%", []), ("10 ± 0,5 bar", "10 bar và 0,5 mm", ["10 ± 0.5"]), ("1 400 bar", "1400 bar", []), ("1.061 và 6.3.1", "", []),
        ("5 mm, 5 mm và 07,50 kPa", "7.5 giờ", ["5 mm"]), ("12 tháng", "mỗi 12 tháng", []), ("12 tháng", None, ["12 tháng"]), ("5 mmx", "", []), (None, "5 mm", None), ("2 ± 1 ± 3 mm", "", ["2 ± 1", "3 mm"]),
    ],
)
def test_claims(spark, answer, context, want):
    assert claims(spark, answer, context) == want


def test_places_of_matches(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 ±.2") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    pattern = r"(?<![\w.])\d+(?:\.\d+)?"
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", evidence.spans(F.col("t"), pattern).alias("s"))
    assert {r.i: [tuple(x) for x in r.s] for r in df.collect()} == {i: [(*m.span(), m[0]) for m in re.finditer(pattern, t, re.ASCII)] for i, t in enumerate(texts)}


def plain_problem(t):
    """The rules one by one, character by character."""

    def group_end(i):
        if i is None or i >= len(t) or t[i] != "{":
            return None
        depth = 0
        while i < len(t):
            if t[i] == "\\":
                i += 2
                continue
            depth += {"{": 1, "}": -1}.get(t[i], 0)
            i += 1
            if depth == 0:
                return i
        return None

    if "$" in t:
        return "dollar", None
    depth = i = 0
    while i < len(t):
        if t[i] == "\\":
            i += 2
            continue
        depth += {"{": 1, "}": -1}.get(t[i], 0)
        if depth < 0:
            return "extra closing brace", i
        i += 1
    if depth:
        return "open braces", None
    if len(re.findall(r"\\left(?![a-zA-Z])", t)) != len(re.findall(r"\\right(?![a-zA-Z])", t)):
        return "left and right", None
    if re.search(r"\\(Delta|alpha)[A-Za-z]", t):
        return "glued command", None
    if re.search(r"\\(?:left|right)[{}]", t):
        return "bare brace", None
    for m in re.finditer(r"\\frac(?![a-zA-Z])", t):
        a = m.end()
        for _ in range(2):
            b = group_end(a)
            if b is None:
                break
            if not t[a + 1 : b - 1].strip():
                return "empty fraction", None
            a = b
    return None, None


def test_structure_of_formulas(spark):
    """Random strings of braces, escapes and fractions, nested ones among them; ``}{`` is no balance."""
    rng = random.Random(2)
    pieces = ["{", "}", "\\{", "\\}", "\\\\", "a", " ", "\\frac", "\\frac{", "}{", "{}", "{ }", "\\left(", "\\right)", "\\left\\{", "\\right{", "\\leftarrow", "\\Delta x", "\\Deltax", "\\alpha", "\\frac{\\frac{1}{2}}{", "$"]

    def group(n):
        return "{" + "".join(rng.choice(["a", " ", "\\{", "\\frac" + group(n - 1) + group(n - 1)] if n else ["b", "", " "]) for _ in range(rng.randint(0, 2))) + "}"

    texts = ["}{", "", "\\frac{a}{b}", "\\frac", "\\frac{a", "\\frac{a}{", "{a}\\"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(1500)] + [f"\\frac{group(2)}{group(2)}" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, latex string")
    got = {r.i: (r.problem, r.place) for r in answers.latex_problem(df, "latex").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_problem(t), t
    assert {p for p, _ in got.values()} == {None, "dollar", "extra closing brace", "open braces", "left and right", "glued command", "bare brace", "empty fraction"}


def test_totals_of_an_extraction(spark):
    md = spark.createDataFrame([("a", "x $y$ and $z$"), ("a", "not $ over\n lines $"), ("a", f"bad {answers.SENTINEL}"), ("b", None), ("c", "$q$")], "doc string, text string")
    formulas = spark.createDataFrame([("a", "}{"), ("a", None), ("a", "x")], "doc string, latex string")
    totals = spark.createDataFrame([("a", 4, 3, {"ole": 0.75, "omml": 1.0, "none": None}), ("b", 0, 0, None), ("d", 1, 1, {})], "doc string, found long, converted long, rates map<string,double>")
    assert {tuple(r) for r in answers.fidelity(md, formulas, totals).collect()} == {("a", "rate", 1), ("a", "lost", 1), ("a", "spans", 1), ("a", "unread", 1), ("a", "extra closing brace", 1), ("d", "spans", 1)}


def test_each_way_not_to_be_grounded(spark):
    """Words that a source runs together or writes apart are found; a code and an absent word are not."""
    q = [(1, "áp kế đo 2"), (2, "theo QTKĐ 1.061 áp kế"), (3, "the OF"), (4, "một hai ba bốn"), (5, "áp kế lò xo zzz"), (6, "áp kế lò xo đo đúng chuẩn mới zzz"), (7, None), (8, "Áp")]
    texts = [(1, 2, "đo2"), (1, 1, "ápkế"), (2, 1, "1.062 áp kế"), (4, 1, "một"), (4, 2, "hai ba bốn"), (5, 1, "áp kế lò xo"), (6, 1, "áp kế lò xo đo đúng chuẩn mới"), (3, 1, None)]
    questions = spark.createDataFrame(q, "query_id long, question string")
    sources = spark.createDataFrame(texts, "query_id long, rank int, text string")
    got = {r.query_id: (r.status, round(r.covered, 6)) for r in evidence.grounded(questions, sources.filter("rank = 1 OR query_id = 1"), sources, 0.5, 0.85, ["The", "of"]).collect()}
    assert got == {1: ("grounded", 1.0), 2: ("unknown code", 0.5), 3: ("no keywords", 0.0), 4: ("too few", 0.25), 5: ("absent word", 0.8), 6: ("grounded", 0.888889), 7: ("no keywords", 0.0), 8: ("too few", 0.0)}


def test_a_text_is_read_once_however_often_it_is_said(spark):
    texts = ["5 mm và 2 ± 1 bar", "5 mm", "2.0 ± 1 và 5", None]
    a = spark.createDataFrame([(i, texts[i % 4]) for i in range(64)], "query_id long, answer string")
    c = spark.createDataFrame([(i, texts[i // 4 % 4]) for i in range(64)], "query_id long, context string")
    assert evidence.read_numbers(a.select(F.col("answer").alias("text"))).count() == 3
    want = [[[], [], [], None], [["2 ± 1"], [], ["2.0 ± 1"], None], [[], [], [], None], [["2 ± 1", "5 mm"], ["5 mm"], ["2.0 ± 1"], None]]
    assert {r.query_id: r.claims for r in evidence.unsupported_numbers(a, c).collect()} == {i: want[i // 4 % 4][i % 4] for i in range(64)}
