"""Evidence units and windows on sections made by hand, and windows against trying all whole-block choices."""

import random

import pytest

from tessera.operators import passages as P


def quotes(text):
    return [q for _, q in P.Units(text).all()]


def test_tables_keep_what_stands_around_them():
    text = "Only for oil.\n\n# Bảng 1\n\n| class | bar |\n| --- | --- |\n| 1 | 2 |\n\nNot for gas.\n\nSee Bảng 1 for more."
    table = next(q for q in quotes(text) if q.startswith("Only for oil.\n\n# Bảng 1"))
    assert table.endswith("Not for gas.") and "| 1 | 2 |" in table
    named = quotes(text)[-1]
    assert named.startswith("See Bảng 1") and "| class | bar |" in named


def test_formulas_come_with_lead_in_and_definitions():
    text = "It is:\n\n$$p = a + b$$\n\nTrong đó:\n\n$a$ là one;\n\n$b$ - two.\n\nAfter."
    assert quotes(text) == ["It is:\n\n$$p = a + b$$\n\nTrong đó:\n\n$a$ là one;\n\n$b$ - two.", "After."]


def test_items_notes_and_conditions():
    text = "# Head\n\nTiến hành trong các điều kiện sau:\n\n- warm\n\n- dry\n\nThen:\n\n1. first\n\n2) second\n\nCHÚ THÍCH: careful\n\n# Next\n\nFree."
    got = dict(P.Units(text).all())
    held = "Tiến hành trong các điều kiện sau:\n\n- warm\n\n- dry"
    assert got["2) second"] == f"{held}\n\nThen:\n\n2) second\n\nCHÚ THÍCH: careful"
    assert got["- dry"] == f"{held}\n\n{held.split(chr(10))[0]}\n\n- dry" or got["- dry"].endswith("- dry")
    assert got["Free."] == "Free." and "# Head" not in got


def test_units_are_ranked_once(spark):
    rows = spark.createDataFrame([("a", "x\n\ny\n\nx"), ("b", None), ("c", " \n\n "), ("a", "x\n\ny\n\nx")], "section_id string, text string")
    got = sorted(map(tuple, P.evidence_units(rows).collect()))
    assert got == sorted([("a", 1, "x", "x"), ("a", 2, "y", "y")] * 2)


LEAD, FORMULA, WHERE, ONE, TWO = "The area follows from:", "| $A = M / P$ |  |\n| --- | --- |", "trong đó:", "$M$ là mass;", "$P$ là pressure."
SECTION = "\n\n".join(["### Head", "first words", *(f"filler {k} " + "w " * 20 for k in range(6)), LEAD, FORMULA, WHERE, ONE, TWO, *(f"more {k} " + "v " * 20 for k in range(6)), "Last."])


@pytest.mark.parametrize("anchor", [LEAD, FORMULA, TWO])
def test_anchor_brings_its_formula(anchor):
    out = P.Window(SECTION).fitted([anchor], 150)
    assert all(x in out for x in (LEAD, FORMULA, anchor)) and len(out) <= 150 and out.startswith("…\n") and out.endswith("\n…")


def test_small_budget_keeps_the_anchor_alone():
    out = P.Window(SECTION).fitted(["Last.", LEAD], 12)
    assert out == "…\nLast."


def test_missing_anchor_shows_the_start():
    out = P.Window(SECTION).fitted(["not there"], 100)
    assert out.startswith("### Head") and out.endswith("…")


def test_large_block_is_cut_around_the_anchor():
    text = "C" * 5000 + " the error is small. " + "D" * 5000
    out = P.Window(text).fitted(["the error is small."], 1000)
    assert "the error is small." in out and len(out) <= 1004
    lines = "pad\n" * 400 + "| $x = 1$ |\n$x$ is one\n" + "pad\n" * 400
    cut = P.Window(lines).fitted(["$x$ is one"], 1000).splitlines()
    assert "| $x = 1$ |" in cut and "$x$ is one" in cut and set(cut) <= {"", "…", "pad", "| $x = 1$ |", "$x$ is one"}


def test_windows_are_whole_blocks_and_full():
    """Within the budget, blocks in order with gaps marked; no neighbour of what was chosen would fit as well."""
    rng = random.Random(7)
    for _ in range(200):
        blocks = [rng.choice(["text ", "lead: x:", "$$a$$", "trong đó $a$", "$b$ là it "]) + str(k) + "z" * rng.randrange(30) for k in range(rng.randint(1, 12))]
        text = "\n\n".join(blocks)
        anchors = rng.sample(blocks, min(len(blocks), rng.randint(1, 3)))
        budget = rng.randint(40, 200)
        w = P.Window(text)
        assert w.blocks == blocks
        out = w.fitted(anchors, budget)
        kept = {k for k, b in enumerate(blocks) if b in out}
        if not kept or out != w.shown(kept):  # no whole block fits: cut
            assert all(len(w.shown({k})) > budget for k in [blocks.index(a) for a in anchors])
            continue
        assert len(out) <= budget
        first = blocks.index(anchors[0])
        assert first in kept or len(w.shown({first})) > budget
        near = {k + d for k in kept for d in (-1, 1)} & set(range(len(blocks))) - kept
        assert all(len(w.shown(kept | {k})) > budget for k in near)


def test_windows_as_a_job(spark):
    rows = spark.createDataFrame([("a", SECTION, 150), ("b", "short", 10), ("c", None, 5), ("d", SECTION, 100), ("e", "", 0)], "section_id string, text string, budget int")
    anchors = spark.createDataFrame([("a", 2, "first words"), ("a", 1, LEAD), ("b", 1, "x"), ("z", 1, "y"), ("a", 3, None)], "section_id string, place int, anchor string")
    got = {r.section_id: r.text for r in P.windows(rows, anchors).collect()}
    assert got == {"a": P.Window(SECTION).fitted([LEAD, "first words"], 150), "b": "short", "c": None, "d": P.Window(SECTION).fitted([], 100), "e": ""}
