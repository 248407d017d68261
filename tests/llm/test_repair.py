import hashlib
import itertools
import random
import re
import zlib

from tessera.llm import repair as R
from tessera.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece int, at long, row string"


def table(spark, rows):
    """Rows with columns whose names the operator might use itself."""
    return spark.createDataFrame([(*r, "c", 1, 2, "r") for r in rows], SCHEMA)


def damage(rows):
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else x
        c = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if c:
            row = (conv, turn, "user" if c == 4 else role, "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text)
            yield from [row] * (2 if c == 3 else 1)


def cheapest(kinds):
    """Least (cost, audit) by going from row to row and place to place, with insertions anywhere."""
    states = {0: (0, "")}

    def inserted(states):
        for _ in range(4):
            for (p, role), q in R.STEPS.items():
                if role in "ua" and p in states:
                    got = (states[p][0] + 5, states[p][1] + "I")
                    states[q] = min(states.get(q, got), got)
        return states

    for kind in kinds:
        new = {}
        for p, (cost, audit) in inserted(states).items():
            ways = [(p, cost + 2, "D")]
            if kind != "x":
                more = 5 if kind.isupper() else 0
                ways += [(q, cost + more, "K") for (a, role), q in R.STEPS.items() if a == p and role == kind.lower()]
                ways += [(q, cost + more + 1, "R") for (a, role), q in R.STEPS.items() if a == p and role in "ua"]
            for q, c, e in ways:
                new[q] = min(new.get(q, (c, audit + e)), (c, audit + e))
        states = new
    inserted(states)
    return min(states[q] for q in (0, 3) if q in states)


def plain(rows):
    """The report of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    count, seen, kinds = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        kinds += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = cheapest(kinds)
    out, it = [], iter(rows)
    for e in audit:
        want = "assistant" if out and out[-1][0] == "u" else "user"
        row = None if e == "I" else next(it)
        if e != "D":
            out.append(f"{want}:" if e == "I" else f"{row[2] if e == 'K' else want}:{row[3]}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), "\n".join(out))


def expected(rows, put_in=damage):
    groups = {r[0]: [] for r in rows}
    for r in put_in(rows):
        groups[r[0]].append(r)
    return {c: plain(g) for c, g in groups.items()}


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"]), rng.choice(["Yes.", "No!", "Is it?", "cut off", "", " \t\n", "and so. \n", "Why? ü"]) + rng.choice(["", f" {t}", f" {t}.", "."])))
    rows += [(9000, None, "user", "a null turn."), (9000, 3, None, None), (9000, 1, "assistant", None), (None, 1, "user", "No id."), (None, 2, "assistant", "Still none."), (9001, None, None, None)]
    rows += [(9002, 1, "user", "x" * 300_000 + ".")] + [(9003, 5, "assistant", "Again.")] * 7 + [(9004, -3, "user", "Low?"), (9004, 4, "assistant", "High.")]
    gone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, (gone, 1, "user", "All of it is dropped.")]


def test_cells_equal_going_from_row_to_row():
    rng = random.Random(1)
    for n in [*range(7)] * 60 + [20, 33]:
        kinds = "".join(rng.choice("xsSuUaAoO") for _ in range(n))
        assert R.best(R.span(kinds)) == cheapest(kinds), kinds


def test_cells_equal_trying_all_edits():
    """Every repair of up to four rows with up to two insertions at each place."""
    edits = {"x": "D"} | dict.fromkeys("sSuUaA", "KRD") | dict.fromkeys("oO", "RD")
    for kinds in ["", "s", "su", "usa", "aa", "Uau", "oxA", "sUuo", "ssua", "aUxs"]:
        found = [(2, "D")] if kinds == "x" else []
        for each in itertools.product(*(edits[k] for k in kinds)):
            for put in itertools.product(range(3), repeat=len(kinds) + 1):
                audit = "".join("I" * i + e for i, e in zip(put, each, strict=False)) + "I" * put[-1]
                cost = 5 * sum(put) + sum(2 if e == "D" else (e == "R") + 5 * k.isupper() for e, k in zip(each, kinds, strict=True))
                role, k, state = "", 0, 0
                for e in audit:
                    want = "a" if state == R.USER else "u"
                    role = (kinds[k].lower() if e == "K" else want) if e != "D" else ""
                    k += e != "I"
                    if role:
                        state = R.STEPS.get((state, role), -1)
                        if state < 0:
                            break
                if state in (0, R.ASSISTANT):
                    found.append((cost, audit))
        assert R.best(R.span(kinds)) == min(found), kinds


def test_every_split_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choice("xsSuUaAoO") for _ in range(rng.randint(2, 20)))
        assert len({R.join(R.span(kinds[:k]), R.span(kinds[k:])) for k in range(len(kinds) + 1)}) == 1


def test_awkward_rows_equal_plain_version(spark):
    rows = conversations(random.Random(4), 300)
    got = {r[0]: tuple(r)[1:] for r in R.with_all(R.repair(R.damaged(table(spark, rows)))[0], table(spark, rows)).collect()}
    want = {c: x[:-1] for c, x in expected(rows).items()}
    assert got == want
    assert len({x[6] for x in got.values()}) > 50 and any(x[6] == "" for x in got.values())


def test_a_conversation_over_many_partitions(spark):
    """Long conversations among short ones, in ten small partitions: pieces give what one task would, texts included."""
    rng = random.Random(5)
    rows = conversations(rng, 20) + [(500, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "cut", f"It is {t}.", ""])) for t in range(3000)] + [(501, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(1500)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        report, texts = R.repair(table(spark, [(c, t, r or " ", x or " ") for c, t, r, x in rows]))
        got, parts = {r[0]: tuple(r)[1:] for r in report.collect()}, {}
        for r in texts.orderBy("piece").collect():
            parts.setdefault(r.conv_id, []).append(r.repaired)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = expected([(c, t, r or " ", x or " ") for c, t, r, x in rows], list)
    assert got == {c: x[:-1] for c, x in want.items()}
    assert {c: "\n".join(p for p in x if p) for c, x in parts.items()} == {c: x[-1] for c, x in want.items()}
    assert len(parts[500]) > 2


def test_small_table_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, sf).collect()}
    assert got == {c: x[:-1] for c, x in expected(rows).items()}


def test_empty_table(spark):
    none = table(spark, [])
    assert R.with_all(R.repair(R.damaged(none))[0], none).count() == 0
