"""What of a section is shown: evidence units, and a window inside a budget around its anchors.

Sections are small, and what a block brings along depends on its neighbours step by step, so each section is worked on as a
whole by a helper in Python; reading, joining and counting sections stay with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import ship

#: Characters by which a cut window may run over for the sake of a whole formula line.
SLACK = 400

# How the corpus marks items, definitions, captions, notes and conditions.
_ITEM, _BULLET = re.compile(r"[-*+] |\d+[.)] "), re.compile(r"[-*+] ")
_WHERE, _SYMBOL = re.compile(r"trong đó\b", re.I), re.compile(r"\$[^$]+\$\s*(?:là\b|[-–])")
_CAPTION, _TABLE_NO = re.compile(r"(?:#+\s*)?Bảng\s+(\d+)\b", re.I), re.compile(r"\bBảng\s+(\d+)\b", re.I)
_NOTE, _CONDITIONS = re.compile(r"CHÚ THÍCH\b", re.I), re.compile(r"\btrong các điều kiện sau\s*:", re.I)
_TITLE = re.compile(r"#+\s*|Bảng\s")
_GAP = "…"


def _has_rows(block: str) -> bool:
    return any(line.lstrip().startswith("|") for line in block.splitlines())


def _while(test, at: int, end: int, step: int = 1) -> int:
    """The first place from ``at`` on, going by ``step``, that is ``end`` or fails the test."""
    while at != end and test(at):
        at += step
    return at


class Units:
    """A section's blocks, and what each of them is quoted with."""

    def __init__(self, text: str):
        self.blocks = b = [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]
        self.n = n = len(b)
        self.joined = lambda lo, hi: "\n\n".join(b[lo:hi])
        self.formula: dict[int, str] = {}
        self.condition: dict[int, str] = {}
        self.table: dict[str, str] = {}
        held = ""
        for i, x in enumerate(b):
            if x.startswith("#"):
                held = ""
            if _CONDITIONS.search(x) and (end := _while(lambda k: _BULLET.match(b[k]), i + 1, n)) > i + 1:
                held = self.joined(i, end)
            if held:
                self.condition[i] = held
            if m := _CAPTION.match(x):
                near = next((k for k in range(i + 1, min(i + 5, n)) if _has_rows(b[k]) or b[k].startswith("#")), None)
                if near is not None and _has_rows(b[near]):
                    self.table[m[1]] = self.joined(i, near + 1)
            if x.startswith("$$") or (x[0] in "$|" and "$" in x and ("=" in x or r"\frac" in x)):
                lo, hi = i - (i > 0 and b[i - 1].endswith(":")), i + 1
                if hi < n and _WHERE.match(b[hi]):
                    hi = _while(lambda k: _SYMBOL.match(b[k]), hi + 1, n)
                self.formula |= dict.fromkeys(range(lo, hi), self.joined(lo, hi))

    def core(self, i: int) -> str:
        """A block with its formula group, or a table with what stands around it."""
        if i in self.formula:
            return self.formula[i]
        if not _has_rows(self.blocks[i]):
            return self.blocks[i]
        lo = max(0, i - 1)
        return self.joined(lo - (lo > 0 and bool(_TITLE.match(self.blocks[lo]))), i + 2)

    def quoted(self, i: int, core: str) -> str:
        """The core with a list's lead-in, a note, the conditions in force and the tables it names."""
        b, out = self.blocks, core
        if _ITEM.match(b[i]) and (lead := _while(lambda k: _ITEM.match(b[k]), i - 1, -1, -1)) >= 0 and b[lead].endswith(":"):
            out = f"{b[lead]}\n\n{out}"
        if i + 1 < self.n and _NOTE.match(b[i + 1]) and b[i + 1] not in out:
            out = f"{out}\n\n{b[i + 1]}"
        if self.condition.get(i, "") not in out:
            out = f"{self.condition[i]}\n\n{out}"
        for number in _TABLE_NO.findall(core):
            if self.table.get(number, "") not in out:
                out = f"{out}\n\n{self.table[number]}"
        return out

    def all(self) -> list[tuple[str, str]]:
        """(text to rank, text to quote) in order, each text to rank once; one-line headings are none."""
        out: dict[str, str] = {}
        for i, x in enumerate(self.blocks):
            if not x.startswith("#") or "\n" in x:
                core = self.core(i)
                if core not in out:
                    out[core] = self.quoted(i, core)
        return list(out.items())


def evidence_units(sections: DataFrame) -> DataFrame:
    """(section_id, unit_no, ranking_text, quote) of sections (section_id, text): paragraphs, items with their lead-in, tables with caption and neighbours, formulas with
    their definitions, each with the note, conditions and tables that belong to it. A null or empty section has none; repeated rows repeat theirs."""
    ship(sections.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, *u) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, u in enumerate(Units(t or "").all(), 1)]
            ids, numbers, ranked, quotes = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(ranked, pa.string()), pa.array(quotes, pa.string())], names=["section_id", "unit_no", "ranking_text", "quote"])

    return sections.select(F.col("section_id").cast("string"), "text").mapInArrow(run, "section_id string, unit_no int, ranking_text string, quote string")


class Window:
    """A section as blocks (runs of lines without a blank one between), of which some are kept."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - (m[0][-1] == "\n")) for m in re.finditer(r"(?:[^\n]*[^\s][^\n]*(?:\n|\Z))+", text)]
        self.blocks = b = [text[lo:hi] for lo, hi in self.spans]
        self.n = len(b)
        self.is_formula = [x.startswith("$$") or ("$" in x and all(line.lstrip().startswith("|") for line in x.splitlines())) for x in b]
        self.leads = [x.rstrip().endswith(":") for x in b]
        self.is_where = [bool(_WHERE.match(x)) for x in b]
        self.defines = [not f and (w or (" là " in x and not lead)) for x, f, w, lead in zip(b, self.is_formula, self.is_where, self.leads, strict=True)]

    def find(self, anchor: str, whole: bool = True) -> tuple[int, int] | None:
        """Characters [from, to) of an anchor, or of its beginning where its end differs."""
        anchor = anchor.strip() if whole else anchor
        for part in (anchor, anchor[:80]):
            if part.strip() and (at := self.text.find(part)) >= 0:
                return at, at + len(part)
        return None

    def touched(self, place: tuple[int, int]) -> tuple[int, int] | None:
        """The first and last block of some characters."""
        hit = [k for k, (lo, hi) in enumerate(self.spans) if lo < place[1] and place[0] < hi]
        return (hit[0], hit[-1]) if hit else None

    def above(self, k: int) -> range:
        """The formulas that end before block k, with their lead-in."""
        lo = _while(lambda i: self.is_formula[i], k - 1, -1, -1) + 1
        return range(lo - (lo < k and lo > 0 and self.leads[lo - 1]), k)

    def units(self, first: int, last: int) -> list[set[int]]:
        """What an anchor could be kept as, from the widest: with its formulas and their definitions, with its formulas, alone."""
        alone = set(range(first, last + 1))
        core = set(alone)
        if self.is_formula[first]:
            core |= {*self.above(first + 1)}
        else:
            where = _while(lambda i: self.defines[i] and not self.is_where[i], first, -1, -1)
            if self.defines[first] and where >= 0 and self.is_where[where] and len(self.above(where)):
                core |= {*self.above(where), where}
        if self.leads[last]:
            core |= {*range(last + 1, _while(lambda i: self.is_formula[i], last + 1, self.n))}
        wide = set(core)
        for i in core:
            if self.is_formula[i] and i + 1 < self.n and self.is_where[i + 1]:
                wide |= {*range(i + 1, _while(lambda k: self.defines[k], i + 2, self.n))}
        return [wide, core, alone]

    def shown(self, kept: set[int]) -> str:
        """Kept blocks as they stand, gaps marked."""
        runs: list[list[int]] = []
        for k in sorted(kept):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        parts = [self.text[self.spans[a][0] : self.spans[z][1]] for a, z in runs]
        return "\n".join([_GAP] * (runs[0][0] > 0) + [f"\n{_GAP}\n".join(parts)] + [_GAP] * (runs[-1][1] < self.n - 1))

    def cut(self, anchors: list[str], budget: int) -> str:
        """Characters around the first anchor that is there, for a section whose blocks are too large; ends fall on lines where that loses no anchor."""
        t, n = self.text, len(self.text)
        anchor, place = next(((a, p) for a in anchors if (p := self.find(a, whole=False))), ("", (0, 0)))
        keep = (place[0], place[0] + len(anchor))
        lo = max(0, min(keep[0] - (0 if anchor.rstrip().endswith(":") else max(0, budget - len(anchor)) // 2), n - budget))
        hi = min(lo + budget, n)
        if lo and t[lo - 1] != "\n" and 0 <= (line := t.find("\n", lo, hi)) and (not anchor or line < keep[0]):
            lo = line + 1
        if hi < n and t[hi - 1] != "\n":
            begin, end = t.rfind("\n", lo, hi) + 1, t.find("\n", hi)
            end = n if end < 0 else end
            if "$" in t[begin:end] and end - hi <= SLACK:
                hi = end
            elif begin > lo and (not anchor or begin >= keep[1]):
                hi = begin
        return f"{_GAP}\n" * (lo > 0) + t[lo:hi] + f"\n{_GAP}" * (hi < n)

    def fitted(self, anchors: list[str], budget: int) -> str:
        """The anchors' units in rank order as far as they fit, then neighbours as long as whole blocks do."""
        places = [h for a in anchors if (p := self.find(a)) and (h := self.touched(p))] or [(0, 0)] * (self.n > 0)
        kept: set[int] = set()
        ends: list[list[int]] = []
        for place in places:
            fits = next((u for u in self.units(*place) if u <= kept or len(self.shown(kept | u)) <= budget), None)
            if fits and not fits <= kept:
                kept |= fits
                ends.append([min(fits), max(fits)])
        if not kept:
            return self.cut(anchors, budget)
        grown = True
        while grown:
            grown = False
            for e in ends:
                for side, step in ((1, 1), (0, -1)):
                    k = _while(lambda i: i in kept, e[side] + step, self.n if step > 0 else -1, step)
                    if 0 <= k < self.n and len(self.shown(kept | {k})) <= budget:
                        kept.add(k)
                        e[side] = k
                        grown = True
        return self.shown(kept)


def windows(sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """(section_id, text): sections (section_id, text, budget) as they are where they fit their budget, else a window of whole blocks around their anchors.

    Anchors (section_id, place, anchor) are taken by ``place``, few for a section; one that isn't there is passed over, without any the section's start is shown. A null text gives null.
    """
    ship(sections.sparkSession)
    listed = anchors.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "anchor"))), lambda x: x["anchor"]).alias("anchors"))
    rows = sections.join(listed, "section_id", "left").select(F.col("section_id").cast("string"), "text", F.col("budget").cast("int"), "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if t is None or len(t) <= n else Window(t).fitted([a for a in list_ or [] if a], n) for t, n, list_ in zip(*(c.to_pylist() for c in b.columns[1:4]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["section_id", "text"])

    return rows.mapInArrow(run, "section_id string, text string")
