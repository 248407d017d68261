"""Licence scan: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import word_table
from tessera.llm.spdx import EXCEPTIONS, LICENCES
from tessera.session import ship

#: Phrases whose places are counted as base matches, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases (words in lower case) and the labels they stand for.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}

#: Label of an expression's operands that are no identifiers, next to the known ones.
UNKNOWN = "unknown"

# First parts of identifiers whose licences ask for the same terms again, and of those that forbid some uses.
COPYLEFT = ("agpl-", "cc-by-sa-", "cddl-", "cecill-1", "cecill-2", "cpl-", "epl-", "eupl-", "gfdl-", "gpl-", "lgpl-", "mpl-", "ms-rl", "osl-", "qpl-", "sleepycat")
RESTRICTED = ("aladdin", "busl-", "cc-by-nc-", "cc-by-nd-", "elastic-", "licenseref-", "polyform-", "sspl-")

#: What an expression comes to, from the freest: the terms of its best alternative, whose worst term decides.
OUTCOMES = ("permissive", "copyleft", "restricted", "unclear")

TAG = "spdx license identifier"

#: What one kind of evidence adds to the score: the score is 1 minus the product of (1 - weight) over distinct evidence.
WEIGHTS = {"tag": 0.9, "notice": 0.6, "base": 0.4, "broken": 0.2}

_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(rb"[()]|[^\s()]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(text: str) -> list[str] | None:
    """Shunting-yard: a licence expression in reverse Polish order, or None if it is broken.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; all are left-associative. Reading ends before an
    operand that follows a complete expression, so text after the expression does no harm. Closing punctuation of an operand goes.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token completed an operand
    depth = 0
    for token in (t.decode("latin-1").lower() for t in _TOKEN.findall(text.encode("latin-1", "replace"))):
        if token in _RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
            depth += 1
        elif token == ")":
            if not operand:
                return None
            if not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            if operand:
                break
            if not (name := token.rstrip(".,;:!?*/'\"")):
                break
            out.append(name)
            operand = True
    if not operand or depth:
        return None
    return out + held[::-1]


def identifiers(rpn: list[str] | None) -> set[str] | None:
    """Known identifiers of an expression, and ``UNKNOWN`` if it names others as well; None if it is broken or names nothing known."""
    if rpn is None:
        return None
    named: set[str] = set()
    kinds: list[str] = []  # an operand's kind: of a name "licence", "exception" or "unknown", else "with" or "terms"
    for t in rpn:
        if t not in _RANK:
            kind = "exception" if t in EXCEPTIONS else "licence" if t in LICENCES or t.removesuffix("+") in LICENCES or t.startswith("licenseref-") else UNKNOWN
            named.add(UNKNOWN if kind == UNKNOWN else t)
            kinds.append(kind)
            continue
        b, a = kinds.pop(), kinds.pop()
        if t == "with":
            if a not in ("licence", "with", UNKNOWN) or b not in ("exception", UNKNOWN):
                return None
        elif "exception" in (a, b):
            return None
        kinds.append("with" if t == "with" else "terms")
    return None if kinds == ["exception"] or named == {UNKNOWN} else named


def evaluate(rpn: list[str] | None) -> tuple[set[str], list[frozenset[str]]] | None:
    """``identifiers`` of an expression, and the sets of terms that each satisfy it; None if it is broken or names nothing known.

    ``or`` offers either side's sets, ``and`` joins a set of each side, ``with`` adds an exception to a licence. Terms that are not known stand as
    written. There are as many sets as the expression allows, up to two to the power of its ``and``s and more: ask ``identifiers`` where names will do.
    """
    named = identifiers(rpn)
    if named is None:
        return None
    stack: list[list[frozenset[str]]] = []
    for t in rpn:
        if t not in _RANK:
            stack.append([frozenset([t])])
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            both = [frozenset([f"{next(iter(a[0]))} with {next(iter(b[0]))}"])]
        else:
            both = a + b if t == "or" else [x | y for x in a for y in b]
        stack.append(list(dict.fromkeys(both)))
    return named, stack[0]


def outcome(rpn: list[str]) -> tuple[int, tuple[str, ...]]:
    """The place in ``OUTCOMES`` of an expression that ``identifiers`` can read, and the terms of its best alternative.

    ``or`` takes the better side (the freer, then the one of fewer terms, then the first in order), ``and`` both sides' terms, of which the least free decides; an
    exception stays with its licence. Each operator is looked at once, however many alternatives there are.
    """
    stack: list[tuple[int, int, tuple[str, ...]]] = []
    for t in rpn:
        if t not in _RANK:
            known = t in LICENCES or t.removesuffix("+") in LICENCES or t in EXCEPTIONS or t.startswith("licenseref-")
            rank = 3 if not known else 2 if t.startswith(RESTRICTED) else 1 if t.startswith(COPYLEFT) else 0
            stack.append((rank, 1, (t,)))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "or":
            stack.append(min(a, b))
            continue
        terms = (f"{a[2][0]} with {b[2][0]}",) if t == "with" else tuple(sorted({*a[2], *b[2]}))
        stack.append((max(a[0], b[0]), len(terms), terms))
    return stack[0][0], stack[0][2]


class Scanner:
    """One automaton for all phrases; one per worker process."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                found.setdefault(f" {phrase} ", []).append((kind, label))
        for phrase, what in found.items():
            self.automaton.add_word(phrase, (len(phrase), what))
        self.automaton.make_automaton()
        lower, word = word_table("plain")
        self.table = bytes(int(lower[b]) if word[lower[b]] else 32 for b in range(256))

    def scan(self, raw: bytes) -> tuple:
        """(words, base places, first start, last start, base labels, labels, score, terms) of one text's UTF-8 bytes."""
        words = raw.translate(self.table).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        n_base, first, last = 0, None, None
        base: set[str] = set()
        more: set[str] = set()
        evidence: set[tuple[str, str]] = set()
        chosen: set[str] = set()
        at = word = 0
        tagged = False
        for end, (size, what) in self.automaton.iter(line):
            for kind, label in what:
                if kind == "base":
                    start = end - size + 1
                    if start >= at:
                        word += line.count(" ", at, start)
                        at, here = start, word
                    else:
                        here = word - line.count(" ", start, at)
                    n_base += 1
                    first = here if first is None else min(first, here)
                    last = here if last is None else max(last, here)
                    base.add(label)
                    evidence.add(("base", label))
                elif kind == "notice":
                    more.add(label)
                    evidence.add(("notice", label))
                else:
                    tagged = True
        if tagged:
            for m in _TAG_LINE.finditer(raw.lower()):
                rpn = parse(m[1].decode("latin-1"))
                if (got := identifiers(rpn)) is None:
                    more.add("unparsed")
                    evidence.add(("broken", ""))
                else:
                    rank, terms = outcome(rpn)
                    more |= {*got, f"terms-{OUTCOMES[rank]}"}
                    chosen.add(" and ".join(terms))
                    evidence |= {("broken", "") if rank == 3 else ("tag", x) for x in terms}
        doubt = 1.0
        for kind, _ in sorted(evidence):
            doubt *= 1 - WEIGHTS[kind]
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1 - doubt if evidence else 0.0, "; ".join(sorted(chosen))


_scanner: list[Scanner] = []


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, phrase places, labels, a score and licence terms for each row's whole text.

    Expressions in identifier tags are evaluated: ``labels`` has all identifiers that they name and what each comes to (``terms-`` and one of ``OUTCOMES``),
    ``terms`` the best alternative of each, and only its terms count in the score, or as broken if no alternative is clear.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A null or empty text has no words, null
    places, empty labels and terms and score 0. Rows are independent: repeated rows repeat their result, an empty table gives none.
    """
    ship(docs.sparkSession)
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "terms": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for b in batches:
            rows = [_scanner[0].scan(x.as_py() or b"") for x in b.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True))], names=["doc_id", *types])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string")
