"""Text normal forms and parsing as Column functions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _fold_map() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)).replace("đ", "d")
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_map()


def fold(text: Column) -> Column:
    """Case and accents away, white space collapsed. Decomposed accents go as well."""
    plain = F.regexp_replace(F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _FROM, _TO), r"\p{M}+", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: What ends a lexical token. Fixed value.
TOKEN_ENDS = "[\\s,;!()\\[\\]{}<>\"'\\\\|]+"


def tokens(text: Column) -> Column:
    """Lexical tokens: lower case, split at white space and the marks that never belong to a code or unit."""
    return F.filter(F.split(F.lower(text), TOKEN_ENDS), lambda t: t != "")


def word_runs(text: Column, lengths: Column) -> Column:
    """Distinct runs of words that single spaces part, of as many words as the array ``lengths`` names."""
    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.filter(lengths, lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))
        return F.array_distinct(F.flatten(runs))

    return F.get(F.transform(F.array(F.split(text, " ")), of), F.lit(0))  # one element, so that the text is split once


def word_tokens(text: Column) -> Column:
    """Words of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def index_text(stem: Column, path: Column, text: Column) -> Column:
    """What the lexical index sees of a chunk."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (stem, path, text)))


#: Units that a number may be glued to; longer ones first. Fixed values.
UNITS = ("%rh", "%", "°c", "°", "oc", "mbar", "mpa", "kpa", "hpa", "bar", "pa", "mm", "cst", "kg", "phút", "tháng", "lần", "s", "h", "min", "r/min")


def measurement_text(text: Column) -> Column:
    """Normal form for comparing measurements: decimal point, no digit groups, number and unit glued."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[    ]", " "))
    t = F.replace(t, F.lit("°c"), F.lit("oc"))
    t = F.regexp_replace(t, r"(?U)\bmin\b", "phút")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")
    t = F.regexp_replace(t, r"(?<=\d)\s+(?=\d{3}(?![\p{L}\p{N}_]))", "")
    t = F.regexp_replace(t, r"(?<=\d)\s+(?=(?:" + "|".join(UNITS) + "))", "")
    return collapse(t)


def measurement_number(text: Column) -> Column:
    """Harder form for a number with unit: no spaces, no leading sign."""
    return F.regexp_replace(F.regexp_replace(measurement_text(text), r"\s+", ""), "^[±+-]+", "")


def latex_text(text: Column) -> Column:
    """A formula without delimiters, spaces and braces."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\$+|\$+$", ""), r"\s+", ""), "{}", "")


def without_codes(text: Column) -> Column:
    """A query without labelled document codes."""
    return F.trim(F.regexp_replace(text, r"(?i)QTK[DĐđ]\s*\d\.\d{3}(?!\d)", ""))


def parse_number(text: Column) -> Column:
    """One number written the Vietnamese way, or null where it is ambiguous or no number."""
    s = F.regexp_replace(F.regexp_replace(collapse(F.regexp_replace(text, "[−–]", "-")), r"(?<=\d) (?=\d)", ""), "e", "E")
    # Arrays of one element bind a text once, however often it is looked at.
    return F.get(F.transform(F.array(s), lambda s: F.get(F.transform(F.array(F.regexp_extract(s, r"^[+-]?(\d+(?:[.,]\d+)?|\d[\d.,]*\d)(?:E[+-]?\d+)?$", 1)), lambda body: _number(s, body)), F.lit(0))), F.lit(0))


def _number(s: Column, body: Column) -> Column:
    sign = F.regexp_extract(s, "^([+-]?)", 1)
    power = F.regexp_extract(s, r"(E[+-]?\d+)$", 1)
    grouped = body.rlike(r"^\d{1,3}(\.\d{3})+$") & ~body.startswith("0")
    plain = (
        F.when(body == "", None)
        .when(~body.rlike(r"^\d+([.,]\d+)?$"), None)
        .when(body.contains(","), F.replace(body, F.lit(","), F.lit(".")))
        .when(grouped, F.replace(body, F.lit("."), F.lit("")))
        .otherwise(body)
    )
    return F.concat(sign, plain, power).try_cast("double")


#: A number inside running text.
NUMBER = r"\d+(?:[.,]\d+)?"


def numbers_in(text: Column) -> Column:
    """All numbers of a text, in order; digit groups joined first."""
    prepared = F.regexp_replace(collapse(text), r"(?<=\d) (?=\d{3}(?!\d))", "")
    return F.transform(F.regexp_extract_all(prepared, F.lit(f"({NUMBER})"), 1), _plain_number)


def _plain_number(body: Column) -> Column:
    """``parse_number`` of what NUMBER matches, which has neither sign nor power and one mark at most."""
    grouped = body.contains(".") & body.rlike(r"^[1-9]\d{0,2}\.\d{3}$")
    return F.when(grouped, F.replace(body, F.lit("."), F.lit(""))).otherwise(F.replace(body, F.lit(","), F.lit("."))).cast("double")


def parse_quantity(text: Column) -> Column:
    """(rel_op, value_min, value_max, tolerance, unit): a value, a range or a value with tolerance; null without numbers."""
    # One element, so that the numbers are read off once and bound to a name.
    return F.get(F.transform(F.array(numbers_in(text)), lambda values: _quantity(text, values)), F.lit(0))


def _quantity(text: Column, values: Column) -> Column:
    n = F.size(values)
    plus_minus, ranged = text.contains("±"), text.contains("÷") | text.rlike("(?U)\\b(đến|tới)\\b")
    unit = collapse(F.regexp_replace(F.regexp_replace(text, NUMBER, " "), "(?U)[±÷()\\[\\]]|\\b(từ|đến|tới)\\b", " "))
    words = F.array_distinct(F.split(unit, " "))
    unit = F.nullif(F.when(F.size(words) == 1, words[0]).otherwise(unit), F.lit(""))
    first, second, last = F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(2)), F.try_element_at(values, F.lit(-1))
    center = F.when(n >= 2, first)
    return F.when(
        n > 0,
        F.when(plus_minus, F.struct(F.lit("±").alias("rel_op"), center.alias("value_min"), center.alias("value_max"), F.abs(last).alias("tolerance"), unit.alias("unit")))
        .when(ranged & (n >= 2), F.struct(F.lit("range").alias("rel_op"), F.least(first, second).alias("value_min"), F.greatest(first, second).alias("value_max"), F.lit(None).cast("double").alias("tolerance"), unit.alias("unit")))
        .when(~ranged, F.struct(F.lit("=").alias("rel_op"), first.alias("value_min"), first.alias("value_max"), F.lit(None).cast("double").alias("tolerance"), unit.alias("unit"))),
    )


def math_marks(text: Column) -> Column:
    """Formulas in code ticks, ``\\[..\\]`` and ``\\(..\\)`` to dollar marks."""
    t = F.regexp_replace(text, r"`\s*(\$[^`]*\$)\s*`", "$1")
    t = F.regexp_replace(t, r"(?s)\\\[\s*(.+?)\s*\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(t, r"(?s)\\\(\s*(.+?)\s*\\\)", r"\$$1\$")


def sub_sup(text: Column) -> Column:
    """Words with sub or sup tags to inline formulas, and how many were replaced: (text, n)."""
    n = F.lit(0)
    t = text
    for tag, mark in (("sub", "_"), ("sup", "^")):
        pattern = rf"(?U)(\w+)<{tag}>([^<]*)</{tag}>"
        n = n + F.regexp_count(t, F.lit(pattern))
        t = F.regexp_replace(t, pattern, rf"\$$1{mark}{{$2}}\$")
    for tag, mark in (("sub", "_"), ("sup", "^")):
        pattern = rf"<{tag}>([^<]*)</{tag}>"
        n = n + F.regexp_count(t, F.lit(pattern))
        t = F.regexp_replace(t, pattern, rf"\${mark}{{$1}}\$")
    return F.struct(t.alias("text"), n.alias("n"))


#: Ideographs, kana and hangul. Fixed value.
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]"


def strip_cjk(text: Column, least: int = 6, share: float = 0.4) -> Column:
    """(text, needs_regen, fixed, empty): a translated tail is cut, other foreign runs are deleted and flagged.

    A tail is what follows from the first foreign character on, if it has at least ``least`` such characters, they are at least ``share``
    of its non-space characters and it has no letter with an accent.
    """
    n = F.regexp_count(text, F.lit(f"({CJK})"))
    at = F.regexp_instr(text, F.lit(f"({CJK})"))
    tail = F.substr(text, at)
    solid = F.length(F.regexp_replace(tail, r"(?U)\s", ""))
    is_tail = (F.regexp_count(tail, F.lit(f"({CJK})")) >= least) & (n >= share * solid) & ~tail.rlike("[\\u00c0-\\u024f\\u1ea0-\\u1eff]")
    cut = F.rtrim(F.substring(text, F.lit(1), at - 1))
    kept = F.when(n == 0, text).when(is_tail, cut).otherwise(collapse(F.regexp_replace(text, f"{CJK}+", "")))
    return F.struct(kept.alias("text"), ((n > 0) & ~is_tail).alias("needs_regen"), (n > 0).alias("fixed"), (F.trim(kept) == "").alias("empty"))


#: The sentence that ends an answer without findings. Fixed value.
REFUSAL = "không tìm thấy thông tin"


def after_refusal_cut(text: Column) -> Column:
    """The text up to and with the refusal sentence, where it has one."""
    at = F.instr(F.lower(text), REFUSAL)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1 + len(REFUSAL))).otherwise(text)


def keys_of(text: Column, k: int) -> Column:
    """Distinct runs of ``k`` word tokens."""
    w = word_tokens(text)
    n = F.size(w) - (k - 1)
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array()))
