"""Units, batch formula evaluation and relational views over calibration records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def unit_names(units: DataFrame) -> DataFrame:
    """(name, unit row): a unit's code and each alias."""
    return units.select(F.explode(F.array_distinct(F.concat(F.array("code"), F.coalesce("aliases", F.array())))).alias("name"), "code", "category", "factor", "offset")


def to_si(values: DataFrame, units: DataFrame) -> DataFrame:
    """``si`` = factor * value + offset by unit code or alias; null for an unknown unit."""
    names = unit_names(units)
    return values.join(names, values["unit"] == names["name"], "left").select(*values.columns, (F.col("factor") * F.col("value") + F.col("offset")).alias("si"))


def convert(requests: DataFrame, units: DataFrame) -> DataFrame:
    """``result`` of ``value source -> target`` and a ``status``: ok, unknown unit, or another category."""
    names = unit_names(units)
    side = lambda p: names.select(*(F.col(c).alias(f"{p}_{c}") for c in names.columns))
    rows = requests.join(side("s"), F.col("source") == F.col("s_name"), "left").join(side("t"), F.col("target") == F.col("t_name"), "left")
    known = F.col("s_code").isNotNull() & F.col("t_code").isNotNull()
    status = F.when(~known, "unknown unit").when(F.col("s_category") != F.col("t_category"), "other category").otherwise("ok")
    value = (F.col("s_factor") * F.col("value") + F.col("s_offset") - F.col("t_offset")) / F.col("t_factor")
    return rows.select(*requests.columns, status.alias("status"), F.when(status == "ok", value).alias("result"))


def mentions(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(id, number, code): every number with a known unit in the texts."""
    hits = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+(?:[.,]\d+)?\s*[%°\p{L}/]+)"), 1)).alias("m"))
    rows = hits.select("id", F.replace(F.regexp_extract("m", r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).cast("double").alias("number"), F.regexp_extract("m", r"^\d+(?:[.,]\d+)?\s*(.+)$", 1).alias("name"))
    return rows.join(unit_names(units).select("name", "code"), "name").select("id", "number", "code")


_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[a-zA-Z_]\w*)|(?P<mark>\*\*|[-+*/(),]))")

#: Functions of a formula, with how many arguments each takes (None: two or more).
_FUNCTIONS: dict[str, tuple[Callable[..., Column], int | None]] = {"sqrt": (F.sqrt, 1), "abs": (F.abs, 1), "max": (F.greatest, None), "min": (F.least, None), "pow": (F.pow, 2)}


class _Columns:
    """Builds a Column over double columns."""

    number, name = staticmethod(lambda x: F.lit(x)), staticmethod(lambda x: F.col(x))
    sign = staticmethod(lambda a: -a)

    @staticmethod
    def binary(mark: str, a: Column, b: Column) -> Column:
        return F.pow(a, b) if mark == "**" else F.try_divide(a, b) if mark == "/" else a + b if mark == "+" else a - b if mark == "-" else a * b

    @staticmethod
    def call(name: str, arguments: list[Column]) -> Column:
        make, n = _FUNCTIONS.get(name, (None, 0))
        if make is None or (len(arguments) != n and (n or len(arguments) < 2)):
            raise ValueError(f"the formula gives {name} {len(arguments)} arguments")
        return make(*arguments)


class _Formula:
    """Reads a formula by precedence: sums, products, signs, powers (from the right), then numbers, variables, calls and parentheses. ``make`` builds what comes out."""

    def __init__(self, text: str, variables: list[str], make):
        self.variables, self.make, self.tokens, at = variables, make, [], 0
        text = text.strip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise ValueError("the formula has other characters than numbers, names and operators")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, *marks: str) -> str | None:
        if self.tokens and self.tokens[0][0] == "mark" and self.tokens[0][1] in marks:
            return self.tokens.pop(0)[1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"the formula lacks a {mark!r}")

    def sum(self):
        out = self.product()
        while mark := self.take("+", "-"):
            out = self.make.binary(mark, out, self.product())
        return out

    def product(self):
        out = self.signed()
        while mark := self.take("*", "/"):
            out = self.make.binary(mark, out, self.signed())
        return out

    def signed(self):
        if mark := self.take("+", "-"):
            return self.make.sign(self.signed()) if mark == "-" else self.signed()
        base = self.atom()
        return self.make.binary("**", base, self.signed()) if self.take("**") else base

    def atom(self):
        if self.take("("):
            out = self.sum()
            self.need(")")
            return out
        kind, text = self.tokens.pop(0) if self.tokens else ("mark", "end")
        if kind == "number":
            return self.make.number(float(text))
        if kind == "name" and self.take("("):
            arguments = [self.sum()]
            while self.take(","):
                arguments.append(self.sum())
            self.need(")")
            return self.make.call(text, arguments)
        if kind == "name" and text in self.variables:
            return self.make.name(text)
        raise ValueError(f"the formula has {text}, which is neither a number, a variable nor a known function")


def read_formula(text: str, variables: list[str], make):
    """What ``make`` builds of a formula: only listed variables, numbers, ``+ - * / **``, parentheses and calls pass. Powers bind from the right and before a sign, as in Python."""
    formula = _Formula(text, variables, make)
    out = formula.sum()
    if formula.tokens:
        raise ValueError(f"the formula can't be read from {formula.tokens[0][1]} on")
    return out


def expression(text: str, variables: list[str]) -> Column:
    """An approved formula as a Column over double columns: only listed variables, numbers, ``+ - * / **``, parentheses and a few functions pass.

    Powers bind from the right and before a sign, as in Python. A division by zero gives null.
    """
    return read_formula(text, variables, _Columns)


def verdict(points: DataFrame) -> DataFrame:
    """``limit`` = the larger of a rate of the set point and a floor, and whether the error is within it."""
    limit = F.greatest(F.abs(F.col("nominal")) * F.col("rate") / 100, F.col("floor"))
    return points.select(*points.columns, limit.alias("limit"), F.when(F.abs(F.col("measured") - F.col("nominal")) <= limit, "Đạt").otherwise("Không đạt").alias("verdict"))


def series(points: DataFrame, key: str) -> DataFrame:
    """Mean, root sum of squares, slope, largest and smallest per series of (x, y)."""
    return points.groupBy(key).agg(F.avg("y").alias("mean"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("rss"), F.regr_slope("y", "x").alias("slope"), F.max("y").alias("largest"), F.min("y").alias("smallest"))


def approved_only(rows: DataFrame, extractions: DataFrame) -> DataFrame:
    """Rows whose extraction is approved."""
    return rows.join(extractions.filter("status = 'approved'"), "extraction_id", "left_semi")


def wide_records(records: DataFrame, devices: DataFrame, places: DataFrame, points: DataFrame) -> DataFrame:
    """Each record with its device and place, its first point and its widest point; every look-up is reduced to one row per record before it is joined."""
    first = points.groupBy("record_id").agg(F.min_by("point_id", F.struct("point_no", "point_id")).alias("first_point"), F.max_by("point_id", F.struct("span", "point_id")).alias("widest_point"), F.count("*").alias("n_points"))
    return records.join(devices, "device_id", "left").join(places, "place_id", "left").join(first, "record_id", "left")


def pivot_kinds(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per procedure with the largest value of each kind of fact."""
    return facts.groupBy("procedure_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k.lower()) for k in kinds))


def by_time(records: DataFrame, verdict_: str, n: int) -> DataFrame:
    """The latest ``n`` records of a verdict."""
    return records.filter(F.col("verdict") == verdict_).orderBy(F.desc("at"), "record_id").limit(n)


#: A range's bucket is at most this fine against its own size: numbers of buckets stay below 2 ** 41.
_FINE = 40


def _bucket(x: Column, level: Column) -> Column:
    """Number of the bucket of width 2 ** level that holds x; null where ranges of that level can't reach x."""
    return F.when(F.abs(x) < F.pow(F.lit(2.0), level + _FINE + 1), F.floor(x / F.pow(F.lit(2.0), level)))


def range_lookup(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """The one cell whose table, class and row range hold a value; null where none or several do.

    Cells (table_id, class, low, high, open, cell), where an open range begins above ``low`` and has no end; questions (query_id, table_id, class, value).

    A closed range lies in two buckets at most of the width (a power of two) next above its own, and a value looks in the one bucket that holds it for each width that its table
    and class have. So what is joined is a small factor of what is found, however many ranges a class has. Of open ranges the two lowest of a class say whether a value has none,
    one or several. Equal ranges of a class are one with a count, and equal values are looked up once for all questions.
    """
    key = ["table_id", "class"]
    bounds = cells.select(*key, F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "open", "cell")
    closed = bounds.filter("NOT open AND low <= high AND abs(low) < 1e300 AND abs(high) < 1e300").groupBy(*key, "low", "high").agg(F.count("*").alias("n"), F.min("cell").alias("cell"))
    width, size = F.col("high") - F.col("low"), F.greatest(F.abs("low"), F.abs("high"), F.lit(1e-270))
    level = F.greatest(F.when(F.col("high") > F.col("low"), F.ceil(F.log2(width))), F.ceil(F.log2(size)) - _FINE).cast("int")
    closed = closed.withColumn("level", level)
    placed = closed.withColumn("bucket", F.explode(F.array_distinct(F.array(_bucket(F.col("low"), F.col("level")), _bucket(F.col("high"), F.col("level"))))))
    own = questions.select("query_id", *key, F.col("value").cast("double").alias("value"))
    value = own.drop("query_id").filter("value IS NOT NULL AND NOT isnan(value)").distinct()
    asked = value.join(closed.select(*key, "level").distinct(), key).withColumn("bucket", _bucket(F.col("value"), F.col("level")))
    inside = asked.join(placed, [*key, "level", "bucket"]).filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).select(*key, "value", "n", "cell")
    lowest = Window.partitionBy(*key).orderBy("low", "cell")
    two = bounds.filter("open AND low IS NOT NULL").withColumn("k", F.row_number().over(lowest)).filter("k <= 2").select(*key, "low", "cell")
    above = value.join(two, key).filter(F.col("value") > F.col("low")).select(*key, "value", F.lit(1).cast("bigint").alias("n"), "cell")
    one = inside.unionAll(above).groupBy(*key, "value").agg(F.sum("n").alias("n"), F.min("cell").alias("cell"))
    return own.join(one, [*key, "value"], "left").select("query_id", F.when(F.col("n") == 1, F.col("cell")).alias("cell"))
