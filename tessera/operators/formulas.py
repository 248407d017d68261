"""Approved formulas over many cases at once: definitions are rows, inputs are a map, and an expression is postfix code folded over a stack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.records import read_formula
from tessera.session import ship

# The largest input and result, the largest whole exponent, and the most arguments of max and min.
MOST_INPUT, MOST_RESULT, MOST_POWER, MOST_ARGUMENTS = 1e30, 1e40, 8, 12

_CODE = "array<struct<op:string,x:double,a:string,b:string,n:int>>"

#: Functions of numbers with how many arguments each takes (None: up to ``MOST_ARGUMENTS``), and those of series, whose arguments are names.
_SCALAR = {"sqrt": 1, "abs": 1, "pow": 2, "max": None, "min": None}
_SERIES = {"mean": 1, "rss": 1, "slope": 2}

Code = list[tuple]


class _Postfix:
    """Builds postfix code: (op, number, name, second name, how many values it takes)."""

    def __init__(self, series: set[str]):
        self.series = series

    def number(self, x: float) -> Code:
        return [("num", x, None, None, 0)]

    def name(self, name: str) -> Code:
        return [("series" if name in self.series else "var", None, name, None, 0)]

    def _scalar(self, code: Code) -> Code:
        if code[-1][0] == "series":
            raise ValueError(f"{code[-1][2]} is a series where a number is needed")
        return code

    def sign(self, a: Code) -> Code:
        return [*self._scalar(a), ("neg", None, None, None, 1)]

    def binary(self, mark: str, a: Code, b: Code) -> Code:
        return [*self._scalar(a), *self._scalar(b), (mark, None, None, None, 2)]

    def call(self, name: str, arguments: list[Code]) -> Code:
        n = len(arguments)
        if name in _SERIES:
            if n != _SERIES[name] or any(len(a) != 1 or a[0][0] != "series" for a in arguments):
                raise ValueError(f"{name} takes {_SERIES[name]} series")
            names = [a[0][2] for a in arguments]
            return [(name, None, names[0], names[-1], 0)]
        if name not in _SCALAR or not (n == _SCALAR[name] or (_SCALAR[name] is None and 1 <= n <= MOST_ARGUMENTS)):
            raise ValueError(f"no function {name} of {n} arguments")
        return [x for a in arguments for x in self._scalar(a)] + [("**" if name == "pow" else name, None, None, None, n)]


def postfix(text: str | None, scalars: list[str], series: list[str]) -> Code | None:
    """The code of an expression, or None where it isn't one."""
    try:
        return _scalar_code(read_formula(text or "", [*scalars, *series], _Postfix(set(series))))
    except (ValueError, RecursionError):
        return None


def _scalar_code(code: Code) -> Code:
    if code[-1][0] == "series":
        raise ValueError("a series is no result")
    return code


def compiled(formulas: DataFrame) -> DataFrame:
    """``formulas`` with ``code``; null for an expression that can't be read. A small helper, once a formula."""
    ship(formulas.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            code = []
            for text, variables in zip(f["expression"], f["variables"], strict=True):
                kinds = {s: [v["key"] for v in variables if (v["kind"] == "series") == s] for s in (False, True)}
                code.append(postfix(text, kinds[False], kinds[True]))
            yield pd.DataFrame({"formula": f["formula"], "code": [None if c is None else [dict(zip(("op", "x", "a", "b", "n"), x, strict=True)) for x in c] for c in code]})

    made = formulas.select("formula", "expression", "variables").mapInPandas(run, f"formula {dict(formulas.dtypes)['formula']}, code {_CODE}")
    return formulas.join(made, "formula")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _slope(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    xm, ym = _sum(xs) / n, _sum(ys) / n
    pairs = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    both = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - xm) * (p["y"] - ym))
    own = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - xm) * (x - xm))
    return F.when((n == F.size(ys)) & (n >= 2), F.try_divide(both, own))


def value(code: Column, given: Column) -> Column:
    """Result of postfix code over a map of name -> array of numbers: null where an operation has none (division by zero, root of a negative number, a power that is not whole or too high)."""

    def step(stack: Column, c: Column) -> Column:
        n = F.size(stack)
        last, before = F.get(stack, n - 1), F.get(stack, n - 2)
        own, second = F.try_element_at(given, c["a"]), F.try_element_at(given, c["b"])
        top = F.slice(stack, n - c["n"] + 1, c["n"])
        whole = (last == F.floor(last)) & (F.abs(last) <= MOST_POWER) & ~((before == 0) & (last < 0))
        most = F.when(~F.exists(top, lambda x: x.isNull()), F.when(c["op"] == "max", F.array_max(top)).otherwise(F.array_min(top)))
        got = (
            F.when(c["op"] == "num", c["x"]).when(c["op"] == "var", F.get(own, F.lit(0)))
            .when(c["op"] == "+", before + last).when(c["op"] == "-", before - last).when(c["op"] == "*", before * last)
            .when(c["op"] == "/", F.try_divide(before, last)).when(c["op"] == "neg", -last)
            .when(c["op"] == "**", F.when(whole, F.pow(before, last)))
            .when(c["op"] == "sqrt", F.when(last >= 0, F.sqrt(last))).when(c["op"] == "abs", F.abs(last))
            .when(c["op"].isin("max", "min"), most)
            .when(c["op"] == "mean", F.try_divide(_sum(own), F.size(own))).when(c["op"] == "rss", F.sqrt(_sum(F.transform(own, lambda x: x * x))))
            .when(c["op"] == "slope", _slope(own, second))
        )
        return F.concat(F.slice(stack, F.lit(1), n - c["n"]), F.array(got))

    return F.get(F.aggregate(code, F.array().cast("array<double>"), step), F.lit(0))


def evaluate(cases: DataFrame, formulas: DataFrame, units: DataFrame) -> DataFrame:
    """``cases`` with ``status`` and ``value``: each case's formula over its inputs, or the first reason why not.

    - cases: formula, inputs (map of name -> struct of values, an array of numbers, and unit), confirmed (array of conditions), and any other columns but the definitions' own
    - formulas: formula, expression, conditions (array) and variables (array of struct key, unit, kind ``scalar`` or ``series``, min, max, exclusive_min, exclusive_max, min_items, max_items; null bounds don't bind)
    - units: code, category, factor

    Statuses in the order of the rules: ``unknown formula``, ``unreadable``, ``missing or extra input``; then for the first variable at fault ``unit``
    (unknown or of another category), ``items`` (how many values), ``number`` (missing, not finite or too large), ``bounds`` (after conversion to the variable's unit); then ``unconfirmed`` and ``no value``.
    A formula of any number of cases is one broadcast or shuffled row; cases are not grouped.
    """
    known = units.agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("category", "factor")))).alias("known_units"))  # one row of all units
    own = compiled(formulas).select("formula", "code", "variables", "conditions", F.lit(True).alias("found"))
    rows = cases.join(own, "formula", "left").join(F.broadcast(known))

    def judged(v: Column) -> Column:
        entry = F.try_element_at("inputs", v["key"])
        source, target = F.try_element_at("known_units", entry["unit"]), F.try_element_at("known_units", v["unit"])
        n, series = F.coalesce(F.size(entry["values"]), F.lit(-1)), v["kind"] == "series"
        counted = F.when(series, (n >= F.coalesce(v["min_items"], F.lit(1))) & (n <= F.coalesce(v["max_items"], F.lit(100)))).otherwise(n == 1)
        number = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST_INPUT)
        x = F.transform(entry["values"], lambda y: y * source["factor"] / target["factor"])
        low = lambda y: (y < v["min"]) | (v["exclusive_min"] & (y == v["min"]))
        high = lambda y: (y > v["max"]) | (v["exclusive_max"] & (y == v["max"]))
        outside = F.exists(x, lambda y: F.coalesce(low(y), F.lit(False)) | F.coalesce(high(y), F.lit(False)))
        status = F.when(~F.coalesce(source["category"] == target["category"], F.lit(False)), "unit").when(~counted, "items").when(F.exists(entry["values"], number), "number").when(outside, "bounds")
        return F.struct(v["key"].alias("key"), status.alias("status"), x.alias("x"))

    names = F.transform("variables", lambda v: v["key"])
    given = F.map_keys("inputs")
    same = (F.size(F.array_except(names, given)) == 0) & (F.size(F.array_except(given, names)) == 0)
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("judged", F.when(F.col("same"), F.transform("variables", judged)))
    fault = F.get(F.transform(F.filter("judged", lambda j: j["status"].isNotNull()), lambda j: j["status"]), F.lit(0))
    rows = rows.withColumn("fault", F.when(F.col("found").isNull(), "unknown formula").when(F.col("code").isNull(), "unreadable").when(~F.col("same"), "missing or extra input").when(fault.isNotNull(), fault))
    open_ = F.size(F.array_except(F.coalesce("conditions", F.array().cast("array<string>")), F.coalesce("confirmed", F.array().cast("array<string>")))) > 0
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(open_, "unconfirmed")))
    rows = rows.withColumn("given", F.when(F.col("fault").isNull(), F.map_from_arrays(names, F.transform("judged", lambda j: j["x"]))))
    rows = rows.withColumn("result", F.when(F.col("fault").isNull(), value(F.col("code"), F.col("given"))))
    fine = F.col("result").isNotNull() & ~F.isnan("result") & (F.abs("result") <= MOST_RESULT)
    status = F.coalesce("fault", F.when(fine, "ok").otherwise("no value"))
    return rows.select(*cases.columns, status.alias("status"), F.when(status == "ok", F.col("result")).alias("value"))
