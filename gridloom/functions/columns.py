"""Column functions shared by the operators.

A missing value is NULL, never NaN: Spark counts NaN as larger than every
number and equal to itself, so :func:`nan_to_null` is applied where data enter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """True for a number that is neither missing nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def whole(agg: Column, value: Column, n: Column | int | None = None) -> Column:
    """``agg`` if no value of the group is missing, else NULL; ``n``: how many values there should be."""
    rows = F.count(F.lit(1)) if n is None else n if isinstance(n, Column) else F.lit(n)
    return F.when(F.count(value) == rows, agg)


def seconds(interval: Column) -> Column:
    """Whole seconds of a difference of two timestamps; needs no time zone."""
    part = lambda unit: F.extract(F.lit(unit), interval).cast("decimal(20,6)")
    return (part("DAY") * DAY + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("bigint")


def later(start: Column, n_seconds: Column) -> Column:
    """``start`` moved by a number of seconds."""
    zero = F.lit(0)
    return start + F.make_dt_interval(F.call_function("div", n_seconds, F.lit(DAY)).cast("int"), zero, zero, (n_seconds % DAY).cast("decimal(18,6)"))


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, even where ``f`` uses it for every element of an array.

    A column that is used inside a lambda may be replaced there by the expression
    that makes it; a lambda's variable isn't.
    """
    return F.get(F.transform(F.array(x), f), F.lit(0))


def filled(series: Column, n: int) -> Column:
    """An array of (i bigint, v) with the steps 0..n - 1 that it lacks, v missing, in order of i."""
    lacking = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), F.transform(series, lambda x: x["i"]))
    added = F.transform(lacking, lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("v")))
    return F.when(F.size(series) < n, F.sort_array(F.concat(series, added))).otherwise(F.sort_array(series))


def constants(values: Sequence[float], kind: str = "double") -> Column:
    """A constant array, folded to one literal, for look-ups by place in a short axis."""
    return F.from_json(F.lit(json.dumps([float(v) if kind == "double" else int(v) for v in values])), f"array<{kind}>")
