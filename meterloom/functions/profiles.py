"""Expressions along the day's profile: an array of 96 quarter-hour values in kW, null where missing.

Slot k (from 0) covers k/4 to (k+1)/4 hours; a window [a, b) in hours holds the slots whose centre lies in
it and wraps past midnight where a > b.

The expressions are unrolled over the fixed 96 slots instead of being higher-order functions: element
access, sums and comparisons are generated as Java code, while lambdas are interpreted value by value
(measured: about ten times slower). Runs are read off a string of 0 and 1, one character a slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 96
SUMMER, WINTER = (5, 6, 7, 8), (11, 12, 1, 2)


def sealed(df: DataFrame) -> DataFrame:
    """df behind a step that the optimizer doesn't move filters or expressions across.

    A filter on a column that stands on 96 others, which stand on 96 more, would otherwise be rewritten in
    terms of the first table and grow beyond any plan's size.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__r")).select("__r.*")


def slots(a: float = 0, b: float = 24) -> list[int]:
    """The slots of the window [a, b)."""
    lo, hi = int(a * 4), int(b * 4)
    return list(range(lo, hi)) if a < b else [*range(0, hi), *range(lo, SLOTS)]


def width(a: float, b: float) -> int:
    return len(slots(a, b))


def at(x: Column, k: int) -> Column:
    return F.get(x, F.lit(k))


def balanced(parts: list[Column]) -> Column:
    """Sum as a balanced tree: 96 terms are 7 levels deep, not 96."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def each(x: Column, f: Callable[[Column, int], Column], n: int = SLOTS) -> Column:
    """The array of f(value, slot)."""
    return F.array(*[f(at(x, k), k) for k in range(n)])


def window_sum(x: Column, a: float = 0, b: float = 24, f: Callable[[Column, int], Column] = lambda v, k: v) -> Column:
    """Sum of f(value, slot) over a window; missing values count as 0."""
    return balanced([F.coalesce(f(at(x, k), k), F.lit(0.0)) for k in slots(a, b)])


def window_count(x: Column, a: float = 0, b: float = 24, test: Callable[[Column], Column] = lambda v: v.isNotNull()) -> Column:
    """Number of values in a window that pass a test."""
    return balanced([F.when(test(at(x, k)), F.lit(1)).otherwise(F.lit(0)) for k in slots(a, b)]).cast("long")


def floored(x: Column) -> Column:
    """Negative values as 0; missing ones stay missing."""
    return each(x, lambda v, k: F.when(v < 0, F.lit(0.0)).otherwise(v))


def add(x: Column, y: Column, strict: bool = False) -> Column:
    """Element-wise sum; a slot is missing where both are (strict: where either is)."""
    return F.zip_with(x, y, (lambda p, r: p + r) if strict else (lambda p, r: F.coalesce(p + r, p, r)))


def largest(x: Column) -> Column:
    """The largest value that is there."""
    return F.array_max(x)


def weighted(x: Column, power: int) -> Column:
    """Sum of value times (centre hour)**power."""
    return window_sum(x, f=lambda v, k: v * F.lit(((k + 0.5) / 4) ** power))


def quantile(x: Column, q: float, n: Column | None = None) -> Column:
    """Linear-interpolation quantile of the values that are there; null where none is.

    n: their number, if it is at hand. Ascending order puts the missing values first.
    """
    return sorted_quantile(F.sort_array(x), window_count(x) if n is None else n, q)


def sorted_quantile(s: Column, n: Column, q: float) -> Column:
    """The quantile of the last n values of an ascending array."""
    place = (n - 1) * F.lit(float(q))
    lo = F.floor(place).cast("int")
    first = F.size(s) - n.cast("int")
    low, high = F.get(s, first + lo), F.get(s, first + F.least(lo + 1, n.cast("int") - 1))
    return F.when(n > 0, low + (high - low) * (place - lo))


def bits(x: Column, test: Callable[[Column, int], Column], picked: list[int] | None = None, n: int = SLOTS) -> Column:
    """A string with 1 for each slot that passes a test (and is among the picked), else 0."""
    use = set(range(n) if picked is None else picked)
    return F.concat(*[F.when(test(at(x, k), k), F.lit("1")).otherwise(F.lit("0")) if k in use else F.lit("0") for k in range(n)])


def ones(b: Column) -> Column:
    return F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("long")


def rising_edges(b: Column) -> Column:
    """Changes from 0 to 1; the first slot counts where 1."""
    return run_count(b, 1)


def run_count(b: Column, least: int) -> Column:
    """Number of runs of at least so many ones."""
    return F.regexp_count(b, F.lit(f"1{{{least},}}")).cast("long")


def longest_run(b: Column) -> tuple[Column, Column]:
    """Start (from 0, null without ones) and length of the longest run, the first on ties."""
    n = F.length(F.array_max(F.split(b, "0+")))  # of strings of ones the longest is the greatest
    return F.when(n > 0, F.instr(b, F.repeat(F.lit("1"), n)) - 1), n


def run_list(b: Column) -> Column:
    """The runs as an array of (start, length), in order."""
    cuts = F.regexp_extract_all(b, F.lit("0*1+"), F.lit(0))
    done = F.transform(cuts, lambda c, i: F.aggregate(F.slice(cuts, 1, i + 1), F.lit(0), lambda s, v: s + F.length(v)))
    return F.zip_with(cuts, done, lambda c, e: F.struct((e - F.length(F.replace(c, F.lit("0"), F.lit("")))).alias("start"), F.length(F.replace(c, F.lit("0"), F.lit(""))).alias("length")))


def hourly_means(x: Column) -> Column:
    """24 means of four slots; null where all four are missing."""
    def mean(h):
        n = window_count(x, h, h + 1)
        return F.when(n > 0, window_sum(x, h, h + 1) / n)

    return F.array(*[mean(h) for h in range(24)])


def min_hour(hours: Column, zero_kw: float = 0.02) -> Column:
    """Hour of the daily minimum from hourly means: the centre of the plateau near the minimum.

    A plateau over midnight gives the first lowest hour; a day without values gives 0.5.
    """
    low = F.array_min(hours)
    n = balanced([F.when(at(hours, h).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for h in range(24)])
    mean = balanced([F.coalesce(at(hours, h), F.lit(0.0)) for h in range(24)]) / F.greatest(n, F.lit(1))
    tolerance = F.greatest(F.lit(zero_kw), 0.05 * mean)
    near = [F.coalesce(at(hours, h) <= low + tolerance, F.lit(False)) for h in range(24)]
    count = balanced([F.when(t, F.lit(1)).otherwise(F.lit(0)) for t in near])
    centre = balanced([F.when(t, F.lit(float(h))).otherwise(F.lit(0.0)) for h, t in enumerate(near)]) / F.greatest(count, F.lit(1)) + 0.5
    return F.when(near[0] & near[23], F.array_position(hours, low) - 0.5).otherwise(centre)
