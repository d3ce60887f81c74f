"""Aggregates with the guards that the feature definitions need; none throws on constant or empty groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return a / F.when(b > 0, b)


def mean_if(test: Column, value: Column | None = None) -> Column:
    """Mean over the rows that pass; without a value, the share of rows that do."""
    if value is None:
        return F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    return F.avg(F.when(test, value))


def sum_if(test: Column, value: Column) -> Column:
    return F.sum(F.when(test, value))


def count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def quantile_if(test: Column, value: Column, q: float) -> Column:
    """Exact linear-interpolation quantile over the rows that pass."""
    return F.percentile(F.when(test, value), F.lit(q))


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y on x from sums; null where x is constant."""
    return F.covar_pop(x, y) / F.when(F.var_pop(x) > 0, F.var_pop(x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums over rows where both are there; null where either is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(x, y) / F.when((F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9), F.stddev_pop(x) * F.stddev_pop(y))


def pairs(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def circular_std_hours(hour: Column) -> Column:
    """Circular standard deviation of clock hours."""
    angle = hour * (2 * math.pi / 24)
    r = F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle)))
    return F.sqrt(-2 * F.ln(F.least(F.greatest(r, F.lit(1e-12)), F.lit(1.0)))) * (24 / (2 * math.pi))


def flatness(a: Column, b: Column, eps: float) -> Column:
    """Minus the absolute log ratio: 0 where a and b are alike."""
    return -F.abs(F.ln((a + eps) / (b + eps)))


def contrast(high: Column, low: Column) -> Column:
    """(high - low) / (high + low), null where the sum is not positive."""
    return ratio(high - low, high + low)


def average_rank(by: list[str], order: str) -> Column:
    """Rank with ties averaged, within the partition."""
    w = Window.partitionBy(*by).orderBy(order)
    ties = Window.partitionBy(*by, order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def counted_before(counts: DataFrame, by: list[str], value: str, n: str, buckets: int = 256) -> DataFrame:
    """counts (one row per group and value, n rows each) with `before`: rows of the group with smaller values, and `of`: all of its rows.

    Each group's values are cut into buckets by approximate quantiles; buckets are summed apart and offset by the
    totals of those before them, so no task orders a whole group.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)]).alias("__c"))
    b = counts.join(cuts, by).withColumn("__b", F.size(F.filter("__c", lambda x: x < F.col(value)))).drop("__c")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*by, "__b").agg(F.sum(n).alias("__t"))  # at most `buckets` rows a group
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "__b", F.coalesce(F.sum("__t").over(until(whole.orderBy("__b"))), F.lit(0)).alias("__o"), F.sum("__t").over(whole).alias("of"))
    inside = F.coalesce(F.sum(n).over(until(Window.partitionBy(*by, "__b").orderBy(value))), F.lit(0))
    return b.withColumn("__i", inside).join(sums, [*by, "__b"]).withColumn("before", F.col("__o") + F.col("__i")).drop("__b", "__i", "__o")


def percentile_ranks(df: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """(value, pct): the rank of every distinct value over all rows, ties averaged, divided by the row count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("__g", F.lit(0))
    x = counted_before(counts, ["__g"], "value", "n", buckets)
    return x.select("value", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("of")).alias("pct"))


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per group by rank sums, ties averaged; null where one class is missing."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__n1"))
    x = counted_before(counts, by, "__v", "__n")
    n1, n = F.sum("__n1"), F.sum("__n")
    ranks = F.sum(F.col("__n1") * (F.col("before") + (F.col("__n") + 1) / 2))
    return x.groupBy(*by).agg(((ranks - n1 * (n1 + 1) / 2) / F.when((n1 > 0) & (n1 < n), n1 * (n - n1))).alias("auc"))


def numbered(df: DataFrame, by: list[str], key: str, *salt: int, parts: int = 1024) -> DataFrame:
    """df with `number` (0, 1, ... within its group, in a random order that a hash of key and salt fixes) and `of` (rows of the group).

    The hash cuts each group into parts of like size, which are numbered apart and offset by the sizes of the parts
    before; one task never orders a whole group. Null groups are groups.
    """
    df = df.withColumn("__h", F.xxhash64(key, *[F.lit(s) for s in salt])).withColumn("__p", F.pmod(F.shiftright("__h", 20), F.lit(parts)))
    sizes = df.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # at most `parts` rows a group
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__p").alias("__q"), before.alias("__o"), F.sum("__n").over(whole).alias("of"))
    inside = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__h", key)) - 1
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = df.withColumn("__i", inside).join(sizes, same).withColumn("number", F.col("__o") + F.col("__i"))
    return out.drop("__h", "__p", "__q", "__o", "__i", *[f"__by_{c}" for c in by])


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for output; the small shift keeps decimal ties from falling either way."""
    return F.round(c + 1e-9, digits)
