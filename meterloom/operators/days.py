"""From raw meter-days to house-days: floors, noise, several meters, day and noon windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.session import tasks

ZERO_KW = 0.02
EXPORT_NOISE_KW = 0.05
EXPORT_REAL_KW = 0.10
KEY = ["mp_id", "channel", "date"]


def MISSING(n: int) -> Column:  # noqa: N802
    """An array of n missing values."""
    return F.array_repeat(F.lit(None).cast("double"), n)


def clean(raw: DataFrame, noise_kw: float = EXPORT_NOISE_KW) -> DataFrame:
    """Adds n_neg (negative slots) and vmax_raw (-1 for an all-missing row) and floors kw at 0; export below the noise becomes 0."""
    kw, export = F.col("kw"), F.col("channel") == "export"
    counted = raw.withColumns({"n_neg": p.window_count(kw, test=lambda v: v < 0), "vmax_raw": F.coalesce(F.greatest(p.largest(kw), F.when(p.largest(kw).isNotNull(), F.lit(0.0))), F.lit(-1.0))})
    low = F.when(export, F.lit(noise_kw)).otherwise(F.lit(0.0))
    return counted.withColumn("kw", p.each(kw, lambda v, k: F.when(v < low, F.lit(0.0)).otherwise(v)))


def _dealt(raw: DataFrame, dealt: bool) -> DataFrame:
    """raw dealt by house before anything wide is made of it; `dealt`: it already is."""
    return raw if dealt else raw.repartition(tasks(raw.sparkSession), "mp_id")


def house_days(raw: DataFrame, noise_kw: float = EXPORT_NOISE_KW, dealt: bool = False) -> DataFrame:
    """One row per house, channel and day: the meters summed (a slot is missing only if it is for all).

    The rows are dealt by house before they are cleaned, so all cores share the work and every later grouping or
    window of a house reuses this one shuffle. dealt: the rows already are.
    """
    rows = clean(_dealt(raw, dealt), noise_kw).select(*KEY, "kw", "n_neg", "vmax_raw")
    days = rows.groupBy(*KEY).agg(F.collect_list("kw").alias("all"), F.sum("n_neg").alias("n_neg"), F.max("vmax_raw").alias("vmax_raw"))
    return days.select(*KEY, _sum_arrays(False).alias("kw"), "n_neg", "vmax_raw")


def strict_days(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """As house_days, but a slot needs every meter and a meter-day with a negative value is missing altogether."""
    rows = clean(_dealt(raw, dealt)).withColumn("kw", F.when(F.col("n_neg") == 0, F.col("kw")).otherwise(MISSING(96)))
    days = rows.select(*KEY, "kw").groupBy(*KEY).agg(F.collect_list("kw").alias("all"))
    return days.select(*KEY, _sum_arrays(True).alias("kw"))


def _sum_arrays(strict: bool) -> Column:
    first, rest = F.get("all", F.lit(0)), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1)))
    return F.when(F.size("all") == 1, first).otherwise(F.aggregate(rest, first, lambda x, y: p.add(x, y, strict)))


def in_season(months: tuple[int, ...], date: str = "date") -> Column:
    return F.month(date).isin(*months)


def season_or_all(days: DataFrame, months: tuple[int, ...], name: str, by: list[str], counted: Column | None = None) -> DataFrame:
    """Adds a flag for the rows that stand for a season: its own days, or all where the group has none.

    counted: which rows decide whether there is one (default: all of the group's).
    """
    own = in_season(months)
    has = F.max((own & counted if counted is not None else own).cast("int")).over(Window.partitionBy(*by))
    return days.withColumn(name, own | (F.coalesce(has, F.lit(0)) == 0))


def noon_windows(days: DataFrame) -> DataFrame:
    """Import days as windows from noon to the next day's noon; the morning is missing where the next day is."""
    rows = days.where("channel = 'import'").withColumn("__half", F.slice("kw", 1, 48))
    w = Window.partitionBy("mp_id").orderBy("date")
    rows = rows.withColumns({"__next": F.lead("date").over(w), "__morning": F.lead("__half").over(w)})
    morning = F.when(F.datediff("__next", F.col("date")) == 1, F.col("__morning")).otherwise(MISSING(48))
    return rows.withColumn("win", F.concat(F.slice("kw", 49, 48), morning)).drop("__half", "__next", "__morning")


def local_day_hours(date: Column, zone: str = "Europe/Zurich") -> Column:
    """Hours of a local calendar day: 23 or 25 where the clock changes."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone).cast("long")
    return (at(F.date_add(date, 1)) - at(date)) / 3600


def complete_days(days: DataFrame) -> DataFrame:
    """Days with 96 values, none negative, of 24 hours."""
    return days.where((p.window_count(F.col("kw"), test=lambda v: v >= 0) == p.SLOTS) & (local_day_hours(F.col("date")) == 24))
