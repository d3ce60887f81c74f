"""Electric-vehicle pack: 20 features and 5 quality columns per house, on noon-to-noon windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators.days import ZERO_KW, in_season, noon_windows

STEP_KW, MIN_RUN, FLAT_TOL, FLAT_SHARE, LEVEL_TOL = 2.0, 4, 0.10, 0.80, 0.15


def windows_table(days: DataFrame) -> DataFrame:
    """The numbers of each noon-to-noon window of import."""
    return reduce_windows(noon_windows(days).select("mp_id", "date", "win"))


def reduce_windows(windows: DataFrame) -> DataFrame:
    c, w = F.col, F.col("win")
    d = windows.withColumn("n_valid", p.window_count(w))
    d = d.withColumn("base", F.coalesce(p.quantile(w, 0.1, c("n_valid")), F.lit(0.0)))
    d = d.withColumn("above", p.each(w, lambda v, k: F.coalesce(v - c("base"), F.lit(0.0))))
    high = lambda v, k: (v >= STEP_KW) & p.at(w, k).isNotNull()
    d = p.sealed(d.withColumn("high", p.bits(c("above"), high)))
    start, n = p.longest_run(c("high"))
    d = d.withColumns({"start": start, "blk_len": n.cast("long")})
    block = F.slice("above", F.coalesce(c("start"), F.lit(0)) + 1, F.greatest(c("blk_len").cast("int"), F.lit(0)))
    d = d.withColumn("block", block)
    some = c("blk_len") > 0
    d = d.withColumn("blk_level", F.when(some, p.sorted_quantile(F.sort_array("block"), c("blk_len"), 0.5)).otherwise(F.lit(0.0)))
    core = F.slice("block", 1, F.when(c("blk_len") >= 8, c("blk_len") - 3).otherwise(F.greatest(c("blk_len"), F.lit(0))).cast("int"))
    close = F.size(F.filter(core, lambda v: F.abs(v - c("blk_level")) <= FLAT_TOL * F.greatest(c("blk_level"), F.lit(1e-6))))
    hour = (((c("start") + 48) % 96) + 0.5) / 4
    step = F.greatest(*[F.coalesce(p.at(w, k), F.lit(0.0)) - F.coalesce(p.at(w, k - 1), F.lit(0.0)) for k in range(1, 96)])
    return p.sealed(d.select(
        "mp_id", "date", "n_valid", p.window_sum(w).alias("tot"), "base", F.array_max("above").alias("vmax_over_base"), (p.ones(c("high")) / 4).alias("hours_high"), (p.window_sum(c("above"), f=lambda v, k: F.when(high(v, k), v)) / 4).alias("e_high"),
        p.run_count(c("high"), MIN_RUN).alias("n_runs"), "blk_len", "blk_level", F.when(some, F.aggregate("block", F.lit(0.0), lambda s, v: s + v) / 4).otherwise(F.lit(0.0)).alias("blk_energy"),
        F.when(some, close / F.greatest(F.size(core), F.lit(1))).otherwise(F.lit(0.0)).alias("blk_flat_share"), F.when(some, hour).alias("blk_start_h"), step.alias("step_up"),
    ))


def ev20(days: DataFrame) -> DataFrame:
    return features(windows_table(days))


def features(windows: DataFrame) -> DataFrame:
    c = F.col
    plateau = c("blk_len") >= MIN_RUN
    w = Window.partitionBy("mp_id")
    on = lambda v: F.when(c("plateau"), v)
    d = windows.withColumn("plateau", plateau)
    d = d.withColumns({"level": F.percentile(on(c("blk_level")), F.lit(0.5)).over(w), "prior": F.lag("date").over(Window.partitionBy("mp_id", "plateau").orderBy("date"))})
    s, wi, weekend = in_season(p.SUMMER), in_season(p.WINTER), F.weekday("date") >= 5
    share = lambda t: st.mean_if(t, c("plateau").cast("double"))
    h = c("blk_start_h")
    med = lambda v, q=0.5: F.percentile(on(v), F.lit(q))
    g = d.groupBy("mp_id").agg(
        F.count(F.lit(1)).alias("n_days"), st.count_if(c("plateau")).alias("np"), med(c("blk_level")).alias("lvl"), med(c("blk_level"), 0.9).alias("lvl9"), F.avg(on((F.abs(c("blk_level") - c("level")) <= LEVEL_TOL * c("level")).cast("double"))).alias("same"),
        med(c("blk_len")).alias("len"), med(c("blk_len"), 0.9).alias("len9"), med(c("blk_energy")).alias("en"), med(c("blk_energy"), 0.9).alias("en9"), st.count_if(c("plateau") & (c("blk_flat_share") >= FLAT_SHARE)).alias("flat"), med(c("step_up")).alias("step"),
        F.avg(on(((h >= 17) | (h < 7)).cast("double"))).alias("eve"), st.circular_std_hours(on(h)).alias("spread"), st.count_if(c("plateau") & (h >= 7) & (h < 17)).alias("day"), share(weekend).alias("we"), share(~weekend).alias("wd"),
        F.percentile(on(F.datediff("date", "prior")), F.lit(0.5)).alias("gap"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span"), share(wi).alias("win"), share(s).alias("sum"), F.avg(c("plateau").cast("double")).alias("all"),
        F.percentile("vmax_over_base", F.lit(0.99)).alias("max"), F.avg("hours_high").alias("hh"), F.sum("e_high").alias("eh"), F.sum("tot").alias("tot"), F.avg(on(c("n_runs"))).alias("runs"), st.count_if(s).alias("n_summer_days"), st.count_if(wi).alias("n_winter_days"), F.sum("n_valid").alias("nv"), F.percentile("base", F.lit(0.5)).alias("base"),
    )
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    feats = {
        "ev_plateau_days_frac": c("np") / c("n_days"), "ev_plateau_level_kw": z("lvl"), "ev_plateau_level_p90_kw": z("lvl9"), "ev_level_consistency": z("same"), "ev_plateau_duration_h": z("len") / 4, "ev_plateau_duration_p90_h": z("len9") / 4, "ev_plateau_energy_kwh": z("en"),
        "ev_plateau_energy_p90_kwh": z("en9"), "ev_flat_plateau_days_frac": c("flat") / c("n_days"), "ev_step_up_kw": z("step"), "ev_start_evening_night_frac": z("eve"), "ev_start_hour_spread_h": F.abs(z("spread")), "ev_day_plateau_days_frac": c("day") / c("n_days"),
        "ev_weekend_minus_weekday_frac": z("we") - z("wd"), "ev_gap_days_median": F.coalesce(c("gap"), c("span").cast("double")), "ev_plateau_days_winter_minus_summer": F.coalesce("win", "all") - F.coalesce("sum", "all"), "ev_max_over_base_kw": z("max"), "ev_high_hours_per_day": z("hh"),
        "ev_high_energy_share": z("eh") / F.greatest(z("tot") / 4, F.lit(ZERO_KW)), "ev_sessions_per_plateau_day": z("runs"), "mean_import_kw": z("tot") / F.greatest(c("nv"), F.lit(1)), "base_kw": z("base"),
    }
    return g.select("mp_id", *[x.alias(n) for n, x in feats.items()], "n_days", "n_summer_days", "n_winter_days")
