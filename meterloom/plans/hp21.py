"""Heat-pump pack: 20 features, a temperature slope and 6 quality columns per house."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators.days import ZERO_KW, season_or_all

RUN_KW, MIN_RUN, SPREAD_MAX, HEAT_LIMIT_C = 0.5, 2, 10.0, 15.0


def days_table(days: DataFrame) -> DataFrame:
    c, kw = F.col, F.col("kw")
    d = days.where("channel = 'import'").select("mp_id", "date", "kw").withColumn("n_valid", p.window_count(kw)).withColumn("sorted", F.sort_array("kw"))
    d = d.withColumns({"base": F.coalesce(p.sorted_quantile(c("sorted"), c("n_valid"), 0.1), F.lit(0.0)), "vp99": F.coalesce(p.sorted_quantile(c("sorted"), c("n_valid"), 0.99), F.lit(0.0))})
    run = lambda v: F.coalesce(v - c("base") >= RUN_KW, F.lit(False))
    d = p.sealed(d.withColumn("run", p.bits(kw, lambda v, k: run(v))))
    both = [(k, run(p.at(kw, k)) & run(p.at(kw, k - 1))) for k in range(1, 96)]
    return p.sealed(d.select(
        "mp_id", "date", "n_valid", p.window_sum(kw).alias("tot"), p.window_sum(kw, 2, 6).alias("early"), "base", F.greatest(F.coalesce(p.largest(kw), F.lit(0.0)), F.lit(0.0)).alias("vmax"), "vp99", (p.ones(c("run")) / 4).alias("run_hours"),
        F.coalesce(st.ratio(p.window_sum(kw, f=lambda v, k: F.when(run(v), v - c("base"))), p.ones(c("run"))), F.lit(0.0)).alias("run_level"), p.run_count(c("run"), MIN_RUN).alias("n_cycles"),
        F.coalesce(st.ratio(p.balanced([F.when(t, F.abs(p.at(kw, k) - p.at(kw, k - 1))).otherwise(F.lit(0.0)) for k, t in both]), p.balanced([F.when(t, F.lit(1)).otherwise(F.lit(0)) for _, t in both])), F.lit(0.0)).alias("run_jump"),
    ))


def hp21(days: DataFrame, temperature: DataFrame | None = None) -> DataFrame:
    """temperature: date, temp_c (mean of the local day); without it the slope is 0."""
    c, eps = F.col, F.lit(ZERO_KW)
    d = days_table(days).withColumns({"kwh": c("tot") / 4, "month": F.month("date")})
    d = season_or_all(season_or_all(d, p.WINTER, "w", ["mp_id"]), p.SUMMER, "s", ["mp_id"])
    month = Window.partitionBy("mp_id", "month")
    d = d.withColumns({"month_mean": F.avg("kwh").over(month), "first_of_month": F.row_number().over(month.orderBy("date")) == 1})
    # The anomaly of winter rows against their month among winter rows: a month is in or out as a whole.
    d = d.withColumn("anomaly", F.when(c("w"), c("kwh") - c("month_mean")))
    by = Window.partitionBy("mp_id", "w").orderBy("date")
    d = d.withColumn("prior", F.when(c("w") & (F.datediff("date", F.lag("date").over(by)) == 1), F.lag("anomaly").over(by)))
    if temperature is not None:
        d = d.join(F.broadcast(temperature.select("date", F.col("temp_c").alias("t"))), "date", "left")
    else:
        d = d.withColumn("t", F.lit(None).cast("double"))
    w, s = c("w"), c("s")
    cold = (c("n_valid") >= 0.9 * 96) & (c("t") < HEAT_LIMIT_C)
    x, y = F.when(cold, c("t")), F.when(cold, c("kwh"))
    q = st.quantile_if
    g = d.groupBy("mp_id").agg(
        F.count(F.lit(1)).alias("n_days"), st.count_if(c("month").isin(*p.SUMMER)).alias("n_summer_days"), st.count_if(c("month").isin(*p.WINTER)).alias("n_winter_days"), st.mean_if(w, c("kwh")).alias("ew"), st.mean_if(s, c("kwh")).alias("es"),
        q(w, c("base"), 0.5).alias("bw"), q(s, c("base"), 0.5).alias("bs"), F.max("month_mean").alias("mmax"), F.min("month_mean").alias("mmin"), st.mean_if(c("first_of_month"), c("month_mean")).alias("mmean"), q(w, c("kwh"), 0.9).alias("k9"), q(w, c("kwh"), 0.1).alias("k1"), q(w, c("kwh"), 0.5).alias("k5"),
        st.mean_if(w, c("run_hours")).alias("rw"), st.mean_if(s, c("run_hours")).alias("rs"), st.mean_if(w, c("n_cycles")).alias("cw"), st.mean_if(s, c("n_cycles")).alias("cs"), st.sum_if(w, c("run_hours")).alias("rsum"), st.sum_if(w, c("n_cycles")).alias("csum"),
        st.mean_if(w, c("run_level")).alias("lw"), q(w, c("run_level"), 0.9).alias("l9"), q(w, c("run_level"), 0.1).alias("l1"), q(w, c("run_level"), 0.5).alias("l5"), st.mean_if(w, c("run_jump")).alias("jump"),
        st.mean_if(w, c("tot") / 96 / F.greatest(c("vmax"), eps)).alias("lfw"), st.mean_if(s, c("tot") / 96 / F.greatest(c("vmax"), eps)).alias("lfs"), st.mean_if(w, c("early") / F.greatest(c("tot"), eps)).alias("emw"), st.mean_if(s, c("early") / F.greatest(c("tot"), eps)).alias("ems"),
        q(w, c("vp99"), 0.9).alias("pw"), q(s, c("vp99"), 0.9).alias("ps"), F.when(st.pairs(c("prior"), c("anomaly")) >= 5, st.pearson(c("prior"), c("anomaly"))).alias("lag1"), F.count(x).alias("n_cold"), F.when((F.count(x) >= 5) & (F.var_pop(x) > 0.5**2), st.slope(x, y)).alias("b"),
        F.sum("tot").alias("tot"), F.sum("n_valid").alias("nv"), F.percentile("base", F.lit(0.5)).alias("base"),
    )
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    low = lambda n, v=ZERO_KW: F.greatest(z(n), F.lit(v))
    top = lambda v: F.least(F.coalesce(v, F.lit(0.0)), F.lit(SPREAD_MAX))
    feats = {
        "hp_winter_summer_energy_ratio": z("ew") / low("es"), "hp_base_winter_minus_summer_kw": z("bw") - z("bs"), "hp_base_winter_over_summer": z("bw") / low("bs"), "hp_monthly_energy_amplitude": (z("mmax") - z("mmin")) / low("mmean"), "hp_daily_energy_winter_kwh": z("ew"),
        "hp_daily_energy_spread_winter": top((c("k9") - c("k1")) / low("k5")), "hp_run_hours_winter": z("rw"), "hp_run_hours_winter_minus_summer": z("rw") - z("rs"), "hp_cycles_per_day_winter": z("cw"), "hp_cycle_length_h_winter": z("rsum") / F.greatest(z("csum"), F.lit(1)),
        "hp_cycles_per_day_summer": z("cs"), "hp_level_winter_kw": z("lw"), "hp_level_spread_winter": top((c("l9") - c("l1")) / low("l5", RUN_KW)), "hp_modulation_index_winter": z("jump") / low("lw"), "hp_load_factor_winter": z("lfw"), "hp_load_factor_winter_minus_summer": z("lfw") - z("lfs"),
        "hp_early_morning_share_winter": z("emw"), "hp_early_morning_share_winter_minus_summer": z("emw") - z("ems"), "hp_peak_winter_minus_summer_kw": z("pw") - z("ps"), "hp_daily_energy_persistence_winter": F.least(F.greatest(z("lag1"), F.lit(-1.0)), F.lit(1.0)),
        "hp_energy_cold_slope_kwh_per_degc": F.coalesce(-c("b"), F.lit(0.0)), "mean_import_kw": z("tot") / F.greatest(c("nv"), F.lit(1)), "base_kw": z("base"),
    }
    return g.select("mp_id", *[x_.alias(n) for n, x_ in feats.items()], "n_days", "n_summer_days", "n_winter_days", c("n_cold").alias("n_cold_days"))
