"""Heat-response pack: 30 features and diagnostics per house from complete days and temperatures.

A house's complete days are those with 96 values from every meter, none negative, of 24 hours. Missing
evidence stays null; fewer than 20 complete days leave every feature null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators.days import in_season
from meterloom.session import checkpointed

MIN_DAYS = 20
HEAT = (10, 11, 12, 1, 2, 3, 4)
TAUS = [8 + i / 2 for i in range(25)]


def ratio(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return a / F.when(b > floor, b)


def hdd_fit(daily: DataFrame) -> DataFrame:
    """Best balance temperature per house from rows mp_id, e (kWh), t: mp_id, tau, beta, r2, identified.

    For every candidate, e is fitted on max(0, tau - t) with a slope of at least 0; the smallest error
    wins, the smaller candidate on ties. The candidates' sums are aggregates, so days are read once.
    """
    taus = daily.sparkSession.range(len(TAUS)).select((F.lit(8.0) + F.col("id") / 2).alias("tau"))
    paired = daily.where("e IS NOT NULL AND t IS NOT NULL").select("mp_id", "e", "t")
    enough = paired.groupBy("mp_id").agg(F.count(F.lit(1)).alias("n"), (F.percentile("t", F.lit(0.9)) - F.percentile("t", F.lit(0.1))).alias("span")).where("n >= 60 AND span >= 8").select("mp_id")
    x = F.greatest(F.col("tau") - F.col("t"), F.lit(0.0))
    g = paired.join(enough, "mp_id", "left_semi").crossJoin(F.broadcast(taus)).groupBy("mp_id", "tau").agg(
        F.count(F.lit(1)).alias("n"), st.count_if(F.col("t") <= F.col("tau") - 2).alias("cold"), st.count_if(F.col("t") >= F.col("tau")).alias("warm"), F.var_pop(x).alias("vx"), F.var_pop("e").alias("vy"), F.covar_pop(x, F.col("e")).alias("cxy")
    )
    g = g.where((F.col("cold") >= 20) & (F.col("warm") >= 20) & (F.col("vx") * F.col("n") > 1e-10)).withColumn("beta", F.greatest(F.col("cxy") / F.col("vx"), F.lit(0.0)))
    sse = (F.col("vy") - 2 * F.col("beta") * F.col("cxy") + F.col("beta") * F.col("beta") * F.col("vx")) * F.col("n")
    best = g.withColumns({"sse": F.round(sse, 6), "sst": F.col("vy") * F.col("n")}).groupBy("mp_id").agg(F.min(F.struct("sse", "tau", "beta", "sst")).alias("b"))
    r2 = F.when(F.col("b.sst") > 1e-9, F.greatest(1 - F.col("b.sse") / F.col("b.sst"), F.lit(0.0)))
    return best.select("mp_id", "b.tau", "b.beta", r2.alias("r2"), (F.coalesce(r2 >= 0.1, F.lit(False)) & (F.col("b.tau") > 8) & (F.col("b.tau") < 20)).alias("identified"))


def pooled(q: DataFrame) -> DataFrame:
    """Quantiles of all slots of a house's complete days.

    A house's values are gathered as arrays and sorted once a season: 96 a day, some 35,000 for a year, so a house
    stays small; no row per slot is made.
    """
    s, w = in_season(p.SUMMER), in_season(p.WINTER)
    sets = {"": F.lit(True), "w": w, "s": s}
    total = p.window_sum(F.col("kw"))
    days = q.select("mp_id", "kw", total.alias("e"), *[t.alias(f"in{n}") for n, t in sets.items()])
    a = days.groupBy("mp_id").agg(*[x for n in sets for x in (F.collect_list(F.when(F.col(f"in{n}"), F.col("kw"))).alias(f"l{n}"), (F.sum(F.when(F.col(f"in{n}"), F.col("e"))) / (96 * F.count(F.when(F.col(f"in{n}"), F.lit(1))))).alias(f"pm{n}"))])
    a = p.sealed(a.select("mp_id", *[f"pm{n}" for n in sets], *[F.sort_array(F.flatten(f"l{n}")).alias(f"v{n}") for n in sets]))  # else every quantile would sort again
    q_ = lambda n, x: p.sorted_quantile(F.col(f"v{n}"), F.size(f"v{n}"), x).alias(f"p{round(100 * x)}{n}")
    return a.select("mp_id", "pm", "pmw", "pms", q_("", 0.5), *[q_(n, x) for n in sets for x in (0.95, 0.2)])


def events(q: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """Episodes of slots at or above base + threshold, over midnight but not over missing days.

    Episodes that touch the first or last slot of a stretch of days are dropped. base: mp_id, p20.
    Returns mp_id, island, idx (day number * 96 + slot), k, v and the episode's n, cv and start.
    """
    day = F.datediff("date", F.lit("2000-01-01").cast("date"))
    w = Window.partitionBy("mp_id").orderBy("date")
    edges = q.withColumns({"day": day, "first": F.coalesce(F.datediff("date", F.lag("date").over(w)) != 1, F.lit(True)), "last": F.coalesce(F.datediff(F.lead("date").over(w), "date") != 1, F.lit(True))})
    rows = edges.join(base.select("mp_id", "p20"), "mp_id").select("mp_id", "date", "day", "first", "last", "p20", F.posexplode("kw").alias("k", "v")).where(F.col("v") >= F.col("p20") + threshold)
    rows = rows.withColumn("idx", F.col("day") * 96 + F.col("k"))
    rows = rows.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("mp_id").orderBy("idx")))
    i = Window.partitionBy("mp_id", "island")
    touches = F.max((F.col("first") & (F.col("k") == 0)) | (F.col("last") & (F.col("k") == 95))).over(i)
    rows = rows.withColumns({"cut": touches, "n": F.count(F.lit(1)).over(i), "cv": F.stddev_pop("v").over(i) / F.avg("v").over(i), "start": F.min("idx").over(i), "night": F.avg(((F.col("k") < 24) | (F.col("k") >= 72)).cast("double")).over(i)})
    return rows.where(~F.col("cut")).select("mp_id", "date", "island", "idx", "k", "v", "n", "cv", "start", "night")


def plateau_hours(q: DataFrame, base: DataFrame) -> DataFrame:
    """Hours per house and day in flat evening-to-morning episodes of 2 to 16 h."""
    e = events(q, base, 3.0).where("n BETWEEN 8 AND 64 AND cv <= 0.15 AND night >= 0.75")
    return e.groupBy("mp_id", "date").agg((F.count(F.lit(1)) / 4).alias("hours"))


def fixed_time(q: DataFrame, base: DataFrame) -> DataFrame:
    """How much episodes start within the same two hours of the clock: mp_id, starts, mass (share in the best two hours), active (days)."""
    e = events(q, base, 1.5).where("n >= 2 AND idx = start")
    counts = [st.count_if(F.col("k") == k).alias(f"c{k}") for k in range(96)]
    g = e.groupBy("mp_id").agg(F.count(F.lit(1)).alias("starts"), F.size(F.collect_set("date")).alias("active"), *counts)
    top = F.greatest(*[p.balanced([F.col(f"c{(k + i) % 96}") for i in range(8)]) for k in range(96)])
    return g.select("mp_id", "starts", (top / F.col("starts")).alias("mass"), "active")


def cold_high_load(q: DataFrame, flags: DataFrame) -> DataFrame:
    """Mean hours on cold days above the slot's usual warm-day load; flags: mp_id, date, warm, cold."""
    rows = q.join(flags.where("warm OR cold"), ["mp_id", "date"])
    warm, cold, kw = rows.where("warm").select("mp_id", "kw"), rows.where("cold").select("mp_id", "kw"), F.col("kw")
    medians = lambda df, name: p.sealed(df.groupBy("mp_id").agg(F.array(*[F.percentile(p.at(kw, k), F.lit(0.5)) for k in range(p.SLOTS)]).alias(name)))
    usual = medians(warm, "usual")
    away = warm.join(usual, "mp_id").select("mp_id", p.each(kw, lambda v, k: F.abs(v - p.at(F.col("usual"), k))).alias("kw"))
    limits = usual.join(medians(away, "mad"), "mp_id").select("mp_id", p.each(F.col("usual"), lambda u, k: u + F.greatest(F.lit(0.3), 3 * 1.4826 * p.at(F.col("mad"), k))).alias("limit"))
    high = p.balanced([F.when(p.at(kw, k) > p.at(F.col("limit"), k), F.lit(1)).otherwise(F.lit(0)) for k in range(p.SLOTS)])
    return cold.join(p.sealed(limits), "mp_id").groupBy("mp_id").agg((F.sum(high) / 4 / F.count(F.lit(1))).alias("high_hours"))


def hp30(complete: DataFrame, weather: DataFrame, station_of: DataFrame) -> DataFrame:
    """complete: complete days of strict house-days; weather: station, date, temp_c, irr; station_of: mp_id, station.

    A dozen branches read the days, so give a stored or checkpointed table.
    """
    c = F.col
    q = complete.where("channel = 'import'").select("mp_id", "date", "kw")
    kw = c("kw")
    d = q.select("mp_id", "date", (p.window_sum(kw) / 4).alias("e"), (p.window_sum(kw, 0, 6) / 4).alias("n"), (p.window_sum(kw, 6, 24) / 4).alias("dd"))
    wx = station_of.select("mp_id", "station").join(weather.select("station", "date", c("temp_c").alias("t"), "irr"), "station").drop("station")
    d = d.join(wx, ["mp_id", "date"], "left")
    d = d.withColumns({"w": in_season(p.WINTER), "s": in_season(p.SUMMER), "heat": in_season(HEAT), "we": F.weekday("date") >= 5})
    fit = hdd_fit(d)
    d = d.join(fit, "mp_id", "left").withColumn("trusted", F.when(c("identified"), c("tau")).otherwise(F.lit(18.0)))
    d = d.withColumns({"warm": F.coalesce(c("t") >= F.greatest(F.lit(18.0), c("trusted")), F.lit(False)), "cold": F.coalesce(c("t") <= F.least(F.lit(8.0), c("trusted") - 4), F.lit(False))})
    h = Window.partitionBy("mp_id")
    d = d.withColumns({"n_warm": st.count_if(c("warm")).over(h), "n_cold": st.count_if(c("cold")).over(h), "med": F.percentile(F.when(c("warm"), c("e")), F.lit(0.5)).over(h)})
    d = d.withColumn("b", F.when(c("n_warm") >= 20, c("med"))).withColumn("excess", F.greatest(c("e") - c("b"), F.when(c("b").isNotNull(), F.lit(0.0))))
    d = d.withColumn("mad", F.percentile(F.when(c("warm"), F.abs(c("e") - c("b"))), F.lit(0.5)).over(h))
    d = d.withColumn("limit", F.when(c("b").isNotNull(), F.greatest(F.lit(3.0), 0.15 * c("b"), 3 * 1.4826 * c("mad"))))
    d = d.withColumns({"active": c("excess") > c("limit"), "hdd": F.when(c("t").isNotNull(), F.greatest(c("tau") - c("t"), F.lit(0.0)))})
    base = checkpointed(pooled(q))
    d = d.join(plateau_hours(q, base), ["mp_id", "date"], "left").withColumns({"hours": F.coalesce("hours", F.lit(0.0)), "need": F.when(c("t").isNotNull(), F.greatest(F.coalesce("tau", F.lit(15.0)) - c("t"), F.lit(0.0)))})
    d = checkpointed(d)
    in_heat = lambda x: F.when(c("heat"), x)
    beta = lambda y: F.greatest(st.slope(c("hdd"), F.when(c("hdd").isNotNull(), y)), F.lit(0.0))
    tspan = lambda t: F.max(t) - F.min(t)
    corr = lambda y: F.when((F.count(in_heat(c("t"))) >= 20) & (tspan(in_heat(c("t"))) >= 3), st.pearson(in_heat(y), in_heat(c("t"))))
    sn, sd = st.slope(c("hdd"), c("n") / 6), st.slope(c("hdd"), c("dd") / 18)
    g = d.groupBy("mp_id").agg(
        F.count(F.lit(1)).alias("days"), F.avg("e").alias("em"), F.stddev_pop("e").alias("es"), F.sum("n").alias("ns"), F.sum("dd").alias("ds"), st.mean_if(c("we"), c("e")).alias("ewe"), st.mean_if(~c("we"), c("e")).alias("ewd"), st.count_if(c("we")).alias("nwe"), st.count_if(~c("we")).alias("nwd"),
        st.count_if(c("w")).alias("nw"), st.count_if(c("s")).alias("nsu"), st.mean_if(c("w"), c("e")).alias("ew"), st.mean_if(c("s"), c("e")).alias("esu"), st.sum_if(c("w"), c("e")).alias("ews"), st.sum_if(c("w"), c("excess")).alias("exw"), corr(c("e")).alias("ct"), corr(c("n")).alias("cn"),
        F.count("t").alias("nt"), tspan(c("t")).alias("ts"), F.max("n_warm").alias("n_warm"), F.max("n_cold").alias("n_cold"), F.max("tau").alias("tau"), F.max("beta").alias("beta"), F.max("r2").alias("r2"), F.max("identified").alias("identified"), F.max("b").alias("b"), F.max("limit").alias("limit"),
        st.mean_if(c("cold"), c("e")).alias("ec"), st.mean_if(c("warm"), c("e")).alias("ewm"), st.quantile_if(c("cold"), c("excess"), 0.5).alias("exc"), st.mean_if(c("cold"), c("active").cast("double")).alias("act"), F.greatest(sn, F.when(sn.isNotNull(), F.lit(0.0))).alias("bn"), F.greatest(sd, F.when(sd.isNotNull(), F.lit(0.0))).alias("bd"),
        F.sum("hours").alias("hs"), F.avg((c("hours") > 0).cast("double")).alias("ha"), F.when(F.count("need") >= 40, st.pearson(c("hours"), c("need"))).alias("hr"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("stretch"),
    )
    years = d.where(c("identified") & c("t").isNotNull()).groupBy("mp_id", F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("n"), st.count_if(c("t") <= c("tau") - 2).alias("k1"), st.count_if(c("t") >= c("tau")).alias("k2"), F.greatest(st.slope(c("hdd"), c("e")), F.lit(0.0)).alias("b"))
    years = years.where("n >= 60 AND k1 >= 20 AND k2 >= 20").groupBy("mp_id").agg(F.count("b").alias("yn"), F.avg("b").alias("ym"), F.stddev_pop("b").alias("ys"))
    weeks = d.where(c("cold") & c("heat")).groupBy("mp_id", F.date_trunc("week", "date").alias("wk")).agg(F.count(F.lit(1)).alias("n"), st.count_if(c("active")).alias("a")).where("n >= 3").groupBy("mp_id").agg(F.count(F.lit(1)).alias("wn"), F.avg((c("a") / c("n") >= 0.5).cast("double")).alias("ws"))
    x = complete.where("channel = 'export'").select("mp_id", "date", (p.window_sum(kw) / 4).alias("x"), (p.window_sum(kw, 20, 6) / 4).alias("xn"))
    x = x.join(d.select("mp_id", "date", "e", "irr", "s"), ["mp_id", "date"])
    sx, si = F.when(c("s"), c("x")), F.when(c("s"), c("irr"))
    x = x.groupBy("mp_id").agg(F.count(F.lit(1)).alias("xc"), F.sum("x").alias("x"), F.sum("xn").alias("xn"), F.sum("e").alias("xe"), F.when(st.pairs(sx, si) >= 20, st.pearson(sx, si)).alias("xi"))
    high = cold_high_load(q, d.where("b IS NOT NULL AND n_cold >= 20").select("mp_id", "date", "warm", "cold"))
    a = g.where(c("days") >= MIN_DAYS)
    for t in (base, years, weeks, x.where("xc >= 20"), high, fixed_time(q, base)):
        a = a.join(t, "mp_id", "left")
    fits, warm, cold = c("tau").isNotNull(), c("b").isNotNull(), c("b").isNotNull() & (c("n_cold") >= 20)
    when = F.when
    feats = {
        "hp_daily_import_temperature_corr": c("ct"), "hp_hdd_year_slope_stability": when((c("yn") >= 2) & (c("ym") > 1e-6), 1 / (1 + c("ys") / when(c("ym") > 1e-6, c("ym")))), "hp_balance_temperature_c": when(c("identified"), c("tau")), "hp_hdd_slope_kwh_per_degree_day": when(fits, c("beta")),
        "hp_hdd_slope_normalized": when(fits, ratio(c("beta"), c("b"), 1.0)), "hp_hdd_response_r2": when(fits, c("r2")), "hp_cold_mild_daily_energy_ratio": when(cold, ratio(c("ec"), c("ewm"))), "hp_winter_summer_daily_energy_ratio": when((c("nw") >= 20) & (c("nsu") >= 20), ratio(c("ew"), c("esu"))),
        "hp_heating_excess_share_winter": when(warm & (c("nw") >= 20), ratio(c("exw"), c("ews"))), "hp_cold_day_heating_excess_kwh": when(cold, c("exc")), "hp_cold_day_active_fraction": when(cold, c("act")), "hp_winter_baseload_increase_kw": when((c("nw") >= 20) & (c("nsu") >= 20), c("p20w") - c("p20s")),
        "hp_winter_load_factor": when(c("nw") >= 20, ratio(c("pmw"), c("p95w"))), "hp_winter_minus_summer_load_factor": when((c("nw") >= 20) & (c("nsu") >= 20), ratio(c("pmw"), c("p95w")) - ratio(c("pms"), c("p95s"))), "hp_cold_night_temperature_corr": c("cn"),
        "hp_night_day_temperature_sensitivity_ratio": when(fits, ratio(c("bn"), c("bd"), 0.01)), "hp_cold_weather_high_load_hours_per_day": when(cold, c("high_hours")), "hp_heating_season_persistence": when(cold & (c("wn") >= 4), c("ws")),
        "general_mean_daily_import_kwh": c("em"), "general_median_import_power_kw": c("p50"), "general_p95_import_power_kw": c("p95"), "general_daily_energy_cv": ratio(c("es"), c("em")), "general_night_day_energy_ratio": ratio(c("ns"), c("ds")),
        "general_weekend_weekday_energy_ratio": when((c("nwe") >= 20) & (c("nwd") >= 20), ratio(c("ewe"), c("ewd"))), "general_load_factor_all_year": ratio(c("pm"), c("p95")), "conf_export_to_import_ratio": ratio(c("x"), c("xe")), "conf_export_irradiance_corr": c("xi"), "conf_night_export_share": ratio(c("xn"), c("x"), 0.1),
        "conf_evening_long_plateau_score": when((c("nt") >= 40) & (c("ts") >= 8), when(c("hs") == 0, F.lit(0.0)).otherwise(c("hs") / (24 * c("days")) * 4 * c("ha") * (1 - c("ha")) * (1 - F.pow(F.greatest(c("hr"), when(c("hr").isNotNull(), F.lit(0.0))), F.lit(2))))),
        "conf_fixed_time_daily_load_concentration": when(c("starts") >= 20, F.greatest((c("mass") - 1 / 12) / (1 - 1 / 12), F.lit(0.0)) * c("active") / c("days")),
    }
    table = a.select("mp_id", *[v.alias(n) for n, v in feats.items()], c("days").alias("n_days"), c("nt").alias("n_common_weather_days"), c("n_cold").alias("n_cold_days"), c("n_warm").alias("n_warm_days"), c("tau").alias("balance_candidate_c"), F.coalesce("identified", F.lit(False)).alias("balance_identified"), c("b").alias("warm_day_baseline_kwh"), c("limit").alias("active_excess_threshold_kwh"), (c("days") / c("stretch")).alias("data_coverage_ratio"))
    few = g.where(c("days") < MIN_DAYS).select("mp_id", c("days").alias("n_days"), (c("days") / c("stretch")).alias("data_coverage_ratio"))
    return table.unionByName(few, allowMissingColumns=True)


def median_fill(table: DataFrame, features: list[str]) -> DataFrame:
    """Nulls replaced by the feature's median; features without any value are dropped."""
    stats = table.agg(*[F.percentile(f, F.lit(0.5)).alias(f) for f in features]).first()
    kept = [f for f in features if stats[f] is not None]
    return table.select(*[F.coalesce(F.col(c), F.lit(stats[c])).alias(c) if c in kept else F.col(c) for c in table.columns if c not in features or c in kept])
