"""Battery pack: 20 features and 9 quality columns per house."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators.days import EXPORT_NOISE_KW, EXPORT_REAL_KW, ZERO_KW, season_or_all

OFFSOLAR_KWH, RAMP_KW, CHARGE_KW = 0.02, 0.30, 0.50
#: Neutral values (fixed).
FILLS = {
    "export_kwh_total": 0.0, "export_days_frac": 0.0, "export_offsolar_over_import": 0.0, "export_offsolar_days_frac": 0.0, "export_flat_plateau_frac": 0.0, "export_bursts_per_day": 0.0, "export_max_kw": 0.0, "export_max_over_mean_import": 0.0,
    "export_summer_winter_flatness": 0.0, "import_zero_hours_night": 0.0, "import_night_charge_kw_over_mean": 0.0, "import_night_charge_flatness": 1.0, "import_night_charge_persistence": 0.0, "import_evening_peak_suppression": 0.0, "import_ramp_events_night": 0.0,
    "import_zero_hours_midday_allyear": 0.0, "import_seasonal_flatness": 0.0, "import_midday_night_ratio_allyear": 1.0, "daily_activity_cycles": 0.0, "self_consumption_shift_score": 0.0, "has_real_export": 0, "export_max_raw_kw": 0.0, "mean_import_kw": 0.0,
}


def days_table(days: DataFrame) -> DataFrame:
    kw, c = F.col("kw"), F.col
    zero = lambda v: v <= ZERO_KW
    d = days.select(
        "mp_id", "channel", "date", "n_neg", "vmax_raw",
        *[p.window_sum(kw, *w).alias(n) for n, w in {"tot": (0, 24), "mid_tot": (11, 15), "peak_tot": (17, 21), "night_tot": (22, 6), "charge_sum": (23, 6)}.items()],
        *[p.window_count(kw, *w).alias(n) for n, w in {"n_valid": (0, 24), "n_mid": (11, 15), "n_peak": (17, 21), "n_night": (22, 6), "n_day": (9, 17), "n_charge": (23, 6)}.items()],
        p.largest(kw).alias("vmax"), p.window_count(kw, 22, 6, zero).alias("zero_night"), p.window_count(kw, 9, 17, zero).alias("zero_day"), p.window_sum(kw, 23, 6, lambda v, k: v * v).alias("charge_sq"),
        p.bits(kw, lambda v, k: v > EXPORT_NOISE_KW).alias("active"), p.bits(kw, lambda v, k: v > CHARGE_KW, p.slots(23, 6)).alias("charging"),
        p.balanced([F.when(F.abs(F.coalesce(p.at(kw, k + 1), F.lit(0.0)) - F.coalesce(p.at(kw, k), F.lit(0.0))) > RAMP_KW, F.lit(1)).otherwise(F.lit(0)) for k in range(95) if {k, k + 1} <= set(p.slots(22, 6))]).cast("long").alias("ramps"),
        p.window_count(kw, test=lambda v: (v > EXPORT_NOISE_KW) & (v >= 0.9 * p.largest(kw))).alias("near_max"),
    )
    return p.sealed(d).withColumns({"bursts": p.rising_edges(c("active")), "charge_bursts": p.rising_edges(c("charging")), "plateau": st.ratio(c("near_max"), p.ones(c("active")))}).drop("active", "charging", "near_max")


def bat20(days: DataFrame) -> DataFrame:
    c, eps = F.col, F.lit(ZERO_KW)
    i, e = c("channel") == "import", c("channel") == "export"
    d = season_or_all(season_or_all(days_table(days), p.SUMMER, "s", ["mp_id", "channel"]), p.WINTER, "w", ["mp_id", "channel"])
    w = Window.partitionBy("mp_id")
    mean_import = F.coalesce(F.sum(F.when(i, c("tot"))).over(w) / F.greatest(F.sum(F.when(i, c("n_valid"))).over(w), F.lit(1)), F.lit(0.0))
    charge = c("charge_sum") / F.greatest(c("n_charge"), F.lit(1))
    ok_c, ok_p = i & (c("n_charge") >= 0.9 * 28), i & (c("n_peak") >= 0.9 * 16) & (c("n_valid") - c("n_peak") > 0)
    ok_m = i & (c("n_mid") >= 0.9 * 16) & (c("n_night") >= 0.9 * 32)
    d = d.withColumns({"mean_import": mean_import, "charge": charge, "cv": F.sqrt(F.greatest(c("charge_sq") / F.greatest(c("n_charge"), F.lit(1)) - charge * charge, F.lit(0.0))) / F.greatest(charge, eps)})
    rest = (c("tot") - c("peak_tot")) / F.greatest(c("n_valid") - c("n_peak"), F.lit(1))
    # Both channels of a day side by side, for the correlation.
    day = Window.partitionBy("mp_id", "date")
    d = d.withColumn("paired", F.when(i, F.max(F.when(e, c("mid_tot"))).over(day)))
    summer, winter = F.month("date").isin(*p.SUMMER), F.month("date").isin(*p.WINTER)
    x, y = c("paired"), F.when(i, c("peak_tot"))
    g = d.groupBy("mp_id").agg(
        st.count_if(i).alias("n_days"), st.count_if(i & summer).alias("n_summer_days"), st.count_if(i & winter).alias("n_winter_days"), F.max(e.cast("long")).alias("has_export_register"), F.max(F.when(e, c("vmax_raw"))).alias("raw"), F.sum("n_neg").alias("n_negative_raw"),
        F.max("mean_import").alias("mi"), st.sum_if(i, c("tot")).alias("i"), st.sum_if(i & c("s"), c("tot")).alias("is"), st.sum_if(i & c("w"), c("tot")).alias("iw"), st.count_if(i & c("s")).alias("nis"), st.count_if(i & c("w")).alias("niw"),
        st.sum_if(e, c("tot")).alias("e"), st.sum_if(e & c("s"), c("tot")).alias("es"), st.sum_if(e & c("w"), c("tot")).alias("ew"), st.count_if(e & (c("tot") / 4 > 0.1)).alias("edays"), st.sum_if(e, c("night_tot")).alias("enight"), st.count_if(e & (c("night_tot") / 4 > OFFSOLAR_KWH)).alias("eoff"),
        st.mean_if(e, c("plateau")).alias("plateau"), st.mean_if(e, c("bursts")).alias("bursts"), st.quantile_if(e, c("vmax"), 0.95).alias("emax"), st.mean_if(i & (c("n_night") >= 0.9 * 32), c("zero_night")).alias("znight"),
        st.quantile_if(ok_c, c("charge"), 0.95).alias("charge95"), st.mean_if(ok_c, c("cv")).alias("cv"), st.mean_if(ok_c, (c("charge") > 1.5 * c("mean_import")).cast("double")).alias("above"),
        st.mean_if(ok_p, 1 - (c("peak_tot") / F.greatest(c("n_peak"), F.lit(1))) / F.greatest(rest, eps)).alias("suppression"), st.mean_if(i, c("ramps")).alias("ramps"), st.mean_if(i & (c("n_day") >= 0.9 * 32), c("zero_day")).alias("zday"),
        st.mean_if(ok_m, c("mid_tot") / F.greatest(c("n_mid"), F.lit(1))).alias("mid"), st.mean_if(ok_m, c("night_tot") / F.greatest(c("n_night"), F.lit(1))).alias("night"), st.mean_if(i, c("charge_bursts")).alias("cbursts"),
        F.when(st.pairs(x, y) >= 10, st.pearson(x, y)).alias("shift"),
    ).where("n_days > 0")
    z = lambda n, v=0.0: F.coalesce(c(n), F.lit(v))
    per = lambda n, k: z(n) / F.greatest(c(k), F.lit(1))
    feats = {
        "export_kwh_total": z("e") / 4, "export_days_frac": c("edays") / c("n_days"), "export_offsolar_over_import": z("enight") / F.greatest(z("i"), eps), "export_offsolar_days_frac": c("eoff") / c("n_days"), "export_flat_plateau_frac": z("plateau"),
        "export_bursts_per_day": z("bursts"), "export_max_kw": z("emax"), "export_max_over_mean_import": z("emax") / F.greatest(z("mi"), eps), "export_summer_winter_flatness": st.flatness(per("es", "nis") / 4, per("ew", "niw") / 4, ZERO_KW),
        "import_zero_hours_night": z("znight") / 4, "import_night_charge_kw_over_mean": z("charge95") / F.greatest(z("mi"), eps), "import_night_charge_flatness": z("cv", 1.0), "import_night_charge_persistence": z("above"), "import_evening_peak_suppression": z("suppression"),
        "import_ramp_events_night": z("ramps"), "import_zero_hours_midday_allyear": z("zday") / 4, "import_seasonal_flatness": st.flatness(per("is", "nis"), per("iw", "niw"), ZERO_KW), "import_midday_night_ratio_allyear": z("mid") / F.greatest(z("night"), eps),
        "daily_activity_cycles": z("bursts") + z("cbursts"), "self_consumption_shift_score": F.coalesce(-c("shift"), F.lit(0.0)),
    }
    out = g.select("mp_id", *[x.alias(n) for n, x in feats.items()], "n_days", "n_summer_days", "n_winter_days", "has_export_register", (z("emax") >= EXPORT_REAL_KW).cast("long").alias("has_real_export"), z("raw").alias("export_max_raw_kw"), z("mi").alias("mean_import_kw"), "n_negative_raw")
    return out.withColumn("has_offsolar_export", (c("export_offsolar_days_frac") > 0.02).cast("long"))
