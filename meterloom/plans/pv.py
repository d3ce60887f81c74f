"""Photovoltaic packs: pv20s (null where not computable), pv20t (always a number), pv21 and pv25 (with weather)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators import weather as wx
from meterloom.operators.days import EXPORT_REAL_KW, ZERO_KW, in_season, season_or_all

NOON = 13.5
MIN_DAYS = 20
EXPORT = ["export_kwh_total", "export_days_frac", "export_to_import_ratio_summer", "export_to_import_ratio_winter", "export_winter_share", "export_midday_share_summer", "export_night_share", "export_mean_hour_summer", "export_hour_std_summer", "export_max_kw"]
SHAPE = ["export_winter_share", "export_midday_share_summer", "export_night_share", "export_mean_hour_summer", "export_hour_std_summer"]
IMPORT = ["import_midday_night_ratio_summer", "import_midday_night_ratio_winter", "import_zero_hours_midday_summer", "import_zero_hours_night", "import_midday_share_winter_minus_summer", "import_min_hour_offset_noon_summer", "import_summer_to_winter_ratio", "import_daylight_share_summer", "import_midday_spread_over_night_summer", "import_midday_p05_over_night_summer"]
WEATHER = ["weather_export_irradiance_corr_summer", "weather_sunny_cloudy_export_contrast_summer", "weather_export_per_irradiation_summer", "weather_midday_import_irradiance_corr_summer", "weather_winter_import_temperature_corr"]

#: Neutral values (fixed): what a house without the asset shows.
FILLS_20T = {
    "export_kwh_total": 0.0, "export_days_frac": 0.0, "export_to_import_ratio_summer": 0.0, "export_to_import_ratio_winter": 0.0, "export_night_over_import": 0.0, "export_midday_minus_evening_over_import_summer": 0.0,
    "export_max_kw": 0.0, "export_max_over_mean_import": 0.0, "export_summer_minus_winter_over_import": 0.0, "export_midday_over_import_summer": 0.0, "import_midday_night_ratio_summer": 1.0, "import_midday_night_ratio_winter": 1.0,
    "import_zero_hours_midday_summer": 0.0, "import_zero_hours_night": 0.0, "import_midday_share_winter_minus_summer": 0.0, "import_min_hour_offset_noon_summer": 12.0, "import_summer_to_winter_ratio": 1.0,
    "import_daylight_share_summer": 1.0 / 3.0, "import_midday_spread_over_night_summer": 0.0, "import_midday_p05_over_night_summer": 1.0, "has_real_export": 0, "export_max_raw_kw": 0.0, "mean_import_kw": 0.0,
}
FILLS_25 = {
    "export_kwh_total": 0.0, "export_days_frac": 0.0, "export_to_import_ratio_summer": 0.0, "export_to_import_ratio_winter": 0.0, "export_winter_share": 0.5, "export_midday_share_summer": 8.0 / 24.0, "export_night_share": 10.0 / 24.0,
    "export_mean_hour_summer": 12.0, "export_hour_std_summer": 24.0 / math.sqrt(12.0), "export_max_kw": 0.0, "import_midday_night_ratio_summer": 1.0, "import_midday_night_ratio_winter": 1.0, "import_zero_hours_midday_summer": 0.0,
    "import_zero_hours_night": 0.0, "import_midday_share_winter_minus_summer": 0.0, "import_min_hour_offset_noon_summer": 12.0, "import_summer_to_winter_ratio": 1.0, "import_daylight_share_summer": 8.0 / 24.0,
    "import_midday_spread_over_night_summer": 0.0, "import_midday_p05_over_night_summer": 1.0, "weather_export_irradiance_corr_summer": 0.0, "weather_sunny_cloudy_export_contrast_summer": 0.0, "weather_export_per_irradiation_summer": 0.0,
    "weather_midday_import_irradiance_corr_summer": 0.0, "weather_winter_import_temperature_corr": 0.0, "has_real_export": 0, "export_max_raw_kw": 0.0, "mean_import_kw": 0.0,
}


def days_table(days: DataFrame) -> DataFrame:
    """The numbers of each house-day that the photovoltaic features are built from."""
    kw = F.col("kw")
    zero = lambda v: v <= ZERO_KW
    sums = {"tot": (0, 24), "mid_tot": (11, 15), "day_tot": (9, 17), "late_tot": (20, 6), "eve_tot": (17, 23)}
    out = days.select(
        "mp_id", "channel", "date", "n_neg", "vmax_raw",
        *[p.window_sum(kw, *w).alias(n) for n, w in sums.items()],
        st.ratio(p.window_sum(kw, 11, 15), p.window_count(kw, 11, 15)).alias("mid_mean"), st.ratio(p.window_sum(kw, 1, 5), p.window_count(kw, 1, 5)).alias("night_mean"),
        p.weighted(kw, 1).alias("hw"), p.weighted(kw, 2).alias("hw2"), p.largest(kw).alias("vmax"),
        p.window_count(kw, 9, 17, zero).alias("zero_q_mid"), p.window_count(kw, 22, 6, zero).alias("zero_q_night"),
        p.window_count(kw).alias("n_valid"), p.window_count(kw, 9, 17).alias("n_valid_day"), p.window_count(kw, 22, 6).alias("n_valid_night"),
        p.hourly_means(kw).alias("hours"),
    )
    return p.sealed(out).withColumn("min_hour", p.min_hour(F.col("hours"))).drop("hours")


def _quality(i: Column, e: Column) -> list[Column]:
    return [
        st.count_if(i).alias("n_days"), st.count_if(i & in_season(p.SUMMER)).alias("n_summer_days"), st.count_if(i & in_season(p.WINTER)).alias("n_winter_days"),
        F.max(e.cast("long")).alias("has_export_register"), F.max(F.when(e, F.col("vmax_raw"))).alias("export_max_raw_kw"), F.sum("n_neg").alias("n_negative_raw"),
    ]


def pv20s(days: DataFrame) -> DataFrame:
    """20 features and 8 quality columns per house with import days; a feature is null unless its gate holds."""
    d = days_table(days)
    i, e = F.col("channel") == "import", F.col("channel") == "export"
    s, w = in_season(p.SUMMER), in_season(p.WINTER)
    c = F.col
    full, full_day, full_night = c("n_valid") >= 0.9 * 96, c("n_valid_day") >= 0.9 * 32, c("n_valid_night") >= 0.9 * 32
    shared = (c("tot") > 0) & full
    g = d.groupBy("mp_id").agg(
        *_quality(i, e),
        st.sum_if(e, c("tot")).alias("e"), st.sum_if(e & s, c("tot")).alias("es"), st.sum_if(e & w, c("tot")).alias("ew"), st.count_if(e & s).alias("nes"), st.count_if(e & w).alias("new"),
        st.mean_if(e, (c("tot") / 4 > 0.1).cast("double")).alias("edays"), st.sum_if(i & s, c("tot")).alias("is"), st.sum_if(i & w, c("tot")).alias("iw"), st.sum_if(i, c("tot")).alias("i"), st.sum_if(i, c("n_valid")).alias("nv"),
        st.sum_if(e & s, c("day_tot")).alias("esday"), st.sum_if(e, c("late_tot")).alias("elate"), st.sum_if(e & s, c("hw")).alias("hw"), st.sum_if(e & s, c("hw2")).alias("hw2"), st.quantile_if(e, c("vmax"), 0.95).alias("emax"),
        st.mean_if(i & s, c("mid_mean")).alias("mids"), st.mean_if(i & w, c("mid_mean")).alias("midw"), st.mean_if(i & s, c("night_mean")).alias("nights"), st.mean_if(i & w, c("night_mean")).alias("nightw"),
        st.mean_if(i & s & full_day, c("zero_q_mid")).alias("zmid"), st.count_if(i & s & full_day).alias("nzmid"), st.mean_if(i & full_night, c("zero_q_night")).alias("znight"), st.count_if(i & full_night).alias("nznight"),
        st.mean_if(i & w & shared, c("mid_tot") / F.when(c("tot") > 0, c("tot"))).alias("sw"), st.count_if(i & w & shared).alias("nsw"), st.mean_if(i & s & shared, c("mid_tot") / F.when(c("tot") > 0, c("tot"))).alias("ss"), st.count_if(i & s & shared).alias("nss"),
        st.mean_if(i & s & shared, c("day_tot") / F.when(c("tot") > 0, c("tot"))).alias("sday"), st.mean_if(i & s & full, F.abs(c("min_hour") - NOON)).alias("moff"), st.count_if(i & s & full).alias("nmoff"),
        st.quantile_if(i & s, c("mid_mean"), 0.95).alias("m95"), st.quantile_if(i & s, c("mid_mean"), 0.05).alias("m05"), st.mean_if(i & s, c("tot")).alias("ms"), st.mean_if(i & w, c("tot")).alias("mw"),
    ).where("n_days > 0")
    valid = lambda x, *n: F.when(F.least(*[c(k) for k in n], F.lit(1 << 40)) >= MIN_DAYS, x)
    pds, pdw = st.ratio(c("es"), c("nes")), st.ratio(c("ew"), c("new"))
    both = F.coalesce(pds + pdw, pds, pdw)
    mean_h = st.ratio(c("hw"), c("es"))
    has = c("has_export_register") == 1
    feats = {
        "export_kwh_total": valid(c("e") / 4, "n_days"), "export_days_frac": valid(c("edays"), "n_days"), "export_to_import_ratio_summer": valid(st.ratio(c("es"), c("is")), "n_summer_days"), "export_to_import_ratio_winter": valid(st.ratio(c("ew"), c("iw")), "n_winter_days"),
        "export_winter_share": valid(st.ratio(F.coalesce(pdw, F.lit(0.0)), both), "n_summer_days", "n_winter_days"), "export_midday_share_summer": valid(st.ratio(c("esday"), c("es")), "n_summer_days"), "export_night_share": valid(st.ratio(c("elate"), c("e")), "n_days"),
        "export_mean_hour_summer": valid(mean_h, "n_summer_days"), "export_hour_std_summer": valid(F.sqrt(F.greatest(st.ratio(c("hw2"), c("es")) - mean_h * mean_h, F.when(mean_h.isNotNull(), F.lit(0.0)))), "n_summer_days"), "export_max_kw": valid(c("emax"), "n_days"),
        "import_midday_night_ratio_summer": valid(st.ratio(c("mids"), c("nights")), "n_summer_days"), "import_midday_night_ratio_winter": valid(st.ratio(c("midw"), c("nightw")), "n_winter_days"),
        "import_zero_hours_midday_summer": valid(c("zmid") / 4, "nzmid"), "import_zero_hours_night": valid(c("znight") / 4, "nznight"), "import_midday_share_winter_minus_summer": valid(c("sw"), "nsw") - valid(c("ss"), "nss"),
        "import_min_hour_offset_noon_summer": valid(c("moff"), "nmoff"), "import_summer_to_winter_ratio": valid(st.ratio(c("ms"), c("mw")), "n_summer_days", "n_winter_days"), "import_daylight_share_summer": valid(c("sday"), "nss"),
        "import_midday_spread_over_night_summer": valid(st.ratio(c("m95") - c("m05"), c("nights")), "n_summer_days"), "import_midday_p05_over_night_summer": valid(st.ratio(c("m05"), c("nights")), "n_summer_days"),
    }
    real = F.coalesce(has & (feats["export_max_kw"] >= EXPORT_REAL_KW), F.lit(False))
    out = {n: F.when(real, x) if n in SHAPE else F.when(has, x) if n in EXPORT else x for n, x in feats.items()}
    return g.select("mp_id", *[x.alias(n) for n, x in out.items()], "n_days", "n_summer_days", "n_winter_days", "has_export_register", F.when(has, real.cast("long")).alias("has_real_export"), "export_max_raw_kw", st.ratio(c("i"), c("nv")).alias("mean_import_kw"), "n_negative_raw")


def _total_features(d: DataFrame) -> DataFrame:
    """The features of pv20t from the day table with the flags s and w of season-or-all."""
    i, e, c = F.col("channel") == "import", F.col("channel") == "export", F.col
    s, w, eps = c("s"), c("w"), F.lit(ZERO_KW)
    full, full_day, full_night = c("n_valid") >= 0.9 * 96, c("n_valid_day") >= 0.9 * 32, c("n_valid_night") >= 0.9 * 32
    shared = (c("tot") > 0) & full
    share = lambda t, col: st.mean_if(i & t & shared, c(col) / F.when(c("tot") > 0, c("tot")))
    g = d.groupBy("mp_id").agg(
        *_quality(i, e),
        st.sum_if(i, c("tot")).alias("i"), st.sum_if(i & s, c("tot")).alias("is"), st.sum_if(i & w, c("tot")).alias("iw"), st.count_if(i & s).alias("nis"), st.count_if(i & w).alias("niw"), st.sum_if(i, c("n_valid")).alias("nv"),
        st.sum_if(e, c("tot")).alias("e"), st.sum_if(e & s, c("tot")).alias("es"), st.sum_if(e & w, c("tot")).alias("ew"), st.count_if(e & (c("tot") / 4 > 0.1)).alias("edays"), st.sum_if(e & s, c("day_tot")).alias("esday"), st.sum_if(e, c("late_tot")).alias("elate"),
        st.sum_if(e & s, c("mid_tot")).alias("esmid"), st.sum_if(e & s, c("eve_tot")).alias("eseve"), st.quantile_if(e, c("vmax"), 0.95).alias("emax"),
        st.mean_if(i & s, c("night_mean")).alias("nights"), st.mean_if(i & w, c("night_mean")).alias("nightw"), st.mean_if(i & s, c("mid_mean")).alias("mids"), st.mean_if(i & w, c("mid_mean")).alias("midw"),
        st.mean_if(i & s & full_day, c("zero_q_mid")).alias("zmid"), st.mean_if(i & full_night, c("zero_q_night")).alias("znight"), share(w, "mid_tot").alias("sw"), share(s, "mid_tot").alias("ss"), share(s, "day_tot").alias("sday"),
        st.mean_if(i & s & full, F.abs(c("min_hour") - NOON)).alias("moff"), st.quantile_if(i & s, c("mid_mean"), 0.95).alias("m95"), st.quantile_if(i & s, c("mid_mean"), 0.05).alias("m05"),
    ).where("n_days > 0")
    z = lambda x, fill=0.0: F.coalesce(c(x) if isinstance(x, str) else x, F.lit(fill))
    one = lambda x: F.greatest(c(x), F.lit(1))
    mean_import = z(c("i") / F.greatest(c("nv"), F.lit(1)))
    den = lambda x: F.greatest(z(x), eps)
    nights, nightw = den("nights"), den("nightw")
    feats = {
        "export_kwh_total": z("e") / 4, "export_days_frac": c("edays") / one("n_days"), "export_to_import_ratio_summer": z("es") / den("is"), "export_to_import_ratio_winter": z("ew") / den("iw"), "export_midday_over_import_summer": z("esday") / den("is"),
        "export_night_over_import": z("elate") / den("i"), "export_midday_minus_evening_over_import_summer": (z("esmid") - z("eseve")) / den("is"), "export_max_kw": z("emax"), "export_max_over_mean_import": z("emax") / F.greatest(mean_import, eps),
        "export_summer_minus_winter_over_import": (z("es") / one("nis") - z("ew") / one("niw")) / F.greatest(z("i") / one("n_days"), eps),
        "import_midday_night_ratio_summer": z("mids") / nights, "import_midday_night_ratio_winter": z("midw") / nightw, "import_zero_hours_midday_summer": z("zmid") / 4, "import_zero_hours_night": z("znight") / 4,
        "import_midday_share_winter_minus_summer": z("sw", 1 / 6) - z("ss", 1 / 6), "import_min_hour_offset_noon_summer": z("moff", 12.0), "import_summer_to_winter_ratio": (z("is") / one("nis")) / F.greatest(z("iw") / one("niw"), eps),
        "import_daylight_share_summer": z("sday", 1 / 3), "import_midday_spread_over_night_summer": z(c("m95") - c("m05")) / nights, "import_midday_p05_over_night_summer": z("m05") / nights,
    }
    return g.select("mp_id", *[x.alias(n) for n, x in feats.items()], "n_days", "n_summer_days", "n_winter_days", "has_export_register", (z("emax") >= EXPORT_REAL_KW).cast("long").alias("has_real_export"), z("export_max_raw_kw").alias("export_max_raw_kw"), mean_import.alias("mean_import_kw"), "n_negative_raw")


def _flagged(days: DataFrame) -> DataFrame:
    i = F.col("channel") == "import"
    return season_or_all(season_or_all(days_table(days), p.SUMMER, "s", ["mp_id"], i), p.WINTER, "w", ["mp_id"], i)


def pv20t(days: DataFrame) -> DataFrame:
    """20 features that are numbers for every house, and 8 quality columns."""
    return _total_features(_flagged(days))


def pv21(days: DataFrame, irradiation: DataFrame) -> DataFrame:
    """pv20t and the slope of net daylight import on irradiation (date, irr in kWh/m2 from 9 to 17 h)."""
    d = _flagged(days)
    c = F.col
    e = d.where("channel = 'export' AND s").select("mp_id", "date", F.col("day_tot").alias("exported"))
    x = d.where((c("channel") == "import") & c("s") & (c("n_valid_day") >= 0.9 * 32)).join(e, ["mp_id", "date"], "left").join(F.broadcast(irradiation.select("date", "irr")), "date").where("irr IS NOT NULL")
    y = (c("day_tot") - F.coalesce(c("exported"), F.lit(0.0))) / 4
    fit = x.groupBy("mp_id").agg(F.count(F.lit(1)).alias("n_irr_days"), F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("irr") > 0.1**2), st.slope(c("irr"), y)).alias("b"))
    return _total_features(d).join(fit, "mp_id", "left").select(
        "*", F.coalesce(-c("b"), F.lit(0.0)).alias("irr_net_slope_kw_summer"), F.coalesce("n_irr_days", F.lit(0)).cast("long").alias("__n")).drop("b", "n_irr_days").withColumnRenamed("__n", "n_irr_days")


def fill(table: DataFrame, values: dict, counted: list[str] | None = None) -> DataFrame:
    """Nulls replaced by neutral values; with `counted`, n_filled_features says how many of those were null."""
    if counted:
        table = table.withColumn("n_filled_features", sum((F.col(n).isNull().cast("long") for n in counted), F.lit(0).cast("long")))
    return table.select(*[F.coalesce(F.col(n), F.lit(values[n]).cast(t)).alias(n) if n in values else F.col(n) for n, t in table.dtypes])


def electricity(days: DataFrame) -> DataFrame:
    """Per house and day: import_kwh, midday_import_kwh and export_kwh, null unless all their slots are there."""
    kw = F.col("kw")
    d = days.select("mp_id", "date", "channel", (p.window_sum(kw) / 4).alias("kwh"), (p.window_sum(kw, 9, 17) / 4).alias("mid"), p.window_count(kw).alias("n"))
    d = d.groupBy("mp_id", "date").agg(*[F.max(F.when(F.col("channel") == ch, F.struct("kwh", "mid", "n"))).alias(ch[:1]) for ch in ("import", "export")]).where("i IS NOT NULL")
    whole = lambda ch, x: F.when(F.col(f"{ch}.n") >= 96, F.col(f"{ch}.{x}"))
    return d.select("mp_id", "date", whole("i", "kwh").alias("import_kwh"), whole("i", "mid").alias("midday_import_kwh"), whole("e", "kwh").alias("export_kwh"))


def weather_features(days: DataFrame, weather: DataFrame, choice: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Five features per house from its station's weather.

    weather: station, date, irr, midday, temp_c; choice: mp_id, station, temp_station.
    """
    c = F.col
    e = electricity(days).join(choice.select("mp_id", "station", "temp_station"), "mp_id")
    sun = weather.select("station", "date", "irr", "midday")
    warm = weather.select(c("station").alias("temp_station"), "date", "temp_c")
    j = e.join(sun, ["station", "date"]).join(warm, ["temp_station", "date"], "left")
    s, w = in_season(p.SUMMER), in_season(p.WINTER)
    x, r = c("export_kwh"), c("irr")
    both = s & x.isNotNull() & r.isNotNull()
    cut = Window.partitionBy("mp_id")
    j = j.withColumns({"hi": F.percentile(F.when(both, r), F.lit(0.75)).over(cut), "lo": F.percentile(F.when(both, r), F.lit(0.25)).over(cut)})
    on = lambda t, v: F.when(t, v)
    gated = lambda n, v, k=min_days: F.when(n >= k, v)
    g = j.groupBy("mp_id").agg(
        gated(st.pairs(on(s, x), r), st.pearson(on(s, x), r)).alias(WEATHER[0]), st.count_if(both).alias("nb"), st.mean_if(s & (r >= c("hi")), x).alias("sunny"), F.count(on(s & (r >= c("hi")), x)).alias("nsunny"), st.mean_if(s & (r <= c("lo")), x).alias("cloudy"),
        F.count(on(s & (r <= c("lo")), x)).alias("ncloudy"), st.sum_if(both, x).alias("sx"), st.sum_if(both, r).alias("sr"), gated(st.pairs(on(s, c("midday_import_kwh")), c("midday")), st.pearson(on(s, c("midday_import_kwh")), c("midday"))).alias(WEATHER[3]),
        gated(st.pairs(on(w, c("import_kwh")), c("temp_c")), st.pearson(on(w, c("import_kwh")), c("temp_c"))).alias(WEATHER[4]), st.count_if(s & c("midday_import_kwh").isNotNull() & c("midday").isNotNull()).alias("weather_common_summer_days"),
        st.count_if(w & c("import_kwh").isNotNull() & c("temp_c").isNotNull()).alias("weather_common_winter_days"),
    )
    enough = (c("nb") >= min_days) & (c("nsunny") >= 5) & (c("ncloudy") >= 5)
    return g.select("mp_id", WEATHER[0], F.when(enough, st.contrast(c("sunny"), c("cloudy"))).alias(WEATHER[1]), F.when(c("nb") >= min_days, st.ratio(c("sx"), c("sr"))).alias(WEATHER[2]), WEATHER[3], WEATHER[4], "weather_common_summer_days", "weather_common_winter_days")


def pv25(days: DataFrame, weather: DataFrame, house_geo: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """pv20s and five weather features; house_geo: mp_id, plz, lat, lon; weather: station, date, irr, midday, temp_c, lat, lon."""
    choice = wx.choose_stations(house_geo, weather, days.select("date").distinct())
    out = pv20s(days).join(weather_features(days, weather, choice), "mp_id", "left").join(choice, "mp_id", "left")
    out = out.withColumns({"weather_common_summer_days": F.coalesce("weather_common_summer_days", F.lit(0)).cast("long"), "weather_common_winter_days": F.coalesce("weather_common_winter_days", F.lit(0)).cast("long")})
    return out if keep_nulls else fill(out, FILLS_25, EXPORT + IMPORT + WEATHER)
