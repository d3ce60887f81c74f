"""Queries of the heat-response pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.functions import profiles as p
from meterloom.operators import weather as wx
from meterloom.operators.days import complete_days, strict_days
from meterloom.plans import hp30 as hp
from meterloom.queries.base import SUMMER, WINTER, cols, query
from meterloom.queries.pv import house_geo
from meterloom.session import checkpointed

_R = lambda a, b, f="1e-9": f"(({a}) / CASE WHEN ({b}) > {f} THEN ({b}) END)"
_C = lambda a, b, n: f"CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= {n} AND stddev_pop({a}) FILTER ({b} IS NOT NULL) > 1e-9 AND stddev_pop({b}) FILTER ({a} IS NOT NULL) > 1e-9 THEN covar_pop({a}, {b}) / (stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL)) END"
#: Strict, complete import and export days as slots; the chosen stations; daily rows.
QS = """mneg AS (SELECT *, min(wh) OVER (PARTITION BY m, channel) < 0 AS bad FROM raw),
ss AS (SELECT mp_id, channel, date, CAST(k AS INTEGER) AS k, CASE WHEN count(*) = count(CASE WHEN bad THEN NULL ELSE v END) THEN sum(v) END AS v FROM (SELECT *, CASE WHEN channel = 'export' AND wh / 256.0::DOUBLE < 0.05 THEN 0::DOUBLE ELSE wh / 256.0::DOUBLE END AS v FROM mneg) GROUP BY ALL),
okd AS (SELECT mp_id, channel, date FROM ss GROUP BY ALL HAVING count(v) = 96 AND date NOT IN (DATE '2023-03-26', DATE '2023-10-29', DATE '2024-03-31', DATE '2024-10-27')),
qs AS MATERIALIZED (SELECT ss.* FROM ss JOIN okd USING (mp_id, channel, date)),
q AS (SELECT mp_id, date, k, v FROM qs WHERE channel = 'import'),
hg AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS mp_id, CAST(l_suppkey % 25 AS VARCHAR) AS plz FROM lineitem),
rk AS (SELECT plz, station, km, row_number() OVER (PARTITION BY plz ORDER BY km, station) AS rank FROM (SELECT pl.plz, st.station,
  2 * 6371.0088 * asin(sqrt(pow(sin((st.lat - pl.lat) * pi() / 360), 2) + cos(pl.lat * pi() / 180) * cos(st.lat * pi() / 180) * pow(sin((st.lon - pl.lon) * pi() / 360), 2))) AS km FROM pl, st)),
hv AS (SELECT x.mp_id, station, count(*) AS matched FROM (SELECT DISTINCT mp_id, date FROM q) x JOIN w ON w.date = x.date AND w.temp_c IS NOT NULL GROUP BY ALL HAVING count(*) >= 60),
hs AS (SELECT mp_id, b.station AS station, b.km AS station_km, b.matched AS matched FROM (SELECT mp_id, min({'rank': rank, 'station': station, 'km': km, 'matched': matched}) AS b FROM hv JOIN hg USING (mp_id) JOIN rk USING (plz, station) GROUP BY mp_id))"""
DAILY = f"""d0 AS (SELECT mp_id, date, sum(v) / 4 AS e, sum(v) FILTER (k < 24) / 4 AS n, sum(v) FILTER (k >= 24) / 4 AS dd FROM q GROUP BY ALL),
d1 AS (SELECT d0.*, w.temp_c AS t, w.irr, {WINTER.replace('date', 'd0.date')} AS w, {SUMMER.replace('date', 'd0.date')} AS s, month(d0.date) IN (10, 11, 12, 1, 2, 3, 4) AS heat, isodow(d0.date) >= 6 AS we FROM d0 LEFT JOIN hs USING (mp_id) LEFT JOIN w ON w.station = hs.station AND w.date = d0.date)"""
FIT = """en AS (SELECT mp_id FROM d1 WHERE t IS NOT NULL GROUP BY mp_id HAVING count(*) >= 60 AND quantile_cont(t, 0.9) - quantile_cont(t, 0.1) >= 8),
fg AS (SELECT mp_id, tau, count(*) AS n, count(*) FILTER (t <= tau - 2) AS c, count(*) FILTER (t >= tau) AS wm, var_pop(greatest(tau - t, 0)) AS vx, var_pop(e) AS vy, covar_pop(greatest(tau - t, 0), e) AS cxy FROM d1 JOIN en USING (mp_id), (SELECT 8 + i / 2.0::DOUBLE AS tau FROM range(25) AS r(i)) WHERE t IS NOT NULL GROUP BY ALL),
fb AS (SELECT mp_id, tau, greatest(cxy / vx, 0) AS beta, round((vy - 2 * greatest(cxy / vx, 0) * cxy + greatest(cxy / vx, 0) * greatest(cxy / vx, 0) * vx) * n, 6) AS sse, vy * n AS sst FROM fg WHERE c >= 20 AND wm >= 20 AND vx * n > 1e-10),
fm AS (SELECT mp_id, min({'sse': sse, 'tau': tau, 'beta': beta, 'sst': sst}) AS b FROM fb GROUP BY mp_id),
fit AS (SELECT mp_id, b.tau AS tau, b.beta AS beta, CASE WHEN b.sst > 1e-9 THEN greatest(1 - b.sse / b.sst, 0) END AS r2, coalesce(CASE WHEN b.sst > 1e-9 THEN greatest(1 - b.sse / b.sst, 0) END >= 0.1, false) AND b.tau > 8 AND b.tau < 20 AS identified FROM fm)"""


def _events(name: str, threshold: str) -> str:
    return f"""{name}0 AS (SELECT mp_id, date, k, v, date_diff('day', DATE '2000-01-01', date) * 96 + k AS idx, NOT coalesce(pd, false) AS fst, NOT coalesce(nd, false) AS lst FROM q JOIN adj USING (mp_id, date) JOIN pq USING (mp_id) WHERE v >= p20 + {threshold}),
{name}1 AS (SELECT *, idx - row_number() OVER (PARTITION BY mp_id ORDER BY idx) AS isl FROM {name}0),
{name} AS (SELECT *, bool_or((fst AND k = 0) OR (lst AND k = 95)) OVER i AS cut, count(*) OVER i AS n, stddev_pop(v) OVER i / avg(v) OVER i AS cv, min(idx) OVER i AS start, avg(CASE WHEN k < 24 OR k >= 72 THEN 1.0 ELSE 0 END) OVER i AS night FROM {name}1 WINDOW i AS (PARTITION BY mp_id, isl))"""


REST = f"""pq AS (SELECT mp_id, median(v) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.2) AS p20, avg(v) AS pm, quantile_cont(v, 0.95) FILTER ({WINTER}) AS p95w, avg(v) FILTER ({WINTER}) AS pmw, quantile_cont(v, 0.95) FILTER ({SUMMER}) AS p95s, avg(v) FILTER ({SUMMER}) AS pms, quantile_cont(v, 0.2) FILTER ({WINTER}) AS p20w, quantile_cont(v, 0.2) FILTER ({SUMMER}) AS p20s FROM q GROUP BY mp_id),
adj AS (SELECT mp_id, date, lag(date) OVER o = date - 1 AS pd, lead(date) OVER o = date + 1 AS nd FROM d0 WINDOW o AS (PARTITION BY mp_id ORDER BY date)),
{_events('ea', '3')}, {_events('eb', '1.5')},
ph AS (SELECT mp_id, date, count(*) / 4.0 AS hours FROM ea WHERE NOT cut AND n BETWEEN 8 AND 64 AND cv <= 0.15 AND night >= 0.75 GROUP BY ALL),
es AS (SELECT mp_id, date, k FROM eb WHERE NOT cut AND n >= 2 AND idx = start),
ft AS (SELECT mp_id, count(*) AS starts, count(DISTINCT date) AS active FROM es GROUP BY mp_id),
fw AS (SELECT mp_id, max(n) AS top FROM (SELECT mp_id, (k - a + 96) % 96 AS win, count(*) AS n FROM es, range(8) AS r(a) GROUP BY ALL) GROUP BY mp_id),
d2 AS (SELECT d1.*, tau, beta, r2, identified, CASE WHEN identified THEN tau ELSE 18 END AS trusted FROM d1 LEFT JOIN fit USING (mp_id)),
d3 AS (SELECT *, coalesce(t >= greatest(18, trusted), false) AS warm, coalesce(t <= least(8, trusted - 4), false) AS cold FROM d2),
d4 AS (SELECT *, count(*) FILTER (warm) OVER h AS n_warm, count(*) FILTER (cold) OVER h AS n_cold, CASE WHEN count(*) FILTER (warm) OVER h >= 20 THEN median(CASE WHEN warm THEN e END) OVER h END AS b FROM d3 WINDOW h AS (PARTITION BY mp_id)),
d5 AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(e - b, 0) END AS excess, median(CASE WHEN warm THEN abs(e - b) END) OVER (PARTITION BY mp_id) AS mad FROM d4),
d6 AS (SELECT d5.*, CASE WHEN b IS NOT NULL THEN greatest(3, 0.15 * b, 3 * 1.4826 * mad) END AS lim, CASE WHEN t IS NOT NULL AND tau IS NOT NULL THEN greatest(tau - t, 0) END AS hdd, coalesce(hours, 0) AS hours, CASE WHEN t IS NOT NULL THEN greatest(coalesce(tau, 15) - t, 0) END AS need, CASE WHEN heat THEN t END AS th, CASE WHEN heat THEN e END AS eh, CASE WHEN heat THEN n END AS nh FROM d5 LEFT JOIN ph USING (mp_id, date)),
g AS (SELECT mp_id, count(*) AS days, avg(e) AS em, stddev_pop(e) AS es, sum(n) AS ns, sum(dd) AS ds, avg(e) FILTER (we) AS ewe, avg(e) FILTER (NOT we) AS ewd, count(*) FILTER (we) AS nwe, count(*) FILTER (NOT we) AS nwd, count(*) FILTER (w) AS nw, count(*) FILTER (s) AS nsu, avg(e) FILTER (w) AS ew, avg(e) FILTER (s) AS esu, sum(e) FILTER (w) AS ews, sum(excess) FILTER (w) AS exw,
  CASE WHEN max(th) - min(th) >= 3 THEN {_C('eh', 'th', 20)} END AS ct, CASE WHEN max(th) - min(th) >= 3 THEN {_C('nh', 'th', 20)} END AS cn, count(t) AS nt, max(t) - min(t) AS ts, max(n_warm) AS n_warm, max(n_cold) AS n_cold, max(tau) AS tau, max(beta) AS beta, max(r2) AS r2, bool_or(identified) AS identified, max(b) AS b, max(lim) AS lim,
  avg(e) FILTER (cold) AS ec, avg(e) FILTER (warm) AS ewm, median(excess) FILTER (cold) AS exc, avg(CASE WHEN excess > lim THEN 1.0 ELSE 0 END) FILTER (cold AND lim IS NOT NULL) AS act, CASE WHEN var_pop(hdd) > 0 THEN greatest(covar_pop(hdd, n / 6) / var_pop(hdd), 0) END AS bn, CASE WHEN var_pop(hdd) > 0 THEN greatest(covar_pop(hdd, dd / 18) / var_pop(hdd), 0) END AS bd,
  sum(hours) AS hs, avg(CASE WHEN hours > 0 THEN 1.0 ELSE 0 END) AS ha, {_C('hours', 'need', 40)} AS hr, date_diff('day', min(date), max(date)) + 1 AS stretch FROM d6 GROUP BY mp_id),
yr AS (SELECT mp_id, count(b) AS yn, avg(b) AS ym, stddev_pop(b) AS ys FROM (SELECT mp_id, year(date) AS y, greatest(CASE WHEN var_pop(hdd) > 0 THEN covar_pop(hdd, e) / var_pop(hdd) END, 0) AS b FROM d6 WHERE identified AND t IS NOT NULL GROUP BY ALL HAVING count(*) >= 60 AND count(*) FILTER (t <= tau - 2) >= 20 AND count(*) FILTER (t >= tau) >= 20) GROUP BY mp_id),
wk AS (SELECT mp_id, count(*) AS wn, avg(CASE WHEN a::DOUBLE / n >= 0.5 THEN 1.0 ELSE 0 END) AS ws FROM (SELECT mp_id, date_trunc('week', date) AS wk, count(*) AS n, count(*) FILTER (excess > lim) AS a FROM d6 WHERE cold AND heat GROUP BY ALL HAVING count(*) >= 3) GROUP BY mp_id),
x0 AS (SELECT mp_id, date, sum(v) / 4 AS x, sum(v) FILTER (k >= 80 OR k < 24) / 4 AS xn FROM qs WHERE channel = 'export' GROUP BY ALL),
x1 AS (SELECT x0.*, e, CASE WHEN s THEN x END AS sx, CASE WHEN s THEN irr END AS si FROM x0 JOIN d6 USING (mp_id, date)),
x2 AS (SELECT mp_id, count(*) AS xc, sum(x) AS x, sum(xn) AS xn, sum(e) AS xe, {_C('sx', 'si', 20)} AS xi FROM x1 GROUP BY mp_id HAVING count(*) >= 20),
c0 AS (SELECT q.*, warm, cold FROM q JOIN d6 USING (mp_id, date) WHERE b IS NOT NULL AND n_cold >= 20 AND (warm OR cold)),
c1 AS (SELECT *, median(CASE WHEN warm THEN v END) OVER (PARTITION BY mp_id, k) AS u FROM c0), c2 AS (SELECT *, median(CASE WHEN warm THEN abs(v - u) END) OVER (PARTITION BY mp_id, k) AS md FROM c1),
hl AS (SELECT mp_id, count(*) FILTER (v > u + greatest(0.3, 3 * 1.4826 * md)) / 4.0 / count(DISTINCT date) AS high_hours FROM c2 WHERE cold GROUP BY mp_id),
a AS (SELECT * FROM g LEFT JOIN pq USING (mp_id) LEFT JOIN yr USING (mp_id) LEFT JOIN wk USING (mp_id) LEFT JOIN x2 USING (mp_id) LEFT JOIN hl USING (mp_id) LEFT JOIN ft USING (mp_id) LEFT JOIN fw USING (mp_id))"""
_OK, _COLD = "days >= 20", "b IS NOT NULL AND n_cold >= 20"
_when = lambda t, x: f"CASE WHEN {_OK} AND {t} THEN {x} END"
_FEATS = {
    "hp_daily_import_temperature_corr": _when("true", "ct"), "hp_hdd_year_slope_stability": _when("yn >= 2 AND ym > 1e-6", "1 / (1 + ys / ym)"), "hp_balance_temperature_c": _when("identified", "tau"), "hp_hdd_slope_kwh_per_degree_day": _when("true", "beta"), "hp_hdd_slope_normalized": _when("true", _R("beta", "b", "1")), "hp_hdd_response_r2": _when("true", "r2"),
    "hp_cold_mild_daily_energy_ratio": _when(_COLD, _R("ec", "ewm")), "hp_winter_summer_daily_energy_ratio": _when("nw >= 20 AND nsu >= 20", _R("ew", "esu")), "hp_heating_excess_share_winter": _when("b IS NOT NULL AND nw >= 20", _R("exw", "ews")), "hp_cold_day_heating_excess_kwh": _when(_COLD, "exc"), "hp_cold_day_active_fraction": _when(_COLD, "act"),
    "hp_winter_baseload_increase_kw": _when("nw >= 20 AND nsu >= 20", "p20w - p20s"), "hp_winter_load_factor": _when("nw >= 20", _R("pmw", "p95w")), "hp_winter_minus_summer_load_factor": _when("nw >= 20 AND nsu >= 20", f"{_R('pmw', 'p95w')} - {_R('pms', 'p95s')}"), "hp_cold_night_temperature_corr": _when("true", "cn"),
    "hp_night_day_temperature_sensitivity_ratio": _when("tau IS NOT NULL", _R("bn", "bd", "0.01")), "hp_cold_weather_high_load_hours_per_day": _when(_COLD, "high_hours"), "hp_heating_season_persistence": _when(f"{_COLD} AND wn >= 4", "ws"), "general_mean_daily_import_kwh": _when("true", "em"), "general_median_import_power_kw": _when("true", "p50"),
    "general_p95_import_power_kw": _when("true", "p95"), "general_daily_energy_cv": _when("true", _R("es", "em")), "general_night_day_energy_ratio": _when("true", _R("ns", "ds")), "general_weekend_weekday_energy_ratio": _when("nwe >= 20 AND nwd >= 20", _R("ewe", "ewd")), "general_load_factor_all_year": _when("true", _R("pm", "p95")),
    "conf_export_to_import_ratio": _when("true", _R("x", "xe")), "conf_export_irradiance_corr": _when("true", "xi"), "conf_night_export_share": _when("true", _R("xn", "x", "0.1")),
    "conf_evening_long_plateau_score": _when("nt >= 40 AND ts >= 8", "CASE WHEN hs = 0 THEN 0 WHEN hr IS NOT NULL THEN hs / (24 * days) * 4 * ha * (1 - ha) * (1 - pow(greatest(hr, 0), 2)) END"), "conf_fixed_time_daily_load_concentration": _when("starts >= 20", "greatest((top::DOUBLE / starts - 1.0 / 12) / (1 - 1.0 / 12), 0) * active / days"),
    "balance_candidate_c": _when("true", "tau"), "warm_day_baseline_kwh": _when("true", "b"), "active_excess_threshold_kwh": _when("true", "lim"), "data_coverage_ratio": "days::DOUBLE / stretch",
}
_LONGS = {"n_days": "days", "n_common_weather_days": _when("true", "nt"), "n_cold_days": _when("true", "n_cold"), "n_warm_days": _when("true", "n_warm")}
HEAD = f"WITH {fx.METER_SQL}, {fx.WEATHER_SQL}, {QS}"


def _inputs(spark, d):
    complete = checkpointed(complete_days(strict_days(fx.meter_days(spark, d), dealt=True)).select("mp_id", "channel", "date", "kw"))
    weather = fx.daily_weather(spark, d)
    dates = complete.where("channel = 'import'").select("mp_id", "date")
    return complete, weather, wx.choose_for_house(house_geo(spark, d), dates, weather)


@query("f8_hp30", f"{HEAD}, {DAILY}, {FIT}, {REST} SELECT {cols(_FEATS, _LONGS, 'mp_id')}, CASE WHEN {_OK} THEN coalesce(identified, false) END AS balance_identified FROM a")
def hp30(spark, d):
    return hp.hp30(*_inputs(spark, d))


@query("j12_house_station", f"{HEAD} SELECT {cols({'station_km': 'station_km'}, {'matched': 'matched'}, 'mp_id, station')} FROM hs")
def house_station(spark, d):
    return _inputs(spark, d)[2]


@query("a23_hdd_grid_search", f"{HEAD}, {DAILY}, {FIT} SELECT {cols({'tau': 'tau', 'beta': 'beta', 'r2': 'r2'}, None, 'mp_id, identified')} FROM fit")
def hdd(spark, d):
    complete, weather, station = _inputs(spark, d)
    daily = complete.where("channel = 'import'").select("mp_id", "date", (p.window_sum(F.col("kw")) / 4).alias("e"))
    t = station.select("mp_id", "station").join(weather.select("station", "date", F.col("temp_c").alias("t")), "station").drop("station")
    return hp.hdd_fit(daily.join(t, ["mp_id", "date"], "left"))


@query("w6_episodes_over_midnight", f"{HEAD}, d0 AS (SELECT DISTINCT mp_id, date FROM q), pq AS (SELECT mp_id, quantile_cont(v, 0.2) AS p20 FROM q GROUP BY mp_id), adj AS (SELECT mp_id, date, lag(date) OVER o = date - 1 AS pd, lead(date) OVER o = date + 1 AS nd FROM d0 WINDOW o AS (PARTITION BY mp_id ORDER BY date)), {_events('ea', '3')} SELECT {cols({'mean_cv': 'avg(cv)'}, {'n_events': 'count(*)', 'n_slots': 'sum(n)', 'longest': 'max(n)'}, 'mp_id')} FROM ea WHERE NOT cut AND idx = start GROUP BY mp_id")
def episodes(spark, d):
    q = complete_days(strict_days(fx.meter_days(spark, d), dealt=True).where("channel = 'import'")).select("mp_id", "date", "kw")
    return hp.events(q, hp.pooled(q), 3.0).where("idx = start").groupBy("mp_id").agg(F.avg("cv").alias("mean_cv"), F.count(F.lit(1)).alias("n_events"), F.sum("n").alias("n_slots"), F.max("n").alias("longest"))


