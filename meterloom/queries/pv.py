"""Queries of the photovoltaic packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.operators.days import house_days
from meterloom.plans import pv
from meterloom.queries.base import DAY, EVE, LATE, MID, NIGHT, NZ, SUMMER, WINTER, clip, cols, query, rat

DAYS = f"""h AS (SELECT mp_id, channel, date, k // 4 AS h, sum(kw) / count(kw) AS m FROM s GROUP BY ALL),
hl AS (SELECT *, min(m) OVER w AS lo, avg(m) OVER w AS mean FROM h WINDOW w AS (PARTITION BY mp_id, channel, date)),
ha AS (SELECT *, coalesce(m <= lo + greatest(0.02, 0.05 * mean), false) AS low FROM hl),
hm AS (SELECT mp_id, channel, date, CASE WHEN bool_or(low AND h = 0) AND bool_or(low AND h = 23) THEN min(h) FILTER (m = lo) + 0.5
  ELSE coalesce(sum(h) FILTER (low), 0)::DOUBLE / greatest(count(*) FILTER (low), 1) + 0.5 END AS min_hour FROM ha GROUP BY ALL),
d0 AS (SELECT mp_id, channel, date, sum(neg) AS n_neg, coalesce(max(rmax), -1.0) AS vmax_raw, coalesce(sum(kw), 0) AS tot,
  {', '.join(f'coalesce(sum(kw) FILTER ({w}), 0) AS {n}' for n, w in (('mid_tot', MID), ('day_tot', DAY), ('late_tot', LATE), ('eve_tot', EVE)))},
  sum(kw) FILTER ({MID}) / count(kw) FILTER ({MID}) AS mid_mean, sum(kw) FILTER ({NIGHT}) / count(kw) FILTER ({NIGHT}) AS night_mean,
  coalesce(sum(kw * (k + 0.5) / 4), 0) AS hw, coalesce(sum(kw * ((k + 0.5) / 4) * ((k + 0.5) / 4)), 0) AS hw2, max(kw) AS vmax,
  count(*) FILTER ({DAY} AND kw <= 0.02) AS zero_q_mid, count(*) FILTER ({NZ} AND kw <= 0.02) AS zero_q_night, count(kw) AS n_valid, count(kw) FILTER ({DAY}) AS n_valid_day, count(kw) FILTER ({NZ}) AS n_valid_night
  FROM s GROUP BY ALL),
d AS (SELECT d0.*, min_hour, d0.channel = 'import' AS i, d0.channel = 'export' AS e, {SUMMER.replace('date', 'd0.date')} AS s0, {WINTER.replace('date', 'd0.date')} AS w0 FROM d0 JOIN hm USING (mp_id, channel, date))"""
DAY_SQL = f"WITH {fx.METER_SQL}, {DAYS}"

_SHARE = "tot > 0 AND n_valid >= 86.4"


def _ge(n: str, x: str) -> str:
    return f"CASE WHEN {n} THEN {x} END"


def _s_sql(source: str = fx.METER_SQL) -> str:
    agg = f"""g AS (SELECT mp_id, count(*) FILTER (i) AS n_days, count(*) FILTER (i AND s0) AS ns, count(*) FILTER (i AND w0) AS nw, max(CASE WHEN e THEN 1 ELSE 0 END) AS has_e, max(vmax_raw) FILTER (e) AS raw, sum(n_neg) AS neg,
  sum(tot) FILTER (e) AS e, sum(tot) FILTER (e AND s0) AS es, sum(tot) FILTER (e AND w0) AS ew, count(*) FILTER (e AND s0) AS nes, count(*) FILTER (e AND w0) AS new_, avg(CASE WHEN tot / 4 > 0.1 THEN 1.0 ELSE 0 END) FILTER (e) AS ed,
  sum(tot) FILTER (i AND s0) AS is_, sum(tot) FILTER (i AND w0) AS iw, sum(tot) FILTER (i) AS i, sum(n_valid) FILTER (i) AS nv, sum(day_tot) FILTER (e AND s0) AS esday, sum(late_tot) FILTER (e) AS elate, sum(hw) FILTER (e AND s0) AS hw, sum(hw2) FILTER (e AND s0) AS hw2,
  quantile_cont(vmax, 0.95) FILTER (e) AS emax, avg(mid_mean) FILTER (i AND s0) AS mids, avg(mid_mean) FILTER (i AND w0) AS midw, avg(night_mean) FILTER (i AND s0) AS nights, avg(night_mean) FILTER (i AND w0) AS nightw,
  avg(zero_q_mid) FILTER (i AND s0 AND n_valid_day >= 28.8) AS zmid, count(*) FILTER (i AND s0 AND n_valid_day >= 28.8) AS nzmid, avg(zero_q_night) FILTER (i AND n_valid_night >= 28.8) AS znight, count(*) FILTER (i AND n_valid_night >= 28.8) AS nznight,
  avg(mid_tot / tot) FILTER (i AND w0 AND {_SHARE}) AS sw, count(*) FILTER (i AND w0 AND {_SHARE}) AS nsw, avg(mid_tot / tot) FILTER (i AND s0 AND {_SHARE}) AS ss, count(*) FILTER (i AND s0 AND {_SHARE}) AS nss, avg(day_tot / tot) FILTER (i AND s0 AND {_SHARE}) AS sday,
  avg(abs(min_hour - 13.5)) FILTER (i AND s0 AND n_valid >= 86.4) AS moff, count(*) FILTER (i AND s0 AND n_valid >= 86.4) AS nmoff, quantile_cont(mid_mean, 0.95) FILTER (i AND s0) AS m95, quantile_cont(mid_mean, 0.05) FILTER (i AND s0) AS m05,
  avg(tot) FILTER (i AND s0) AS ms, avg(tot) FILTER (i AND w0) AS mw FROM d GROUP BY mp_id HAVING count(*) FILTER (i) > 0),
f AS (SELECT *, CASE WHEN n_days >= 20 THEN emax END AS fmax, {rat('es', 'nes')} AS pds, {rat('ew', 'new_')} AS pdw, {rat('hw', 'es')} AS mh FROM g),
f2 AS (SELECT *, has_e = 1 AND coalesce(fmax >= 0.1, false) AS real_, coalesce(pds + pdw, pds, pdw) AS both_ FROM f)"""
    return f"WITH {source}, {DAYS}, {agg}"


_S_FEATS = {
    "export_kwh_total": "CASE WHEN has_e = 1 AND n_days >= 20 THEN e / 4 END", "export_days_frac": "CASE WHEN has_e = 1 AND n_days >= 20 THEN ed END", "export_to_import_ratio_summer": f"CASE WHEN has_e = 1 AND ns >= 20 THEN {rat('es', 'is_')} END",
    "export_to_import_ratio_winter": f"CASE WHEN has_e = 1 AND nw >= 20 THEN {rat('ew', 'iw')} END", "export_winter_share": f"CASE WHEN real_ AND ns >= 20 AND nw >= 20 THEN {rat('coalesce(pdw, 0)', 'both_')} END",
    "export_midday_share_summer": f"CASE WHEN real_ AND ns >= 20 THEN {rat('esday', 'es')} END", "export_night_share": f"CASE WHEN real_ AND n_days >= 20 THEN {rat('elate', 'e')} END", "export_mean_hour_summer": "CASE WHEN real_ AND ns >= 20 THEN mh END",
    "export_hour_std_summer": f"CASE WHEN real_ AND ns >= 20 AND mh IS NOT NULL THEN sqrt(greatest({rat('hw2', 'es')} - mh * mh, 0)) END", "export_max_kw": "CASE WHEN has_e = 1 THEN fmax END",
    "import_midday_night_ratio_summer": _ge("ns >= 20", rat("mids", "nights")), "import_midday_night_ratio_winter": _ge("nw >= 20", rat("midw", "nightw")), "import_zero_hours_midday_summer": _ge("nzmid >= 20", "zmid / 4"), "import_zero_hours_night": _ge("nznight >= 20", "znight / 4"),
    "import_midday_share_winter_minus_summer": f"{_ge('nsw >= 20', 'sw')} - {_ge('nss >= 20', 'ss')}", "import_min_hour_offset_noon_summer": _ge("nmoff >= 20", "moff"), "import_summer_to_winter_ratio": _ge("ns >= 20 AND nw >= 20", rat("ms", "mw")),
    "import_daylight_share_summer": _ge("nss >= 20", "sday"), "import_midday_spread_over_night_summer": _ge("ns >= 20", rat("m95 - m05", "nights")), "import_midday_p05_over_night_summer": _ge("ns >= 20", rat("m05", "nights")),
    "export_max_raw_kw": "raw", "mean_import_kw": rat("i", "nv"),
}
_S_LONGS = {"n_days": "n_days", "n_summer_days": "ns", "n_winter_days": "nw", "has_export_register": "has_e", "has_real_export": "CASE WHEN has_e = 1 THEN real_ END", "n_negative_raw": "neg"}


@query("f1_pv20s", f"{_s_sql()} SELECT {cols(_S_FEATS, _S_LONGS, 'mp_id')} FROM f2")
def pv20s(spark, d):
    return pv.pv20s(house_days(fx.meter_days(spark, d), dealt=True))


@query("f1_pv20s_sparse", f"{_s_sql(fx.SPARSE_SQL)} SELECT {cols(_S_FEATS, _S_LONGS, 'mp_id')} FROM f2")
def pv20s_sparse(spark, d):
    return pv.pv20s(house_days(fx.sparse_meter_days(spark, d)))


def _t_sql(source: str = fx.METER_SQL) -> str:
    z = lambda x, v="0": f"coalesce({x}, {v})"
    agg = f"""df AS (SELECT *, s0 OR NOT coalesce(bool_or(s0 AND i) OVER w, false) AS s, w0 OR NOT coalesce(bool_or(w0 AND i) OVER w, false) AS w FROM d WINDOW w AS (PARTITION BY mp_id)),
g AS (SELECT mp_id, count(*) FILTER (i) AS n_days, count(*) FILTER (i AND s0) AS ns, count(*) FILTER (i AND w0) AS nw, max(CASE WHEN e THEN 1 ELSE 0 END) AS has_e, coalesce(max(vmax_raw) FILTER (e), 0) AS raw, sum(n_neg) AS neg,
  {z('sum(tot) FILTER (i)')} AS i, {z('sum(tot) FILTER (i AND s)')} AS is_, {z('sum(tot) FILTER (i AND w)')} AS iw, greatest(count(*) FILTER (i AND s), 1) AS nis, greatest(count(*) FILTER (i AND w), 1) AS niw, sum(n_valid) FILTER (i) AS nv,
  {z('sum(tot) FILTER (e)')} AS e, {z('sum(tot) FILTER (e AND s)')} AS es, {z('sum(tot) FILTER (e AND w)')} AS ew, count(*) FILTER (e AND tot / 4 > 0.1) AS ed, {z('sum(day_tot) FILTER (e AND s)')} AS esday, {z('sum(late_tot) FILTER (e)')} AS elate,
  {z('sum(mid_tot) FILTER (e AND s)')} AS esmid, {z('sum(eve_tot) FILTER (e AND s)')} AS eseve, {z('quantile_cont(vmax, 0.95) FILTER (e)')} AS emax, {z('avg(night_mean) FILTER (i AND s)')} AS nights, {z('avg(night_mean) FILTER (i AND w)')} AS nightw,
  {z('avg(mid_mean) FILTER (i AND s)')} AS mids, {z('avg(mid_mean) FILTER (i AND w)')} AS midw, {z('avg(zero_q_mid) FILTER (i AND s AND n_valid_day >= 28.8)')} AS zmid, {z('avg(zero_q_night) FILTER (i AND n_valid_night >= 28.8)')} AS znight,
  {z(f'avg(mid_tot / tot) FILTER (i AND w AND {_SHARE})', '1.0 / 6')} AS sw, {z(f'avg(mid_tot / tot) FILTER (i AND s AND {_SHARE})', '1.0 / 6')} AS ss, {z(f'avg(day_tot / tot) FILTER (i AND s AND {_SHARE})', '1.0 / 3')} AS sday,
  {z('avg(abs(min_hour - 13.5)) FILTER (i AND s AND n_valid >= 86.4)', '12')} AS moff, {z('quantile_cont(mid_mean, 0.95) FILTER (i AND s)')} AS m95, {z('quantile_cont(mid_mean, 0.05) FILTER (i AND s)')} AS m05 FROM df GROUP BY mp_id HAVING count(*) FILTER (i) > 0)"""
    return f"WITH {source}, {DAYS}, {agg}"


_MEAN = "(i / greatest(nv, 1))"
_T_FEATS = {
    "export_kwh_total": "e / 4", "export_days_frac": "ed::DOUBLE / n_days", "export_to_import_ratio_summer": f"es / {clip('is_')}", "export_to_import_ratio_winter": f"ew / {clip('iw')}", "export_midday_over_import_summer": f"esday / {clip('is_')}",
    "export_night_over_import": f"elate / {clip('i')}", "export_midday_minus_evening_over_import_summer": f"(esmid - eseve) / {clip('is_')}", "export_max_kw": "emax", "export_max_over_mean_import": f"emax / {clip(_MEAN)}",
    "export_summer_minus_winter_over_import": f"(es / nis - ew / niw) / {clip('i / n_days')}", "import_midday_night_ratio_summer": f"mids / {clip('nights')}", "import_midday_night_ratio_winter": f"midw / {clip('nightw')}",
    "import_zero_hours_midday_summer": "zmid / 4", "import_zero_hours_night": "znight / 4", "import_midday_share_winter_minus_summer": "sw - ss", "import_min_hour_offset_noon_summer": "moff", "import_summer_to_winter_ratio": f"(is_ / nis) / {clip('iw / niw')}",
    "import_daylight_share_summer": "sday", "import_midday_spread_over_night_summer": f"(m95 - m05) / {clip('nights')}", "import_midday_p05_over_night_summer": f"m05 / {clip('nights')}", "export_max_raw_kw": "raw", "mean_import_kw": _MEAN,
}
_T_LONGS = {"n_days": "n_days", "n_summer_days": "ns", "n_winter_days": "nw", "has_export_register": "has_e", "has_real_export": "emax >= 0.1", "n_negative_raw": "neg"}


@query("f2_pv20t", f"{_t_sql()} SELECT {cols(_T_FEATS, _T_LONGS, 'mp_id')} FROM g")
def pv20t(spark, d):
    return pv.pv20t(house_days(fx.meter_days(spark, d), dealt=True))


@query("f2_pv20t_sparse", f"{_t_sql(fx.SPARSE_SQL)} SELECT {cols(_T_FEATS, _T_LONGS, 'mp_id')} FROM g")
def pv20t_sparse(spark, d):
    return pv.pv20t(house_days(fx.sparse_meter_days(spark, d)))


@query(
    "f3_pv21",
    f"""{_t_sql()}, {fx.WEATHER_SQL}, x AS (SELECT a.mp_id, w.irr AS x, (a.day_tot - coalesce(b.day_tot, 0)) / 4 AS y FROM df a LEFT JOIN (SELECT * FROM df WHERE e AND s) b ON a.mp_id = b.mp_id AND a.date = b.date
  JOIN w ON w.n = 1 AND w.date = a.date WHERE a.i AND a.s AND a.n_valid_day >= 28.8 AND w.irr IS NOT NULL),
fit AS (SELECT mp_id, count(*) AS n_irr_days, CASE WHEN count(*) >= 3 AND var_pop(x) > 0.01 THEN covar_pop(x, y) / var_pop(x) END AS b FROM x GROUP BY mp_id)
SELECT {cols(_T_FEATS | {'irr_net_slope_kw_summer': 'coalesce(-b, 0)'}, _T_LONGS | {'n_irr_days': 'coalesce(n_irr_days, 0)'}, 'g.mp_id')} FROM g LEFT JOIN fit USING (mp_id)""",
)
def pv21(spark, d):
    return pv.pv21(house_days(fx.meter_days(spark, d), dealt=True), fx.daily_weather(spark, d).where("n = 1").select("date", "irr"))


def house_geo(spark, d):
    """Each house with the place of its plz (house number modulo 25)."""
    houses = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("mp_id"), (F.col("l_suppkey") % 25).cast("string").alias("plz")).distinct()
    return houses.join(F.broadcast(fx.places(spark, d)), "plz")


#: Houses with places, stations ranked per plz, and the stations chosen.
CHOICE_SQL = """hg AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS mp_id, CAST(l_suppkey % 25 AS VARCHAR) AS plz FROM lineitem),
rk AS (SELECT plz, station, km, row_number() OVER (PARTITION BY plz ORDER BY km, station) AS rank FROM (SELECT pl.plz, st.station,
  2 * 6371.0088 * asin(sqrt(pow(sin((st.lat - pl.lat) * pi() / 360), 2) + cos(pl.lat * pi() / 180) * cos(st.lat * pi() / 180) * pow(sin((st.lon - pl.lon) * pi() / 360), 2))) AS km FROM pl, st)),
cv AS (SELECT station, count(irr) AS nr, count(temp_c) AS nt FROM w WHERE date IN (SELECT date FROM s) GROUP BY station),
ch AS (SELECT plz, o.station AS station, o.km AS station_km, CASE WHEN own.nt >= 20 OR t IS NULL THEN o.station ELSE t.station END AS temp_station, CASE WHEN own.nt >= 20 OR t IS NULL THEN o.km ELSE t.km END AS temp_station_km
  FROM (SELECT plz, min({'rank': rank, 'station': station, 'km': km}) FILTER (nr >= 20) AS o, min({'rank': rank, 'station': station, 'km': km}) FILTER (nt >= 20) AS t FROM rk JOIN cv USING (station) GROUP BY plz) x JOIN cv own ON own.station = x.o.station)"""
_P = lambda a, b, n: f"CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= {n} AND stddev_pop({a}) FILTER ({b} IS NOT NULL) > 1e-9 AND stddev_pop({b}) FILTER ({a} IS NOT NULL) > 1e-9 THEN covar_pop({a}, {b}) / (stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL)) END"
_W25 = f"""el AS (SELECT mp_id, date, max(CASE WHEN channel = 'import' AND n_valid >= 96 THEN tot / 4 END) AS im, max(CASE WHEN channel = 'import' AND n_valid >= 96 THEN day_tot / 4 END) AS mi, max(CASE WHEN channel = 'export' AND n_valid >= 96 THEN tot / 4 END) AS ex FROM d0 GROUP BY ALL HAVING count(*) FILTER (channel = 'import') > 0),
j AS (SELECT el.mp_id, {SUMMER.replace('date', 'el.date')} AS s, {WINTER.replace('date', 'el.date')} AS wi, im, mi, ex, a.irr, a.midday, b.temp_c FROM el JOIN hg USING (mp_id) JOIN ch USING (plz) JOIN w a ON a.station = ch.station AND a.date = el.date LEFT JOIN w b ON b.station = ch.temp_station AND b.date = el.date),
j2 AS (SELECT *, CASE WHEN s THEN ex END AS xs, CASE WHEN s THEN mi END AS ms, CASE WHEN wi THEN im END AS iw, quantile_cont(CASE WHEN s AND ex IS NOT NULL THEN irr END, 0.75) OVER w AS hi, quantile_cont(CASE WHEN s AND ex IS NOT NULL THEN irr END, 0.25) OVER w AS lo FROM j WINDOW w AS (PARTITION BY mp_id)),
wf AS (SELECT mp_id, {_P('xs', 'irr', 20)} AS w1, count(*) FILTER (xs IS NOT NULL AND irr IS NOT NULL) AS nb, avg(xs) FILTER (irr >= hi) AS su, count(xs) FILTER (irr >= hi) AS nsu, avg(xs) FILTER (irr <= lo) AS cl, count(xs) FILTER (irr <= lo) AS ncl,
  sum(xs) FILTER (irr IS NOT NULL) AS sx, sum(irr) FILTER (xs IS NOT NULL) AS sr, {_P('ms', 'midday', 20)} AS w4, {_P('iw', 'temp_c', 20)} AS w5, count(*) FILTER (ms IS NOT NULL AND midday IS NOT NULL) AS cs, count(*) FILTER (iw IS NOT NULL AND temp_c IS NOT NULL) AS cw FROM j2 GROUP BY mp_id),
wfe AS (SELECT mp_id, w1, CASE WHEN nb >= 20 AND nsu >= 5 AND ncl >= 5 THEN {rat('su - cl', 'su + cl')} END AS w2, CASE WHEN nb >= 20 THEN {rat('sx', 'sr')} END AS w3, w4, w5, cs, cw FROM wf)"""
_25_FEATS = _S_FEATS | dict(zip(pv.WEATHER, ("w1", "w2", "w3", "w4", "w5"), strict=True))
_25_NAMES = pv.EXPORT + pv.IMPORT + pv.WEATHER


@query(
    "f4_pv25",
    f"""{_s_sql()}, {fx.WEATHER_SQL}, {CHOICE_SQL}, {_W25}, t AS (SELECT f2.mp_id, plz, station, temp_station, station_km, temp_station_km, {', '.join(f'{x} AS {n}' for n, x in _25_FEATS.items())}, {', '.join(f'{x} AS {n}' for n, x in _S_LONGS.items())}, coalesce(cs, 0) AS weather_common_summer_days, coalesce(cw, 0) AS weather_common_winter_days FROM f2 LEFT JOIN wfe USING (mp_id) LEFT JOIN (SELECT * FROM hg JOIN ch USING (plz)) c USING (mp_id))
SELECT {cols({n: f'coalesce({n}, {v})' for n, v in pv.FILLS_25.items() if n != 'has_real_export'} | {'station_km': 'station_km', 'temp_station_km': 'temp_station_km'}, {n: n for n in _S_LONGS if n != 'has_real_export'} | {'has_real_export': 'coalesce(has_real_export, 0)', 'weather_common_summer_days': 'weather_common_summer_days', 'weather_common_winter_days': 'weather_common_winter_days', 'n_filled_features': ' + '.join(f'CAST({n} IS NULL AS INT)' for n in _25_NAMES)}, 'mp_id, plz, station, temp_station')} FROM t""",
)
def pv25(spark, d):
    return pv.pv25(house_days(fx.meter_days(spark, d), dealt=True), fx.daily_weather(spark, d), house_geo(spark, d))
