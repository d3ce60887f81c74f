"""Further queries: rows of the inventory that share an operator with another, and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators import days as dy
from meterloom.operators import labels as lb
from meterloom.operators import pu
from meterloom.operators import weather as wx
from meterloom.plans import hp30 as hp
from meterloom.plans import pv
from meterloom.queries import base, hp30, models, tables
from meterloom.queries.base import SUMMER, cols, query
from meterloom.queries.hp30 import DAILY, FIT, HEAD, REST
from meterloom.queries.pv import CHOICE_SQL, house_geo
from meterloom.sources import store

@query("j13_interpolate_both_sides", base.SQL["m2_interpolate"].replace("i * 300", "i * 420").replace("range(2000)", "range(1500)").replace("<= 3600", "<= 7200"))
def j13(spark, d):
    """As-of samples on both sides at 7-minute points, over gaps of up to two hours."""
    s = tables.ten_minutes(spark, d)
    lo = s.agg(F.expr("min(t) div 3600 * 3600").alias("a"))
    grid = s.select("station").distinct().crossJoin(lo).select("station", F.explode(F.sequence(F.col("a"), F.col("a") + 1499 * 420, F.lit(420))).alias("t"))
    return wx.interpolate(s, grid, max_gap=7200)


@query("l1_unknown_marks", f"{tables.RG} SELECT trim(mark) AS mark, CAST(count(*) AS BIGINT) AS n FROM rg WHERE mark IS NOT NULL AND {tables.MARK} IS NULL GROUP BY 1")
def l1(spark, d):
    """What the label normaliser warns of: marks that mean neither yes nor no."""
    return lb.unknown_marks(fx.registry(spark, d))


@query("l3_installations_by_year", f"{tables.RG}, f AS (SELECT gp, min(try_strptime(installed, '%d.%m.%Y'))::DATE AS installed FROM rg WHERE {tables.MARK} = 1 GROUP BY gp HAVING min(try_strptime(installed, '%d.%m.%Y')) IS NOT NULL), h AS (SELECT mp_id, min(installed) AS installed FROM mt JOIN f USING (gp) GROUP BY mp_id) SELECT CAST(year(installed) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS houses FROM h GROUP BY 1")
def l3(spark, d):
    return lb.installation_dates(fx.registry(spark, d), fx.meters(spark, d)).groupBy(F.year("installed").alias("year")).agg(F.count(F.lit(1)).alias("houses"))


@query("m8_choose_station", f"{tables.F1}, {fx.WEATHER_SQL}, {CHOICE_SQL} SELECT mp_id, station, temp_station, {cols({'station_km': 'station_km', 'temp_station_km': 'temp_station_km'})} FROM hg JOIN ch USING (plz)")
def m8(spark, d):
    """Every house's station, and the one that lends it temperatures."""
    c = wx.choose_stations(house_geo(spark, d), fx.daily_weather(spark, d), fx.meter_days(spark, d).select("date").distinct())
    return c.select("mp_id", "station", "temp_station", "station_km", "temp_station_km")


@query("m9_house_place", f"{tables.F1}, x AS (SELECT mp_id, plz, count(*) AS n FROM fx GROUP BY ALL) SELECT mp_id, plz FROM (SELECT *, row_number() OVER (PARTITION BY mp_id ORDER BY n DESC, plz) AS r FROM x) WHERE r = 1")
def m9(spark, d):
    return wx.place_of_house(fx.meter_days(spark, d).select("mp_id", "plz"))


@query("w16_circular_window_max", f"{tables.F1}, c AS (SELECT mp_id, k, count(*) FILTER (kw >= 5) AS n FROM s WHERE channel = 'import' GROUP BY ALL), w AS (SELECT mp_id, (k - a + 96) % 96 AS start, sum(n) AS n FROM c, range(8) AS r(a) GROUP BY ALL) SELECT mp_id, CAST(max(n) AS BIGINT) AS most FROM w GROUP BY mp_id")
def w16(spark, d):
    """Most slots of 5 kW or more of a house within any two hours of the clock, midnight included."""
    days = dy.house_days(fx.meter_days(spark, d), dealt=True).where("channel = 'import'")
    counts = days.groupBy("mp_id").agg(*[st.count_if(p.at(F.col("kw"), k) >= 5).alias(f"c{k}") for k in range(p.SLOTS)])
    return counts.select("mp_id", F.greatest(*[p.balanced([F.col(f"c{(k + i) % 96}") for i in range(8)]) for k in range(p.SLOTS)]).alias("most"))


@query("a19_bounded_contrast", f"WITH {fx.SERIES_SQL}, x AS (SELECT mp_id, avg(value) FILTER ({SUMMER}) AS a, avg(value) FILTER (NOT {SUMMER}) AS b FROM t GROUP BY mp_id) SELECT mp_id, {cols({'contrast': 'CASE WHEN a + b > 0 THEN (a - b) / (a + b) END'})} FROM x")
def a19(spark, d):
    s = dy.in_season(p.SUMMER)
    x = fx.day_series(spark, d).groupBy("mp_id").agg(st.mean_if(s, F.col("value")).alias("a"), st.mean_if(~s, F.col("value")).alias("b"))
    return x.select("mp_id", st.contrast(F.col("a"), F.col("b")).alias("contrast"))


def _features(name, keep):
    renamed = {n: n for n in keep}

    @query(name, f"{HEAD}, {DAILY}, {FIT}, {REST} SELECT {cols({n: hp30._FEATS[n] for n in renamed}, None, 'mp_id')} FROM a")
    def run(spark, d):
        return hp.hp30(*hp30._inputs(spark, d)).select("mp_id", *keep)

    return run


_features("a24_year_slope_stability", ["hp_hdd_year_slope_stability", "hp_hdd_slope_kwh_per_degree_day"])
_features("a25_cold_high_load_hours", ["hp_cold_weather_high_load_hours_per_day"])


@query("a35_covered_days", f"WITH {tables._TEN}, x AS (SELECT to_timestamp(t) AT TIME ZONE 'UTC' AS ts, v FROM one) SELECT CAST(ts AS DATE) AS date, {cols({'mean': 'avg(v)'}, {'n': 'count(v)'})} FROM x GROUP BY 1 HAVING count(v) / 300.0 >= 0.7")
def a35(spark, d):
    x = tables.ten_minutes(spark, d).groupBy(F.timestamp_seconds("t").cast("date").alias("date")).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    return x.where(F.col("n") / 300.0 >= 0.7)


@query("f9_single_house", base.SQL["f1_pv20s"] + " WHERE mp_id = '7'")
def f9(spark, d):
    """One house: the filter reaches the scan, so no other house is read."""
    return pv.pv20s(dy.house_days(fx.meter_days(spark, d).where("mp_id = '7'"), dealt=True))


@query("l14_export_ids", f"{tables.RG}, {tables.HL} SELECT mp_id FROM hl")
def l14(spark, d):
    return lb.house_labels(fx.registry(spark, d), fx.meters(spark, d)).select("mp_id")


def _minutes(name: str, shift: int) -> str:
    return f"""b{name} AS (SELECT station, t - {shift} AS a_t, v AS a_v, lead(t - {shift}) OVER o AS b_t, lead(v) OVER o AS b_v FROM one WINDOW o AS (PARTITION BY station ORDER BY t)),
m{name} AS (SELECT g.station, g.t, CASE WHEN b_t IS NULL THEN CASE WHEN a_t = g.t THEN a_v END WHEN b_t - a_t <= 3600 THEN a_v + (b_v - a_v) * ((g.t - a_t)::DOUBLE / (b_t - a_t)) END AS v FROM g LEFT JOIN b{name} b ON b.station = g.station AND g.t >= a_t AND (b_t IS NULL OR g.t < b_t))"""


QUARTERS = f"""{tables._TEN}, g AS (SELECT station, CAST(epoch(TIMESTAMP '2024-01-09 23:00:00') AS BIGINT) + i * 60 AS t FROM (SELECT DISTINCT station FROM one), range(2880) AS r(i)), {_minutes('i', 300)}, {_minutes('c', 0)},
q AS (SELECT station, t // 900 * 900 AS t, avg(mi.v) AS irr, avg(mc.v) AS temp FROM mi JOIN mc USING (station, t) GROUP BY station, t // 900 * 900)"""


def _quarters(spark, d):
    s = tables.ten_minutes(spark, d)
    return wx.to_quarter_hours(s.select("station", "t", F.col("v").alias("irr"), F.col("v").alias("temp")), "2024-01-10", "2024-01-11")


@query("m3_quarter_hours", f"WITH {QUARTERS} SELECT station, t, {cols({'irr': 'irr', 'temp': 'temp'})} FROM q")
def m3(spark, d):
    return _quarters(spark, d).select("station", "t", "irr", "temp")


@query("m4_grid_mean", f"WITH {QUARTERS} SELECT t, round(round(CASE WHEN avg(irr) < 0 THEN 0 ELSE avg(irr) END + 1e-9, 2) + 1e-9, 6) AS irradiance, round(round(avg(temp) + 1e-9, 2) + 1e-9, 6) AS temperature FROM q GROUP BY t")
def m4(spark, d):
    return wx.grid_mean(_quarters(spark, d)).select("t", "irradiance", "temperature")


@query("s11_bucket_ids", f"WITH {tables._B} SELECT mp_id FROM (SELECT DISTINCT bucket, mp_id FROM b WHERE bucket < 4 ORDER BY bucket, mp_id LIMIT 12)")
def s11(spark, d):
    return store.first_ids(tables._bucketed(spark, d).where("bucket < 4"), 12).select("mp_id")


@query("s25_weather_text", "SELECT event_id, CAST(hour(ts + INTERVAL 1 HOUR) AS BIGINT) AS local_hour FROM events")
def s25(spark, d):
    text = fx.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'").alias("s"))
    return text.select("event_id", F.hour(F.from_utc_timestamp(F.to_timestamp("s", "yyyy-MM-dd'T'HH:mm:ssZ"), wx.ZONE)).alias("local_hour"))


_AUC = "x AS (SELECT label % 2 AS y, i, embedding[i]::DOUBLE + CASE WHEN i = 1 THEN (label % 2) * 0.3::DOUBLE ELSE 0 END AS v FROM embeddings, range(1, 65) AS r(i)), r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS rk FROM x), a AS (SELECT i, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY i)"


@query("t6_best_feature", f"WITH {_AUC} SELECT 'f' || CAST(i - 1 AS VARCHAR) AS feature, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END::BIGINT AS sign, round(auc + 1e-9, 6) AS auc FROM a ORDER BY abs(auc - 0.5) DESC, i LIMIT 1")
def t6(spark, d):
    name, sign, auc = pu.guide_feature(models.matrix(spark, d), models.FEATURES)
    return spark.createDataFrame([(name, sign, float(auc))], "feature string, sign long, auc double")


@query("w15_weeks", f"WITH {fx.SERIES_SQL} SELECT CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS sunday, {cols(None, {'n': 'count(*)', 'total': 'sum(value)'})} FROM t GROUP BY 1")
def w15(spark, d):
    return fx.day_series(spark, d).groupBy(F.date_add(F.date_trunc("week", "date").cast("date"), 6).alias("sunday")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


