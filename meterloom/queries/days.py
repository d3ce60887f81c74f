"""Queries of the day-level primitives: floors, meters, windows, runs, hours, quantiles, seasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators import days as dy
from meterloom.plans import bat20 as bat
from meterloom.plans import ev20 as ev
from meterloom.plans import hp21 as hp
from meterloom.plans import pv
from meterloom.queries.base import DAY, EVE, LATE, MID, NIGHT, NZ, SUMMER, cols, query
from meterloom.queries.bat_ev_hp import BAT_DAYS, EV_DAYS, HP_DAYS
from meterloom.queries.pv import DAY_SQL

F1 = f"WITH {fx.METER_SQL}"
KEY = "mp_id, channel, date"


def _days(spark, d):
    return dy.house_days(fx.meter_days(spark, d), dealt=True)


def _by_house(df, **aggs):
    """House-level digests keep results small: sums over the house's days."""
    return df.groupBy("mp_id", "channel").agg(*[a.alias(n) for n, a in aggs.items()])


@query("p2_kwh_to_kw", f"{F1} SELECT {cols({'kw_sum': 'sum(wh / 256.0)'}, {'n': 'count(wh)'}, 'mp_id')} FROM raw GROUP BY mp_id")
def p2(spark, d):
    raw = fx.meter_days(spark, d)
    return raw.groupBy("mp_id").agg(F.sum(p.window_sum(F.col("kw"))).alias("kw_sum"), F.sum(p.window_count(F.col("kw"))).alias("n"))


@query("p3_clean_meter_days", f"""{F1}, x AS (SELECT mp_id, channel, m, count(*) FILTER (wh < 0) AS n_neg, coalesce(max(r), -1) AS vmax_raw, sum(CASE WHEN channel = 'export' AND r < 0.05 THEN 0 ELSE r END) AS t FROM kwr GROUP BY ALL)
SELECT {cols({'vmax_raw': 'sum(vmax_raw)', 'tot': 'sum(t)'}, {'n_neg': 'sum(n_neg)'}, 'mp_id, channel')} FROM x GROUP BY mp_id, channel""")
def p3(spark, d):
    c = dy.clean(fx.meter_days(spark, d))
    return _by_house(c, vmax_raw=F.sum("vmax_raw"), tot=F.sum(p.window_sum(F.col("kw"))), n_neg=F.sum("n_neg"))


@query("p4_import_only", f"{F1} SELECT mp_id, CAST(count(DISTINCT date) AS BIGINT) AS days FROM fx WHERE channel = 'import' GROUP BY mp_id")
def p4(spark, d):
    return fx.meter_days(spark, d).where("channel = 'import'").groupBy("mp_id").agg(F.countDistinct("date").alias("days"))


@query("p5_season_days", f"WITH {fx.SERIES_SQL} SELECT mp_id, {cols(None, {'summer': f'count(*) FILTER ({SUMMER})', 'winter': 'count(*) FILTER (month(date) IN (11, 12, 1, 2))', 'other': 'count(*) FILTER (month(date) IN (3, 4, 9, 10))'})} FROM t GROUP BY mp_id")
def p5(spark, d):
    t = fx.day_series(spark, d)
    s, w = dy.in_season(p.SUMMER), dy.in_season(p.WINTER)
    return t.groupBy("mp_id").agg(st.count_if(s).alias("summer"), st.count_if(w).alias("winter"), st.count_if(~s & ~w).alias("other"))


def _season(name, by, flag, partition):
    sql = f"""WITH {fx.SPARSE_SQL}, x AS (SELECT DISTINCT {KEY} FROM s), y AS (SELECT *, {SUMMER} OR NOT coalesce(bool_or({SUMMER} AND {flag}) OVER (PARTITION BY {partition}), false) AS s FROM x)
SELECT {cols(None, {'used': 'count(*) FILTER (s)', 'days': 'count(*)'}, 'mp_id, channel')} FROM y GROUP BY mp_id, channel"""

    @query(name, sql)
    def run(spark, d):
        x = fx.sparse_meter_days(spark, d).select("mp_id", "channel", "date")
        x = dy.season_or_all(x, p.SUMMER, "s", by, (F.col("channel") == "import") if by == ["mp_id"] else None)
        return x.groupBy("mp_id", "channel").agg(st.count_if(F.col("s")).alias("used"), F.count(F.lit(1)).alias("days"))

    return run


_season("p6_season_or_all_house", ["mp_id"], "channel = 'import'", "mp_id")
_season("p7_season_or_all_channel", ["mp_id", "channel"], "true", "mp_id, channel")


@query("p8_season_or_all_import", f"""WITH {fx.SERIES_SQL}, y AS (SELECT *, {SUMMER} OR NOT bool_or({SUMMER}) OVER (PARTITION BY mp_id) AS s FROM t) SELECT mp_id, {cols(None, {'used': 'sum(value) FILTER (s)', 'days': 'count(*)'})} FROM y GROUP BY mp_id""")
def p8(spark, d):
    t = dy.season_or_all(fx.day_series(spark, d), p.SUMMER, "s", ["mp_id"])
    return t.groupBy("mp_id").agg(F.sum(F.when(F.col("s"), F.col("value"))).alias("used"), F.count(F.lit(1)).alias("days"))


@query("p9_coverage_gate", f"{F1}, x AS (SELECT {KEY}, count(kw) AS n, count(kw) FILTER ({DAY}) AS nd FROM s GROUP BY ALL) SELECT {cols(None, {'good': 'count(*) FILTER (n >= 86.4)', 'good_day': 'count(*) FILTER (nd >= 28.8)', 'days': 'count(*)'}, 'mp_id, channel')} FROM x GROUP BY mp_id, channel")
def p9(spark, d):
    x = _days(spark, d).select("mp_id", "channel", p.window_count(F.col("kw")).alias("n"), p.window_count(F.col("kw"), 9, 17).alias("nd"))
    return _by_house(x, good=st.count_if(F.col("n") >= 0.9 * 96), good_day=st.count_if(F.col("nd") >= 0.9 * 32), days=F.count(F.lit(1)))


@query("p10_full_day_gate", f"{F1}, x AS (SELECT mp_id, date, CASE WHEN count(kw) = 96 THEN sum(kw) / 4 END AS kwh FROM s WHERE channel = 'import' GROUP BY ALL) SELECT {cols({'kwh': 'sum(kwh)'}, {'full': 'count(kwh)', 'days': 'count(*)'}, 'mp_id')} FROM x GROUP BY mp_id")
def p10(spark, d):
    e = pv.electricity(_days(spark, d))
    return e.groupBy("mp_id").agg(F.sum("import_kwh").alias("kwh"), F.count("import_kwh").alias("full"), F.count(F.lit(1)).alias("days"))


_DST = "date NOT IN (DATE '2023-03-26', DATE '2023-10-29', DATE '2024-03-31', DATE '2024-10-27')"
STRICT = f"""{F1}, mneg AS (SELECT *, min(wh) OVER (PARTITION BY m, channel) < 0 AS bad FROM raw),
ss AS (SELECT {KEY}, CAST(k AS INTEGER) AS k, CASE WHEN count(*) = count(CASE WHEN bad THEN NULL ELSE v END) THEN sum(v) END AS v FROM (SELECT *, CASE WHEN channel = 'export' AND wh / 256.0::DOUBLE < 0.05 THEN 0::DOUBLE ELSE wh / 256.0::DOUBLE END AS v FROM mneg) GROUP BY ALL)"""


@query("p11_complete_days", f"{STRICT}, x AS (SELECT {KEY}, count(v) AS n FROM ss GROUP BY ALL) SELECT {cols(None, {'days': f'count(*) FILTER (n = 96 AND {_DST})'}, 'mp_id, channel')} FROM x GROUP BY mp_id, channel HAVING count(*) FILTER (n = 96 AND {_DST}) > 0")
def p11(spark, d):
    return dy.complete_days(dy.strict_days(fx.meter_days(spark, d), dealt=True)).groupBy("mp_id", "channel").agg(F.count(F.lit(1)).alias("days"))


@query("p12_negative_invalidates", f"{F1}, x AS (SELECT m, channel, min(wh) AS lo FROM raw GROUP BY ALL) SELECT channel, {cols(None, {'bad': 'count(*) FILTER (lo < 0)', 'all_rows': 'count(*)'})} FROM x GROUP BY channel")
def p12(spark, d):
    c = dy.clean(fx.meter_days(spark, d))
    return c.groupBy("channel").agg(st.count_if(F.col("n_neg") > 0).alias("bad"), F.count(F.lit(1)).alias("all_rows"))


@query("p13_min_days_gate", f"WITH {fx.SERIES_SQL} SELECT mp_id, {cols({'mean': 'CASE WHEN count(*) >= 20 THEN avg(value) END'}, {'n': 'count(*)'})} FROM t GROUP BY mp_id")
def p13(spark, d):
    return fx.day_series(spark, d).groupBy("mp_id").agg(F.when(F.count(F.lit(1)) >= 20, F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("p14_guarded_ratio", f"{F1}, x AS (SELECT mp_id, sum(kw) FILTER (channel = 'export' AND kw >= 1) AS e, sum(kw) FILTER (channel = 'import') AS i FROM s GROUP BY mp_id) SELECT mp_id, {cols({'r': 'CASE WHEN i > 0 THEN e / i END', 'r2': 'CASE WHEN e > 100 THEN i / e END'})} FROM x")
def p14(spark, d):
    kw = F.col("kw")
    x = _days(spark, d).select("mp_id", "channel", p.window_sum(kw).alias("t"), p.window_sum(kw, f=lambda v, k: F.when(v >= 1, v)).alias("t1"), p.window_count(kw, test=lambda v: v >= 1).alias("n1"))
    e = F.sum(F.when((F.col("channel") == "export") & (F.col("n1") > 0), F.col("t1")))
    i = F.sum(F.when(F.col("channel") == "import", F.col("t")))
    return x.groupBy("mp_id").agg(st.ratio(e, i).alias("r"), (i / F.when(e > 100, e)).alias("r2"))


@query("p15_clipped_denominator", f"{F1}, x AS (SELECT mp_id, date, sum(kw) FILTER ({MID}) AS mid, sum(kw) AS tot FROM s WHERE channel = 'import' GROUP BY ALL) SELECT mp_id, {cols({'share': 'avg(coalesce(mid, 0) / greatest(coalesce(tot, 0), 0.02))'})} FROM x GROUP BY mp_id")
def p15(spark, d):
    kw = F.col("kw")
    x = _days(spark, d).where("channel = 'import'").select("mp_id", (p.window_sum(kw, 11, 15) / F.greatest(p.window_sum(kw), F.lit(0.02))).alias("share"))
    return x.groupBy("mp_id").agg(F.avg("share").alias("share"))


@query("p21_local_day_hours", "SELECT DATE '2023-01-01' + CAST(i AS INTEGER) AS date, CAST(CASE WHEN DATE '2023-01-01' + CAST(i AS INTEGER) IN (DATE '2023-03-26', DATE '2024-03-31') THEN 23 WHEN DATE '2023-01-01' + CAST(i AS INTEGER) IN (DATE '2023-10-29', DATE '2024-10-27') THEN 25 ELSE 24 END AS BIGINT) AS hours FROM range(731) AS r(i)")
def p21(spark, d):
    x = spark.range(731).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    return x.withColumn("hours", dy.local_day_hours(F.col("date")).cast("long"))


_WINDOWS = {"tot": ("true", (0, 24)), "mid": (MID, (11, 15)), "night": (NIGHT, (1, 5)), "day": (DAY, (9, 17)), "late": (LATE, (20, 6)), "nz": (NZ, (22, 6)), "eve": (EVE, (17, 23))}


@query("a1_window_sums", f"{F1} SELECT {cols({n: f'sum(kw) FILTER ({w})' for n, (w, _) in _WINDOWS.items()}, None, 'mp_id, channel')} FROM s GROUP BY mp_id, channel")
def a1(spark, d):
    x = _days(spark, d).select("mp_id", "channel", *[p.window_sum(F.col("kw"), *w).alias(n) for n, (_, w) in _WINDOWS.items()])
    return _by_house(x, **{n: F.sum(n) for n in _WINDOWS})


@query("a2_window_counts", f"{F1} SELECT {cols(None, {n: f'count(kw) FILTER ({w})' for n, (w, _) in _WINDOWS.items()}, 'mp_id, channel')} FROM s GROUP BY mp_id, channel")
def a2(spark, d):
    x = _days(spark, d).select("mp_id", "channel", *[p.window_count(F.col("kw"), *w).alias(n) for n, (_, w) in _WINDOWS.items()])
    return _by_house(x, **{n: F.sum(n) for n in _WINDOWS})


@query("a3_sum_meters", f"{F1}, x AS (SELECT {KEY}, sum(kw) AS t, count(kw) AS n, sum(neg) AS neg, coalesce(max(rmax), -1) AS v, max(meters) AS m FROM s GROUP BY ALL) SELECT {cols({'tot': 'sum(t)', 'vmax_raw': 'sum(v)'}, {'slots': 'sum(n)', 'n_neg': 'sum(neg)', 'days': 'count(*)'}, 'mp_id, channel')} FROM x GROUP BY mp_id, channel")
def a3(spark, d):
    kw = F.col("kw")
    x = _days(spark, d).select("mp_id", "channel", p.window_sum(kw).alias("t"), p.window_count(kw).alias("n"), "n_neg", "vmax_raw")
    return _by_house(x, tot=F.sum("t"), vmax_raw=F.sum("vmax_raw"), slots=F.sum("n"), n_neg=F.sum("n_neg"), days=F.count(F.lit(1)))


@query("a4_sum_meters_strict", f"{STRICT} SELECT {cols({'tot': 'sum(v)'}, {'slots': 'count(v)'}, 'mp_id, channel')} FROM ss GROUP BY mp_id, channel")
def a4(spark, d):
    kw = F.col("kw")
    x = dy.strict_days(fx.meter_days(spark, d), dealt=True).select("mp_id", "channel", F.when(p.window_count(kw) > 0, p.window_sum(kw)).alias("t"), p.window_count(kw).alias("n"))
    return _by_house(x, tot=F.sum("t"), slots=F.sum("n"))


@query("a5_house_stats", f"WITH {fx.SERIES_SQL} SELECT mp_id, {cols({'mean': 'avg(value)'}, {'n': 'count(*)', 'total': 'sum(value)', 'lo': 'min(value)', 'hi': 'max(value)'})} FROM t GROUP BY mp_id")
def a5(spark, d):
    return fx.day_series(spark, d).groupBy("mp_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a6_conditional_share", f"{F1}, x AS (SELECT mp_id, date, sum(kw) AS t FROM s WHERE channel = 'export' GROUP BY ALL) SELECT mp_id, {cols({'share': 'avg(CASE WHEN t / 4 > 0.1 THEN 1.0 ELSE 0 END)'}, {'days': 'count(*) FILTER (t / 4 > 0.1)'})} FROM x GROUP BY mp_id")
def a6(spark, d):
    x = _days(spark, d).where("channel = 'export'").select("mp_id", p.window_sum(F.col("kw")).alias("t"))
    t = F.col("t") / 4 > 0.1
    return x.groupBy("mp_id").agg(st.mean_if(t).alias("share"), st.count_if(t).alias("days"))


@query("a7_exact_quantiles", f"WITH {fx.SERIES_SQL} SELECT mp_id, {cols({f'q{int(q * 100):02d}': f'quantile_cont(value::DOUBLE, {q})' for q in (0.05, 0.1, 0.9, 0.95, 0.99)})} FROM t GROUP BY mp_id")
def a7(spark, d):
    return fx.day_series(spark, d).groupBy("mp_id").agg(*[F.percentile("value", F.lit(q)).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.1, 0.9, 0.95, 0.99)])


@query("a8_median", f"WITH {fx.SERIES_SQL} SELECT mp_id, {cols({'med': 'median(value::DOUBLE)'})} FROM t GROUP BY mp_id")
def a8(spark, d):
    return fx.day_series(spark, d).groupBy("mp_id").agg(F.median("value").alias("med"))


@query("a9_mad", f"WITH {fx.SERIES_SQL}, x AS (SELECT *, median(value::DOUBLE) OVER (PARTITION BY mp_id) AS m FROM t) SELECT mp_id, {cols({'mad': 'median(abs(value - m))'})} FROM x GROUP BY mp_id")
def a9(spark, d):
    t = fx.day_series(spark, d).withColumn("m", F.percentile("value", F.lit(0.5)).over(Window.partitionBy("mp_id")))
    return t.groupBy("mp_id").agg(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).alias("mad"))


_XY = "x AS (SELECT mp_id, date_diff('day', DATE '1992-01-01', date)::DOUBLE AS x, value / 1000.0::DOUBLE AS y FROM t)"


def _xy(spark, d):
    return fx.day_series(spark, d).select("mp_id", F.datediff("date", F.lit("1992-01-01").cast("date")).cast("double").alias("x"), (F.col("value") / 1000.0).alias("y"))


@query("a10_ols_slope", f"WITH {fx.SERIES_SQL}, {_XY} SELECT mp_id, {cols({'slope': 'CASE WHEN count(*) >= 3 AND var_pop(x) > 0.01 THEN covar_pop(x, y) / var_pop(x) END'}, {'n': 'count(*)'})} FROM x GROUP BY mp_id")
def a10(spark, d):
    return _xy(spark, d).groupBy("mp_id").agg(F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("x") > 0.01), st.slope(F.col("x"), F.col("y"))).alias("slope"), F.count(F.lit(1)).alias("n"))


def _pearson(name, least):
    @query(name, f"WITH {fx.SERIES_SQL}, {_XY} SELECT mp_id, {cols({'r': f'CASE WHEN count(*) >= {least} AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END'}, {'n': 'count(*)'})} FROM x GROUP BY mp_id")
    def run(spark, d):
        return _xy(spark, d).groupBy("mp_id").agg(F.when(F.count(F.lit(1)) >= least, st.pearson(F.col("x"), F.col("y"))).alias("r"), F.count(F.lit(1)).alias("n"))


_pearson("a11_pearson", 2)
_pearson("a12_pearson_guarded", 20)

_PVD = f"{DAY_SQL}"


@query("a13_energy_weighted_hour", f"{_PVD} SELECT mp_id, {cols({'mean_h': 'CASE WHEN sum(tot) > 0 THEN sum(hw) / sum(tot) END', 'std_h': 'CASE WHEN sum(tot) > 0 THEN sqrt(greatest(sum(hw2) / sum(tot) - pow(sum(hw) / sum(tot), 2), 0)) END'})} FROM d WHERE e GROUP BY mp_id")
def a13(spark, d):
    x = pv.days_table(_days(spark, d)).where("channel = 'export'").groupBy("mp_id").agg(F.sum("hw").alias("h"), F.sum("hw2").alias("h2"), F.sum("tot").alias("t"))
    m = st.ratio(F.col("h"), F.col("t"))
    return x.select("mp_id", m.alias("mean_h"), F.when(F.col("t") > 0, F.sqrt(F.greatest(F.col("h2") / F.col("t") - m * m, F.lit(0.0)))).alias("std_h"))


@query("a14_charge_variation", f"WITH {fx.METER_SQL}, {BAT_DAYS} SELECT mp_id, {cols({'cv': 'avg(cv)', 'mean': 'avg(charge)'})} FROM d2 WHERE i AND n_charge >= 25.2 GROUP BY mp_id")
def a14(spark, d):
    x = bat.days_table(_days(spark, d)).where("channel = 'import' AND n_charge >= 0.9 * 28")
    m = F.col("charge_sum") / F.col("n_charge")
    cv = F.sqrt(F.greatest(F.col("charge_sq") / F.col("n_charge") - m * m, F.lit(0.0))) / F.greatest(m, F.lit(0.02))
    return x.select("mp_id", cv.alias("cv"), m.alias("m")).groupBy("mp_id").agg(F.avg("cv").alias("cv"), F.avg("m").alias("mean"))


@query("a15_circular_spread", f"WITH {fx.METER_SQL}, {EV_DAYS} SELECT mp_id, {cols({'spread': 'sqrt(-2 * ln(least(greatest(sqrt(pow(avg(cos(blk_start_h * 2 * pi() / 24)), 2) + pow(avg(sin(blk_start_h * 2 * pi() / 24)), 2)), 1e-12), 1.0))) * 24 / (2 * pi())'}, {'n': 'count(*)'})} FROM ed WHERE blk_start_h IS NOT NULL GROUP BY mp_id")
def a15(spark, d):
    x = ev.windows_table(_days(spark, d)).where("blk_start_h IS NOT NULL")
    return x.groupBy("mp_id").agg(st.circular_std_hours(F.col("blk_start_h")).alias("spread"), F.count(F.lit(1)).alias("n"))


@query("a16_monthly_amplitude", f"WITH {fx.SERIES_SQL}, m AS (SELECT mp_id, month(date) AS mon, avg(value) AS v FROM t GROUP BY ALL) SELECT mp_id, {cols({'amplitude': '(max(v) - min(v)) / avg(v)'}, {'months': 'count(*)'})} FROM m GROUP BY mp_id")
def a16(spark, d):
    m = fx.day_series(spark, d).groupBy("mp_id", F.month("date").alias("mon")).agg(F.avg("value").alias("v"))
    return m.groupBy("mp_id").agg(((F.max("v") - F.min("v")) / F.avg("v")).alias("amplitude"), F.count(F.lit(1)).alias("months"))


@query("a17_month_anomaly", f"WITH {fx.SERIES_SQL} SELECT mp_id, date, {cols({'anomaly': 'value - avg(value) OVER (PARTITION BY mp_id, month(date))'})} FROM t")
def a17(spark, d):
    w = Window.partitionBy("mp_id", F.month("date"))
    return fx.day_series(spark, d).select("mp_id", "date", (F.col("value") - F.avg("value").over(w)).alias("anomaly"))


@query("a18_flatness", f"WITH {fx.SERIES_SQL}, x AS (SELECT mp_id, coalesce(sum(value) FILTER ({SUMMER}), 0)::DOUBLE / 1000 AS a, coalesce(sum(value) FILTER (NOT {SUMMER}), 0)::DOUBLE / 1000 AS b FROM t GROUP BY mp_id) SELECT mp_id, {cols({'f': '-abs(ln((a + 0.02) / (b + 0.02)))', 'contrast': 'CASE WHEN a + b > 0 THEN (a - b) / (a + b) END'})} FROM x")
def a18(spark, d):
    s = dy.in_season(p.SUMMER)
    x = fx.day_series(spark, d).groupBy("mp_id").agg((F.coalesce(F.sum(F.when(s, F.col("value"))), F.lit(0)).cast("double") / 1000).alias("a"), (F.coalesce(F.sum(F.when(~s, F.col("value"))), F.lit(0)).cast("double") / 1000).alias("b"))
    return x.select("mp_id", st.flatness(F.col("a"), F.col("b"), 0.02).alias("f"), st.contrast(F.col("a"), F.col("b")).alias("contrast"))


@query("a20_quartile_split_means", f"WITH {fx.SERIES_SQL}, x AS (SELECT *, quantile_cont(value::DOUBLE, 0.75) OVER (PARTITION BY mp_id) AS hi, quantile_cont(value::DOUBLE, 0.25) OVER (PARTITION BY mp_id) AS lo, dayofweek(date) AS w FROM t) SELECT mp_id, {cols({'top': 'avg(w) FILTER (value >= hi)', 'bottom': 'avg(w) FILTER (value <= lo)'})} FROM x GROUP BY mp_id")
def a20(spark, d):
    w = Window.partitionBy("mp_id")
    x = fx.day_series(spark, d).withColumns({"hi": F.percentile("value", F.lit(0.75)).over(w), "lo": F.percentile("value", F.lit(0.25)).over(w), "w": F.dayofweek("date") - 1})
    return x.groupBy("mp_id").agg(st.mean_if(F.col("value") >= F.col("hi"), F.col("w")).alias("top"), st.mean_if(F.col("value") <= F.col("lo"), F.col("w")).alias("bottom"))


@query("a21_median_gap", f"WITH {fx.SERIES_SQL}, x AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY mp_id ORDER BY date), date) AS g FROM t) SELECT mp_id, {cols({'gap': 'coalesce(median(g::DOUBLE), date_diff(' + chr(39) + 'day' + chr(39) + ', min(date), max(date)) + 1)'})} FROM x GROUP BY mp_id")
def a21(spark, d):
    x = fx.day_series(spark, d).withColumn("g", F.datediff("date", F.lag("date").over(Window.partitionBy("mp_id").orderBy("date"))))
    return x.groupBy("mp_id").agg(F.coalesce(F.percentile("g", F.lit(0.5)), (F.datediff(F.max("date"), F.min("date")) + 1).cast("double")).alias("gap"))


@query("a22_share_near_median", f"WITH {fx.SERIES_SQL}, x AS (SELECT *, median(value::DOUBLE) OVER (PARTITION BY mp_id) AS m FROM t) SELECT mp_id, {cols({'share': 'avg(CASE WHEN abs(value - m) <= 0.15 * m THEN 1.0 ELSE 0 END)'})} FROM x GROUP BY mp_id")
def a22(spark, d):
    t = fx.day_series(spark, d).withColumn("m", F.percentile("value", F.lit(0.5)).over(Window.partitionBy("mp_id")))
    return t.groupBy("mp_id").agg(F.avg((F.abs(F.col("value") - F.col("m")) <= 0.15 * F.col("m")).cast("double")).alias("share"))


@query("a26_weekly_active_share", f"WITH {fx.SERIES_SQL}, k AS (SELECT mp_id, date_trunc('week', date) AS wk, count(*) AS n, count(*) FILTER (value > 100000) AS a FROM t GROUP BY ALL HAVING count(*) >= 1) SELECT mp_id, {cols({'share': 'avg(CASE WHEN a::DOUBLE / n >= 0.5 THEN 1.0 ELSE 0 END)'}, {'weeks': 'count(*)'})} FROM k GROUP BY mp_id")
def a26(spark, d):
    k = fx.day_series(spark, d).groupBy("mp_id", F.date_trunc("week", "date").alias("wk")).agg(F.count(F.lit(1)).alias("n"), st.count_if(F.col("value") > 100000).alias("a"))
    return k.groupBy("mp_id").agg(F.avg((F.col("a") / F.col("n") >= 0.5).cast("double")).alias("share"), F.count(F.lit(1)).alias("weeks"))


@query("a27_circular_concentration", """WITH c AS (SELECT user_id, CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT user_id, (k - a + 96) % 96 AS win, sum(n) AS n FROM c, range(8) AS r(a) GROUP BY ALL) SELECT user_id, round(CAST(max(n) AS DOUBLE) / (SELECT sum(n) FROM c WHERE c.user_id = w.user_id) + 1e-9, 6) AS mass FROM w GROUP BY user_id""")
def a27(spark, d):
    c = fx.table(spark, d, "events").groupBy("user_id", F.expr("hour(ts) * 4 + minute(ts) div 15").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    w = c.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(7)))).groupBy("user_id", ((F.col("k") - F.col("a") + 96) % 96).alias("win")).agg(F.sum("n").alias("n"))
    return w.groupBy("user_id").agg(F.max("n").alias("top")).join(c.groupBy("user_id").agg(F.sum("n").alias("all")), "user_id").select("user_id", (F.col("top") / F.col("all")).alias("mass"))


@query("a32_day_extremes", f"{F1}, x AS (SELECT mp_id, date, min(kw) AS lo, avg(kw) AS mean, max(kw) AS hi, quantile_cont(kw, 0.95) AS p95 FROM s WHERE channel = 'import' GROUP BY ALL) SELECT mp_id, {cols({n: f'sum({n})' for n in ('lo', 'mean', 'hi', 'p95')})} FROM x GROUP BY mp_id")
def a32(spark, d):
    kw = F.col("kw")
    x = _days(spark, d).where("channel = 'import'").select("mp_id", F.array_min(kw).alias("lo"), st.ratio(p.window_sum(kw), p.window_count(kw)).alias("mean"), p.largest(kw).alias("hi"), p.quantile(kw, 0.95).alias("p95"))
    return x.groupBy("mp_id").agg(*[F.sum(n).alias(n) for n in ("lo", "mean", "hi", "p95")])


@query("w1_adjacent_days", f"WITH {fx.SERIES_SQL}, x AS (SELECT mp_id, date, value, CASE WHEN lag(date) OVER o = date - 1 THEN lag(value) OVER o END AS prev, CASE WHEN lead(date) OVER o = date + 1 THEN lead(value) OVER o END AS next FROM t WINDOW o AS (PARTITION BY mp_id ORDER BY date)) SELECT mp_id, date, value, CAST(prev AS BIGINT) AS prev, CAST(next AS BIGINT) AS next FROM x")
def w1(spark, d):
    w = Window.partitionBy("mp_id").orderBy("date")
    x = fx.day_series(spark, d)
    return x.select("mp_id", "date", "value", F.when(F.datediff("date", F.lag("date").over(w)) == 1, F.lag("value").over(w)).alias("prev"), F.when(F.datediff(F.lead("date").over(w), "date") == 1, F.lead("value").over(w)).alias("next"))


@query("w2_percentile_rank", f"WITH {fx.SERIES_SQL} SELECT mp_id, date, {cols({'pct': '(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER ()'})} FROM t")
def w2(spark, d):
    t = fx.day_series(spark, d)
    return t.join(st.percentile_ranks(t, "value"), "value").select("mp_id", "date", "pct")


@query("w3_equal_bands", f"""WITH {fx.SERIES_SQL}, e AS (SELECT quantile_cont(value::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM t)
SELECT CAST(len(list_filter(list_distinct(c), lambda x: x < value)) AS BIGINT) AS band, {cols({'mean': 'avg(value)'}, {'n': 'count(*)'})} FROM t, e GROUP BY 1""")
def w3(spark, d):
    t = fx.day_series(spark, d)
    edges = t.agg(F.percentile("value", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("c"))
    x = t.crossJoin(F.broadcast(edges)).withColumn("band", F.size(F.filter(F.array_distinct("c"), lambda e: e < F.col("value"))).cast("long"))
    return x.groupBy("band").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("w4_rising_edges", f"WITH {fx.METER_SQL}, {BAT_DAYS} SELECT {cols(None, {'bursts': 'sum(bursts)', 'charge_bursts': 'sum(cbursts)'}, 'mp_id, channel')} FROM d0 GROUP BY mp_id, channel")
def w4(spark, d):
    return _by_house(bat.days_table(_days(spark, d)), bursts=F.sum("bursts"), charge_bursts=F.sum("charge_bursts"))


@query("w5_run_lengths", f"WITH {fx.METER_SQL}, {EV_DAYS} SELECT mp_id, {cols(None, {'runs': 'sum(n_runs)', 'longest': 'sum(blk_len)', 'days': 'count(*) FILTER (blk_len >= 4)'})} FROM ed GROUP BY mp_id")
def w5(spark, d):
    return ev.windows_table(_days(spark, d)).groupBy("mp_id").agg(F.sum("n_runs").alias("runs"), F.sum("blk_len").alias("longest"), st.count_if(F.col("blk_len") >= 4).alias("days"))


@query("w7_plateau_share", f"WITH {fx.METER_SQL}, {BAT_DAYS} SELECT mp_id, {cols({'plateau': 'avg(plateau)'}, {'days': 'count(plateau)'})} FROM d0 WHERE channel = 'export' GROUP BY mp_id")
def w7(spark, d):
    x = bat.days_table(_days(spark, d)).where("channel = 'export'")
    return x.groupBy("mp_id").agg(F.avg("plateau").alias("plateau"), F.count("plateau").alias("days"))


@query("w8_night_ramps", f"WITH {fx.METER_SQL}, {BAT_DAYS} SELECT mp_id, {cols(None, {'ramps': 'sum(ramps)'})} FROM d0 WHERE channel = 'import' GROUP BY mp_id")
def w8(spark, d):
    return bat.days_table(_days(spark, d)).where("channel = 'import'").groupBy("mp_id").agg(F.sum("ramps").alias("ramps"))


@query("w9_run_modulation", f"WITH {fx.METER_SQL}, {fx.WEATHER_SQL}, {HP_DAYS} SELECT mp_id, {cols({'jump': 'sum(run_jump)', 'level': 'sum(run_level)', 'hours': 'sum(run_hours)'}, {'cycles': 'sum(n_cycles)'})} FROM h1 GROUP BY mp_id")
def w9(spark, d):
    return hp.days_table(_days(spark, d)).groupBy("mp_id").agg(F.sum("run_jump").alias("jump"), F.sum("run_level").alias("level"), F.sum("run_hours").alias("hours"), F.sum("n_cycles").alias("cycles"))


@query("w10_largest_step", f"WITH {fx.METER_SQL}, {EV_DAYS} SELECT mp_id, {cols({'step': 'sum(step_up)', 'top': 'max(step_up)'})} FROM wd GROUP BY mp_id")
def w10(spark, d):
    return ev.windows_table(_days(spark, d)).groupBy("mp_id").agg(F.sum("step_up").alias("step"), F.max("step_up").alias("top"))


@query("w11_block_flatness", f"WITH {fx.METER_SQL}, {EV_DAYS} SELECT mp_id, {cols({'flat': 'sum(blk_flat_share)', 'level': 'sum(blk_level)', 'energy': 'sum(blk_energy)'})} FROM ed GROUP BY mp_id")
def w11(spark, d):
    return ev.windows_table(_days(spark, d)).groupBy("mp_id").agg(F.sum("blk_flat_share").alias("flat"), F.sum("blk_level").alias("level"), F.sum("blk_energy").alias("energy"))


@query("w12_min_hour", f"{_PVD} SELECT {cols({'mean_hour': 'avg(min_hour)', 'offset_': 'avg(abs(min_hour - 13.5))'}, None, 'mp_id, channel')} FROM d GROUP BY mp_id, channel")
def w12(spark, d):
    return _by_house(pv.days_table(_days(spark, d)), mean_hour=F.avg("min_hour"), offset_=F.avg(F.abs(F.col("min_hour") - 13.5)))


@query("w13_day_quantiles", f"{F1}, x AS (SELECT {KEY}, quantile_cont(kw, 0.1) AS p10, quantile_cont(kw, 0.99) AS p99 FROM s GROUP BY ALL) SELECT {cols({'p10': 'sum(p10)', 'p99': 'sum(p99)'}, {'n': 'count(p10)'}, 'mp_id, channel')} FROM x GROUP BY mp_id, channel")
def w13(spark, d):
    x = _days(spark, d).select("mp_id", "channel", p.quantile(F.col("kw"), 0.1).alias("p10"), p.quantile(F.col("kw"), 0.99).alias("p99"))
    return _by_house(x, p10=F.sum("p10"), p99=F.sum("p99"), n=F.count("p10"))


@query("j15_noon_windows", f"WITH {fx.METER_SQL}, {EV_DAYS} SELECT mp_id, {cols({'tot': 'sum(tot)', 'base': 'sum(base)'}, {'slots': 'sum(n_valid)', 'whole': 'count(*) FILTER (n_valid > 48)'})} FROM wd GROUP BY mp_id")
def j15(spark, d):
    return ev.windows_table(_days(spark, d)).groupBy("mp_id").agg(F.sum("tot").alias("tot"), F.sum("base").alias("base"), F.sum("n_valid").alias("slots"), st.count_if(F.col("n_valid") > 48).alias("whole"))
