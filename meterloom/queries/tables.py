"""Queries of joins, sets, sorts, sources, labels and weather."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.operators import days as dy
from meterloom.operators import labels as lb
from meterloom.operators import weather as wx
from meterloom.plans import pv
from meterloom.queries.base import SUMMER, cols, query
from meterloom.queries.pv import CHOICE_SQL, house_geo
from meterloom.session import tasks
from meterloom.sources import meter_csv, store

F1 = f"WITH {fx.METER_SQL}"
RG = f"WITH {fx.REGISTRY_SQL}"
MARK = "CASE WHEN lower(trim(mark)) = 'x' THEN 1 WHEN mark IS NULL OR trim(mark) IN ('-', '') THEN 0 END"
CL = f"cl AS (SELECT gp, max({MARK}) AS label FROM rg GROUP BY gp HAVING max({MARK}) IS NOT NULL)"
HL = f"{CL}, hl AS (SELECT mp_id, label FROM (SELECT mp_id, label, row_number() OVER (PARTITION BY mp_id ORDER BY gp, meter) AS r FROM mt JOIN cl USING (gp)) WHERE r = 1)"


# Sources. Text lines stand in for monthly files: every lineitem becomes a row of three readings' fields.
_LINES = "lines AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS line, l_suppkey, l_orderkey, l_linenumber FROM lineitem)"


def lines(spark, d):
    """Text rows as in the monthly files, 96 values each: some counters unknown, dates unreadable, values missing."""
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate").repartition(tasks(spark))
    obis = F.when(F.col("l_linenumber") % 5 == 0, "1-1:9.9.9*255").when(F.col("l_linenumber") % 2 == 0, "1-1:2.29.0*255").otherwise("1-1:1.29.0*255")
    date = F.when(F.col("l_orderkey") % 11 == 0, "31.02.2023").otherwise(F.date_format("l_shipdate", "dd.MM.yyyy"))
    value = lambda k: F.when((F.col("l_orderkey") + k) % 13 == 0, "-").when((F.col("l_orderkey") + k) % 17 == 0, " ").otherwise((F.col("l_quantity").cast("long") * (k % 4) / 256).cast("string"))
    return li.select("l_orderkey", "l_linenumber", F.concat_ws(";", F.concat(F.lit(" "), F.col("l_suppkey").cast("string")), obis, date, F.lit("5000"), *[value(k) for k in range(96)], F.lit("")).alias("value"))


WHERE = {"mp_id": 0, "obis": 1, "date": 2, "plz": 3}
_PARSED = "ps AS (SELECT CAST(l_suppkey AS VARCHAR) AS mp_id, CASE WHEN l_linenumber % 2 = 0 THEN 'export' ELSE 'import' END AS channel, CAST(l_shipdate AS DATE) AS date, l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_orderkey % 11 <> 0), pv AS (SELECT ps.*, k, CASE WHEN (l_orderkey + k) % 13 = 0 OR (l_orderkey + k) % 17 = 0 THEN NULL ELSE q * (k % 4) / 256.0::DOUBLE * 4 END AS kw FROM ps, range(96) AS r(k))"


@query("s4_parse_lines", f"WITH {_PARSED} SELECT mp_id, channel, {cols({'tot': 'sum(kw)'}, {'values_': 'count(kw)', 'rows_': 'count(*) / 96', 'days': 'count(DISTINCT date)'})} FROM pv GROUP BY mp_id, channel")
def s4(spark, d):
    x = meter_csv.parse(lines(spark, d), WHERE)
    x = x.select("mp_id", "channel", "date", p.window_sum(F.col("kw")).alias("t"), p.window_count(F.col("kw")).alias("n"))
    return x.groupBy("mp_id", "channel").agg(F.sum("t").alias("tot"), F.sum("n").alias("values_"), F.count(F.lit(1)).alias("rows_"), F.countDistinct("date").alias("days"))


@query("s5_filter_houses", f"WITH {_PARSED} SELECT mp_id, {cols({'tot': 'sum(kw)'}, {'rows_': 'count(*) / 96'})} FROM pv WHERE mp_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000) GROUP BY mp_id")
def s5(spark, d):
    houses = fx.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("mp_id"))
    x = meter_csv.parse(lines(spark, d), WHERE, houses=houses)
    return x.groupBy("mp_id").agg(F.sum(p.window_sum(F.col("kw"))).alias("tot"), F.count(F.lit(1)).alias("rows_"))


@query("s6_first_ids", "SELECT CAST(l_suppkey AS VARCHAR) AS mp_id FROM lineitem GROUP BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), CAST(l_suppkey AS VARCHAR) LIMIT 20")
def s6(spark, d):
    return meter_csv.first_ids(lines(spark, d).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber")), 20)


@query("s16_check_file", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (l_linenumber % 5 <> 0) AS BIGINT) AS obis_ok, CAST(count(*) FILTER (l_orderkey % 11 <> 0) AS BIGINT) AS date_ok, CAST(count(*) FILTER (l_linenumber % 5 <> 0 AND l_orderkey % 11 <> 0) AS BIGINT) AS both_ok FROM lineitem")
def s16(spark, d):
    return meter_csv.check(lines(spark, d), WHERE)


@query("p1_obis_channel", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'export' ELSE 'import' END AS channel, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_orderkey % 11 <> 0 GROUP BY 1")
def p1(spark, d):
    return meter_csv.parse(lines(spark, d), WHERE).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def _bucketed(spark, d):
    return fx.meter_days(spark, d).withColumn("bucket", store.bucket_of(F.col("mp_id"), 16))


_B = "b AS (SELECT CAST(l_suppkey AS VARCHAR) AS mp_id, CAST(l_suppkey % 16 AS INTEGER) AS bucket FROM lineitem)"


@query("s9_first_store_ids", f"WITH {_B} SELECT DISTINCT CAST(bucket AS BIGINT) AS bucket, mp_id FROM b ORDER BY 1, 2 LIMIT 15")
def s9(spark, d):
    return store.first_ids(_bucketed(spark, d), 15)


@query("s10_store_ids", f"WITH {_B} SELECT DISTINCT mp_id FROM b WHERE bucket IN (0, 1, 2, 3)")
def s10(spark, d):
    return store.ids(_bucketed(spark, d), [0, 1, 2, 3])


@query("s12_month_range", f"WITH {fx.SERIES_SQL} SELECT {cols(None, {'n': 'count(*)', 'total': 'sum(value)'})} FROM t WHERE date >= DATE '1996-12-01' AND date < DATE '1997-01-01'")
def s12(spark, d):
    lo, hi = meter_csv.month_range("Dezember 1996")
    return fx.day_series(spark, d).where((F.col("date") >= lo) & (F.col("date") < hi)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s15_store_stats", f"WITH {_B} SELECT CAST(bucket AS BIGINT) AS bucket, {cols(None, {'rows': 'count(*)', 'houses': 'count(DISTINCT mp_id)'})} FROM b GROUP BY bucket")
def s15(spark, d):
    return store.stats(_bucketed(spark, d))


@query("s24_id_list", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS mp_id FROM supplier")
def s24(spark, d):
    rows = fx.table(spark, d, "supplier").select(F.concat_ws(";", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    return meter_csv.id_list(rows.unionByName(spark.createDataFrame([("MP ID;name",), ("",)], "value string")))


# Joins.
@query("j1_labels_to_meters", f"{RG}, {CL} SELECT gp, meter, CAST(label AS BIGINT) AS label FROM mt JOIN cl USING (gp)")
def j1(spark, d):
    return fx.meters(spark, d).join(lb.customer_labels(fx.registry(spark, d)), "gp").select("gp", "meter", "label")


@query("j2_labels_to_houses", f"{RG}, {HL} SELECT mp_id, CAST(label AS BIGINT) AS label FROM hl")
def j2(spark, d):
    return lb.house_labels(fx.registry(spark, d), fx.meters(spark, d))


@query("j3_installation_dates", f"{RG}, f AS (SELECT gp, min(try_strptime(installed, '%d.%m.%Y'))::DATE AS installed FROM rg WHERE {MARK} = 1 GROUP BY gp HAVING min(try_strptime(installed, '%d.%m.%Y')) IS NOT NULL) SELECT mp_id, min(installed) AS installed FROM mt JOIN f USING (gp) GROUP BY mp_id")
def j3(spark, d):
    return lb.installation_dates(fx.registry(spark, d), fx.meters(spark, d))


_CH = "a AS (SELECT mp_id, date, coalesce(sum(kw), 0) AS i FROM s WHERE channel = 'import' GROUP BY ALL), b AS (SELECT mp_id, date, coalesce(sum(kw), 0) AS e FROM s WHERE channel = 'export' GROUP BY ALL)"


def _channels(spark, d):
    x = dy.house_days(fx.meter_days(spark, d), dealt=True).select("mp_id", "channel", "date", p.window_sum(F.col("kw")).alias("t"))
    side = lambda c, n: x.where(F.col("channel") == c).select("mp_id", "date", F.col("t").alias(n))
    return side("import", "i"), side("export", "e")


@query("j4_export_and_import", f"{F1}, {_CH} SELECT mp_id, {cols({'i': 'sum(i)', 'e': 'sum(e)'}, {'days': 'count(*)'})} FROM a JOIN b USING (mp_id, date) GROUP BY mp_id")
def j4(spark, d):
    a, b = _channels(spark, d)
    return a.join(b, ["mp_id", "date"]).groupBy("mp_id").agg(F.sum("i").alias("i"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("days"))


@query("j5_import_left_export", f"{F1}, {_CH} SELECT mp_id, {cols({'net': 'sum(i - coalesce(e, 0))'}, {'days': 'count(*)', 'with_export': 'count(e)'})} FROM a LEFT JOIN b USING (mp_id, date) GROUP BY mp_id")
def j5(spark, d):
    a, b = _channels(spark, d)
    return a.join(b, ["mp_id", "date"], "left").groupBy("mp_id").agg(F.sum(F.col("i") - F.coalesce("e", F.lit(0.0))).alias("net"), F.count(F.lit(1)).alias("days"), F.count("e").alias("with_export"))


@query("j6_days_with_irradiation", f"{F1}, {fx.WEATHER_SQL}, {_CH} SELECT mp_id, {cols({'energy': 'sum(i)', 'sun': 'sum(irr)'}, {'days': 'count(*)'})} FROM a JOIN (SELECT date, irr FROM w WHERE n = 1 AND irr IS NOT NULL) x USING (date) GROUP BY mp_id")
def j6(spark, d):
    a, _ = _channels(spark, d)
    sun = fx.daily_weather(spark, d).where("n = 1 AND irr IS NOT NULL").select("date", "irr")
    return a.join(F.broadcast(sun), "date").groupBy("mp_id").agg(F.sum("i").alias("energy"), F.sum("irr").alias("sun"), F.count(F.lit(1)).alias("days"))


@query("j7_days_with_station_weather", f"{F1}, {fx.WEATHER_SQL}, {CHOICE_SQL}, {_CH} SELECT mp_id, {cols({'energy': 'sum(i)', 'sun': 'sum(irr)'}, {'days': 'count(*)', 'sunny': 'count(irr)'})} FROM a JOIN hg USING (mp_id) JOIN ch USING (plz) JOIN w ON w.station = ch.station AND w.date = a.date GROUP BY mp_id")
def j7(spark, d):
    a, _ = _channels(spark, d)
    w = fx.daily_weather(spark, d)
    c = wx.choose_stations(house_geo(spark, d), w, fx.meter_days(spark, d).select("date").distinct())
    return a.join(c.select("mp_id", "station"), "mp_id").join(w.select("station", "date", "irr"), ["station", "date"]).groupBy("mp_id").agg(F.sum("i").alias("energy"), F.sum("irr").alias("sun"), F.count(F.lit(1)).alias("days"), F.count("irr").alias("sunny"))


@query("j8_days_left_weather", f"{F1}, {fx.WEATHER_SQL}, {_CH} SELECT mp_id, {cols({'temp': 'avg(temp_c)'}, {'days': 'count(*)', 'known': 'count(temp_c)'})} FROM a LEFT JOIN (SELECT date, temp_c FROM w WHERE n = 2 AND month(date) <> 3) x USING (date) GROUP BY mp_id")
def j8(spark, d):
    a, _ = _channels(spark, d)
    w = fx.daily_weather(spark, d).where("n = 2 AND month(date) <> 3").select("date", "temp_c")
    return a.join(F.broadcast(w), "date", "left").groupBy("mp_id").agg(F.avg("temp_c").alias("temp"), F.count(F.lit(1)).alias("days"), F.count("temp_c").alias("known"))


@query("j9_electric_day_table", f"{F1}, x AS (SELECT mp_id, channel, date, CASE WHEN count(kw) = 96 THEN sum(kw) / 4 END AS kwh FROM s GROUP BY ALL), a AS (SELECT * FROM x WHERE channel = 'import'), b AS (SELECT * FROM x WHERE channel = 'export') SELECT a.mp_id, {cols({'i': 'sum(a.kwh)', 'e': 'sum(b.kwh)'}, {'days': 'count(*)', 'exporting': 'count(b.kwh)'})} FROM a LEFT JOIN b USING (mp_id, date) GROUP BY a.mp_id")
def j9(spark, d):
    e = pv.electricity(dy.house_days(fx.meter_days(spark, d), dealt=True))
    return e.groupBy("mp_id").agg(F.sum("import_kwh").alias("i"), F.sum("export_kwh").alias("e"), F.count(F.lit(1)).alias("days"), F.count("export_kwh").alias("exporting"))


@query("j10_nearest_station", f"{F1}, {fx.WEATHER_SQL}, {CHOICE_SQL} SELECT plz, station, {cols({'station_km': 'station_km'})} FROM ch")
def j10(spark, d):
    return wx.choose_by_plz(fx.places(spark, d), fx.daily_weather(spark, d), fx.meter_days(spark, d).select("date").distinct()).select("plz", "station", "station_km")


@query("j11_borrowed_temperature", f"{F1}, {fx.WEATHER_SQL}, {CHOICE_SQL} SELECT plz, temp_station, {cols({'temp_station_km': 'temp_station_km'})} FROM ch")
def j11(spark, d):
    return wx.choose_by_plz(fx.places(spark, d), fx.daily_weather(spark, d), fx.meter_days(spark, d).select("date").distinct()).select("plz", "temp_station", "temp_station_km")


@query("j14_previous_day_pairs", f"WITH {fx.SERIES_SQL} SELECT a.mp_id, {cols(None, {'pairs': 'count(*)', 'cross_': 'sum(a.value * b.value)'})} FROM t a JOIN t b ON a.mp_id = b.mp_id AND b.date = a.date - 1 GROUP BY a.mp_id")
def j14(spark, d):
    w = Window.partitionBy("mp_id").orderBy("date")
    x = fx.day_series(spark, d).withColumn("prev", F.when(F.datediff("date", F.lag("date").over(w)) == 1, F.lag("value").over(w))).where("prev IS NOT NULL")
    return x.groupBy("mp_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("value") * F.col("prev")).alias("cross_"))


@query("j16_scores_side_by_side", "WITH a AS (SELECT vec_id AS mp_id, embedding[1]::DOUBLE AS pv FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS mp_id, embedding[2]::DOUBLE AS ev FROM embeddings WHERE vec_id % 3 = 0) SELECT mp_id, round(pv + 1e-9, 6) AS pv, round(ev + 1e-9, 6) AS ev FROM a FULL JOIN b USING (mp_id)")
def j16(spark, d):
    from meterloom.operators import ml

    v = fx.table(spark, d, "embeddings")
    score = lambda k, m, n: v.where(F.col("vec_id") % m == 0).select(F.col("vec_id").alias("mp_id"), F.get("embedding", F.lit(k)).cast("double").alias(n))
    return ml.side_by_side({"pv": score(0, 2, "pv"), "ev": score(1, 3, "ev")})


@query("j16_scores_of_all_houses", "WITH v AS (SELECT vec_id AS mp_id, embedding[1]::DOUBLE AS pv, embedding[2]::DOUBLE AS ev, coalesce(embedding[1] > 0, false) AS up FROM embeddings), a AS (SELECT mp_id, pv FROM v WHERE up), b AS (SELECT mp_id, ev FROM v WHERE NOT up OR ev > 0) SELECT mp_id, round(pv + 1e-9, 6) AS pv, round(ev + 1e-9, 6) AS ev FROM a FULL JOIN b USING (mp_id)")
def j16_all(spark, d):
    """Every id is in one table or both; the gaps follow the data."""
    from meterloom.operators import ml

    value = lambda k: F.get("embedding", F.lit(k)).cast("double")
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("mp_id"), value(0).alias("pv"), value(1).alias("ev"), F.coalesce(value(0) > 0, F.lit(False)).alias("up"))
    return ml.side_by_side({"pv": v.where("up").select("mp_id", "pv"), "ev": v.where("NOT up OR ev > 0").select("mp_id", "ev")})


@query("j17_align_to_labels", f"{RG}, {HL} SELECT mp_id, CAST(label AS BIGINT) AS label, CAST(o_totalprice > 100000 AS BIGINT) AS big FROM hl JOIN orders ON CAST(o_orderkey AS VARCHAR) = mp_id")
def j17(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("mp_id"), (F.col("o_totalprice") > 100000).cast("long").alias("big"))
    return lb.house_labels(fx.registry(spark, d), fx.meters(spark, d)).join(o, "mp_id")


@query("j18_align_fill", f"WITH {fx.SERIES_SQL} SELECT c_custkey AS mp_id, {cols(None, {'total': 'coalesce(sum(value), 0)', 'summer': f'coalesce(sum(value) FILTER ({SUMMER}), 0)'})} FROM customer LEFT JOIN t ON mp_id = c_custkey GROUP BY c_custkey")
def j18(spark, d):
    a = fx.day_series(spark, d).groupBy("mp_id").agg(F.sum("value").alias("total"), F.sum(F.when(dy.in_season(p.SUMMER), F.col("value"))).alias("summer"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("mp_id"))
    return c.join(a, "mp_id", "left").na.fill(0, ["total", "summer"])


@query("j19_semi_join", f"WITH {fx.SERIES_SQL} SELECT mp_id, date, value FROM t WHERE mp_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j19(spark, d):
    return fx.day_series(spark, d).join(fx.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("mp_id")), "mp_id", "left_semi")


@query("j20_mean_of_stations", f"WITH {fx.WEATHER_SQL} SELECT date, {cols({'t': 'avg(temp_c)', 'r': 'avg(irr)'})} FROM w WHERE n IN (1, 2, 7, 11) GROUP BY date")
def j20(spark, d):
    return fx.daily_weather(spark, d).where("n IN (1, 2, 7, 11)").groupBy("date").agg(F.avg("temp_c").alias("t"), F.avg("irr").alias("r"))


@query("j21_common_days", f"{F1}, a AS (SELECT DISTINCT mp_id, date FROM fx WHERE channel = 'import'), b AS (SELECT DISTINCT mp_id, date FROM fx WHERE channel = 'export') SELECT mp_id, CAST(count(*) AS BIGINT) AS days FROM a JOIN b USING (mp_id, date) GROUP BY mp_id")
def j21(spark, d):
    x = fx.meter_days(spark, d).select("mp_id", "channel", "date").groupBy("mp_id", "date").agg(F.countDistinct("channel").alias("c"))
    return x.where("c = 2").groupBy("mp_id").agg(F.count(F.lit(1)).alias("days"))


# Aggregates on tables.
@query("a28_mode", "WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS mp_id, CAST(l_linenumber AS VARCHAR) AS plz, count(*) AS n FROM lineitem GROUP BY ALL) SELECT mp_id, plz FROM (SELECT *, row_number() OVER (PARTITION BY mp_id ORDER BY n DESC, plz) AS r FROM x) WHERE r = 1")
def a28(spark, d):
    return wx.place_of_house(fx.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("mp_id"), F.col("l_linenumber").cast("string").alias("plz")))


@query("a29_unanimous", "SELECT c_nationkey AS nation, CASE WHEN count(DISTINCT c_mktsegment) FILTER (c_acctbal < -900) = 1 THEN max(c_mktsegment) FILTER (c_acctbal < -900) ELSE '' END AS segment FROM customer GROUP BY ALL".replace("c_nationkey AS nation", "CAST(c_nationkey AS BIGINT) AS nation"))
def a29(spark, d):
    s = F.when(F.col("c_acctbal") < -900, F.col("c_mktsegment"))
    return fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.when(F.countDistinct(s) == 1, F.max(s)).otherwise("").alias("segment"))


@query("a30_or_labels", f"{RG}, {CL} SELECT gp, CAST(label AS BIGINT) AS label FROM cl")
def a30(spark, d):
    return lb.customer_labels(fx.registry(spark, d))


@query("a31_earliest_date", f"{RG} SELECT gp, min(try_strptime(installed, '%d.%m.%Y'))::DATE AS first FROM rg GROUP BY gp")
def a31(spark, d):
    return fx.registry(spark, d).groupBy("gp").agg(F.min(F.try_to_date("installed", "dd.MM.yyyy")).alias("first"))


@query("a33_count_distinct", f"{F1} SELECT channel, {cols(None, {'houses': 'count(DISTINCT mp_id)', 'days': 'count(DISTINCT date)'})} FROM fx GROUP BY channel")
def a33(spark, d):
    return fx.meter_days(spark, d).groupBy("channel").agg(F.countDistinct("mp_id").alias("houses"), F.countDistinct("date").alias("days"))


@query("a34_describe", f"WITH {fx.SERIES_SQL} SELECT {cols({'mean': 'avg(value)', 'q25': 'quantile_cont(value::DOUBLE, 0.25)', 'q50': 'quantile_cont(value::DOUBLE, 0.5)', 'q75': 'quantile_cont(value::DOUBLE, 0.75)'}, {'n': 'count(*)', 'lo': 'min(value)', 'hi': 'max(value)'})} FROM t")
def a34(spark, d):
    q = lambda x: F.percentile("value", F.lit(x))
    return fx.day_series(spark, d).agg(F.avg("value").alias("mean"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a36_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def a36(spark, d):
    return wx.dedupe_keep_last(fx.table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("p18_marks", f"{RG} SELECT gp, CAST(max({MARK}) AS BIGINT) AS label, CAST(count(*) FILTER ({MARK} IS NULL) AS BIGINT) AS unknown FROM rg GROUP BY gp")
def p18(spark, d):
    m = lb.mark(F.col("mark"))
    return fx.registry(spark, d).groupBy("gp").agg(F.max(m).alias("label"), F.count(F.when(m.isNull(), F.lit(1))).alias("unknown"))


@query("p20_header", "SELECT p_partkey, regexp_replace(translate(lower(trim(p_type)), 'äöüéèà', 'aoueea'), '[^a-z0-9]+', '', 'g') AS name FROM part")
def p20(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", lb.header(F.col("p_type")).alias("name"))


# Sorts and sets.
@query("t2_stations_by_distance", f"{F1}, {fx.WEATHER_SQL}, {CHOICE_SQL} SELECT plz, station, CAST(rank AS BIGINT) AS rank, round(km + 1e-9, 6) AS distance_km FROM rk")
def t2(spark, d):
    return wx.rank_stations(fx.places(spark, d), fx.stations(spark, d)).select("plz", "station", "rank", "distance_km")


@query("t4_top_contributions", "SELECT p_partkey, round(p_retailprice - 1400 + 1e-9, 6) AS v FROM part ORDER BY abs(p_retailprice - 1400) DESC, p_partkey LIMIT 10")
def t4(spark, d):
    v = F.col("p_retailprice") - 1400
    return fx.table(spark, d, "part").select("p_partkey", v.alias("v")).orderBy(F.abs(v).desc(), "p_partkey").limit(10)


@query("u1_union_all", f"{F1} SELECT channel, CAST(count(*) AS BIGINT) AS n FROM (SELECT channel, date FROM fx UNION ALL SELECT channel, date FROM fx WHERE month(date) = 1) GROUP BY channel")
def u1(spark, d):
    x = fx.meter_days(spark, d).select("channel", "date")
    return x.unionByName(x.where(F.month("date") == 1)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("u2_except", "SELECT c_custkey AS mp_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def u2(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("mp_id")).join(fx.table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("mp_id")), "mp_id", "left_anti")


@query("u3_intersect", "SELECT c_custkey AS mp_id FROM customer INTERSECT SELECT o_custkey FROM orders")
def u3(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("mp_id")).intersect(fx.table(spark, d, "orders").select("o_custkey"))


@query("u4_ordered_distinct", "SELECT o_custkey AS mp_id, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def u4(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("mp_id")).agg(F.min("o_orderkey").alias("first"))


@query("u5_duplicate_keys", f"{F1} SELECT mp_id, channel, date, CAST(count(*) AS BIGINT) AS meters FROM fx GROUP BY ALL HAVING count(*) > 1")
def u5(spark, d):
    return fx.meter_days(spark, d).groupBy("mp_id", "channel", "date").agg(F.count(F.lit(1)).alias("meters")).where("meters > 1")


# Labels and scores.
@query("l2_positive_houses", f"{RG}, {HL} SELECT mp_id, CAST(label AS BIGINT) AS label FROM hl WHERE label = 1")
def l2(spark, d):
    return lb.house_labels(fx.registry(spark, d), fx.meters(spark, d), absent_is_negative=False)


@query("l4_stratified_split", f"{RG}, {HL} SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM hl GROUP BY label")
def l4(spark, d):
    x = lb.split(lb.house_labels(fx.registry(spark, d), fx.meters(spark, d)))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), st.count_if(F.col("test")).alias("n_test"))


_SC = "sc AS (SELECT vec_id, embedding[1]::DOUBLE AS score, label % 2 AS y FROM embeddings)"


@query("l6_evaluate_scores", f"WITH {_SC}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc) SELECT {cols({'precision': 'count(*) FILTER (score > 0 AND y = 1)::DOUBLE / count(*) FILTER (score > 0)', 'recall': 'count(*) FILTER (score > 0 AND y = 1)::DOUBLE / count(*) FILTER (y = 1)', 'auc': '(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))'}, {'n': 'count(*)'})} FROM r")
def l6(spark, d):
    from meterloom.operators import ml

    x = fx.table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("score"), (F.col("label") % 2).alias("label"))
    return ml.evaluate(x, threshold=0.0)


@query("pu1_guide_feature", f"WITH x AS (SELECT vec_id, label % 2 AS y, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)), r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS rk FROM x), a AS (SELECT i, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY i) SELECT CAST(i AS BIGINT) AS feature, {cols({'auc': 'auc'})} FROM a")
def pu1(spark, d):
    x = fx.table(spark, d, "embeddings").select((F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("feature", "v")).select("y", (F.col("feature") + 1).alias("feature"), F.col("v").cast("double").alias("v"))
    return st.auc(x, ["feature"], "v", "y")


@query("pu2_spearman", f"WITH {fx.SERIES_SQL}, r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, rank() OVER (ORDER BY dayofyear(date)) + (count(*) OVER (PARTITION BY dayofyear(date)) - 1) / 2.0 AS b FROM t) SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) + 1e-9, 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r")
def pu2(spark, d):
    from meterloom.operators import pu

    return pu.spearman(fx.day_series(spark, d).select(F.col("value").alias("x"), F.dayofyear("date").alias("y")))


@query("pu3_sampling_weights", f"WITH {fx.SERIES_SQL} SELECT mp_id, date, {cols({'w': 'least(greatest(0.3 + 0.2 * ((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER () - 0.5), 0), 1)'})} FROM t")
def pu3(spark, d):
    from meterloom.operators import pu

    return pu.sampling_weights(fx.day_series(spark, d), "value", 0.3, 0.2).select("mp_id", "date", "w")


@query("pu6_recall", f"WITH {_SC} SELECT {cols({'recall': 'avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0 END) FILTER (y = 1)', 'positive_share': 'avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0 END) FILTER (y = 0)'})} FROM sc")
def pu6(spark, d):
    x = fx.table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("score"), (F.col("label") % 2).alias("y"))
    t = (F.col("score") > 0.1).cast("double")
    return x.agg(st.mean_if(F.col("y") == 1, t).alias("recall"), st.mean_if(F.col("y") == 0, t).alias("positive_share"))


# Weather grids from events: t is minutes of January in epoch seconds, one station per user class.
_TEN = "ten AS (SELECT 'S' || CAST(user_id % 3 AS VARCHAR) AS station, CAST(floor(epoch(ts)) AS BIGINT) // 600 * 600 AS t, CAST(floor(value) AS DOUBLE) AS v, event_id FROM events), one AS (SELECT station, t, arg_max(v, event_id) AS v FROM ten GROUP BY ALL)"


def ten_minutes(spark, d):
    e = fx.table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("station"), F.expr("unix_timestamp(ts) div 600 * 600").alias("t"), F.floor("value").cast("double").alias("v"), "event_id")
    return wx.dedupe_keep_last(e, ["station", "t"], "event_id").drop("event_id")


@query("m1_read_station", f"WITH {_TEN} SELECT station, t, {cols({'v': 'v'})} FROM one")
def m1(spark, d):
    return ten_minutes(spark, d)


@query("m2_interpolate", f"""WITH {_TEN}, b AS (SELECT station, t AS a_t, v AS a_v, lead(t) OVER o AS b_t, lead(v) OVER o AS b_v FROM one WINDOW o AS (PARTITION BY station ORDER BY t)), lo AS (SELECT min(t) // 3600 * 3600 AS a FROM one), g AS (SELECT station, lo.a + i * 300 AS t FROM (SELECT DISTINCT station FROM one), lo, range(2000) AS r(i))
SELECT g.station, CAST(g.t AS BIGINT) AS t, round(CASE WHEN b_t IS NULL THEN CASE WHEN a_t = g.t THEN a_v END WHEN b_t - a_t <= 3600 THEN a_v + (b_v - a_v) * ((g.t - a_t)::DOUBLE / (b_t - a_t)) END + 1e-9, 6) AS v FROM g LEFT JOIN b ON b.station = g.station AND g.t >= a_t AND (b_t IS NULL OR g.t < b_t)""")
def m2(spark, d):
    s = ten_minutes(spark, d)
    lo = s.agg(F.expr("min(t) div 3600 * 3600").alias("a"))
    grid = s.select("station").distinct().crossJoin(lo).select("station", F.explode(F.sequence(F.col("a"), F.col("a") + 1999 * 300, F.lit(300))).alias("t"))
    return wx.interpolate(s, grid)


@query("w14_quarter_hours", f"WITH {_TEN} SELECT station, t // 900 * 900 AS q, {cols({'v': 'avg(v)'}, {'n': 'count(*)'})} FROM one GROUP BY ALL")
def w14(spark, d):
    s = ten_minutes(spark, d).withColumn("w", F.window(F.timestamp_seconds("t"), "15 minutes"))
    return s.groupBy("station", F.unix_timestamp("w.start").alias("q")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


_HOUR = "hr AS (SELECT station, to_timestamp(t // 3600 * 3600 + 3600) AT TIME ZONE 'UTC' AS ts, avg(v) AS v FROM one GROUP BY ALL)"


@query("m7_hourly_to_daily", f"""WITH {_TEN}, {_HOUR}, l AS (SELECT station, (ts - INTERVAL 30 MINUTE + INTERVAL 1 HOUR) AS local, v FROM hr), x AS (SELECT station, CAST(local AS DATE) AS date, sum(v) AS s, count(v) AS n, sum(v) FILTER (hour(local) + minute(local) / 60.0 >= 9 AND hour(local) + minute(local) / 60.0 < 17) AS m, count(v) FILTER (hour(local) + minute(local) / 60.0 >= 9 AND hour(local) + minute(local) / 60.0 < 17) AS mn, avg(v) AS t FROM l GROUP BY ALL)
SELECT station, date, {cols({'irr': 'CASE WHEN n >= 24 THEN s / 1000 END', 'midday': 'CASE WHEN n >= 24 AND mn >= 8 THEN m / 1000 END', 'temp_c': 'CASE WHEN n >= 24 THEN t END'}, {'radiation_hours': 'n', 'temperature_hours': 'n'})} FROM x""")
def m7(spark, d):
    s = ten_minutes(spark, d).groupBy("station", F.timestamp_seconds(F.expr("t div 3600 * 3600 + 3600")).alias("ts")).agg(F.avg("v").alias("rad"))
    return wx.hourly_to_daily(s.withColumn("temp", F.col("rad")))


_G = "gr AS (SELECT t // 900 * 900 AS q, avg(v) AS v FROM one GROUP BY ALL), gl AS (SELECT (to_timestamp(q) AT TIME ZONE 'UTC') + INTERVAL 1 HOUR AS local, v FROM gr)"


def _grid(spark, d):
    s = ten_minutes(spark, d).groupBy(F.expr("t div 900 * 900").alias("q")).agg(F.avg("v").alias("v"))
    return s.select(F.from_utc_timestamp(F.timestamp_seconds("q"), wx.ZONE).alias("local"), F.col("v").alias("irradiance"), F.col("v").alias("temperature"))


@query("m5_daily_irradiation", f"WITH {_TEN}, {_G} SELECT CAST(local AS DATE) AS date, round(sum(v) / 4000 + 1e-9, 6) AS irr FROM gl WHERE hour(local) >= 9 AND hour(local) < 17 GROUP BY 1 HAVING count(v) / 32.0 >= 0.5")
def m5(spark, d):
    return wx.daily_irradiation(_grid(spark, d), min_cover=0.5)


@query("m6_daily_temperature", f"WITH {_TEN}, {_G} SELECT CAST(local AS DATE) AS date, round(avg(v) + 1e-9, 6) AS temp_c FROM gl GROUP BY 1 HAVING count(v) / 96.0 >= 0.5")
def m6(spark, d):
    return wx.daily_temperature(_grid(spark, d), 0.5)


