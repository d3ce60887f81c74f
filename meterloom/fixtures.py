"""Deterministic stand-ins for meter, weather and registry tables, built from the driver's tables.

Meter values are whole watt-hours per quarter-hour; a fixture's kW is wh / 256, a power of two, so
sums are exact in any order and both engines agree to the last bit. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.session import tasks

SCALE = 256.0


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(ts: Column) -> Column:
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.datediff(ts.cast("date"), F.lit("1995-01-01").cast("date")), F.lit(731)))


def meter_days(spark, sf_dir: str) -> DataFrame:
    """FX1: dense meter-days from lineitem: mp_id, channel, date, plz and kw (96 raw values)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("mp_id"), F.when(F.col("l_linestatus") == "O", "import").otherwise("export").alias("channel"), _day(F.col("l_shipdate")).alias("date"),
        F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("pk"), F.col("l_linenumber").cast("long").alias("ln"), (F.col("l_suppkey") % 25).cast("string").alias("plz"),
    )
    li = li.repartition(tasks(spark), "mp_id").withColumn("mon", F.month("date"))  # the narrow rows are dealt by house, before the 96 values
    q, pk, ln = F.col("q"), F.col("pk"), F.col("ln")
    export, winter, summer = F.col("channel") == "export", F.col("mon").isin(11, 12, 1, 2), F.col("mon").between(5, 8)

    def wh(k: int):
        solar = F.floor(F.lit((k - 27) * (76 - k)) * q / 60).cast("long") if 28 <= k <= 75 else pk % 3
        rest = (pk * (k + 1) * 7 + ln * 131 + k * k) % (q * 4 + 8)
        use = F.when((pk % 2 == 0) & summer, F.lit(0)).otherwise(rest) if 40 <= k <= 64 else rest
        if 70 <= k:
            use = use + F.when((pk % 5 == 0) & (ln * 2 + 76 >= k), F.lit(2500)).otherwise(F.lit(0))
        use = use + F.when((pk % 3 == 0) & winter, F.lit(250)).otherwise(F.lit(0))
        value = F.when(export, solar).otherwise(use)
        if k == 7:
            value = F.when(pk % 211 == 0, F.lit(-4)).otherwise(value)
        return F.when(((pk + 3 * k) % 97 != 0) | (ln % 2 != 0), value) / SCALE

    return li.select("mp_id", "channel", "date", "plz", F.array(*[wh(k) for k in range(96)]).alias("kw"))


#: The same as DuckDB CTEs: fx (meter-days) and raw (one row a slot, wh).
METER_SQL = """fx AS (SELECT CAST(l_suppkey AS VARCHAR) AS mp_id, CASE WHEN l_linestatus = 'O' THEN 'import' ELSE 'export' END AS channel,
  DATE '2023-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 731 AS INTEGER) AS date,
  CAST(l_quantity AS BIGINT) AS q, l_partkey AS pk, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_suppkey % 25 AS VARCHAR) AS plz, row_number() OVER () AS m FROM lineitem),
raw AS (SELECT fx.mp_id, fx.channel, fx.date, fx.plz, fx.m, k, CASE WHEN (pk + 3 * k) % 97 = 0 AND ln % 2 = 0 THEN NULL WHEN pk % 211 = 0 AND k = 7 THEN -4
  WHEN channel = 'export' THEN CASE WHEN k BETWEEN 28 AND 75 THEN ((k - 27) * (76 - k) * q) // 60 ELSE pk % 3 END
  ELSE (CASE WHEN pk % 2 = 0 AND month(date) BETWEEN 5 AND 8 AND k BETWEEN 40 AND 64 THEN 0 ELSE (pk * (k + 1) * 7 + ln * 131 + k * k) % (q * 4 + 8) END)
    + (CASE WHEN pk % 5 = 0 AND k BETWEEN 70 AND 76 + 2 * ln THEN 2500 ELSE 0 END) + (CASE WHEN pk % 3 = 0 AND month(date) IN (11, 12, 1, 2) THEN 250 ELSE 0 END) END AS wh
  FROM fx, range(96) AS r(k)),
kwr AS (SELECT mp_id, channel, date, m, k, wh, CASE WHEN wh IS NULL THEN NULL ELSE greatest(wh, 0) / 256.0::DOUBLE END AS r FROM raw),
s AS MATERIALIZED (SELECT mp_id, channel, date, CAST(k AS INTEGER) AS k, sum(CASE WHEN channel = 'export' AND r < 0.05 THEN 0::DOUBLE ELSE r END) AS kw, count(*) AS meters, count(r) AS meters_there,
  count(*) FILTER (wh < 0) AS neg, max(r) AS rmax FROM kwr GROUP BY ALL)"""


def sparse_meter_days(spark, sf_dir: str) -> DataFrame:
    """FX2: sparse meter-days from events, January only: mp_id, channel, date and kw."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("mp_id"), F.when(F.col("event_type") == "purchase", "export").otherwise("import").alias("channel"), F.col("ts").cast("date").alias("date"),
        F.expr("hour(ts) * 4 + minute(ts) div 15").cast("int").alias("k"), F.floor(F.col("value") * 10).cast("long").alias("wh"),
    )
    slots = e.groupBy("mp_id", "channel", "date", "k").agg(F.sum("wh").alias("wh"))
    by = F.map_from_entries(F.collect_list(F.struct("k", (F.col("wh") / SCALE).alias("v"))))
    return slots.groupBy("mp_id", "channel", "date").agg(by.alias("m")).select("mp_id", "channel", "date", F.transform(F.sequence(F.lit(0), F.lit(95)), lambda k: F.try_element_at("m", k)).alias("kw"))


#: FX2 as a DuckDB CTE s with the columns of METER_SQL's s.
SPARSE_SQL = """e AS (SELECT CAST(user_id AS VARCHAR) AS mp_id, CASE WHEN event_type = 'purchase' THEN 'export' ELSE 'import' END AS channel, CAST(ts AS DATE) AS date,
  CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS k, CAST(floor(value * 10) AS BIGINT) AS wh FROM events),
ev AS (SELECT mp_id, channel, date, k, sum(wh) AS wh FROM e GROUP BY ALL),
kwr AS (SELECT d.mp_id, d.channel, d.date, 1 AS m, CAST(r.k AS INTEGER) AS k, g.wh, CASE WHEN g.wh IS NULL THEN NULL ELSE greatest(g.wh, 0) / 256.0::DOUBLE END AS r FROM (SELECT DISTINCT mp_id, channel, date FROM ev) d CROSS JOIN range(96) AS r(k) LEFT JOIN ev g ON g.mp_id = d.mp_id AND g.channel = d.channel AND g.date = d.date AND g.k = r.k),
s AS MATERIALIZED (SELECT mp_id, channel, date, k, sum(CASE WHEN channel = 'export' AND r < 0.05 THEN 0::DOUBLE ELSE r END) AS kw, count(*) AS meters, count(r) AS meters_there,
  count(*) FILTER (wh < 0) AS neg, max(r) AS rmax FROM kwr GROUP BY ALL)"""


def day_series(spark, sf_dir: str) -> DataFrame:
    """FX3: one value per customer and order date: mp_id (long), date, value (long)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("mp_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("value"))


SERIES_SQL = "t AS (SELECT o_custkey AS mp_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY ALL)"


def daily_weather(spark, sf_dir: str) -> DataFrame:
    """FX4: daily weather of 25 stations: n, station, date, temp_c, irr, midday, lat, lon."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    days = n.crossJoin(spark.range(731).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("date"))).withColumn("doy", F.dayofyear("date").cast("long"))
    temp = "CASE WHEN (doy + 13 * n) % 89 = 0 OR n % 7 = 0 THEN NULL ELSE 220 - (abs(doy - 196) * 230) div 182 + (doy * 37 + n * 11) % 60 - 30 END"
    irr = "CASE WHEN (doy + 17 * n) % 83 = 0 OR n % 11 = 0 THEN NULL ELSE greatest(300, 6500 - abs(doy - 172) * 30 - ((doy * 53 + n * 17) % 40) * 60) END"
    return days.select("n", F.concat(F.lit("S"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("station"), "date", (F.expr(temp) / 16.0).alias("temp_c"), (F.expr(irr) / 1024.0).alias("irr"), (F.expr(irr) / 2048.0).alias("midday")).join(
        stations(spark, sf_dir).select("n", "lat", "lon"), "n"
    )


def stations(spark, sf_dir: str) -> DataFrame:
    """Station metadata of FX4: n, station, name, lat, lon."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        n.alias("n"), F.concat(F.lit("S"), F.lpad(n.cast("string"), 2, "0")).alias("station"), F.col("n_name").alias("name"), ((45800 + 80 * n + (7 * n * n) % 50) / 1000.0).alias("lat"), ((6000 + (317 * n) % 4400) / 1000.0).alias("lon")
    )


def places(spark, sf_dir: str) -> DataFrame:
    """Where houses are: plz (number of a station as text), lat, lon."""
    return stations(spark, sf_dir).select(F.col("n").cast("string").alias("plz"), (F.col("lat") + 0.013).alias("lat"), (F.col("lon") - 0.021).alias("lon"))


WEATHER_SQL = """st AS (SELECT CAST(n_nationkey AS BIGINT) AS n, 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS station, n_name AS name, (45800 + 80 * n + (7 * n * n) % 50) / 1000.0::DOUBLE AS lat, (6000 + (317 * n) % 4400) / 1000.0::DOUBLE AS lon FROM nation),
pl AS (SELECT CAST(n AS VARCHAR) AS plz, lat + 0.013::DOUBLE AS lat, lon - 0.021::DOUBLE AS lon FROM st),
wd AS (SELECT n, station, DATE '2023-01-01' + CAST(i AS INTEGER) AS date, CAST(dayofyear(DATE '2023-01-01' + CAST(i AS INTEGER)) AS BIGINT) AS doy, lat, lon FROM st, range(731) AS r(i)),
w AS (SELECT n, station, date, (CASE WHEN (doy + 13 * n) % 89 = 0 OR n % 7 = 0 THEN NULL ELSE 220 - (abs(doy - 196) * 230) // 182 + (doy * 37 + n * 11) % 60 - 30 END) / 16.0::DOUBLE AS temp_c,
  (CASE WHEN (doy + 17 * n) % 83 = 0 OR n % 11 = 0 THEN NULL ELSE greatest(300, 6500 - abs(doy - 172) * 30 - ((doy * 53 + n * 17) % 40) * 60) END) / 1024.0::DOUBLE AS irr, irr / 2 AS midday, lat, lon FROM wd)"""


def registry(spark, sf_dir: str) -> DataFrame:
    """FX5: customers with raw marks: gp, mark, installed (text dates), from customer."""
    mark = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "x", "HOUSEHOLD", " X ", "BUILDING", "-", "MACHINERY", "Boiler")])
    c = table(spark, sf_dir, "customer")
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    return c.select((F.col("c_custkey") % 1000).cast("string").alias("gp"), F.try_element_at(mark, F.col("c_mktsegment")).alias("mark"), F.when(F.col("c_custkey") % 7 == 0, "unbekannt").otherwise(F.date_format(day, "dd.MM.yyyy")).alias("installed"))


def meters(spark, sf_dir: str) -> DataFrame:
    """FX5: customer to meter to house: gp, meter, mp_id from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 1000).cast("string").alias("gp"), F.col("o_orderkey").cast("string").alias("meter"), F.col("o_orderkey").cast("string").alias("mp_id"))


REGISTRY_SQL = """rg AS (SELECT CAST(c_custkey % 1000 AS VARCHAR) AS gp, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'x' WHEN 'HOUSEHOLD' THEN ' X ' WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN 'Boiler' END AS mark,
  CASE WHEN c_custkey % 7 = 0 THEN 'unbekannt' ELSE strftime(DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER), '%d.%m.%Y') END AS installed FROM customer),
mt AS (SELECT CAST(o_custkey % 1000 AS VARCHAR) AS gp, CAST(o_orderkey AS VARCHAR) AS meter, CAST(o_orderkey AS VARCHAR) AS mp_id FROM orders)"""
