"""Weather: station files to a 15-minute grid and daily tables; choosing stations by distance and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.days import local_day_hours

ZONE = "Europe/Zurich"
EARTH_KM = 6371.0088
MIN_WEATHER_DAYS = 20


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = math.pi / 360
    a = F.pow(F.sin((lat2 - lat1) * half), F.lit(2)) + F.cos(lat1 * (2 * half)) * F.cos(lat2 * (2 * half)) * F.pow(F.sin((lon2 - lon1) * half), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def rank_stations(places: DataFrame, stations: DataFrame) -> DataFrame:
    """Every place (plz, lat, lon) with every station and its distance, ranked from the nearest.

    The stations are few (a national network has hundreds) and their number doesn't grow with the meter data, so they are broadcast.
    """
    s = stations.select("station", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    d = places.crossJoin(F.broadcast(s)).withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("plz").orderBy("distance_km", "station"))).drop("s_lat", "s_lon")


def coverage(weather: DataFrame, dates: DataFrame) -> DataFrame:
    """Days with radiation and with temperature per station, over the meter period."""
    w = weather.join(F.broadcast(dates), "date", "left_semi")
    return w.groupBy("station").agg(F.count("irr").alias("irr_days"), F.count("temp_c").alias("temp_days"))


def choose_by_plz(places: DataFrame, weather: DataFrame, dates: DataFrame, min_days: int = MIN_WEATHER_DAYS) -> DataFrame:
    """Per plz the nearest station with enough radiation days, and the one that lends its temperature.

    The temperature comes from the same station if it has enough days, else from the nearest other one
    that does, else from the same.
    """
    stations = weather.select("station", "lat", "lon").distinct().join(coverage(weather, dates), "station")
    s = stations.select("station", "irr_days", "temp_days")
    ranked = rank_stations(places, stations).join(F.broadcast(s), "station")
    first = lambda test: F.min(F.when(test, F.struct("rank", "station", "distance_km")))
    own = first(F.col("irr_days") >= min_days)
    lent = first(F.col("temp_days") >= min_days)
    g = ranked.groupBy("plz").agg(own.alias("o"), lent.alias("t")).where("o IS NOT NULL")
    has = s.select(F.col("station").alias("os"), (F.col("temp_days") >= min_days).alias("own_temp"))
    g = g.withColumn("os", F.col("o.station")).join(F.broadcast(has), "os")
    t = F.when(F.col("own_temp") | F.col("t").isNull(), F.col("o")).otherwise(F.col("t"))
    return g.select("plz", F.col("o.station").alias("station"), F.col("o.distance_km").alias("station_km"), t["station"].alias("temp_station"), t["distance_km"].alias("temp_station_km"))


def choose_stations(house_geo: DataFrame, weather: DataFrame, dates: DataFrame, min_days: int = MIN_WEATHER_DAYS) -> DataFrame:
    """choose_by_plz for houses: mp_id, plz, station, station_km, temp_station, temp_station_km."""
    places = house_geo.select("plz", "lat", "lon").distinct()
    return house_geo.select("mp_id", "plz").join(choose_by_plz(places, weather, dates, min_days), "plz")


def choose_for_house(house_geo: DataFrame, house_dates: DataFrame, weather: DataFrame, min_days: int = 60) -> DataFrame:
    """Per house the nearest station with temperatures on enough of the house's own dates."""
    have = house_dates.join(weather.where("temp_c IS NOT NULL").select("station", "date"), "date").groupBy("mp_id", "station").agg(F.count(F.lit(1)).alias("matched")).where(F.col("matched") >= min_days)
    stations = weather.select("station", "lat", "lon").distinct()
    ranked = rank_stations(house_geo.select("plz", "lat", "lon").distinct(), stations)
    near = have.join(house_geo.select("mp_id", "plz"), "mp_id").join(ranked.select("plz", "station", "rank", "distance_km"), ["plz", "station"])
    best = near.groupBy("mp_id").agg(F.min(F.struct("rank", "station", "distance_km", "matched")).alias("b"))
    return best.select("mp_id", "b.station", F.col("b.distance_km").alias("station_km"), F.col("b.matched").cast("long").alias("matched"))


def dedupe_keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the last by an explicit order."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def interpolate(samples: DataFrame, grid: DataFrame, by: str = "station", ts: str = "t", value: str = "v", max_gap: int = 3600) -> DataFrame:
    """Linear interpolation of samples (by, ts in epoch seconds, value) at grid points (by, ts).

    A point is null outside the samples and where its bracket is wider than max_gap; an exact sample
    that starts such a gap is null too, the last sample is not. Samples and points are put in one order
    per station and hour, with the bracketing samples of the neighbouring hours carried along, so no window
    spans more than a station's hour.
    """
    s = samples.where(F.col(value).isNotNull()).select(by, F.col(ts).cast("long").alias("t"), F.col(value).alias("v"))
    hour = (F.col("t") / 3600).cast("long")
    # Brackets reach at most max_gap on either side: every sample is lent to the hours that it can bracket.
    reach = -(-max_gap // 3600)
    lent = s.withColumn("h", F.explode(F.sequence(hour - reach, hour + reach)))
    points = grid.select(by, F.col(ts).cast("long").alias("t")).withColumn("h", hour)
    last = s.groupBy(by).agg(F.max("t").alias("last"))
    both = lent.select(by, "h", "t", "v", F.lit(0).alias("p")).unionByName(points.select(by, "h", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("p")))
    w = Window.partitionBy(by, "h").orderBy("t", "p")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    pair = F.when(F.col("p") == 0, F.struct("t", "v"))
    found = both.withColumns({"a": F.last(pair, True).over(back), "b": F.first(pair, True).over(ahead)}).where("p = 1").join(F.broadcast(last), by, "left")
    gap = F.col("b.t") - F.col("a.t")
    mixed = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * ((F.col("t") - F.col("a.t")) / gap)
    out = F.when((F.col("a.t") == F.col("t")) & (F.col("t") == F.col("last")), F.col("a.v")).when(gap <= max_gap, mixed)
    return found.select(by, F.col("t").alias(ts), out.alias(value))


def to_quarter_hours(ten_minutes: DataFrame, start: str, end: str, zone: str = ZONE) -> DataFrame:
    """10-minute station values (station, t, irr, temp; t in epoch seconds, the end of the interval) to local quarter-hours.

    Irradiance is moved to the middle of its interval; both are interpolated to minutes and averaged per
    quarter-hour, labelled by its start.
    """
    spark = ten_minutes.sparkSession
    edges = spark.sql(f"SELECT unix_timestamp(to_utc_timestamp(timestamp'{start}', '{zone}')) AS a, unix_timestamp(to_utc_timestamp(timestamp'{end}' + interval 1 day, '{zone}')) AS b")
    minutes = edges.select(F.explode(F.sequence("a", F.col("b") - 60, F.lit(60))).alias("t"))
    grid = ten_minutes.select("station").distinct().crossJoin(minutes)
    irr = interpolate(ten_minutes.select("station", (F.col("t") - 300).alias("t"), F.col("irr").alias("v")), grid).withColumnRenamed("v", "irr")
    temp = interpolate(ten_minutes.select("station", "t", F.col("temp").alias("v")), grid).withColumnRenamed("v", "temp")
    q = irr.join(temp, ["station", "t"]).groupBy("station", (F.floor(F.col("t") / 900) * 900).cast("long").alias("t")).agg(F.avg("irr").alias("irr"), F.avg("temp").alias("temp"))
    return q.withColumn("local", F.from_utc_timestamp(F.timestamp_seconds("t"), zone))


def grid_mean(quarters: DataFrame) -> DataFrame:
    """Mean of the stations at each quarter-hour, ignoring gaps; irradiance not below 0; two decimals."""
    g = quarters.groupBy("t", "local").agg(F.avg("irr").alias("i"), F.avg("temp").alias("c"))
    return g.select("t", "local", F.round(F.when(F.col("i") < 0, 0.0).otherwise(F.col("i")) + 1e-9, 2).alias("irradiance"), F.round(F.col("c") + 1e-9, 2).alias("temperature"))


def daily_irradiation(grid: DataFrame, a: int = 9, b: int = 17, min_cover: float = 0.9) -> DataFrame:
    """kWh/m2 per local day between two clock hours, for days with enough of their quarter-hours."""
    h = F.hour("local") + F.minute("local") / 60
    g = grid.where((h >= a) & (h < b)).groupBy(F.to_date("local").alias("date")).agg((F.sum("irradiance") / 4000).alias("irr"), (F.count("irradiance") / ((b - a) * 4)).alias("cover"))
    return g.where(F.col("cover") >= min_cover).select("date", "irr")


def daily_temperature(grid: DataFrame, min_cover: float = 0.9) -> DataFrame:
    """Mean temperature per local day with enough of its 96 quarter-hours."""
    g = grid.groupBy(F.to_date("local").alias("date")).agg(F.avg("temperature").alias("temp_c"), (F.count("temperature") / 96).alias("cover"))
    return g.where(F.col("cover") >= min_cover).select("date", "temp_c")


def hourly_to_daily(hourly: DataFrame, zone: str = ZONE) -> DataFrame:
    """Hourly station values (station, ts UTC end of hour, rad W/m2, temp) to daily ones.

    Totals need every hour of the local day (23, 24 or 25), midday 9 to 17 h needs 8 hours.
    """
    local = F.from_utc_timestamp(F.col("ts") - F.expr("INTERVAL 30 MINUTES"), zone)
    r = F.when(F.col("rad") < 0, 0.0).otherwise(F.col("rad"))
    h = hourly.select("station", F.to_date(local).alias("date"), (F.hour(local) + F.minute(local) / 60).alias("h"), r.alias("rad"), F.col("temp"))
    mid = (F.col("h") >= 9) & (F.col("h") < 17)
    g = h.groupBy("station", "date").agg(F.sum("rad").alias("s"), F.count("rad").alias("radiation_hours"), F.sum(F.when(mid, F.col("rad"))).alias("m"), F.count(F.when(mid, F.col("rad"))).alias("mh"), F.avg("temp").alias("t"), F.count("temp").alias("temperature_hours"))
    want = local_day_hours(F.col("date"), zone)
    sun = F.col("radiation_hours") >= want
    return g.select("station", "date", F.when(sun, F.col("s") / 1000).alias("irr"), F.when(sun & (F.col("mh") >= 8), F.col("m") / 1000).alias("midday"), F.when(F.col("temperature_hours") >= want, F.col("t")).alias("temp_c"), "radiation_hours", "temperature_hours")


def place_of_house(rows: DataFrame) -> DataFrame:
    """The most frequent valid plz (digits) of a house, the smallest on ties."""
    return rows.where(F.col("plz").rlike("^[0-9]+$")).groupBy("mp_id").agg(F.mode(F.col("plz"), True).alias("plz"))
