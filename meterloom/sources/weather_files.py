"""Station files of ten-minute weather: semicolon text in windows-1252, times in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.sources import registry

#: The column of times, its format, and the columns of global radiation and air temperature.
TIME, FORMAT = "reference_timestamp", "dd.MM.yyyy HH:mm Z"
COLUMNS = {"gre000z0": "irr", "tre200s0": "temp"}


def read_station(spark: SparkSession, files: list[str], station: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """station, t (epoch seconds) and the named values of one station's files, one row a time.

    Of rows with the same time the last counts as a whole: of the last file, then its last line. Columns that a
    file lacks are null, as are values that can't be read; rows without a readable time are dropped. Files are
    taken in the order given; no files give no rows.
    """
    names = list(dict.fromkeys(columns.values()))
    kinds = ", ".join(["t long", *(f"{n} double" for n in names)])
    out = None
    for i, path in enumerate(files):
        rows = registry.read(spark, path, encoding="windows-1252")
        value = {n: F.col(f"`{c}`").try_cast("double") for c, n in columns.items() if c in rows.columns}
        at = F.unix_timestamp(F.try_to_timestamp(F.concat(F.trim(F.col(TIME)), F.lit(" +0000")), F.lit(FORMAT)))
        part = rows.select(F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line")).alias("place"), at.alias("t"), *[value.get(n, F.lit(None).cast("double")).alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], kinds).select(F.lit(station).alias("station"), "t", *names)
    last = out.where("t IS NOT NULL").groupBy("t").agg(F.max_by(F.struct(*names), "place").alias("v"))
    return last.select(F.lit(station).alias("station"), "t", *[F.col("v")[n].alias(n) for n in names])
