"""Registry marks to house labels, installation dates, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import stats as st


def mark(raw: Column) -> Column:
    """x is 1, - and blank are 0, anything else is unknown."""
    m = F.lower(F.trim(raw))
    return F.when(m == "x", 1).when((m == "-") | (m == "") | m.isNull(), 0)


def unknown_marks(registry: DataFrame, column: str = "mark") -> DataFrame:
    """The marks that are none of the known ones, with their counts."""
    return registry.where(mark(F.col(column)).isNull()).groupBy(F.trim(column).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


def customer_labels(registry: DataFrame, column: str = "mark") -> DataFrame:
    """One label per customer: 1 if any row says so; customers without a known mark are left out."""
    return registry.groupBy(F.trim("gp").alias("gp")).agg(F.max(mark(F.col(column))).alias("label")).where("label IS NOT NULL")


def house_labels(registry: DataFrame, meters: DataFrame, absent_is_negative: bool = True, column: str = "mark") -> DataFrame:
    """mp_id and label over customer, meter and house; the first by customer and meter where a house has several.

    Without absent_is_negative only the positive houses are returned.
    """
    found = meters.select(F.trim("gp").alias("gp"), "meter", "mp_id").join(customer_labels(registry, column), "gp")
    w = Window.partitionBy("mp_id").orderBy("gp", "meter")
    one = found.withColumn("r", F.row_number().over(w)).where("r = 1").select("mp_id", F.col("label").cast("long").alias("label"))
    return one if absent_is_negative else one.where("label = 1")


def installation_dates(registry: DataFrame, meters: DataFrame, column: str = "mark") -> DataFrame:
    """Earliest readable installation date of each positive customer, per house."""
    first = registry.where(mark(F.col(column)) == 1).groupBy(F.trim("gp").alias("gp")).agg(F.min(F.try_to_date("installed", "dd.MM.yyyy")).alias("installed")).where("installed IS NOT NULL")
    return meters.select(F.trim("gp").alias("gp"), "mp_id").join(first, "gp").groupBy("mp_id").agg(F.min("installed").alias("installed"))


def split(labelled: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified split: of each class the first share by a hash of the house is the test set."""
    rows = st.numbered(labelled, ["label"], "mp_id", seed)
    return rows.withColumn("test", F.col("number") < F.round(F.col("of") * test_share)).drop("number", "of")


def header(name: Column) -> Column:
    """A column name in lower case without accents and signs."""
    return F.regexp_replace(F.translate(F.lower(F.trim(name)), "äöüéèà", "aoueea"), "[^a-z0-9]+", "")
