"""Registry tables: semicolon text in whatever encoding it came in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that windows-1252 doesn't define (a fixed value).
UNDEFINED_1252 = "[\\x81\\x8D\\x8F\\x90\\x9D]"
#: What it means by the bytes that ISO-8859-1 gives to control characters: the latter's characters and its own.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
ANSI = CONTROLS.encode("latin-1").decode("cp1252")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first of UTF-8, windows-1252 and ISO-8859-1 in which every line of a file can be read."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("b"))  # the bytes as they are
    bad = lines.agg(F.max((~F.is_valid_utf8(F.col("b").cast("string"))).cast("int")).alias("utf8"), F.max(F.decode("b", "ISO-8859-1").rlike(UNDEFINED_1252).cast("int")).alias("ansi")).first()
    return "UTF-8" if not bad.utf8 else "windows-1252" if not bad.ansi else "ISO-8859-1"


def plain_name(name: str) -> str:
    """A column name in lower case, accents and signs left out."""
    import unicodedata

    letters = unicodedata.normalize("NFKD", name.strip().lower())
    return re.sub(r"[^a-z0-9]+", "", "".join(c for c in letters if not unicodedata.combining(c)))


def read(spark: SparkSession, path: str, columns: set[str] | None = None, encoding: str | None = None) -> DataFrame:
    """A table with a header, all columns as text; a byte order mark is dropped. columns: plain names of those to keep."""
    encoding = encoding or encoding_of(spark, path)
    ansi = encoding == "windows-1252"  # the reader knows no such name: read byte by byte, then put its characters in
    rows = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1" if ansi else encoding, emptyValue="")
    rows = rows.toDF(*[c.lstrip("\ufeff").translate(str.maketrans(CONTROLS, ANSI)) if ansi else c.lstrip("\ufeff") for c in rows.columns])
    if ansi:
        rows = rows.select(*[F.translate(F.col(f"`{c}`"), CONTROLS, ANSI).alias(c) for c in rows.columns])
    if columns is None:
        return rows
    return rows.select(*[F.col(f"`{c}`").alias(plain_name(c)) for c in rows.columns if plain_name(c) in columns])


def read_all(spark: SparkSession, customers: str, meters: str, houses: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables that every run over labels begins with."""
    return tuple(read(spark, p, encoding="UTF-8") for p in (customers, meters, houses))


def places(spark: SparkSession, path: str) -> DataFrame:
    """plz, ort and kanton of a register, whatever its encoding and further columns."""
    return read(spark, path, {"plz", "ort", "kanton"})
