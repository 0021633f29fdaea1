"""FASTA text, plain or gzip: one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, sequence); the name is the whole header line."""
    # a record begins with ">" at the start of a line; one inside a header is part of it
    rows = spark.read.text(list(paths), lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) != ''")
    part = lambda i: F.try_element_at(F.split("value", "\n", 2), F.lit(i))
    return rows.select(F.trim(F.regexp_replace(part(1), "\r$", "")).alias("name"), F.regexp_replace(F.coalesce(part(2), F.lit("")), r"\s", "").alias("sequence"))
