"""Interval files: whitespace-separated text, plain or gzip, to (chrom, start, stop)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, one_based: bool = False, compat: bool = False) -> DataFrame:
    """Lines in ``value``. A line with one position is that 1-based position; header, empty and malformed lines are left out.

    compat: a start of 0 becomes 1.
    """
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    number = lambda i: F.when(F.try_element_at(t, F.lit(i)).rlike("^[0-9]"), F.regexp_extract(F.try_element_at(t, F.lit(i)), "^[0-9]+", 0).cast("int"))
    rows = lines.select(F.try_element_at(t, F.lit(1)).alias("chrom"), number(2).alias("a"), F.coalesce(number(3), F.lit(0)).alias("b")).where("chrom != '' and not startswith(chrom, '#') and a is not null")
    single = F.col("b") == 0
    rows = rows.select("chrom", F.when(single, F.greatest(F.col("a") - 1, F.lit(0))).otherwise(F.col("a") - int(one_based)).alias("a"), F.when(single, F.col("a")).otherwise(F.col("b")).alias("b")).where("b > 0")
    return rows.select("chrom", F.greatest(F.least("a", "b"), F.lit(1 if compat else 0)).alias("start"), F.greatest("a", "b").alias("stop"))


def read(spark: SparkSession, *paths: str, one_based: bool = False, compat: bool = False) -> DataFrame:
    return parse(spark.read.text(list(paths)), one_based, compat)


def write(regions: DataFrame, path: str) -> None:
    """A folder of tab-separated parts, in order by chromosome and start."""
    regions.select("chrom", "start", "stop").orderBy("chrom", "start", "stop").write.mode("overwrite").csv(path, sep="\t")


def write_file(regions: DataFrame, path: str, ordered: bool = False) -> None:
    """One file beside the driver, row by row from the cluster: for reports. ``ordered``: the rows are in their order already."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = regions.select("chrom", "start", "stop")
    rows = rows if ordered else rows.orderBy("chrom", "start", "stop")
    with open(path, "w") as f:
        f.writelines(f"{r.chrom}\t{r.start}\t{r.stop}\n" for r in rows.toLocalIterator())
