"""SAM text: alignment rows and the chromosome dictionary of the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.schema import CHROMS


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    if any(p.endswith(".cram") for p in paths):
        raise ValueError("CRAM needs an external decoder; convert the file to SAM, BAM or Parquet first")
    if "-" in paths:
        raise ValueError("standard input isn't a distributed source; pass a DataFrame of reads instead")
    return spark.read.text(list(paths))


def parse(lines: DataFrame, keep: bool = False) -> DataFrame:
    """Rows of ``value`` to reads; positions become 0-based, ``=`` as mate reference is resolved. ``keep``: with the line itself."""
    t = F.split("value", "\t")
    rows = lines.where("not startswith(value, '@') and value != ''").select(t.alias("t"), F.col("value").alias("line")).where("size(t) >= 11")
    f = lambda k: F.get("t", F.lit(k))  # noqa: E731  a filter may run after what stands above it
    i = lambda k: f(k).try_cast("int")
    mate = F.when(f(6) == "=", f(2)).otherwise(f(6))
    length = F.when(f(9) == "*", 0).otherwise(F.length(f(9)))
    return rows.select(f(2).alias("rname"), (i(3) - 1).alias("pos"), i(1).alias("flag"), i(4).alias("mapq"), length.alias("l_qseq"), mate.alias("mate_rname"), i(8).alias("isize"), f(5).alias("cigar"), *(["line"] if keep else []))


def read(spark: SparkSession, *paths: str, keep: bool = False) -> DataFrame:
    """Any number of files, in any order."""
    return parse(_lines(spark, *paths), keep)


def header_text(spark: SparkSession, path: str) -> str:
    """The header's lines, which are few."""
    return "".join(r.value + "\n" for r in _lines(spark, path).where("startswith(value, '@')").collect())


def header(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length) from the @SQ lines of the first file. The header is short and its lines are few, so it is gathered whole."""
    rows = _lines(spark, path).where("startswith(value, '@SQ')").select(F.regexp_extract("value", "\tSN:([^\t]+)", 1), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long")).collect()
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], CHROMS)


def write(reads: DataFrame, path: str) -> None:
    """SAM text without header, sequence or qualities (unknown here: ``*`` of the read's length isn't kept)."""
    reads.select(F.concat_ws("\t", F.lit("*"), "flag", "rname", F.col("pos") + 1, "mapq", "cigar", "mate_rname", F.lit(0), "isize", F.when(F.col("l_qseq") > 0, F.repeat(F.lit("N"), F.col("l_qseq"))).otherwise("*"), F.lit("*"))).write.mode("overwrite").text(path)
