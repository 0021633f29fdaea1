"""Read classes, counters and insert sizes: one pass, partial aggregation before the only shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pileflow.functions.flags import DUPLICATE, MATE_UNMAPPED, PAIRED, PROPER, QCFAIL, READ1, READ2, REVERSE, UNMAPPED, has, is_primary, lacks, not_duplicate, placed, read_class


def classes(reads: DataFrame) -> DataFrame:
    """Primary reads by class."""
    return reads.where(is_primary()).groupBy(read_class().alias("class")).agg(F.count("*").alias("n"), F.sum(F.col("l_qseq").cast("bigint")).alias("bases"))


def flagstat(reads: DataFrame, mapq: int = 20) -> DataFrame:
    """The counters over primary reads, as one row."""
    ok, mapped = lacks(QCFAIL), lacks(QCFAIL | UNMAPPED)
    pair_map = mapped & has(PAIRED) & lacks(MATE_UNMAPPED)
    kept = placed() & not_duplicate()

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    def bases(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("l_qseq").cast("bigint"))), F.lit(0)).alias(name)

    return reads.where(is_primary()).agg(
        F.count("*").alias("n_reads"), bases(F.lit(True), "n_data"), n(has(QCFAIL), "n_qcfail"),
        n(ok & has(PAIRED), "n_pair_all"), n(mapped & has(PAIRED) & has(PROPER), "n_pair_good"),
        n(ok & has(PAIRED) & has(READ1), "n_read1"), n(ok & has(PAIRED) & has(READ2), "n_read2"),
        n(mapped & has(PAIRED) & has(MATE_UNMAPPED), "n_sgltn"), n(pair_map, "n_pair_map"),
        n(pair_map & (F.col("mate_rname") != F.col("rname")), "n_diffchr"),
        n(mapped, "n_mapped"), bases(mapped, "n_mdata"), n(mapped & has(REVERSE), "n_mstrand"), n(mapped & lacks(REVERSE), "n_pstrand"),
        n(mapped & has(DUPLICATE), "n_dup"), n(F.col("mapq") >= mapq, "n_qual"),
        n(kept & has(READ1), "n_rmdup1"), n(kept & has(READ2), "n_rmdup2"),
    )


def mapq_counts(reads: DataFrame) -> DataFrame:
    return reads.where(is_primary()).groupBy("mapq").agg(F.count("*").alias("n"))


def insert_hist(reads: DataFrame, limit: int = 2000) -> DataFrame:
    """(value, cnt) of template lengths above 0 and below the limit."""
    return reads.where(is_primary() & placed() & (F.col("isize") > 0) & (F.col("isize") < limit)).groupBy(F.col("isize").alias("value")).agg(F.count("*").alias("cnt"))
