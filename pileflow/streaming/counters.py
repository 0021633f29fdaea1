"""Reads as a stream: counters that are kept up, and depth of bins that late reads can no longer reach."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pileflow.functions.flags import is_primary, read_class
from pileflow.operators.depth import read_blocks, usable
from pileflow.operators.intervals import BIN
from pileflow.schema import READS


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Parquet files of reads, as they come."""
    return spark.readStream.schema(READS).options(**options).parquet(folder)


def classes(reads: DataFrame) -> DataFrame:
    """Running counts by read class; for output modes complete and update."""
    return reads.where(is_primary()).groupBy(read_class().alias("class")).agg(F.count("*").alias("n"))


def _number(chroms: Sequence[str]) -> Column:
    """Place of a read's chromosome in the header; null for others."""
    return F.create_map(*[F.lit(x) for i, c in enumerate(chroms) for x in (c, i)])[F.col("chrom")]


def bin_depth(reads: DataFrame, chroms: Sequence[str], delay_bins: int = 2, mapq: int = 20, bins: int = BIN) -> DataFrame:
    """Sums of the three depths by (chrom, bin), each given out once the stream is ``delay_bins`` past it.

    For coordinate-sorted streams, chromosomes in the order of ``chroms``: a position counts as a microsecond of event time
    and a chromosome begins 2^32 after the one before, so the watermark drops what the sweep has passed, as a sorted single pass would.
    Blocks are cut at the borders of bins. ``bins`` is a power of two.
    """
    if bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    cut = read_blocks(reads, mapq).withColumns({"s": F.col("s") - 1, "tid": _number(chroms)}).where("tid is not null")
    cut = cut.withColumn("bin", F.explode(F.sequence(F.expr(f"s div {bins}"), F.expr(f"(e - 1) div {bins}"))))
    cut = cut.withColumns({"s": F.greatest(F.col("s").cast("long"), F.col("bin") * bins), "e": F.least(F.col("e").cast("long"), (F.col("bin") + 1) * bins)})
    cut = cut.withColumn("t", F.timestamp_micros(F.col("tid").cast("long") * (1 << 32) + F.col("s")))
    sums = [F.sum(F.col(c) * (F.col("e") - F.col("s"))).alias(c) for c in ("raw", "rmdup", "cover")]
    return cut.withWatermark("t", f"{delay_bins * bins} microseconds").groupBy(F.window("t", f"{bins} microseconds").alias("w"), "chrom", "bin").agg(*sums).select("chrom", F.col("bin").cast("int").alias("bin"), "raw", "rmdup", "cover")


def disorder(reads: DataFrame) -> DataFrame:
    """(chrom, reached, late) of each chromosome in each batch: the furthest start so far, and how many reads of the batch lie before
    what earlier batches had reached. A coordinate-sorted stream has no late ones. One number a chromosome is kept."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached = state.get[0] if state.exists else -1
        far, late = reached, 0
        for f in frames:
            late += int((f.pos < reached).sum())
            far = max(far, int(f.pos.max()))
        state.update((far,))
        yield pd.DataFrame({"chrom": [key[0]], "reached": [far], "late": [late]})

    rows = usable(reads).select(F.col("rname").alias("chrom"), F.col("pos").cast("long").alias("pos"))
    return rows.groupBy("chrom").applyInPandasWithState(check, "chrom string, reached long, late long", "reached long", "update", GroupStateTimeout.NoTimeout)
