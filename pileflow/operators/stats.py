"""Distributions and coverage figures, all from depth segments or small (value, cnt) histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pileflow.operators.intervals import merge

def width() -> Column:
    """Positions in a segment."""
    return F.expr("cast(e - s + 1 as bigint)")


def depth_hist(segs: DataFrame, depth: str = "cover") -> DataFrame:
    return segs.groupBy(F.col(depth).alias("value")).agg(F.sum(width()).alias("cnt"))


def chrom_hist(segs: DataFrame, depth: str = "cover") -> DataFrame:
    return segs.groupBy("chrom", F.col(depth).alias("value")).agg(F.sum(width()).alias("cnt"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Every value from 0 to the largest: its count and share, and those of all larger values.

    The histogram has as many rows as distinct depths; the window over it takes one task.
    """
    top = hist.agg(F.max("value").alias("top")).where("top is not null")
    dense = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top").cast("bigint"))).alias("value"))
    full = dense.join(hist.withColumn("value", F.col("value").cast("bigint")), "value", "left").na.fill(0, ["cnt"])
    every, above = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("value"))
    counts = full.select("value", "cnt", F.sum("cnt").over(every).alias("total"), (F.sum("cnt").over(above) - F.col("cnt")).alias("cnt_gt"))
    return counts.select("value", "cnt", (F.col("cnt") / F.col("total")).alias("frac"), "cnt_gt", (F.col("cnt_gt") / F.col("total")).alias("frac_gt"))


def region_stats(segs: DataFrame, compat: bool = False) -> DataFrame:
    """Per region: mean and median raw depth, percent of positions with raw depth and with cover depth.

    The median is exact and weighted by run length. compat: of an odd number of positions, three at least, it is one place above the middle.
    """
    keys = ["chrom", "start", "stop"]
    n = F.sum(width())
    out = segs.groupBy(*keys).agg(
        (F.sum(F.col("raw") * width()) / n).alias("avg"), F.expr("percentile(raw, 0.5D, e - s + 1)").alias("median"),
        (100.0 * F.sum(F.when(F.col("raw") > 0, width()).otherwise(0)) / n).alias("coverage"), (100.0 * F.sum(F.when(F.col("cover") > 0, width()).otherwise(0)) / n).alias("coverage_fix"),
    )
    if not compat:
        return out
    run = Window.partitionBy(*keys).orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)
    place = F.expr("(stop - start) div 2 + 2")
    odd = segs.withColumn("_upto", F.sum(width()).over(run)).where((F.expr("(stop - start) % 2 = 1 and stop - start >= 3")) & (F.col("_upto") >= place))
    odd = odd.groupBy(*keys).agg(F.min("raw").cast("double").alias("_odd"))
    return out.join(odd, keys, "left").withColumn("median", F.coalesce("_odd", "median")).drop("_odd")


def region_hist(stats: DataFrame) -> DataFrame:
    """Regions by whole mean depth."""
    return stats.groupBy(F.floor("avg").alias("value")).agg(F.count("*").alias("cnt"))


def hist_mean(hist: DataFrame) -> DataFrame:
    return hist.agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean"))


def hist_median(hist: DataFrame, compat: bool = False) -> DataFrame:
    """compat: the first value whose running count reaches half, halves rounded down; an even split averages it with the next."""
    if not compat:
        return hist.agg(F.expr("percentile(value, 0.5D, cnt)").alias("median"))
    w = Window.partitionBy().orderBy("value")
    run = hist.where("cnt > 0").select("value", F.sum("cnt").over(w).alias("upto"), F.lead("value").over(w).alias("next"), F.sum("cnt").over(Window.partitionBy()).alias("n"))
    # a value of 0 starts the scan with nothing counted, so one single row gives 0
    hit = F.when((F.col("upto") == F.expr("n div 2")) & (F.expr("n % 2 = 0")), (F.col("value") + F.coalesce("next", "value")) / 2.0).otherwise(F.col("value").cast("double"))
    return run.where("upto >= n div 2").agg(F.min_by(F.when(F.col("n") == 1, F.lit(0.0)).otherwise(hit), "value").alias("median"))


def share_at(threshold: Column | int) -> Column:
    """Percent of a histogram's count at or above the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return 100.0 * F.sum(F.when(F.col("value") >= t, F.col("cnt")).otherwise(0)) / F.sum("cnt")


def coverage_at(hist: DataFrame, thresholds: Sequence[int] = (1, 4, 10, 30, 100), by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, percent) in one pass over the histogram."""
    wide = hist.groupBy(*by).agg(*[share_at(t).alias(f"t{t}") for t in thresholds])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("percent")) for t in thresholds])
    return wide.select(*by, F.inline(pairs))


def hist_center(hist: DataFrame) -> DataFrame:
    """Mean and median of a histogram, in one row."""
    return hist.agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.expr("percentile(value, 0.5D, cnt)").alias("median"))


def coverage_ratio(hist: DataFrame, ratios: Sequence[float] = (0.2, 0.5), strict: bool = True) -> DataFrame:
    """(ratio, threshold, percent). strict: depth above trunc(ratio * mean); else at least trunc(ratio * whole mean).

    The histogram counts every target base, so the mean is its own.
    """
    every = Window.partitionBy()
    data = hist.withColumn("_mean", F.sum(F.col("value") * F.col("cnt")).over(every) / F.sum("cnt").over(every))
    mean = F.col("_mean") if strict else F.floor("_mean")
    each = data.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))).withColumn("threshold", F.floor(F.col("ratio") * mean))
    hit = F.col("value") > F.col("threshold") if strict else F.col("value") >= F.col("threshold")
    return each.groupBy("ratio", "threshold").agg((100.0 * F.sum(F.when(hit, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("percent"))


def chrom_report(hist: DataFrame, thresholds: Sequence[int] = (4, 10, 30, 100), cutoffs: Sequence[int] = ()) -> DataFrame:
    """Per chromosome, from its cover histogram: share of all target data, mean, median, percent covered."""
    t = [*dict.fromkeys([*thresholds, *cutoffs])]
    data = F.sum(F.col("value") * F.col("cnt"))
    per = hist.groupBy("chrom").agg(data.alias("data"), (data / F.sum("cnt")).alias("avg"), F.expr("percentile(value, 0.5D, cnt)").alias("median"), share_at(1).alias("coverage"), *[share_at(x).alias(f"cov_{x}x") for x in t])
    total = F.sum("data").over(Window.partitionBy())
    return per.withColumn("data_percent", F.coalesce(100.0 * F.try_divide(F.col("data"), total), F.lit(0.0)))


def uncovered(segs: DataFrame, below: int = 5) -> DataFrame:
    """Maximal runs with cover depth under ``below``, as merged intervals."""
    if below <= 0:
        raise ValueError("below must be positive")
    return merge(segs.where(F.col("cover") < below).select("chrom", (F.col("s") - 1).cast("int").alias("start"), F.col("e").cast("int").alias("stop")))
