"""Interval sets: DataFrames of (chrom, start, stop), 0-based and half-open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases in a bin; one bin of one chromosome is the unit of work, so a single chromosome still spreads out.
BIN = 1 << 14


def _islands(regions: DataFrame, *by: str) -> DataFrame:
    """Overlapping and bookended intervals of each group as one."""
    before = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    return (
        regions.withColumn("_new", F.when(F.max("stop").over(before) >= F.col("start"), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(upto))
        .groupBy(*by, "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_island")
    )


def merge(regions: DataFrame, bins: int = BIN) -> DataFrame:
    """Union of a set with itself: overlapping and bookended intervals become one. Empty intervals stay where nothing touches them.

    Cut and merged by (chrom, bin); only what touches a bin's border, two islands a bin at most, is merged again by chromosome.
    """
    at = lambda c: F.floor(F.col(c) / bins).cast("int")
    cut = regions.select("chrom", "start", "stop", F.greatest("start", F.col("stop") - 1).alias("_last")).withColumn("bin", F.explode(F.sequence(at("start"), at("_last"))))
    low, high = F.col("bin") * bins, (F.col("bin") + 1) * bins
    parts = _islands(cut.select("chrom", "bin", F.greatest("start", low).alias("start"), F.least("stop", high).alias("stop")), "chrom", "bin")
    borders = (F.col("start") == low) | (F.col("stop") == high)
    inner = parts.where(~borders).select("chrom", "start", "stop")
    return inner.unionByName(_islands(parts.where(borders).select("chrom", "start", "stop"), "chrom"))


def union(*sets: DataFrame) -> DataFrame:
    """All intervals of all sets, unmerged."""
    return reduce(DataFrame.unionByName, [s.select("chrom", "start", "stop") for s in sets])


def extend(regions: DataFrame, left: int = 0, right: int = 0, chroms: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Moves the ends outwards. compat: starts stop at 1, ends go past the chromosome; else 0 and the chromosome's length."""
    if left < 0 or right < 0:
        raise ValueError("extensions can't be negative")
    out = regions.withColumns({"start": F.greatest(F.col("start") - left, F.lit(1 if compat else 0)), "stop": F.col("stop") + right})
    if chroms is None or compat:
        return out
    lengths = chroms.select(F.col("name").alias("chrom"), F.col("length").alias("_len"))
    return out.join(lengths, "chrom", "left").withColumn("stop", F.least("stop", F.coalesce("_len", "stop")).cast("int")).drop("_len")


def to_zero_based(regions: DataFrame) -> DataFrame:
    return regions.withColumn("start", F.col("start") - 1)


def to_one_based(regions: DataFrame) -> DataFrame:
    """Raises where a start would pass its stop."""
    moved = F.col("start") + 1
    return regions.withColumn("start", F.when(moved <= F.col("stop"), moved).otherwise(F.raise_error(F.lit("start passes stop"))))


def trim(regions: DataFrame, front: int = 0, end: int = 0) -> DataFrame:
    """Cuts both ends of merged regions; one not longer than both cuts stays whole. Merged again after."""
    if front < 0 or end < 0:
        raise ValueError("cuts can't be negative")
    long = F.col("stop") - F.col("start") > front + end
    cut = merge(regions).withColumns({"start": F.when(long, F.col("start") + front).otherwise(F.col("start")), "stop": F.when(long, F.col("stop") - end).otherwise(F.col("stop"))})
    return merge(cut)


def binned(regions: DataFrame, bins: int = BIN) -> DataFrame:
    """Cut at bin borders: adds ``bin``, and ``s``, ``e`` (the part in that bin, 1-based inclusive). Empty intervals go."""
    return (
        regions.where("start < stop")
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bins).cast("int"), F.floor((F.col("stop") - 1) / bins).cast("int"))))
        .withColumns({"s": F.greatest(F.col("start"), F.col("bin") * bins) + 1, "e": F.least(F.col("stop"), (F.col("bin") + 1) * bins)})
    )


def intersect(*sets: DataFrame) -> DataFrame:
    """What lies in every set, folded from the left. Equi-joined on (chrom, bin), so no range join is planned."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        x = binned(merge(a)).select("chrom", "bin", F.col("s").alias("s1"), F.col("e").alias("e1"))
        y = binned(merge(b)).select("chrom", "bin", F.col("s").alias("s2"), F.col("e").alias("e2"))
        hit = x.join(y, ["chrom", "bin"]).where("s1 <= e2 and s2 <= e1")
        # parts cut at a bin's border are bookended, so the merge joins them again
        return merge(hit.select("chrom", (F.greatest("s1", "s2") - 1).alias("start"), F.least("e1", "e2").alias("stop")))

    return reduce(both, sets[1:], merge(sets[0]))


def subtract(a: DataFrame, *others: DataFrame, compat: bool = False) -> DataFrame:
    """What lies in a and in none of the others: a sweep over signed boundary events, by (chrom, bin). Empty intervals have nothing to lose and go.

    compat: the last remaining interval of each chromosome that the others touch is lost.
    """
    b = merge(union(*others))
    cut = lambda x, which: binned(x).selectExpr("chrom", "bin", f"inline(array(struct(s - 1 as p, 1 as {which}), struct(e as p, -1 as {which})))")
    events = cut(merge(a), "da").unionByName(cut(b, "db"), allowMissingColumns=True).na.fill(0, ["da", "db"])
    w = Window.partitionBy("chrom", "bin").orderBy("p")
    swept = (
        events.groupBy("chrom", "bin", "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
        .select("chrom", F.col("p").alias("start"), F.lead("p").over(w).alias("stop"), F.sum("da").over(w).alias("in_a"), F.sum("db").over(w).alias("in_b"))
        .where("in_a > 0 and in_b = 0 and stop is not null")
    )
    swept = merge(swept.select("chrom", "start", "stop"))
    out = swept.select("chrom", "start", "stop")
    if compat:
        last = Window.partitionBy("chrom").orderBy(F.desc("start"))
        seen = b.select("chrom", F.lit(True).alias("_seen")).distinct()
        out = out.withColumn("_r", F.row_number().over(last)).join(seen, "chrom", "left").where("_seen is null or _r > 1").select("chrom", "start", "stop")
    return out


def summary(regions: DataFrame) -> DataFrame:
    """Number of intervals and bases."""
    return regions.agg(F.count("*").alias("regions"), F.coalesce(F.sum(F.col("stop").cast("bigint") - F.col("start")), F.lit(0)).alias("bases"), F.count_if(F.col("start") == F.col("stop")).alias("empty"))


def chromosomes(regions: DataFrame) -> DataFrame:
    return regions.select("chrom").distinct()


def bounds(regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """Each interval that its chromosome doesn't hold, with the reason: ``unknown`` or ``past_end``."""
    lengths = chroms.select(F.col("name").alias("chrom"), "length")
    reason = F.when(F.col("length").isNull(), "unknown").when((F.col("start") >= F.col("length")) | (F.col("stop") > F.col("length")), "past_end")
    return regions.join(lengths, "chrom", "left").select("chrom", "start", "stop", reason.alias("reason")).where("reason is not null")


def check_bounds(regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """The regions, of which one past its chromosome's end raises when it is read."""
    lengths = chroms.select(F.col("name").alias("chrom"), F.col("length").alias("_len"))
    past = (F.col("start") >= F.col("_len")) | (F.col("stop") > F.col("_len"))
    said = F.concat(F.lit("interval past the end of "), "chrom")
    return regions.join(lengths, "chrom", "left").withColumn("start", F.when(past, F.raise_error(said)).otherwise(F.col("start"))).drop("_len")
