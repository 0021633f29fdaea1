"""Depth at target positions by a boundary-event sweep, one (chromosome, bin) at a time.

Blocks and regions are cut at bin borders, so every bin's running sums start at zero and need nothing
from their neighbours: one shuffle on (chrom, bin) of packed blocks, no range join, and a long chromosome is many tasks.
Tasks grow in number with the reads, and packed.py's arrays of a few bins are all that one keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pileflow.functions.cigar import blocks, span
from pileflow.functions.flags import is_clean, is_primary, placed
from pileflow.operators import packed
from pileflow.operators.intervals import BIN, binned


def usable(reads: DataFrame) -> DataFrame:
    """Primary reads that have a place; all of them give depth."""
    return reads.where(is_primary() & placed())


def read_blocks(reads: DataFrame, mapq: int = 20, refskip: str = "stay") -> DataFrame:
    """(chrom, s, e, raw, rmdup, cover): what each aligned or deleted block adds to the three depths."""
    rows = usable(reads).select(F.col("rname").alias("chrom"), "pos", "cigar", is_clean(mapq).cast("int").alias("clean"))
    aligned = (F.col("op") != "D").cast("int")
    return blocks(rows, refskip, ["chrom", "clean"]).select("chrom", "s", "e", aligned.alias("raw"), (aligned * F.col("clean")).alias("rmdup"), F.lit(1).alias("cover"))


#: Bytes of input, as the sources tell their size, for each task that sweeps; beyond MANY tasks each takes more.
SHARE, MANY = 8 << 20, 20_000


def tasks(*inputs: DataFrame) -> int:
    """Tasks for a shuffle: as many as cores, or more by size; at least those of the session where a source doesn't tell its size."""
    leaves = [p.apply(i) for p in (df._jdf.queryExecution().optimizedPlan().collectLeaves() for df in inputs) for i in range(p.size())]
    sizes = [int(str(x.stats().sizeInBytes())) for x in leaves]
    known = sum(x for x in sizes if x < 1 << 50)
    spark = inputs[0].sparkSession
    least = spark.sparkContext.defaultParallelism if known == sum(sizes) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MANY, -(-known // SHARE)))


def _dealt(reads: DataFrame, regions: DataFrame, flank: DataFrame | None, mapq: int, refskip: str, bins: int, hulls: bool) -> DataFrame:
    """Packed blocks and the parts of both sets, sorted by (chrom, bin) with parts first, each bin in one task."""
    place = lambda x, kind: binned(x, bins).select("chrom", "bin", F.lit(None).cast("binary").alias("data"), F.struct("s", "e", "start", "stop", F.lit(kind).alias("kind"), F.lit(1).alias("n")).cast("struct<s:int,e:int,start:int,stop:int,kind:int,n:int>").alias("place"))
    given = usable(reads).select(F.col("rname").alias("chrom"), is_clean(mapq).cast("int").alias("clean"), "pos", "cigar")
    rows = given.mapInArrow(packed.pack(refskip, bins, hulls), packed.SCHEMA).unionByName(place(regions, packed.INSIDE))
    if flank is not None:
        rows = rows.unionByName(place(flank, packed.BESIDE))
    return rows.repartition(tasks(reads, regions), "chrom", "bin").sortWithinPartitions("chrom", "bin", F.isnotnull("data"))


def sweep(reads: DataFrame, regions: DataFrame, flank: DataFrame | None = None, mapq: int = 20, refskip: str = "stay", bins: int = BIN) -> DataFrame:
    """Runs of equal depth inside merged regions or a second merged set: (chrom, start, stop, s, e, inside, beside, raw, rmdup, cover).

    s, e are 1-based inclusive; ``inside`` and ``beside`` tell whether the run lies in the regions and in ``flank``; start, stop are
    of the region, if inside. Covers every position of either set once, with zeros where no read lies. Runs end at bin borders.
    """
    bins = min(bins, packed.WIDEST)
    return _dealt(reads, regions, flank, mapq, refskip, bins, False).mapInArrow(packed.as_runs(bins), packed.RUNS)


def facts(reads: DataFrame, regions: DataFrame, flank: DataFrame, mapq: int = 20, refskip: str = "stay", bins: int = BIN) -> DataFrame:
    """(kind, value, cnt) of both merged sets in one sweep: positions by depth (``tgt`` cover, ``rmdup``, ``flk`` raw), regions by whole mean
    raw depth (``reg``), and the number of usable reads whose hull meets a set (``n_tgt``, ``n_flk``; value null)."""
    bins = min(bins, packed.WIDEST)
    found = _dealt(reads, regions, flank, mapq, refskip, bins, True).mapInArrow(packed.as_facts(bins), packed.FACTS)
    # parts of a region add up by region, all else by value; reads over several bins count once however many of these they meet a set in
    part = F.col("kind") == "part"
    summed = found.groupBy("kind", F.when(~part, F.col("value")).alias("v"), "chrom", "start", "stop").agg(F.sum("value").alias("total"), F.sum("cnt").alias("n"), F.max("cnt").alias("most"))
    hit = F.col("kind").startswith("hit_")
    kind = F.when(part, "reg").when(hit, F.concat(F.lit("n_"), F.substring("kind", 5, 3))).otherwise(F.col("kind"))
    value = F.when(part, F.floor(F.col("total") / F.col("n"))).when(~kind.startswith("n_"), F.col("v"))
    return summed.select(kind.alias("kind"), value.alias("value"), F.when(part, F.lit(1)).when(hit, F.col("most")).otherwise(F.col("n")).alias("n")).groupBy("kind", "value").agg(F.sum("n").alias("cnt"))


def segments(reads: DataFrame, regions: DataFrame, mapq: int = 20, refskip: str = "stay", bins: int = BIN) -> DataFrame:
    """Runs of equal depth inside merged regions: (chrom, start, stop, s, e, raw, rmdup, cover)."""
    return sweep(reads, regions, None, mapq, refskip, bins).drop("inside", "beside")


def positions(segs: DataFrame) -> DataFrame:
    """One row per target position: (chrom, pos, raw, rmdup, cover), pos 1-based."""
    return segs.select("chrom", F.explode(F.sequence("s", "e")).alias("pos"), "raw", "rmdup", "cover")


def overlapping(reads: DataFrame, regions: DataFrame, bins: int = BIN) -> DataFrame:
    """Usable reads whose hull, deletions and skips included, meets a region; each at most once.

    An equi-semi-join on (chrom, bin). A read that crosses a bin's border has one copy per bin, so those few
    get a row number first and meet again after; the rest never shuffles more than once.
    """
    parts = binned(regions, bins).select(F.col("chrom").alias("_c"), F.col("bin").alias("_b"), F.col("s").alias("_rs"), F.col("e").alias("_re"))
    hulls = usable(reads).withColumns({"_s": F.col("pos") + 1, "_e": F.col("pos") + span()})
    hulls = hulls.withColumns({"_b0": F.floor((F.col("_s") - 1) / bins).cast("int"), "_b1": F.floor((F.col("_e") - 1) / bins).cast("int")})
    meets = lambda r, b: (F.col("rname") == r["_c"]) & (F.col(b) == r["_b"]) & (F.col("_s") <= r["_re"]) & (F.col("_e") >= r["_rs"])
    first = hulls.join(parts, meets(parts, "_b0"), "left_semi")
    missed = hulls.where("_b1 > _b0").join(parts, meets(parts, "_b0"), "left_anti")
    second = missed.where("_b1 = _b0 + 1").join(parts, meets(parts, "_b1"), "left_semi")
    # hulls over three bins or more (long skips): by the bins between, then one row each again
    wide = missed.where("_b1 > _b0 + 1").withColumn("_id", F.monotonically_increasing_id())
    hit = wide.withColumn("_k", F.explode(F.sequence(F.col("_b0") + 1, F.col("_b1")))).join(parts, meets(parts, "_k"), "left_semi").dropDuplicates(["_id"])
    return first.select(*reads.columns).unionByName(second.select(*reads.columns)).unionByName(hit.select(*reads.columns))


def unread_chromosomes(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Target chromosomes without a usable read."""
    return regions.select("chrom").distinct().join(usable(reads).select(F.col("rname").alias("chrom")), "chrom", "left_anti")
