"""The depth run: reads and regions in, every table and metric of the reports out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pileflow.operators import depth, intervals, reads, stats
from pileflow.schema import Options


@dataclass
class Coverage:
    """Lazy tables of one run. ``persist`` keeps what several of them read; ``close`` lets it go."""

    alignments: DataFrame
    regions: DataFrame
    chroms: DataFrame | None = None
    options: Options = Options()

    def __post_init__(self) -> None:
        o = self.options
        target = intervals.to_zero_based(self.regions) if o.one_based else self.regions
        target = target.withColumn("start", F.greatest("start", F.lit(1))) if o.compat else target
        self.target = intervals.merge(target)
        if self.chroms is not None:
            self.target = intervals.check_bounds(self.target, self.chroms)
        self.flank_set = intervals.merge(intervals.extend(self.target, o.flank, o.flank, self.chroms, o.compat))
        if o.flank_exclude_target:
            self.flank_set = intervals.subtract(self.flank_set, self.target)
        self.runs = depth.sweep(self.alignments, self.target, self.flank_set, o.mapq, o.refskip)

    @property
    def segments(self) -> DataFrame:
        """Runs inside the target."""
        return self.runs.where("inside").drop("inside", "beside")

    def persist(self) -> Coverage:
        self.runs.persist()
        return self

    def close(self) -> None:
        self.runs.unpersist()

    def in_order(self, rows: DataFrame, *by: str) -> DataFrame:
        """Rows with ``chrom`` in the order of the header, then by columns; chromosomes that it doesn't name come last, by name."""
        if self.chroms is None:
            return rows.orderBy("chrom", *by)
        order = self.chroms.select(F.col("name").alias("chrom"), F.col("tid").alias("_tid"))
        return rows.join(order, "chrom", "left").orderBy(F.col("_tid").asc_nulls_last(), "chrom", *by).drop("_tid")

    def region_stats(self) -> DataFrame:
        return stats.region_stats(self.segments, self.options.compat)

    def uncovered(self) -> DataFrame:
        return stats.uncovered(self.segments, self.options.uncover)

    def target_reads(self) -> DataFrame:
        return depth.overlapping(self.alignments, self.target)

    def metrics(self) -> DataFrame:
        """One row with every figure of the report.

        One sweep counts places, regions and reads by kind and value, and all shares, means and lengths come from those few rows.
        """
        o = self.options
        median = "cast(percentile(value, 0.5D, cnt) as bigint)"
        depths = depth.facts(self.alignments, self.target, self.flank_set, o.mapq, o.refskip).agg(
            *[c for name in ("tgt", "rmdup", "flk", "reg") for c in self._covered(name)], *[_sum("cnt", name).alias(f"{name}_len") for name in ("tgt", "flk")],
            *[F.coalesce(_sum("cnt", name), F.lit(0)).alias(name) for name in ("n_tgt", "n_flk")], F.collect_list(F.when(F.col("kind") == "tgt", F.struct("value", "cnt"))).alias("_h"),
        )
        parts = [
            reads.flagstat(self.alignments, o.mapq),
            reads.insert_hist(self.alignments, o.isize_limit).agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("isize_avg"), F.expr(median).alias("isize_median")),
            self.target.agg(F.count("*").alias("n_regions")),
            depths.withColumns(dict(self._ratios())).withColumnRenamed("reg_data", "reg_depth_sum").drop("_h"),
        ]
        rows = parts[0]
        for p in parts[1:]:  # one row each, side by side
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows.agg(*[F.max(f"`{c}`").alias(c) for c in rows.columns])

    def _covered(self, name: str) -> list[Column]:
        t = dict.fromkeys([1, *self.options.thresholds, *self.options.cutoffs])
        deep = lambda x: F.coalesce(_sum("cnt", name, F.col("value") >= x), F.lit(0))
        data = F.sum(F.when(F.col("kind") == name, F.col("value") * F.col("cnt")))
        return [
            F.coalesce(data, F.lit(0)).cast("bigint").alias(f"{name}_data"), deep(1).alias(f"{name}_covered"),
            *[F.try_divide(100.0 * deep(x), _sum("cnt", name)).alias(f"{name}_{x}x") for x in t],
        ]

    def _ratios(self) -> Iterator[tuple[str, Column]]:
        """Shares of the target above parts of its mean depth, from the few rows of its histogram."""
        at = lambda cond: F.expr(f"try_divide(100.0D * aggregate(filter(_h, x -> {cond}), 0L, (a, x) -> a + x.cnt), tgt_len)")
        mean = "try_divide(tgt_data, tgt_len)"
        for r in (0.2, 0.5):
            yield f"tgt_ge_{r:g}_avg", at(f"x.value >= floor({r}D * floor({mean}))")
        for r in self.options.ratios:
            yield f"tgt_gt_{r:g}_ratio", at(f"x.value > floor({r}D * {mean})")


def _sum(what: str, kind: str, cond: Column | None = None) -> Column:
    hit = F.col("kind") == kind
    return F.sum(F.when(hit if cond is None else hit & cond, F.col(what)))
