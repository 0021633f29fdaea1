"""Report files of a run, written beside the driver: aggregates and streamed rows, never a gathered table."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from pileflow.functions.formats import fixed, percent
from pileflow.operators import stats
from pileflow.plans.coverage import Coverage
from pileflow.schema import Options
from pileflow.sources import bed, bgzf

VERSION = "0.2.0"


def tree(m: dict, run: Coverage, files: list[str]) -> dict:
    """The nested figures of coverage.report.json from the row of metrics."""
    o = run.options
    reads, mapped, data, mdata = m["n_reads"], m["n_mapped"], m["n_data"], m["n_mdata"]
    each = lambda name: {f"gte_{t}x": m[f"{name}_{t}x"] for t in o.thresholds}
    custom = lambda name: {f"gte_{t}x": m[f"{name}_{t}x"] for t in o.cutoffs}
    per = lambda x, n: x / n if n else None
    return {
        "version": VERSION, "files": files,
        "total": {
            "raw_reads": reads, "qc_fail_reads": m["n_qcfail"], "raw_data_mb": data / 1e6, "paired_reads": m["n_pair_all"],
            "mapped_reads": mapped, "mapped_reads_fraction": percent(mapped, reads), "mapped_data_mb": mdata / 1e6, "mapped_data_fraction": percent(mdata, data),
            "properly_paired": m["n_pair_good"], "properly_paired_fraction": percent(m["n_pair_good"], reads), "read_mate_paired": m["n_pair_map"], "read_mate_paired_fraction": percent(m["n_pair_map"], reads),
            "singletons": m["n_sgltn"], "diff_chr": m["n_diffchr"], "read1": m["n_read1"], "read2": m["n_read2"], "read1_rmdup": m["n_rmdup1"], "read2_rmdup": m["n_rmdup2"],
            "forward_strand": m["n_pstrand"], "backward_strand": m["n_mstrand"], "pcr_duplicates": m["n_dup"], "pcr_duplicates_fraction": percent(m["n_dup"], mapped),
            "mapq_cutoff": o.mapq, "mapq_reads": m["n_qual"], "mapq_reads_fraction_all": percent(m["n_qual"], reads), "mapq_reads_fraction_mapped": percent(m["n_qual"], mapped),
        },
        "insert_size": {"average": m["isize_avg"], "median": m["isize_median"]},
        "target": {
            "target_reads": m["n_tgt"], "target_reads_fraction_all": percent(m["n_tgt"], reads), "target_reads_fraction_mapped": percent(m["n_tgt"], mapped),
            "target_data_mb": m["tgt_data"] / 1e6, "target_data_rmdup_mb": m["rmdup_data"] / 1e6, "target_data_fraction_all": percent(m["tgt_data"], data), "target_data_fraction_mapped": percent(m["tgt_data"], mdata),
            "region_length": m["tgt_len"], "average_depth": per(m["tgt_data"], m["tgt_len"]), "average_depth_rmdup": per(m["rmdup_data"], m["tgt_len"]),
            "coverage": {"gt_0x": m["tgt_1x"], **each("tgt"), "gt_0_2_avg": m["tgt_ge_0.2_avg"], "gt_0_5_avg": m["tgt_ge_0.5_avg"], "custom": custom("tgt"), "ratio_based": {f"gt_{r:g}_avg": m[f"tgt_gt_{r:g}_ratio"] for r in o.ratios}},
            "coverage_rmdup": {"gt_0x": m["rmdup_1x"], **each("rmdup"), "custom": custom("rmdup")},
            "region_count": m["n_regions"], "region_coverage": {"gt_0x_count": m["reg_covered"], "gt_0x_fraction": m["reg_1x"], **{f"{k}_fraction": v for k, v in each("reg").items()}},
        },
        "flank": {
            "flank_size": o.flank, "region_length": m["flk_len"], "average_depth": per(m["flk_data"], m["flk_len"]), "flank_reads": m["n_flk"],
            "flank_reads_fraction_all": percent(m["n_flk"], reads), "flank_reads_fraction_mapped": percent(m["n_flk"], mapped),
            "flank_data_mb": m["flk_data"] / 1e6, "flank_data_fraction_all": percent(m["flk_data"], data), "flank_data_fraction_mapped": percent(m["flk_data"], mdata), "coverage": {"gt_0x": m["flk_1x"], **each("flk")},
        },
    }


def write(run: Coverage, outdir: str, files: list[str] = ()) -> dict:
    """All eight report files; returns the tree of figures."""
    os.makedirs(outdir, exist_ok=True)
    at = lambda name: os.path.join(outdir, name)
    run.persist()
    m = run.metrics().first().asDict()
    figures, o = tree(m, run, list(files)), run.options
    depths = run.in_order(run.segments, "s").select(F.explode(F.sequence("s", "e")).alias("pos"), "chrom", "raw", "rmdup", "cover")
    bgzf.write_lines(depths.select(F.concat_ws("\t", "chrom", "pos", "raw", "rmdup", "cover").alias("line")), at("depth.tsv.gz"), "#Chr\tPos\tRaw Depth\tRmdup depth\tCover depth\n")
    with bgzf.Writer(at("region.tsv.gz")) as f:
        f.write("#Chr\tStart\tStop\tAvg depth\tMedian\tCoverage\tCoverage(FIX)\n")
        for r in run.in_order(run.region_stats(), "start").toLocalIterator():
            f.write(f"{r.chrom}\t{r.start}\t{r.stop}\t{fixed(r.avg)}\t{fixed(r.median, 1)}\t{fixed(r.coverage)}\t{fixed(r.coverage_fix)}\n")
    bed.write_file(run.in_order(run.uncovered(), "start"), at("uncover.bed"), ordered=True)
    from pileflow.operators.reads import insert_hist

    for name, hist in (("depth_distribution.plot", stats.depth_hist(run.segments)), ("insertsize.plot", insert_hist(run.alignments, o.isize_limit))):
        with open(at(name), "w") as f:
            f.writelines(f"{r.value}\t{r.cnt}\t{r.frac:f}\t{r.cnt_gt}\t{r.frac_gt:f}\n" for r in stats.cumulative(hist).orderBy("value").toLocalIterator())
    deep = [*dict.fromkeys([*o.thresholds, *o.cutoffs])]
    with open(at("chromosomes.report"), "w") as f:
        f.write("\t".join(["#Chromosome", "DATA(%)", "Avg depth", "Median", "Coverage%", *[f"Cov {t}x %" for t in deep]]) + "\n")
        for r in run.in_order(stats.chrom_report(stats.chrom_hist(run.segments), o.thresholds, o.cutoffs)).toLocalIterator():
            f.write("\t".join([r.chrom, fixed(r.data_percent), fixed(r.avg), fixed(r.median, 1), fixed(r.coverage), *[fixed(r[f"cov_{t}x"]) for t in deep]]) + "\n")
    with open(at("coverage.report.json"), "w") as f:
        json.dump(figures, f, indent=2)
    with open(at("coverage.report"), "w") as f:
        f.write("## The file was created by pileflow\n" + f"## Version : {VERSION}\n## Files : " + "".join(f"{x} " for x in files) + "\n")
        f.writelines(lines(figures, m, o))
    run.close()
    return figures


# The labels of coverage.report in their order, where each figure stands in the tree, and its form. A line with {} is
# repeated for each custom cutoff (or ratio).
LABELS = [
    ("[Total] Raw Reads (All reads)", "total/raw_reads", "%d"),
    ("[Total] QC Fail reads", "total/qc_fail_reads", "%d"),
    ("[Total] Raw Data(Mb)", "total/raw_data_mb", "%.2f"),
    ("[Total] Paired Reads", "total/paired_reads", "%d"),
    ("[Total] Mapped Reads", "total/mapped_reads", "%d"),
    ("[Total] Fraction of Mapped Reads", "total/mapped_reads_fraction", "%.2f%%"),
    ("[Total] Mapped Data(Mb)", "total/mapped_data_mb", "%.2f"),
    ("[Total] Fraction of Mapped Data(Mb)", "total/mapped_data_fraction", "%.2f%%"),
    ("[Total] Properly paired", "total/properly_paired", "%d"),
    ("[Total] Fraction of Properly paired", "total/properly_paired_fraction", "%.2f%%"),
    ("[Total] Read and mate paired", "total/read_mate_paired", "%d"),
    ("[Total] Fraction of Read and mate paired", "total/read_mate_paired_fraction", "%.2f%%"),
    ("[Total] Singletons", "total/singletons", "%d"),
    ("[Total] Read and mate map to diff chr", "total/diff_chr", "%d"),
    ("[Total] Read1", "total/read1", "%d"),
    ("[Total] Read2", "total/read2", "%d"),
    ("[Total] Read1(rmdup)", "total/read1_rmdup", "%d"),
    ("[Total] Read2(rmdup)", "total/read2_rmdup", "%d"),
    ("[Total] forward strand reads", "total/forward_strand", "%d"),
    ("[Total] backward strand reads", "total/backward_strand", "%d"),
    ("[Total] PCR duplicate reads", "total/pcr_duplicates", "%d"),
    ("[Total] Fraction of PCR duplicate reads", "total/pcr_duplicates_fraction", "%.2f%%"),
    ("[Total] Map quality cutoff value", "total/mapq_cutoff", "%d"),
    ("[Total] MapQuality above cutoff reads", "total/mapq_reads", "%d"),
    ("[Total] Fraction of MapQ reads in all reads", "total/mapq_reads_fraction_all", "%.2f%%"),
    ("[Total] Fraction of MapQ reads in mapped reads", "total/mapq_reads_fraction_mapped", "%.2f%%"),
    ("[Insert size] Average", "insert_size/average", "%.2f"),
    ("[Insert size] Median", "insert_size/median", "%.0d"),
    ("[Target] Target Reads", "target/target_reads", "%d"),
    ("[Target] Fraction of Target Reads in all reads", "target/target_reads_fraction_all", "%.2f%%"),
    ("[Target] Fraction of Target Reads in mapped reads", "target/target_reads_fraction_mapped", "%.2f%%"),
    ("[Target] Target Data(Mb)", "target/target_data_mb", "%.2f"),
    ("[Target] Target Data Rmdup(Mb)", "target/target_data_rmdup_mb", "%.2f"),
    ("[Target] Fraction of Target Data in all data", "target/target_data_fraction_all", "%.2f%%"),
    ("[Target] Fraction of Target Data in mapped data", "target/target_data_fraction_mapped", "%.2f%%"),
    ("[Target] Len of region", "target/region_length", "%d"),
    ("[Target] Average depth", "target/average_depth", "%.2f"),
    ("[Target] Average depth(rmdup)", "target/average_depth_rmdup", "%.2f"),
    ("[Target] Coverage (>0.2*(Average depth)x)", "target/coverage/gt_0_2_avg", "%.2f%%"),
    ("[Target] Coverage (>0.5*(Average depth)x)", "target/coverage/gt_0_5_avg", "%.2f%%"),
    ("[Target] Coverage (>0x)", "target/coverage/gt_0x", "%.2f%%"),
    ("[Target] Coverage (>=4x)", "target/coverage/gte_4x", "%.2f%%"),
    ("[Target] Coverage (>=10x)", "target/coverage/gte_10x", "%.2f%%"),
    ("[Target] Coverage (>=30x)", "target/coverage/gte_30x", "%.2f%%"),
    ("[Target] Coverage (>=100x)", "target/coverage/gte_100x", "%.2f%%"),
    ("[Target] Coverage (>={}x)", "cutoffs/tgt", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>0x)", "target/coverage_rmdup/gt_0x", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>=4x)", "target/coverage_rmdup/gte_4x", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>=10x)", "target/coverage_rmdup/gte_10x", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>=30x)", "target/coverage_rmdup/gte_30x", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>=100x)", "target/coverage_rmdup/gte_100x", "%.2f%%"),
    ("[Target] Coverage(rmdup) (>={}x)", "cutoffs/rmdup", "%.2f%%"),
    ("[Target] Coverage (>{:.1f}*Avg)", "ratios", "%.2f%%"),
    ("[Target] Target Region Count", "target/region_count", "%d"),
    ("[Target] Region covered > 0x", "target/region_coverage/gt_0x_count", "%d"),
    ("[Target] Fraction Region covered > 0x", "target/region_coverage/gt_0x_fraction", "%.2f%%"),
    ("[Target] Fraction Region covered >= 4x", "target/region_coverage/gte_4x_fraction", "%.2f%%"),
    ("[Target] Fraction Region covered >= 10x", "target/region_coverage/gte_10x_fraction", "%.2f%%"),
    ("[Target] Fraction Region covered >= 30x", "target/region_coverage/gte_30x_fraction", "%.2f%%"),
    ("[Target] Fraction Region covered >= 100x", "target/region_coverage/gte_100x_fraction", "%.2f%%"),
    ("[Target] Fraction Region covered (>={}x)", "cutoffs/reg", "%.2f%%"),
    ("[flank] flank size", "flank/flank_size", "%d"),
    ("[flank] Len of region (not include target region)", "flank/region_length", "%d"),
    ("[flank] Average depth", "flank/average_depth", "%.2f"),
    ("[flank] flank Reads", "flank/flank_reads", "%d"),
    ("[flank] Fraction of flank Reads in all reads", "flank/flank_reads_fraction_all", "%.2f%%"),
    ("[flank] Fraction of flank Reads in mapped reads", "flank/flank_reads_fraction_mapped", "%.2f%%"),
    ("[flank] flank Data(Mb)", "flank/flank_data_mb", "%.2f"),
    ("[flank] Fraction of flank Data in all data", "flank/flank_data_fraction_all", "%.2f%%"),
    ("[flank] Fraction of flank Data in mapped data", "flank/flank_data_fraction_mapped", "%.2f%%"),
    ("[flank] Coverage (>0x)", "flank/coverage/gt_0x", "%.2f%%"),
    ("[flank] Coverage (>=4x)", "flank/coverage/gte_4x", "%.2f%%"),
    ("[flank] Coverage (>=10x)", "flank/coverage/gte_10x", "%.2f%%"),
    ("[flank] Coverage (>=30x)", "flank/coverage/gte_30x", "%.2f%%"),
    ("[flank] Coverage (>=100x)", "flank/coverage/gte_100x", "%.2f%%"),
    ("[flank] Coverage (>={}x)", "cutoffs/flk", "%.2f%%"),
]


def _shown(value: float | None, form: str) -> str:
    """C's printf: nothing divided by nothing is nan, and a precision of no digits shows no 0."""
    if form.endswith("d"):
        return "" if form == "%.0d" and not value else str(int(value or 0))
    return form % (float("nan") if value is None else value)


def lines(figures: dict, m: dict, o: Options) -> list[str]:
    """The lines of coverage.report below its head."""
    out = []
    for label, path, form in LABELS:
        first, *rest = path.split("/")
        if first == "cutoffs":
            out += [(label.format(t), m[f"{rest[0]}_{t}x"], form) for t in o.cutoffs]
        elif first == "ratios":
            out += [(label.format(r), m[f"tgt_gt_{r:g}_ratio"], form) for r in o.ratios]
        else:
            at = figures[first]
            for k in rest:
                at = at.get(k) if at is not None else None
            out.append((label, at, form))
    return [f"{label:>60}\t{_shown(value, form)}\n" for label, value, form in out]


def tidy(run: Coverage):
    """The row of metrics as (metric, value)."""
    m = run.metrics()
    return m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in m.columns])))
