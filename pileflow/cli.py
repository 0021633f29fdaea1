"""Command line: ``depth`` and the interval tools ``merge``, ``uniq``, ``diff``, ``trim``, ``0to1``, ``1to0``, ``nruns``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pileflow.operators import intervals, nruns
from pileflow.plans import report
from pileflow.plans.coverage import Coverage
from pileflow.schema import Options
from pileflow.sources import bam, bed, fasta, sam


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pileflow", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=report.VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("depth", help="depth and coverage of targets")
    d.add_argument("files", nargs="+", help="SAM, BAM or Parquet")
    d.add_argument("-o", "--outdir", required=True)
    d.add_argument("-p", "--bed", required=True)
    d.add_argument("-f", "--flank", type=int, default=200)
    d.add_argument("-q", "--mapthres", type=int, default=20)
    d.add_argument("--cutoffdepth", default="", help="comma-separated depths")
    d.add_argument("--depthratio", default="0.2,0.5")
    d.add_argument("--isize", type=int, default=2000)
    d.add_argument("--uncover", type=int, default=5)
    d.add_argument("--bamout")
    d.add_argument("-1", dest="one_based", action="store_true")
    d.add_argument("--compat", action="store_true")
    d.add_argument("--refskip", choices=("stay", "advance"), default="stay", help="whether a CIGAR N moves the position")
    d.add_argument("--flank-exclude-target", action="store_true")
    d.add_argument("-T", "--reference", help="taken, but only CRAM needs it, which isn't read")
    d.add_argument("--threads", type=int, default=0, help="taken without effect: Spark's settings say how much runs at once")
    d.add_argument("--maxdepth", type=int, default=0, help="taken without effect")
    for name, about in (("merge", "union"), ("uniq", "intersection"), ("diff", "first minus the others"), ("trim", "cut ends"), ("0to1", "to 1-based starts"), ("1to0", "to 0-based starts")):
        t = sub.add_parser(name, help=about)
        t.add_argument("files", nargs="+")
        t.add_argument("-o", "--out", help="folder to write; else standard output")
        t.add_argument("-1", dest="one_based", action="store_true")
        if name in ("merge", "trim"):
            t.add_argument("--before", "--front", type=int, default=0, dest="front")
            t.add_argument("--after", "--end", type=int, default=0, dest="end")
        t.add_argument("--compat", action="store_true")
    n = sub.add_parser("nruns", help="runs of N in FASTA files")
    n.add_argument("files", nargs="+")
    n.add_argument("-o", "--out")
    return p


def load(spark: SparkSession, files: list[str], keep: bool = False):
    """Reads of all files as one table, the first header's chromosomes and its text (None without one). ``keep``: with whole records."""
    frames, chroms, text = [], None, None
    for f in files:
        if f.endswith(".bam"):
            frames.append(bam.read(spark, f, keep=keep))
            chroms, text = (chroms, text) if chroms is not None else (bam.header(spark, f), bam.header_text(f))
        elif ".parquet" in f:
            frames.append(spark.read.parquet(f))
        else:
            frames.append(sam.read(spark, f, keep=keep))
            chroms, text = (chroms, text) if chroms is not None else (sam.header(spark, f), sam.header_text(spark, f))
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out, chroms, text


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pileflow").getOrCreate()
    if a.command == "depth":
        cutoffs, ratios = (tuple(t(x) for x in given.split(",") if x) for t, given in ((int, a.cutoffdepth), (float, a.depthratio)))
        o = Options(a.flank, a.mapthres, a.isize, a.uncover, cutoffs, ratios, compat=a.compat, refskip=a.refskip, flank_exclude_target=a.flank_exclude_target)
        if a.threads < 0:
            raise ValueError("threads can't be negative")
        reads, chroms, text = load(spark, a.files, keep=bool(a.bamout))
        # the reader moves 1-based starts, and knows the rows that hold a single position, which are 1-based anyway
        run = Coverage(reads, bed.read(spark, a.bed, one_based=a.one_based, compat=a.compat), chroms, o)
        report.write(run, a.outdir, a.files)
        if a.bamout:
            if chroms is None:
                raise ValueError("--bamout needs a header")
            bam.write(run.target_reads(), chroms, a.bamout, text)
        return 0
    if a.command == "nruns":
        out = nruns.n_runs(fasta.read(spark, *a.files)).withColumnRenamed("name", "chrom")
    else:
        sets = [bed.read(spark, f, one_based=a.one_based, compat=a.compat) for f in a.files]
        out = {
            "merge": lambda: intervals.merge(intervals.extend(intervals.union(*sets), a.front, a.end, compat=a.compat)),
            "uniq": lambda: intervals.intersect(*sets),
            "diff": lambda: intervals.subtract(*sets, compat=a.compat),
            "trim": lambda: intervals.trim(intervals.union(*sets), a.front, a.end),
            "0to1": lambda: intervals.to_one_based(intervals.union(*sets)),
            "1to0": lambda: intervals.to_zero_based(intervals.union(*sets)),
        }[a.command]()
    if a.out:
        bed.write(out, a.out)
    else:
        for r in out.orderBy("chrom", "start", "stop").toLocalIterator():
            print(r.chrom, r.start, r.stop, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
