"""Hand-checked cases: the micro fixture, the quirks, files and the command line."""

import collections
import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pileflow import cli
from pileflow.functions.formats import fixed
from pileflow.operators import depth, intervals, nruns, reads, stats
from pileflow.plans import report
from pileflow.plans.coverage import Coverage
from pileflow.schema import CHROMS, READS, REGIONS, Options
from pileflow.sources import bam, bed, bgzf, fasta, sam
from pileflow.streaming import counters

BED = [("chr1", 10, 20), ("chr1", 20, 30), ("chr1", 100, 110), ("chr2", 50, 60), ("chr3", 5, 6)]
ROWS = [
    ("chr1", 5, 99, 60, 10, "chr1", 0, "10M"), ("chr1", 12, 1123, 60, 10, "chr1", 0, "5M2D5M"), ("chr1", 100, 0, 10, 15, "*", 0, "5S10M"),
    ("chr1", 100, 256, 60, 10, "*", 0, "10M"), ("*", -1, 4, 0, 20, "*", 0, "*"),
]


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame(ROWS, READS), spark.createDataFrame(BED, REGIONS), spark.createDataFrame([(0, "chr1", 1000), (1, "chr2", 500), (2, "chr3", 300)], CHROMS)


def as_set(df):
    return {tuple(r) for r in df.select("chrom", "start", "stop").collect()}


def test_micro_case(micro):
    r, b, c = micro
    target = intervals.merge(b)
    assert as_set(target) == {("chr1", 10, 30), ("chr1", 100, 110), ("chr2", 50, 60), ("chr3", 5, 6)}
    segs = depth.segments(r, target)
    assert {x.value: x.cnt for x in stats.depth_hist(segs).collect()} == {0: 17, 1: 21, 2: 3}
    assert {x.value: x.cnt for x in stats.depth_hist(segs, "rmdup").collect()} == {0: 36, 1: 5}
    got = {(x.chrom, x.start): (x.avg, x.median, x.coverage, x.coverage_fix) for x in stats.region_stats(segs).collect()}
    assert got["chr1", 10] == (0.75, 1.0, 60.0, 70.0) and got["chr1", 100] == (1.0, 1.0, 100.0, 100.0) and got["chr3", 5][0] == 0
    f = reads.flagstat(r).first()
    assert (f.n_reads, f.n_mapped, f.n_dup, f.n_qual, f.n_data, f.n_mdata) == (4, 3, 1, 2, 55, 35)
    assert (f.n_pair_all, f.n_pair_good, f.n_read1, f.n_rmdup1) == (2, 2, 2, 1)
    assert depth.overlapping(r, target).count() == 3
    assert as_set(stats.uncovered(segs)) == as_set(target)
    assert intervals.summary(intervals.merge(intervals.extend(target, 200, 200, c))).first().bases == 776
    assert intervals.summary(intervals.merge(intervals.extend(target, 200, 200, c, compat=True))).first().bases == 773
    assert depth.segments(r.limit(0), target).count() > 0 and depth.segments(r, target.limit(0)).count() == 0


def test_bins_change_nothing(micro):
    r, b, _ = micro
    whole = {tuple(x) for x in depth.positions(depth.segments(r, intervals.merge(b))).collect()}
    assert whole == {tuple(x) for x in depth.positions(depth.segments(r, intervals.merge(b), bins=7)).collect()}
    assert depth.overlapping(r, intervals.merge(b), bins=4).count() == 3


def test_skips(spark):
    r = spark.createDataFrame([("chr1", 0, 0, 60, 10, "*", 0, "5M10N5M")], READS)
    b = spark.createDataFrame([("chr1", 0, 30)], REGIONS)
    at = lambda how: [x.pos for x in depth.positions(depth.segments(r, b, refskip=how)).where("raw > 0").orderBy("pos").collect()]
    assert at("stay") == list(range(1, 11)) and at("advance") == [*range(1, 6), *range(16, 21)]


def test_interval_laws(spark):
    a = spark.createDataFrame([("c", 0, 10), ("c", 8, 20), ("c", 40, 50), ("d", 1, 5)], REGIONS)
    b = spark.createDataFrame([("c", 5, 12), ("c", 45, 60)], REGIONS)
    assert as_set(intervals.intersect(a, b)) == {("c", 5, 12), ("c", 45, 50)}
    assert as_set(intervals.subtract(a, b)) == {("c", 0, 5), ("c", 12, 20), ("c", 40, 45), ("d", 1, 5)}
    assert ("c", 40, 45) not in as_set(intervals.subtract(a, b, compat=True))
    assert as_set(intervals.merge(intervals.merge(a))) == as_set(intervals.merge(a))
    assert as_set(intervals.trim(a, 3, 4)) == {("c", 3, 16), ("c", 43, 46), ("d", 1, 5)}
    with pytest.raises(Exception, match="start passes stop"):
        intervals.to_one_based(spark.createDataFrame([("c", 5, 5)], REGIONS)).collect()
    with pytest.raises(Exception, match="past the end"):
        intervals.check_bounds(a, spark.createDataFrame([(0, "c", 30)], CHROMS)).collect()


def test_medians(spark):
    h = lambda rows: spark.createDataFrame(rows, "value long, cnt long")
    assert stats.hist_median(h([(1, 1), (3, 1), (5, 1)])).first()[0] == 3 and stats.hist_median(h([(7, 1)]), compat=True).first()[0] == 0


def test_bed_lines(spark, tmp_path):
    text = "track x\n#c 1 2\nchr1\t0\t5\tname more\nchr1 9 7\nchr2 12\nchr2 x 5\n\n"
    with gzip.open(tmp_path / "a.bed.gz", "wt") as f:
        f.write(text)
    assert as_set(bed.read(spark, str(tmp_path / "a.bed.gz"))) == {("chr1", 0, 5), ("chr1", 7, 9), ("chr2", 11, 12)}
    assert ("chr1", 1, 5) in as_set(bed.read(spark, str(tmp_path / "a.bed.gz"), compat=True))


def test_files_and_command_line(spark, micro, tmp_path, capsys):
    r, _, c = micro
    p = str(tmp_path / "x.bam")
    bam.write(r, c, p)
    assert sorted(map(tuple, bam.read(spark, p).collect())) == sorted(ROWS)
    assert bam.header(spark, p).collect() == c.collect()
    (tmp_path / "x.sam").write_text("@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n@SQ\tSN:chr3\tLN:300\n" + "".join(f"q\t{f}\t{n}\t{p + 1}\t{q}\t{g}\t=\t0\t{i}\t{'N' * size}\t*\n" for n, p, f, q, size, _, i, g in ROWS))
    (tmp_path / "t.bed").write_text("".join(f"{a}\t{b}\t{z}\n" for a, b, z in BED))
    assert sam.header(spark, str(tmp_path / "x.sam")).count() == 3
    for name in ("x.bam", "x.sam"):
        out = tmp_path / f"out-{name}"
        assert cli.main(["depth", str(tmp_path / name), "-p", str(tmp_path / "t.bed"), "-o", str(out), "--bamout", str(tmp_path / "kept.bam")], spark) == 0
        figures = json.loads((out / "coverage.report.json").read_text())
        assert figures["total"]["raw_reads"] == 4 and figures["target"]["target_reads"] == 3 and figures["target"]["region_length"] == 41
        with gzip.open(out / "depth.tsv.gz", "rt") as f:
            assert sum(1 for _ in f) == 42
        assert {x.name for x in out.iterdir()} >= {"region.tsv.gz", "uncover.bed", "depth_distribution.plot", "insertsize.plot", "chromosomes.report", "coverage.report"}
        assert bam.read(spark, str(tmp_path / "kept.bam")).count() == 3
    capsys.readouterr()
    assert cli.main(["merge", str(tmp_path / "t.bed")], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == "chr1\t10\t30"
    with pytest.raises(ValueError, match="CRAM"):
        sam.read(spark, "a.cram")


def test_bgzf_blocks(tmp_path):
    with bgzf.Writer(str(tmp_path / "a.gz")) as f:
        f.write("abc\n" * 50_000)
    with open(tmp_path / "a.gz", "rb") as f:
        assert b"".join(d for _, d in bgzf.blocks(f)) == b"abc\n" * 50_000
    assert gzip.open(tmp_path / "a.gz").read() == b"abc\n" * 50_000


def test_n_runs(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACNN\nNTn\n>two\nNNA\nNN\n")
    s = fasta.read(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, nruns.n_runs(s).collect())) == [("one x", 2, 5), ("two", 0, 2), ("two", 3, 5)]
    assert nruns.n_runs(s, compat=True).count() == 2


def test_fasta_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 a>b len\nAC>NN\nN\n>chr2\r\nNNA\r\n>empty\n")
    got = sorted(map(tuple, fasta.read(spark, str(tmp_path / "a.fa")).collect()))
    assert got == [("chr1 a>b len", "AC>NNN"), ("chr2", "NNA"), ("empty", "")]


def run_stream(spark, made, mode, name):
    q = made.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, micro, tmp_path):
    micro[0].write.parquet(str(tmp_path / "in"))
    got = run_stream(spark, counters.classes(counters.read(spark, str(tmp_path / "in"))), "complete", "classes")
    assert {r[0]: r[1] for r in got} == {1: 2, 2: 1, -3: 1}
    rows = [("c1", 11, 0, 60, 10, "*", 0, "10M"), ("c1", 12, 0, 60, 8, "*", 0, "2M4D2M"), ("c1", 100, 0, 60, 4, "*", 0, "4M"), ("c2", 3, 0, 60, 2, "*", 0, "2M"), ("c2", 500, 0, 60, 2, "*", 0, "2M")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], READS).coalesce(1).write.parquet(str(tmp_path / f"s/{i}"))
    # one file a batch, in order: c2 begins after c1 has passed the watermark, and isn't late
    stream = counters.read(spark, str(tmp_path / "s/*"), maxFilesPerTrigger="1")
    got = {(r.chrom, r.bin): (r.raw, r.rmdup, r.cover) for r in run_stream(spark, counters.bin_depth(stream, ["c1", "c2"], 1, bins=16), "append", "bins")}
    # 1-based blocks 12-21, 13-14, 15-18, 19-20 over the border between 16 and 17
    assert got["c1", 0] == (5 + 2, 5 + 2, 5 + 2 + 2) and got["c1", 1] == (5 + 2, 5 + 2, 5 + 2 + 2) and got["c1", 6] == (4, 4, 4)
    late = run_stream(spark, counters.disorder(counters.read(spark, str(tmp_path / "s/*"), maxFilesPerTrigger="1")), "update", "late")
    assert sum(r.late for r in late) == 0 and max(r.reached for r in late if r.chrom == "c1") == 100


def test_single_positions_with_one_based_starts(spark, tmp_path):
    (tmp_path / "t.bed").write_text("chr1 12\nchr1 1\nchr1 31 40\n")
    (tmp_path / "x.sam").write_text("@SQ\tSN:chr1\tLN:1000\nq\t0\tchr1\t6\t60\t10M\t*\t0\t0\t*\t*\n")
    assert cli.main(["depth", str(tmp_path / "x.sam"), "-p", str(tmp_path / "t.bed"), "-o", str(tmp_path / "o"), "-1", "--threads", "2", "-T", "none.fa", "--maxdepth", "5"], spark) == 0
    with gzip.open(tmp_path / "o" / "region.tsv.gz", "rt") as f:
        assert [tuple(x.split("\t")[:3]) for x in f][1:] == [("chr1", "0", "1"), ("chr1", "11", "12"), ("chr1", "30", "40")]


def test_bam_pieces_and_long_cigars(spark, tmp_path):
    chroms = spark.createDataFrame([(0, "chr1", 100_000_000), (1, "chr2", 500)], CHROMS)
    many = "1M1I" * 40_000
    rows = [("chr1", i * 7, 0, 60, 90, "*", 0, "90M") for i in range(12_000)] + [("chr2", 5, 0, 60, 80_000, "chr1", 3, many)]
    reads_ = spark.createDataFrame(rows, READS)
    p = str(tmp_path / "x.bam")
    bam.write(reads_, chroms, p)
    whole = sorted(map(tuple, bam.read(spark, p).collect()))
    assert whole == sorted(rows)
    pieces = bam.read(spark, p, piece=4_000)
    assert pieces.rdd.getNumPartitions() > 5 and sorted(map(tuple, pieces.collect())) == whole
    blocks = depth.read_blocks(pieces.where("rname = 'chr2'"))
    assert blocks.count() == 40_000 and blocks.agg({"e": "max"}).first()[0] == 40_005


def test_exported_records_keep_everything(spark, tmp_path):
    lines = [
        "r1\t99\tchr2\t11\t60\t4M1I5M\t=\t101\t95\tACGTNACGTA\tIIIIIHHHHH\tNM:i:1\tRG:Z:grp\tXA:A:x\tXF:f:0.5\tXB:B:s,1,-2,3\tXH:H:1AFF",
        "r0\t16\tchr1\t5\t37\t3S7M\tchr2\t9\t-20\tACGTTACGTA\t*", "r9\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII",
    ]
    text = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr2\tLN:500\n@SQ\tSN:chr1\tLN:300\n@RG\tID:grp\n"
    (tmp_path / "x.sam").write_text(text + "\n".join(lines) + "\n")
    (tmp_path / "t.bed").write_text("chr1\t0\t300\nchr2\t0\t500\n")
    one, two = str(tmp_path / "one.bam"), str(tmp_path / "two.bam")
    assert cli.main(["depth", str(tmp_path / "x.sam"), "-p", str(tmp_path / "t.bed"), "-o", str(tmp_path / "o"), "--bamout", one], spark) == 0
    assert cli.main(["depth", one, "-p", str(tmp_path / "t.bed"), "-o", str(tmp_path / "o2"), "--bamout", two], spark) == 0
    assert bam.header_text(one) == bam.header_text(two) == text
    kept = [list(bam.records(p, keep=True)) for p in (one, two)]
    assert kept[0] == kept[1] and [r[:4] for r in kept[0]] == [("chr2", 10, 99, 60), ("chr1", 4, 16, 37)]
    first = kept[0][0][8]
    assert b"r1\0" in first and b"NMi\x01\0\0\0" in first and b"RGZgrp\0" in first and b"XBBs\x03\0\0\0\x01\0\xfe\xff\x03\0" in first and bytes([40, 40, 40, 40, 40, 39]) in first
    assert bytes([0x12, 0x48, 0xF1, 0x24, 0x81]) in first  # bases by their numbers
    # the header's order, in which chr2 comes before chr1
    with gzip.open(tmp_path / "o" / "region.tsv.gz", "rt") as f:
        assert [x.split("\t")[0] for x in f][1:] == ["chr2", "chr1"]
    assert [x.split("\t")[0] for x in (tmp_path / "o" / "chromosomes.report").read_text().splitlines()][1:] == ["chr2", "chr1"]
    assert [x.split("\t")[0] for x in (tmp_path / "o" / "uncover.bed").read_text().splitlines()][0] == "chr2"


GOLDEN = """\
[Total] Raw Reads (All reads)\t4
[Total] QC Fail reads\t0
[Total] Raw Data(Mb)\t0.00
[Total] Paired Reads\t2
[Total] Mapped Reads\t3
[Total] Fraction of Mapped Reads\t75.00%
[Total] Mapped Data(Mb)\t0.00
[Total] Fraction of Mapped Data(Mb)\t63.64%
[Total] Properly paired\t2
[Total] Fraction of Properly paired\t50.00%
[Total] Read and mate paired\t2
[Total] Fraction of Read and mate paired\t50.00%
[Total] Singletons\t0
[Total] Read and mate map to diff chr\t0
[Total] Read1\t2
[Total] Read2\t0
[Total] Read1(rmdup)\t1
[Total] Read2(rmdup)\t0
[Total] forward strand reads\t3
[Total] backward strand reads\t0
[Total] PCR duplicate reads\t1
[Total] Fraction of PCR duplicate reads\t33.33%
[Total] Map quality cutoff value\t20
[Total] MapQuality above cutoff reads\t2
[Total] Fraction of MapQ reads in all reads\t50.00%
[Total] Fraction of MapQ reads in mapped reads\t66.67%
[Insert size] Average\tnan
[Insert size] Median\t
[Target] Target Reads\t3
[Target] Fraction of Target Reads in all reads\t75.00%
[Target] Fraction of Target Reads in mapped reads\t100.00%
[Target] Target Data(Mb)\t0.00
[Target] Target Data Rmdup(Mb)\t0.00
[Target] Fraction of Target Data in all data\t49.09%
[Target] Fraction of Target Data in mapped data\t77.14%
[Target] Len of region\t41
[Target] Average depth\t0.66
[Target] Average depth(rmdup)\t0.12
[Target] Coverage (>0.2*(Average depth)x)\t100.00%
[Target] Coverage (>0.5*(Average depth)x)\t100.00%
[Target] Coverage (>0x)\t58.54%
[Target] Coverage (>=4x)\t0.00%
[Target] Coverage (>=10x)\t0.00%
[Target] Coverage (>=30x)\t0.00%
[Target] Coverage (>=100x)\t0.00%
[Target] Coverage (>=2x)\t7.32%
[Target] Coverage(rmdup) (>0x)\t12.20%
[Target] Coverage(rmdup) (>=4x)\t0.00%
[Target] Coverage(rmdup) (>=10x)\t0.00%
[Target] Coverage(rmdup) (>=30x)\t0.00%
[Target] Coverage(rmdup) (>=100x)\t0.00%
[Target] Coverage(rmdup) (>=2x)\t0.00%
[Target] Coverage (>0.2*Avg)\t58.54%
[Target] Coverage (>0.5*Avg)\t58.54%
[Target] Target Region Count\t4
[Target] Region covered > 0x\t1
[Target] Fraction Region covered > 0x\t25.00%
[Target] Fraction Region covered >= 4x\t0.00%
[Target] Fraction Region covered >= 10x\t0.00%
[Target] Fraction Region covered >= 30x\t0.00%
[Target] Fraction Region covered >= 100x\t0.00%
[Target] Fraction Region covered (>=2x)\t0.00%
[flank] flank size\t200
[flank] Len of region (not include target region)\t776
[flank] Average depth\t0.04
[flank] flank Reads\t3
[flank] Fraction of flank Reads in all reads\t75.00%
[flank] Fraction of flank Reads in mapped reads\t100.00%
[flank] flank Data(Mb)\t0.00
[flank] Fraction of flank Data in all data\t54.55%
[flank] Fraction of flank Data in mapped data\t85.71%
[flank] Coverage (>0x)\t3.48%
[flank] Coverage (>=4x)\t0.00%
[flank] Coverage (>=10x)\t0.00%
[flank] Coverage (>=30x)\t0.00%
[flank] Coverage (>=100x)\t0.00%
[flank] Coverage (>=2x)\t0.39%
"""


def test_text_report_line_by_line(spark, micro, tmp_path):
    r, b, c = micro
    report.write(Coverage(r, b, c, Options(cutoffs=(2,))), str(tmp_path), ["a.bam"])
    head, body = (tmp_path / "coverage.report").read_text().split("a.bam \n")
    assert head.endswith("## Files : ") and [x.strip() for x in body.splitlines()] == [x.strip() for x in GOLDEN.splitlines()]
    assert all(x.index("\t") == 60 or len(x.split("\t")[0]) > 60 for x in body.splitlines())


def test_options_and_formats():
    with pytest.raises(ValueError):
        Options(uncover=0)
    with pytest.raises(ValueError):
        Options(ratios=(1.5,))
    assert (fixed(1.005), fixed(0.125), fixed(12.345), fixed(None)) == ("1.00", "0.12", "12.35", "NA")


def test_one_based(micro):
    r, b, c = micro
    assert ("chr1", 9, 30) in as_set(Coverage(r, b, c, Options(one_based=True)).target)


def test_merge_over_borders_of_bins(spark):
    rows = [("c", 0, 8), ("c", 8, 16), ("c", 16, 30), ("c", 33, 33), ("c", 40, 41), ("c", 48, 48), ("c", 47, 48), ("c", 64, 64), ("d", 5, 70), ("d", 7, 9), ("d", -1, 3), ("d", 80, 96), ("d", 97, 99)]
    r = spark.createDataFrame(rows, REGIONS)
    want = {("c", 0, 30), ("c", 33, 33), ("c", 40, 41), ("c", 47, 48), ("c", 64, 64), ("d", -1, 3), ("d", 5, 70), ("d", 80, 96), ("d", 97, 99)}
    assert all(as_set(intervals.merge(r, bins)) == want and intervals.merge(r, bins).count() == len(want) for bins in (1, 4, 16, 1 << 14))


def written(spark, run):
    """What run() gives, and how many records it wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """40,000 reads over three bins with regions on both sides of borders, some reads in many copies, some over several bins; the depths by position."""
    rng = random.Random(5)
    shapes = ["50M", "10M2D40M", "5S15M3I20M", "12=40N18X", "1M", "*", "20M30000D5M", "9M"]
    rows = [("c1", rng.randrange(40_000), rng.choice([0, 16, 1024, 512, 256, 4]), rng.randrange(61), 50, "*", 0, rng.choices(shapes, [30, 20, 20, 10, 5, 1, 0.02, 10])[0]) for _ in range(20_000)]
    rows += [("c1", 16_370, 0, 60, 20, "*", 0, "20M")] * 20_000
    regions = [("c1", 0, 5), ("c1", 100, 900), ("c1", 16_000, 16_384), ("c1", 16_384, 16_500), ("c1", 32_768, 32_769), ("c1", 70_000, 70_050), ("c2", 10, 20)]
    depths = collections.defaultdict(lambda: [0, 0, 0])
    hulls = []
    for _, pos, flag, mapq, _, _, _, cigar in rows:
        if flag & 256 or flag == 4:
            continue
        at, far = pos + 1, 0
        for size, op in re.findall(r"(\d+)([A-Z=])", cigar):
            far += int(size) if op in "MDN=X" else 0
            if op in "MD=X":
                for p in range(at, at + int(size)):
                    d = depths[p]
                    d[0] += op != "D"
                    d[1] += op != "D" and flag != 1024 and mapq >= 20
                    d[2] += 1
                at += int(size)
        hulls.append((pos, pos + max(1, far)))
    at = str(tmp_path_factory.mktemp("deep") / "reads")
    spark.createDataFrame(rows, READS).repartition(3).write.parquet(at)
    return spark.read.parquet(at), spark.createDataFrame(regions, REGIONS), depths, hulls


def test_report_counts_reads_in_the_sweep(spark, deep):
    r, b, depths, hulls = deep
    chroms = spark.createDataFrame([(0, "c1", 100_000), (1, "c2", 500)], CHROMS)
    run = Coverage(r, b, chroms, Options(cutoffs=(2,)))
    m, n = written(spark, lambda: run.metrics().first().asDict())
    assert n < 2_500
    target, flank = ([(s, e) for c, s, e in as_set(x) if c == "c1"] for x in (run.target, run.flank_set))
    meets = lambda sets: sum(any(s < e2 and s2 < e for s2, e2 in sets) for s, e in hulls)
    assert (m["n_tgt"], m["n_flk"]) == (meets(target), meets(flank)) == (depth.overlapping(r, run.target).count(), depth.overlapping(r, run.flank_set).count())
    at = lambda sets, i: [depths[p][i] for s, e in sets for p in range(s + 1, e + 1)]
    assert (m["tgt_data"], m["rmdup_data"], m["flk_data"]) == (sum(at(target, 2)), sum(at(target, 1)), sum(at(flank, 0)))
    assert (m["tgt_len"], m["tgt_covered"], m["flk_covered"]) == (len(at(target, 2)) + 10, sum(x > 0 for x in at(target, 2)), sum(x > 0 for x in at(flank, 0)))
    means = [sum(x) // len(x) for x in (at([i], 0) for i in target)]
    assert (m["reg_depth_sum"], m["reg_covered"]) == (sum(means), sum(x > 0 for x in means))


def test_report_as_json_shuffles_few_rows(spark, deep):
    run = Coverage(deep[0], deep[1], None, Options())
    names = ["n_reads", "n_mapped", "n_tgt", "tgt_len", "tgt_data", "rmdup_data"]
    got, n = written(spark, lambda: run.metrics().select(F.to_json(F.struct(*names)).alias("report")).first().report)
    whole = run.metrics().first().asDict()
    assert json.loads(got) == {c: whole[c] for c in names} and n < 2_500


FIGURES = {
    "flank_depth": lambda s: stats.depth_hist(s, "raw"),
    "chrom_hist": stats.chrom_hist,
    "chrom_report": lambda s: stats.chrom_report(stats.chrom_hist(s)),
    "coverage_avg": lambda s: stats.coverage_ratio(stats.depth_hist(s), strict=False),
    "coverage_cutoffs": lambda s: stats.coverage_at(stats.depth_hist(s), (2, 20)),
    "coverage_ratio": lambda s: stats.coverage_ratio(stats.depth_hist(s)),
    "coverage_rmdup": lambda s: stats.coverage_at(stats.depth_hist(s, "rmdup")),
    "coverage_thresholds": lambda s: stats.coverage_at(stats.depth_hist(s)),
    "depth_cumu": lambda s: stats.cumulative(stats.depth_hist(s)),
    "depth_hist": stats.depth_hist,
    "depth_stats": lambda s: stats.hist_center(stats.depth_hist(s)),
    "rmdup_hist": lambda s: stats.depth_hist(s, "rmdup"),
    "uncover": stats.uncovered,
    "depth_segments": lambda s: s.groupBy("chrom", "start", "stop").count(),
    "region_stats": stats.region_stats,
    "region_stats_compat": lambda s: stats.region_stats(s, True),
    "region_coverage": lambda s: stats.coverage_at(stats.region_hist(stats.region_stats(s))),
}


@pytest.mark.parametrize("name", FIGURES)
def test_figures_of_many_reads_shuffle_few_rows(spark, deep, name):
    r, b, *_ = deep
    got, n = written(spark, lambda: FIGURES[name](depth.segments(r, intervals.merge(intervals.extend(b, 200, 200) if name == "flank_depth" else b))).collect())
    # a row for each bin's packed blocks, and after them one a region or a depth of one task
    assert got and n < 5_000


def test_tasks_grow_with_the_reads(spark, deep, tmp_path, monkeypatch):
    r, b, *_ = deep
    for i in range(3):
        r.coalesce(1).write.parquet(str(tmp_path / f"s/{i}"))
    size = [sum(x.stat().st_size for x in (tmp_path / f"s/{i}").glob("*.parquet")) for i in range(3)]
    at = lambda n: depth.segments(spark.read.parquet(*[str(tmp_path / f"s/{i}") for i in range(n)]), b).rdd.getNumPartitions()
    assert at(3) == 8
    monkeypatch.setattr(depth, "SHARE", size[0] // 20)
    assert 20 <= at(1) < 25 and 60 <= at(3) < 70


def test_depths_of_many_reads_are_shuffled_by_bin(spark, deep):
    r, b, depths, _ = deep
    target = intervals.merge(b)
    want = {("c1", p): tuple(depths[p]) for _, start, stop in as_set(target) - {("c2", 10, 20)} for p in range(start + 1, stop + 1)} | {("c2", p): (0, 0, 0) for p in range(11, 21)}
    segs = depth.segments(r, target)
    for rows_a_batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        got, n = written(spark, lambda: depth.positions(segs).collect())
        assert len(got) == len(want) and {(x.chrom, x.pos): (x.raw, x.rmdup, x.cover) for x in got} == want
        assert n < 600
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
