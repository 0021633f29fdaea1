"""The operators as queries over the test tables, each with the SQL that DuckDB gives the same rows for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.functions.cigar import blocks, span
from pileflow.operators import depth, intervals, nruns, reads, stats
from pileflow.plans import report
from pileflow.plans.coverage import Coverage
from pileflow.schema import Options
from pileflow.sources import tables as T

OPTIONS = Options(cutoffs=(2, 20))
FLANK = 200


def _half(spark: SparkSession, d: str, odd: int) -> DataFrame:
    """Two interval sets from the regions: even and odd starts, the latter widened so that they meet."""
    r = T.raw_regions(spark, d).withColumn("start", F.greatest("start", F.lit(1)))
    return r.where(F.col("start") % 2 == odd).withColumn("stop", F.col("stop") + 300 * odd)


def _run(spark: SparkSession, d: str) -> Coverage:
    return Coverage(T.reads(spark, d), T.regions(spark, d), T.chroms(spark, d), OPTIONS)


def _segs(spark: SparkSession, d: str) -> DataFrame:
    return depth.segments(T.reads(spark, d), T.regions(spark, d))


def _flank_set(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(intervals.extend(T.regions(spark, d), FLANK, FLANK, T.chroms(spark, d)))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("name"), F.regexp_replace("text", "[a-e]", "N").alias("sequence"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return reads.classes(T.reads(spark, d))


def _ratio(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    return stats.coverage_ratio(stats.depth_hist(_segs(spark, d)), strict=strict)


READ = ["rid", "rno", "rname", "pos", "flag", "mapq", "l_qseq", "cigar"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bed_merge": lambda s, d: intervals.merge(T.raw_regions(s, d).withColumn("start", F.greatest("start", F.lit(1)))),
        "bed_merge_flank": lambda s, d: _flank_set(s, d),
        "bed_union": lambda s, d: intervals.union(_half(s, d, 0), _half(s, d, 1)),
        "bed_intersect": lambda s, d: intervals.intersect(_half(s, d, 0), _half(s, d, 1)),
        "bed_diff": lambda s, d: intervals.subtract(_half(s, d, 0), _half(s, d, 1)),
        "bed_trim": lambda s, d: intervals.trim(T.regions(s, d), 5, 30),
        "bed_0to1": lambda s, d: intervals.to_one_based(T.regions(s, d)),
        "bed_1to0": lambda s, d: intervals.to_zero_based(T.regions(s, d)),
        "bed_stat": lambda s, d: intervals.summary(T.regions(s, d)),
        "bed_chroms": lambda s, d: intervals.chromosomes(T.regions(s, d)),
        "bed_bounds_check": lambda s, d: intervals.bounds(T.regions(s, d), T.chroms(s, d).where("name != 'chr5'").withColumn("length", F.col("length") - 20_000)),
        "read_classes": _classes,
        "flagstat": lambda s, d: reads.flagstat(T.reads(s, d)),
        "mapq_stat": lambda s, d: reads.mapq_counts(T.reads(s, d)),
        "insert_hist": lambda s, d: reads.insert_hist(T.reads(s, d)),
        "insert_cumu": lambda s, d: stats.cumulative(reads.insert_hist(T.reads(s, d))),
        "insert_stats": lambda s, d: stats.hist_center(reads.insert_hist(T.reads(s, d))),
        "insert_median_compat": lambda s, d: stats.hist_median(reads.insert_hist(T.reads(s, d)), compat=True),
        "cigar_blocks": lambda s, d: blocks(T.reads(s, d)).select("rname", "flag", "mapq", "op", "s", "e"),
        "read_ends": lambda s, d: T.reads(s, d).select("rid", "rno", "rname", "pos", "cigar", (F.col("pos") + span()).alias("end_pos")),
        "depth_positions": lambda s, d: depth.positions(_segs(s, d)),
        "depth_segments": lambda s, d: _segs(s, d).groupBy("chrom", "start", "stop").agg(*[F.sum(F.col(c) * stats.width()).alias(f"sum_{c}") for c in ("raw", "rmdup", "cover")], F.sum(stats.width()).alias("bases")),
        "target_reads_semi": lambda s, d: depth.overlapping(T.reads(s, d), T.regions(s, d)).agg(F.count("*").alias("n_tgt")),
        "target_reads_export": lambda s, d: depth.overlapping(T.reads(s, d), T.regions(s, d)).select(*READ),
        "flank_reads": lambda s, d: depth.overlapping(T.reads(s, d), _flank_set(s, d)).agg(F.count("*").alias("n_flk")),
        "absent_chroms_anti": lambda s, d: depth.unread_chromosomes(T.reads(s, d), T.regions(s, d)),
        "depth_hist": lambda s, d: stats.depth_hist(_segs(s, d)),
        "rmdup_hist": lambda s, d: stats.depth_hist(_segs(s, d), "rmdup"),
        "chrom_hist": lambda s, d: stats.chrom_hist(_segs(s, d)),
        "depth_cumu": lambda s, d: stats.cumulative(stats.depth_hist(_segs(s, d))),
        "depth_stats": lambda s, d: stats.hist_center(stats.depth_hist(_segs(s, d))),
        "region_stats": lambda s, d: stats.region_stats(_segs(s, d)),
        "region_stats_compat": lambda s, d: stats.region_stats(_segs(s, d), compat=True),
        "region_hist": lambda s, d: stats.region_hist(stats.region_stats(_segs(s, d))),
        "chrom_report": lambda s, d: stats.chrom_report(stats.chrom_hist(_segs(s, d))),
        "coverage_thresholds": lambda s, d: stats.coverage_at(stats.depth_hist(_segs(s, d))),
        "coverage_cutoffs": lambda s, d: stats.coverage_at(stats.depth_hist(_segs(s, d)), (2, 20)),
        "coverage_rmdup": lambda s, d: stats.coverage_at(stats.depth_hist(_segs(s, d), "rmdup")),
        "coverage_avg": lambda s, d: _ratio(s, d, False),
        "coverage_ratio": lambda s, d: _ratio(s, d, True),
        "region_coverage": lambda s, d: stats.coverage_at(stats.region_hist(stats.region_stats(_segs(s, d)))),
        "flank_depth": lambda s, d: stats.depth_hist(depth.segments(T.reads(s, d), _flank_set(s, d)), "raw"),
        "uncover": lambda s, d: stats.uncovered(_segs(s, d)),
        "n_runs": lambda s, d: nruns.n_runs(_sequences(s, d)),
        "coverage_report": lambda s, d: report.tidy(_run(s, d)),
        "coverage_json": lambda s, d: _run(s, d).metrics().select(F.to_json(F.struct("n_reads", "n_mapped", "n_tgt", "tgt_len", "tgt_data", "rmdup_data")).alias("report")),
    }


MERGED = """select chrom, min(start) as start, max(stop) as stop from (
 select *, sum(brk) over (partition by chrom order by start, stop rows between unbounded preceding and current row) as isl from (
  select *, case when max(stop) over (partition by chrom order by start, stop rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as brk
  from (select chrom, start, stop from {0}) r) a) b
group by chrom, isl"""
PLACED = "flag & 2304 = 0 and rname <> '*' and (flag & 512 <> 0 or flag & 4 = 0)"
DUP = "flag & 512 = 0 and flag & 4 = 0 and flag & 1024 <> 0"
BASE = f"""lens as ({T.LENGTH}), reads as ({T.READS}), raw_regions as (select chrom, greatest(start, 1) as start, stop from ({T.RAW_REGIONS}) q),
regions as ({MERGED.format("raw_regions")}),
ext as (select chrom, greatest(start - {FLANK}, 0) as start, cast(least(stop + {FLANK}, (select length from lens)) as int) as stop from regions),
flank as ({MERGED.format("ext")}),
ops as (select *, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) as o, list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), lambda x: cast(x as int)) as n from reads),
hulls as (select *, pos + greatest(1, cast(list_sum(list_transform(generate_series(1, len(o)), lambda i: case when o[i] in ('M', 'D', 'N', '=', 'X') then n[i] else 0 end)) as int)) as end_pos from ops),
steps as (select *, list_transform(generate_series(1, len(o)), lambda i: case when o[i] in ('M', '=', 'X', 'D') then n[i] else 0 end) as adv, unnest(generate_series(1, len(o))) as i from ops),
blocks as (select rname, flag, mapq, o[i] as op, cast(pos + 1 + coalesce(list_sum(adv[1:i - 1]), 0) as int) as s, cast(pos + coalesce(list_sum(adv[1:i - 1]), 0) + n[i] as int) as e from steps where o[i] in ('M', '=', 'X', 'D')),
bases as (select rname as chrom, unnest(generate_series(s, e)) as pos, case when op = 'D' then 0 else 1 end as raw, case when op <> 'D' and not ({DUP}) and mapq >= 20 then 1 else 0 end as rmdup from blocks where {PLACED}),
sums as (select chrom, pos, cast(sum(raw) as bigint) as raw, cast(sum(rmdup) as bigint) as rmdup, count(*) as cover from bases group by all),
spots as (select chrom, start, stop, unnest(generate_series(start + 1, stop)) as pos from regions),
depths as (select p.chrom, p.start, p.stop, cast(p.pos as int) as pos, coalesce(raw, 0) as raw, coalesce(rmdup, 0) as rmdup, coalesce(cover, 0) as cover from spots p left join sums b on p.chrom = b.chrom and p.pos = b.pos),
hist as (select cover as value, count(*) as cnt from depths group by 1),
per_region as (select chrom, start, stop, sum(raw) / count(*) as avg, median(raw) as median, 100.0::double * count(*) filter (raw > 0) / count(*) as coverage, 100.0::double * count(*) filter (cover > 0) / count(*) as coverage_fix, list_sort(list(raw)) as vals from depths group by all),
reg_hist as (select cast(floor(avg) as bigint) as value, count(*) as cnt from per_region group by 1),
primaries as (select * from reads where flag & 2304 = 0),
ins as (select isize as value, count(*) as cnt from reads where {PLACED} and isize > 0 and isize < 2000 group by 1),
flank_spots as (select chrom, unnest(generate_series(start + 1, stop)) as pos from flank),
flank_hist as (select coalesce(raw, 0) as value, count(*) as cnt from flank_spots p left join sums b on p.chrom = b.chrom and p.pos = b.pos group by 1)"""


def _with(body: str, more: str = "") -> str:
    return f"with {BASE}{', ' + more if more else ''} {body}"


def _pct(cond: str, table: str = "hist") -> str:
    return f"(select 100.0::double * coalesce(sum(cnt) filter ({cond}), 0) / sum(cnt) from {table})"


def _coverage(table: str, thresholds: tuple[int, ...] = (1, 4, 10, 30, 100)) -> str:
    return " union all ".join(f"select {t}::int as threshold, {_pct(f'value >= {t}', table)} as percent" for t in thresholds)


def _cumulative(table: str) -> str:
    return f"""select value, cnt, cnt / total as frac, cnt_gt, cnt_gt / total as frac_gt from (
 select v.value, coalesce(h.cnt, 0) as cnt, cast(sum(coalesce(h.cnt, 0)) over () as bigint) as total, cast(sum(coalesce(h.cnt, 0)) over (order by v.value desc) - coalesce(h.cnt, 0) as bigint) as cnt_gt
 from (select unnest(generate_series(0, (select max(value) from {table}))) as value) v left join {table} h on v.value = h.value)"""


def _ratio_sql(strict: bool) -> str:
    mean = "sum(value * cnt) / {l}" if strict else "floor(sum(value * cnt) / {l})"
    t = "cast(floor(r * m) as bigint)"
    return (
        f"select ratio, threshold, 100.0::double * coalesce((select sum(cnt) from hist where value {'>' if strict else '>='} threshold), 0) / (select sum(cnt) from hist) as percent from ("
        f"select r as ratio, {t} as threshold from (select unnest([0.2::double, 0.5::double]) as r) a, (select {mean.format(l='(select sum(stop - start) from regions)')} as m from hist) b) c"
    )


def _half_sql(odd: int) -> str:
    return f"select chrom, start, cast(stop + {300 * odd} as int) as stop from raw_regions where start % 2 = {odd}"


HALVES = f"ha as ({_half_sql(0)}), hb as ({_half_sql(1)}), ma as ({MERGED.format('ha')}), mb as ({MERGED.format('hb')})"
DIFF = """ev as (select chrom, start as p, 1 as da, 0 as db from ma union all select chrom, stop, -1, 0 from ma union all select chrom, start, 0, 1 from mb union all select chrom, stop, 0, -1 from mb),
pts as (select chrom, p, sum(da) as da, sum(db) as db from ev group by all),
sw as (select chrom, p as start, lead(p) over w as stop, sum(da) over w as ia, sum(db) over w as ib from pts window w as (partition by chrom order by p))"""
MEETS = "exists (select 1 from {0} g where g.chrom = rname and pos + 1 <= g.stop and end_pos > g.start)"
OK, MAPPED = "flag & 512 = 0", "flag & 512 = 0 and flag & 4 = 0"
PAIRMAP = f"{MAPPED} and flag & 1 <> 0 and flag & 8 = 0"
KEPT = f"{PLACED} and not ({DUP})"
# Name, condition and what is summed (1: rows) of each counter.
COUNTERS = [
    ("n_reads", "true", ""), ("n_data", "true", "l_qseq"), ("n_qcfail", "flag & 512 <> 0", ""), ("n_pair_all", f"{OK} and flag & 1 <> 0", ""), ("n_pair_good", f"{MAPPED} and flag & 3 = 3", ""),
    ("n_read1", f"{OK} and flag & 65 = 65", ""), ("n_read2", f"{OK} and flag & 129 = 129", ""), ("n_sgltn", f"{MAPPED} and flag & 9 = 9", ""), ("n_pair_map", PAIRMAP, ""), ("n_diffchr", f"{PAIRMAP} and mate_rname <> rname", ""),
    ("n_mapped", MAPPED, ""), ("n_mdata", MAPPED, "l_qseq"), ("n_mstrand", f"{MAPPED} and flag & 16 <> 0", ""), ("n_pstrand", f"{MAPPED} and flag & 16 = 0", ""), ("n_dup", f"{MAPPED} and flag & 1024 <> 0", ""),
    ("n_qual", "mapq >= 20", ""), ("n_rmdup1", f"{KEPT} and flag & 64 <> 0", ""), ("n_rmdup2", f"{KEPT} and flag & 128 <> 0", ""),
]
FLAGSTAT = "select " + ", ".join(f"cast(coalesce(sum({what}) filter ({c}), 0) as bigint) as {n}" if what else f"count(*) filter ({c}) as {n}" for n, c, what in COUNTERS) + " from primaries"


def _report_sql() -> str:
    one = {n: f"(select {n} from fs)" for n, _, _ in COUNTERS}
    one |= {"isize_avg": "(select sum(value * cnt) / sum(cnt) from ins)", "isize_median": f"(select cast(trunc(median(isize)) as bigint) from reads where {PLACED} and isize > 0 and isize < 2000)"}
    one |= {n: f"(select count(*) from hulls where {PLACED} and {MEETS.format(t)})" for n, t in (("n_tgt", "regions"), ("n_flk", "flank"))}
    one |= {"n_regions": "(select count(*) from regions)", "tgt_len": "(select sum(stop - start) from regions)", "flk_len": "(select sum(stop - start) from flank)"}
    for name, t in (("tgt", "hist"), ("rmdup", "rhist"), ("flk", "flank_hist"), ("reg", "reg_hist")):
        one[f"{name}_data" if name != "reg" else "reg_depth_sum"] = f"(select sum(value * cnt) from {t})"
        one |= {f"{name}_{x}x": _pct(f"value >= {x}", t) for x in (1, 4, 10, 30, 100, 2, 20)}
        one[f"{name}_covered"] = f"(select coalesce(sum(cnt) filter (value >= 1), 0) from {t})"
    mean = "(select sum(value * cnt) / (select sum(stop - start) from regions) from hist)"
    for r in (0.2, 0.5):
        one[f"tgt_ge_{r:g}_avg"] = _pct(f"value >= floor({r}::double * floor({mean}))")
        one[f"tgt_gt_{r:g}_ratio"] = _pct(f"value > floor({r}::double * {mean})")
    rows = " union all ".join(f"select '{k}' as metric, cast({v} as double) as value" for k, v in one.items())
    return _with(rows, f"fs as ({FLAGSTAT}), rhist as (select rmdup as value, count(*) as cnt from depths group by 1)")


def oracle_sql() -> dict[str, str]:
    rhist = "rhist as (select rmdup as value, count(*) as cnt from depths group by 1)"
    trimmed = "cut as (select chrom, case when stop - start > 35 then start + 5 else start end as start, case when stop - start > 35 then stop - 30 else stop end as stop from regions)"
    per = "select chrom, start, stop, avg, {0} as median, coverage, coverage_fix from per_region"
    by_chrom = ", ".join(f"100.0::double * count(*) filter (cover >= {t}) / count(*) as {n}" for t, n in ((1, "coverage"), (4, "cov_4x"), (10, "cov_10x"), (30, "cov_30x"), (100, "cov_100x")))
    low = "low as (select chrom, pos - 1 as start, pos as stop from depths where cover < 5)"
    return {
        "bed_merge": _with("select * from regions"),
        "bed_merge_flank": _with("select * from flank"),
        "bed_union": _with("select * from ha union all select * from hb", HALVES),
        "bed_intersect": _with(MERGED.format("hit"), HALVES + ", hit as (select ma.chrom, greatest(ma.start, mb.start) as start, least(ma.stop, mb.stop) as stop from ma join mb on ma.chrom = mb.chrom and ma.start < mb.stop and mb.start < ma.stop)"),
        "bed_diff": _with("select chrom, start, stop from sw where ia > 0 and ib = 0 and stop is not null", f"{HALVES}, {DIFF}"),
        "bed_trim": _with(MERGED.format("cut"), trimmed),
        "bed_0to1": _with("select chrom, start + 1 as start, stop from regions"),
        "bed_1to0": _with("select chrom, start - 1 as start, stop from regions"),
        "bed_stat": _with("select count(*) as regions, cast(sum(stop - start) as bigint) as bases, count(*) filter (start = stop) as empty from regions"),
        "bed_chroms": _with("select distinct chrom from regions"),
        "bed_bounds_check": _with("select chrom, start, stop, case when chrom = 'chr5' then 'unknown' else 'past_end' end as reason from regions where chrom = 'chr5' or stop > (select length from lens) - 20000"),
        "read_classes": _with("select cast(case when flag & 512 <> 0 then 0 when flag & 4 <> 0 then -3 when flag & 1024 <> 0 then 2 else 1 end as int) as class, count(*) as n, cast(sum(l_qseq) as bigint) as bases from primaries group by 1"),
        "flagstat": _with(FLAGSTAT),
        "mapq_stat": _with("select mapq, count(*) as n from primaries group by 1"),
        "insert_hist": _with("select * from ins"),
        "insert_cumu": _with(_cumulative("ins")),
        "insert_stats": _with(f"select avg(isize) as mean, median(isize) as median from reads where {PLACED} and isize > 0 and isize < 2000"),
        "insert_median_compat": _with(
            "select min_by(case when n = 1 then 0.0::double when upto = n // 2 and n % 2 = 0 then (value + coalesce(nxt, value)) / 2.0::double else value::double end, value) as median from run where upto >= n // 2",
            "run as (select value, sum(cnt) over (order by value) as upto, lead(value) over (order by value) as nxt, sum(cnt) over () as n from ins)",
        ),
        "cigar_blocks": _with("select * from blocks"),
        "read_ends": _with("select rid, rno, rname, pos, cigar, end_pos from hulls"),
        "depth_positions": _with("select chrom, pos, raw, rmdup, cover from depths"),
        "depth_segments": _with("select chrom, start, stop, cast(sum(raw) as bigint) as sum_raw, cast(sum(rmdup) as bigint) as sum_rmdup, cast(sum(cover) as bigint) as sum_cover, count(*) as bases from depths group by all"),
        "target_reads_semi": _with(f"select count(*) as n_tgt from hulls where {PLACED} and {MEETS.format('regions')}"),
        "target_reads_export": _with(f"select {', '.join(READ)} from hulls where {PLACED} and {MEETS.format('regions')}"),
        "flank_reads": _with(f"select count(*) as n_flk from hulls where {PLACED} and {MEETS.format('flank')}"),
        "absent_chroms_anti": _with(f"select distinct chrom from regions where chrom not in (select rname from reads where {PLACED})"),
        "depth_hist": _with("select * from hist"),
        "rmdup_hist": _with("select * from rhist", rhist),
        "chrom_hist": _with("select chrom, cover as value, count(*) as cnt from depths group by all"),
        "depth_cumu": _with(_cumulative("hist")),
        "depth_stats": _with("select avg(cover) as mean, median(cover) as median from depths"),
        "region_stats": _with(per.format("median")),
        "region_stats_compat": _with(per.format("case when len(vals) % 2 = 1 and len(vals) >= 3 then vals[len(vals) // 2 + 2]::double else median end")),
        "region_hist": _with("select * from reg_hist"),
        "chrom_report": _with(f"select chrom, cast(sum(cover) as bigint) as data, sum(cover) / count(*) as avg, median(cover) as median, {by_chrom}, 100.0::double * sum(cover) / (select sum(cover) from depths) as data_percent from depths group by chrom"),
        "coverage_thresholds": _with(_coverage("hist")),
        "coverage_cutoffs": _with(_coverage("hist", (2, 20))),
        "coverage_rmdup": _with(_coverage("rhist"), rhist),
        "coverage_avg": _with(_ratio_sql(False)),
        "coverage_ratio": _with(_ratio_sql(True)),
        "region_coverage": _with(_coverage("reg_hist")),
        "flank_depth": _with("select * from flank_hist"),
        "uncover": _with(MERGED.format("low"), low),
        "n_runs": r"""with seqs as (select doc_id as name, regexp_replace(text, '[a-e]', 'N', 'g') as q from documents),
  ch as (select name, q, unnest(regexp_extract_all(q, '[^N]*N+')) as part, generate_subscripts(regexp_extract_all(q, '[^N]*N+'), 1) as i from seqs),
  pos as (select name, i, length(part) as whole, length(regexp_replace(part, '[^N]', '', 'g')) as run, sum(length(part)) over (partition by name order by i) as upto from ch)
  select name, cast(upto - run as int) as start, cast(upto as int) as stop from pos""",
        "coverage_report": _report_sql(),
        "coverage_json": _with(
            f"""select '{{"n_reads":' || n_reads || ',"n_mapped":' || n_mapped || ',"n_tgt":' || (select count(*) from hulls where {PLACED} and {MEETS.format("regions")}) || ',"tgt_len":' || (select sum(stop - start) from regions) || ',"tgt_data":' || (select sum(cover)::bigint from depths) || ',"rmdup_data":' || (select sum(rmdup)::bigint from depths) || '}}' as report from fs""",
            f"fs as ({FLAGSTAT})",
        ),
    }
