"""Reads, regions and chromosomes derived from the whole test tables.

Every 600 parts open a new stretch of 50,000 bases on each chromosome, so regions and reads grow with the tables at one density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.operators.intervals import merge

#: SQL that Spark and DuckDB both take, over the tables lineitem and part.
STRETCH = "50000 * cast(floor({0} / 600.0) as int)"
READS = f"""select l_orderkey as rid, l_linenumber as rno,
 concat('chr', cast(l_suppkey % 5 as int)) as rname,
 cast((l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 50000 + {STRETCH.format('l_partkey')} as int) as pos,
 cast((l_orderkey*7 + l_linenumber*11 + l_partkey) % 61 as int) as mapq,
 cast(l_quantity as int) + 30 as l_qseq,
 cast(1 + case when l_linenumber % 2 = 1 then 64 else 128 end
   + case when l_returnflag = 'R' then 16 else 0 end
   + case when (l_orderkey + l_partkey) % 10 = 0 then 1024 else 0 end
   + case when (l_orderkey + l_partkey) % 41 = 0 then 512 else 0 end
   + case when (l_orderkey + l_partkey) % 23 = 0 then 256 else 0 end
   + case when (l_orderkey + l_partkey) % 29 = 0 then 4 when l_linestatus = 'F' then 2 else 0 end
   + case when (l_partkey + l_suppkey) % 31 = 0 then 8 else 0 end as int) as flag,
 case when (l_partkey + l_suppkey) % 37 = 0 then concat('chr', cast((l_suppkey + 1) % 5 as int))
      else concat('chr', cast(l_suppkey % 5 as int)) end as mate_rname,
 cast((l_partkey * 13 + l_orderkey) % 2600 - 200 as int) as isize,
 case l_linenumber % 4
   when 0 then concat(cast(cast(l_quantity as int) + 30 as string), 'M')
   when 1 then concat('10M2D', cast(cast(l_quantity as int) + 20 as string), 'M')
   when 2 then concat('5S15M3I', cast(cast(l_quantity as int) + 7 as string), 'M')
   else concat('12=40N', cast(cast(l_quantity as int) + 18 as string), 'X') end as cigar
from lineitem"""
RAW_REGIONS = f"""select concat('chr', cast(p_partkey % 6 as int)) as chrom,
 cast((p_partkey*5003) % 48000 + {STRETCH.format('p_partkey')} as int) as start,
 cast((p_partkey*5003) % 48000 + {STRETCH.format('p_partkey')} + 20 + p_size as int) as stop
from part"""
#: Of each chromosome; all are as long.
LENGTH = f"select cast(60000 + {STRETCH.format('max(p_partkey)')} as bigint) as length from part"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def raw_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_REGIONS.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged, with starts clamped to 1."""
    return merge(raw_regions(spark, sf_dir).withColumn("start", F.greatest("start", F.lit(1))))


def chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = spark.sql(LENGTH.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return length.selectExpr("inline(transform(sequence(0, 5), i -> struct(i as tid, concat('chr', i) as name, length)))")
