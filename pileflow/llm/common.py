"""What the operators share: words and their hashes, folders that all executors see, packed shuffles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

Batches = Iterator[pa.RecordBatch]


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, runs of anything but ASCII white space, as UTF-8. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bytes of a text whose words are objects at one time, and bytes of text that a step of a task works on.
PIECE, STEP = 1 << 20, 1 << 22
_BLANKS = b" \t\n\x0b\x0c\r"


def word_hashes(text: str | None) -> np.ndarray:
    """hashed(words(text)), piece by piece, so that a very long text isn't millions of objects at once."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if len(data) <= PIECE:
        return hashed(data.split())
    out, at = [], 0
    while at < len(data):
        to = at + PIECE
        while to < len(data) and data[to] not in _BLANKS:
            to += 1
        out.append(hashed(data[at:to].split()))
        at = to
    return np.concatenate(out)


def sliced(batches: Batches, column: int, step: int = STEP) -> Batches:
    """Batches in slices of about ``step`` bytes of a text column, so that what a task derives from them stays small."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(size):
            continue
        part = (np.cumsum(size) - size) // step
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
        for a, z in zip(edges, edges[1:], strict=False):
            yield b.slice(a, z - a)
        pa.default_memory_pool().release_unused()


def hashed(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64, so that high and low bits are both fit for buckets."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def as_rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Batches, keys: int = 1) -> Iterator[pa.Table]:
    """Rows that follow each other with the same first ``keys`` columns, as one table each; one run at a time is in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows - 1, bool)
        for x in columns:
            new |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            key = tuple(x[a] for x in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Workspace:
    """Tables written to the folder of spark.checkpoint.dir, which driver and executors share: they cut lineage and survive lost executors.

    Where that setting is missing a temporary folder takes its place if all runs on one machine; on a cluster this raises.
    Operators that write tables also move large values through Arrow, so batches of the session are bounded to BATCH bytes
    unless it has a bound of its own: both sides of the pipe hold a batch of every running task, outside the heap.
    """

    BATCH, SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.conf.get(self.SETTING) in ("64MB", "67108864b"):  # the default
            spark.conf.set(self.SETTING, str(self.BATCH))
        self.spark, self.path = spark, f"{base or tempfile.mkdtemp(prefix='pileflow-')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Columns that operators know by name; all others are carried under names that can't clash with those they add.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over the documents, which returns their columns, with other columns' names put aside meanwhile."""
    return f(docs.toDF(*[c if c in KNOWN else f"_other{i}" for i, c in enumerate(docs.columns)])).toDF(*docs.columns)


def crc_mod(column: str, mod: int) -> str:
    """SQL: crc32 of an id as text, modulo ``mod``; null ids count as empty text."""
    return f"crc32(coalesce(cast({column} as string), '')) % {mod}"
