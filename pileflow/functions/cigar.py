"""CIGAR strings: spans inside the row, blocks by running sums over a batch; no key, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

PATTERN = r"(\\d+)([MIDNSHP=XB])"
ENDING = ("M", "D", "N", "=", "X")


def ops(cigar: str = "cigar") -> Column:
    """array<struct<len:int, op:string>>; empty for '*' and null."""
    return F.coalesce(
        F.expr(f"zip_with(regexp_extract_all({cigar}, '{PATTERN}', 1), regexp_extract_all({cigar}, '{PATTERN}', 2), (n, o) -> named_struct('len', int(n), 'op', o))"),
        F.expr("cast(array() as array<struct<len:int, op:string>>)"),
    )


def span(cigar: str = "cigar") -> Column:
    """Reference bases that the hull of the alignment covers, one at least."""
    total = F.aggregate(ops(cigar), F.lit(0), lambda a, z: a + F.when(z["op"].isin(*ENDING), z["len"]).otherwise(0))
    return F.greatest(F.lit(1), total)


def parsed(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, letter, length) of all operations of a column of CIGAR strings, in order; signs without digits give none."""
    cigars = cigars.cast(pa.string()).fill_null("")
    ends = np.frombuffer(cigars.buffers()[1], np.int32)[cigars.offset : cigars.offset + len(cigars) + 1].astype(np.int64)
    text = np.frombuffer(cigars.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(cigars) else np.empty(0, np.uint8)
    digit = (text >= 48) & (text <= 57)
    op = np.flatnonzero(~digit)
    row = np.searchsorted(ends - ends[0], op, side="right") - 1
    at = np.flatnonzero(digit)
    to = np.searchsorted(op, at)
    at, to = at[to < len(op)], to[to < len(op)]
    place = op[to] - at - 1
    same = (np.searchsorted(ends - ends[0], at, side="right") - 1 == row[to]) & (place < 10)
    size = np.bincount(to[same], (text[at[same]] - 48) * 10.0 ** place[same], len(op)).astype(np.int64)
    known = np.isin(text[op], LETTERS) & (size > 0)
    return row[known], text[op][known], size[known]


LETTERS = np.frombuffer(b"MIDNSHP=XB", np.uint8)


def located(pos: pa.Array, cigars: pa.Array, refskip: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, letter, length, 0-based start) of all operations; a missing position counts as 0."""
    moving = np.frombuffer(b"M=XDN" if refskip == "advance" else b"M=XD", np.uint8)
    row, letter, size = parsed(cigars)
    moved = np.where(np.isin(letter, moving), size, 0)
    before = np.cumsum(moved) - moved
    first = np.searchsorted(row, row)
    return row, letter, size, before - before[first] + pos.fill_null(0).to_numpy(zero_copy_only=False)[row]


def blocks(reads: DataFrame, refskip: str = "stay", keep: list[str] | None = None) -> DataFrame:
    """One row per M, =, X or D operation: adds ``op``, ``s`` and ``e`` (1-based, inclusive). An ``N`` moves the position only with refskip="advance".
    ``keep``: the columns of the reads that blocks need; all by default.

    Offsets are running sums over the operations of an Arrow batch, linear in their number: inside an expression, an array
    built up operation by operation would be copied at each of them, which long reads with tens of thousands can't bear.
    """
    shown = np.frombuffer(b"M=XD", np.uint8)
    names = reads.columns if keep is None else keep
    given = reads.select(*names, F.col("pos").alias("_pos"), F.col("cigar").alias("_cigar"))
    schema = StructType([*given.schema.fields[:-2], StructField("op", StringType()), StructField("s", IntegerType()), StructField("e", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, letter, size, start = located(b.column(len(names)), b.column(len(names) + 1), refskip)
            show = np.isin(letter, shown)
            row, start = row[show], start[show] + 1
            take = pa.array(row)
            yield pa.record_batch([*[c.take(take) for c in b.columns[: len(names)]], _letters(letter[show]), pa.array(start.astype(np.int32)), pa.array((start + size[show] - 1).astype(np.int32))], [*names, "op", "s", "e"])

    return given.mapInArrow(run, schema)


def _letters(codes: np.ndarray) -> pa.Array:
    """Single letters as strings."""
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32)), pa.py_buffer(codes.tobytes()))
