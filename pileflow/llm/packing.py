"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, Workspace, sliced
from pileflow.llm.tokens import ByteBpe

#: Pieces of one length that are ranked together; up to FEW parts a length, LITTLE pieces are enough for one.
RANKED, FEW, LITTLE = 1 << 20, 128, 1 << 8


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts. Rows (length, first rank, count, first sequence, offset), sorted by length and rank.

    A pattern is what a run of equal sequences holds; the work and the plan depend on the lengths that occur and not on
    how many pieces have them. Pieces of one length take ranks 0, 1, ... in the order of the rows.
    """
    open_by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room -> [(number of sequences, pattern)]
    rooms: list[int] = []  # rooms in use, ascending
    closed: list[tuple[int, tuple]] = []

    def keep(room: int, n: int, pattern: tuple) -> None:
        if room == 0:
            closed.append((n, pattern))
            return
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room].append((n, pattern))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                n, pattern = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(i)
                # the tightest room stays the tightest after a piece of this length: fill it as far as it goes
                each = room // length
                full = min(n, left // each)
                if full:
                    keep(room - each * length, full, (*pattern, (length, each)))
                    left -= full * each
                    n -= full
                if n and left and left < each:
                    keep(room - left * length, 1, (*pattern, (length, left)))
                    left, n = 0, n - 1
                if n:
                    keep(room, n, pattern)
            else:
                each = capacity // length
                if full := left // each:
                    keep(capacity - each * length, full, ((length, each),))
                if rest := left % each:
                    keep(capacity - rest * length, 1, ((length, rest),))
                left = 0
    rows, used, sequence = [], defaultdict(int), 0
    for n, pattern in closed + [x for r in rooms for x in open_by_room[r]]:
        offset = 0
        for length, each in pattern:
            for _ in range(each):
                rows.append((length, used[length], n, sequence, offset))
                used[length] += n
                offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int, end_id: int = 2, library: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut from its end if longer than the capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        encoder = ByteBpe(library, ranks)
        tail = np.array([end_id], np.uint32)
        for b in sliced(batches, 1):
            rows, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py()), tail]).astype("<u4", copy=False)
                at, k = 0, 0
                while at < len(ids):
                    to = at + ((len(ids) - at - 1) % capacity + 1 if k == 0 else capacity)
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at, k = to, k + 1
            yield pa.record_batch(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranked: int = RANKED) -> DataFrame:
    """Every piece with its place: sequence_id and offset, gapless from 0, no sequence above the capacity.

    Null texts count as empty and are one piece of the end id; repeated rows, and rows with equal or null ids, are packed each
    on its own. An empty table gives no rows; a text of any length is encoded whole and cut. The driver sees one row per length
    that occurs (``capacity`` at most) and one for each ``ranked`` pieces of a length; pieces meet the plan by their rank among
    those of their length, counted in two levels so that no task has all of one length.
    """
    space = Workspace(spark, "packing")
    made = space.write(pieces(docs, capacity, end_id), "pieces")
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = {x: max(min(FEW, ceil(n / LITTLE)), ceil(n / ranked)) for x, n in histogram.items()}
    table = F.broadcast(spark.createDataFrame(list(parts.items()), "length long, parts int"))
    made = made.join(table, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts").cast("int")).drop("parts")
    # where the ranks of each part of a length begin
    first, size = {}, 0
    for x in parts:
        first[x] = size
        size += parts[x]
    bases, at = np.zeros(size, np.int64), np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect():
        bases[first[r.length] + r.bucket] = r.n
    for x, a in first.items():
        part = bases[a : a + parts[x]]
        part[:] = np.cumsum(part) - part
        at[x] = a
    rows = plan(histogram, capacity)
    keys = rows[:, 0] << 48 | rows[:, 1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")

    def place(batches: Batches) -> Batches:
        for b in batches:
            length, bucket, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            rank = rank + bases[at[length] + bucket]
            row = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            sequence = rows[row, 3] + rank - rows[row, 1]
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(rows[row, 4])], [*names, "sequence_id", "offset"])

    turned = made.select(*names, "bucket", (F.row_number().over(order).cast("long") - 1).alias("rank"))
    return turned.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
