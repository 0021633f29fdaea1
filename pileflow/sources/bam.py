"""BAM as a Spark data source: ``spark.read.format("bam").load(path)``; large files are read in pieces of whole blocks.

Files lie in a folder that driver and executors share.
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_right
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pileflow.schema import CHROMS, READS
from pileflow.sources import bgzf

# The CIGAR operations and the bases by their number, the sizes of tag values by their type.
OPERATIONS = "MIDNSHP=XB"
BASES = "=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
FIXED = struct.Struct("<iiBBHHHiiii")
#: Bytes of a file that one task reads, and records in a row that must make sense for a place to count as a record's beginning.
PIECE, CHAIN = 64 << 20, 4
#: Columns of the source with option keep: the record as it stands in the file, too.
KEPT = READS + ", record binary"


class _Stream:
    """Unpacked bytes from a block on, and for each place in them the block that it lies in."""

    def __init__(self, f) -> None:
        self.blocks, self.kept, self.at, self.starts, self.offsets = bgzf.blocks(f), bytearray(), 0, [], []

    def fill(self, n: int) -> bool:
        """Whether n bytes are there."""
        while len(self.kept) < n:
            part = next(self.blocks, None)
            if part is None:
                return False
            if part[1]:
                self.starts.append(self.at + len(self.kept))
                self.offsets.append(part[0])
                self.kept += part[1]
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            if self.kept:
                raise ValueError("truncated BAM file")
            return b""
        out = bytes(self.kept[:n])
        del self.kept[:n]
        self.at += n
        if len(self.starts) > 256:
            k = bisect_right(self.starts, self.at) - 1
            del self.starts[:k], self.offsets[:k]
        return out

    def number(self) -> int | None:
        x = self.take(4)
        return struct.unpack("<i", x)[0] if x else None

    def block(self) -> int:
        """Where in the file the block of the next byte begins."""
        return self.offsets[bisect_right(self.starts, self.at) - 1] if self.fill(1) else 1 << 62


def _head(s: _Stream) -> tuple[bytes, list[tuple[str, int]]]:
    """(text of the header, names and lengths of the chromosomes)."""
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = s.take(s.number())
    return text, [(s.take(s.number())[:-1].decode(), s.number()) for _ in range(s.number())]


def _sensible(data: bytes, at: int, n_chroms: int) -> int | None:
    """The end of a record that may begin here; None if none can."""
    if at + 36 > len(data):
        return None
    size = struct.unpack_from("<i", data, at)[0]
    tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos, _ = FIXED.unpack_from(data, at + 4)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= tid < n_chroms and -1 <= mtid < n_chroms and pos >= -1 and mpos >= -1 and l_name > 0 and l_seq >= 0 and least <= size < 1 << 28):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def _seek(s: _Stream, n_chroms: int) -> bool:
    """Moves to the first record that begins in the stream."""
    at = 0
    while s.fill(at + 36):
        s.fill(at + (1 << 16))
        to, seen = at, 0
        while seen < CHAIN and to is not None and to + 36 <= len(s.kept):
            to = _sensible(s.kept, to, n_chroms)
            seen += to is not None
            if to is not None:
                s.fill(to + 36)
        if to is not None and seen:
            s.take(at)
            return True
        at += 1
    return False


def _tags(b: bytes, at: int) -> Iterator[tuple[bytes, str, int, int]]:
    """(tag, type, begin, end) of the values of a record's tags; of an array its element type and its elements."""
    while at + 3 <= len(b):
        tag, kind = b[at : at + 2], chr(b[at + 2])
        at += 3
        if kind in "ZH":
            to = b.index(0, at) + 1
        elif kind == "B":
            kind, n = chr(b[at]), struct.unpack_from("<i", b, at + 1)[0]
            at += 5
            to = at + n * TAG_SIZES[kind]
        else:
            to = at + TAG_SIZES[kind]
        yield tag, kind, at, to
        at = to


def _row(b: bytes, names: list[str]) -> tuple:
    tid, pos, l_name, mapq, _bin, n_cigar, flag, l_seq, mtid, _mpos, isize = FIXED.unpack_from(b)
    ops = struct.unpack_from(f"<{n_cigar}I", b, 32 + l_name)
    if n_cigar == 2 and ops[0] == l_seq << 4 | 4 and ops[1] & 15 == 3:
        # more operations than the field can count stand in a tag, and these two in their place
        for tag, kind, a, z in _tags(b, 32 + l_name + 8 + (l_seq + 1) // 2 + l_seq):
            if tag == b"CG" and kind == "I":
                ops = struct.unpack_from(f"<{(z - a) // 4}I", b, a)
    name = lambda i: names[i] if 0 <= i < len(names) else "*"
    return name(tid), pos, flag, mapq, l_seq, name(mtid), isize, "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in ops) or "*"


def records(path: str, begin: int = 0, end: int = 1 << 62, keep: bool = False) -> Iterator[tuple]:
    """Rows of the records that begin in blocks from ``begin`` to before ``end``, in the order of the READS schema."""
    with open(path, "rb") as f:
        s = _Stream(f)
        names = [n for n, _ in _head(s)[1]]
        if begin:
            at = bgzf.find(f, begin)
            if at is None or at >= end:
                return
            f.seek(at)
            s = _Stream(f)
            if not _seek(s, len(names)):
                return
        while s.block() < end and (size := s.number()) is not None:
            b = s.take(size)
            yield (*_row(b, names), b) if keep else _row(b, names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return KEPT if self.options.get("keep") == "true" else READS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("piece", PIECE)), self.options.get("keep") == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, piece: int, keep: bool) -> None:
        self.paths, self.piece, self.keep = sorted(p for part in path.split(",") for p in (glob(part) or [part])), piece, keep

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, a, a + self.piece)) for p in self.paths for a in range(0, max(1, os.path.getsize(p)), self.piece)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(*partition.value, self.keep)


def read(spark: SparkSession, *paths: str, keep: bool = False, piece: int = PIECE) -> DataFrame:
    """``keep``: with the whole record, for writing it again."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("keep", str(keep).lower()).option("piece", str(piece)).load(",".join(paths))


def header(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as f:
        return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(_head(_Stream(f))[1])], CHROMS)


def header_text(path: str) -> str:
    with open(path, "rb") as f:
        return _head(_Stream(f))[0].rstrip(b"\0").decode()


def _operations(cigar: str | None) -> list[int]:
    ops, n = [], 0
    for c in cigar or "":
        if c.isdigit():
            n = 10 * n + int(c)
        elif c in OPERATIONS:
            ops.append(n << 4 | OPERATIONS.index(c))
            n = 0
    return ops


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the usual index (16 kb, eight times larger on each level) that holds the alignment."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end - 1 >> shift:
            return first + (begin >> shift)
    return 0


def _record(tid: int, pos: int, mapq: int, flag: int, mtid: int, mpos: int, isize: int, name: bytes, cigar: str | None, seq: bytes, qual: bytes, l_seq: int, tags: bytes) -> bytes:
    ops = _operations(cigar)
    span = sum(c >> 4 for c in ops if OPERATIONS[c & 15] in "MDN=X") or 1
    if len(ops) > 65_535:
        tags += b"CGBI" + struct.pack("<i", len(ops)) + struct.pack(f"<{len(ops)}I", *ops)
        ops = [l_seq << 4 | 4, span << 4 | 3]
    head = FIXED.pack(tid, pos, len(name) + 1, mapq, _bin(max(pos, 0), max(pos, 0) + span), len(ops), flag, l_seq, mtid, mpos, isize)
    return head + name + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + seq + qual + tags


def _array(kind: str, items: list[str]) -> bytes:
    return b"B" + kind.encode() + struct.pack("<i", len(items)) + struct.pack(f"<{len(items)}{TAG_FORMS[kind]}", *[float(x) if kind == "f" else int(x) for x in items])


def encoded(line: str, tid: dict[str, int]) -> bytes:
    """The record of a line of SAM."""
    q, flag, rname, pos, mapq, cigar, mate, mpos, isize, seq, qual, *tags = line.split("\t")
    out = b""
    for t in tags:
        tag, kind, value = t.split(":", 2)
        out += tag.encode()
        if kind == "B":
            out += _array(value[0], value.split(",")[1:])
        elif kind == "i":
            out += b"i" + struct.pack("<i", int(value)) if -(1 << 31) <= int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value))
        elif kind == "f":
            out += b"f" + struct.pack("<f", float(value))
        else:
            out += kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")
    n = 0 if seq == "*" else len(seq)
    codes = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq.upper()] if n else []
    packed = bytes(codes[i] << 4 | (codes[i + 1] if i + 1 < n else 0) for i in range(0, n, 2))
    quals = b"\xff" * n if qual == "*" else bytes(ord(c) - 33 for c in qual)
    return _record(tid.get(rname, -1), int(pos) - 1, int(mapq), int(flag), tid.get(rname if mate == "=" else mate, -1), int(mpos) - 1, int(isize), q.encode(), cigar, packed, quals, n, out)


def write(reads: DataFrame, chroms: DataFrame, path: str, text: str | None = None) -> None:
    """One file beside the driver, in the order of chromosomes and starts: tasks make the blocks, the driver appends them.

    Rows with a ``record`` (read with keep) are written as they were, those with a ``line`` of SAM in full; of others the name is ``*`` and
    bases and qualities are unknown. ``text``: the header; by default only the chromosomes.
    """
    if not path.endswith(".bam"):
        raise ValueError("the file's name must end in .bam")
    names = [(r.name, r.length) for r in chroms.orderBy("tid").collect()]
    tid = {n: i for i, (n, _) in enumerate(names)}
    columns = reads.columns
    at = {c: columns.index(c) for c in columns}
    record, line = at.get("record"), at.get("line")

    def body(r: tuple) -> bytes:
        if record is not None and r[record] is not None:
            return r[record]
        if line is not None and r[line] is not None:
            return encoded(r[line], tid)
        rname, pos, flag, mapq, n, mate, isize, cigar = (r[at[c]] for c in ("rname", "pos", "flag", "mapq", "l_qseq", "mate_rname", "isize", "cigar"))
        return _record(tid.get(rname, -1), pos, mapq, flag, tid.get(mate, -1), -1, isize, b"*", cigar, b"\xff" * ((n + 1) // 2), b"\xff" * n, n, b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = bytearray()
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = body(r)
                kept += struct.pack("<i", len(x)) + x
            yield pa.record_batch([pa.array([bgzf.compress(bytes(kept))], pa.binary())], ["data"])

    order = chroms.select(F.col("name").alias("rname"), F.col("tid").alias("_tid"))
    rows = reads.join(order, "rname", "left").orderBy(F.col("_tid").asc_nulls_last(), "pos").select(*columns)
    head = (text or "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in names)).encode()
    with open(path, "wb") as f:
        start = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(names))
        f.write(bgzf.compress(start + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in names)))
        for r in rows.mapInArrow(run, "data binary").toLocalIterator():
            f.write(r.data)
        f.write(bgzf.EOF)
