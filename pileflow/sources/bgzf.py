"""Block-gzip: framing, reading and writing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most input bytes in a block.
BLOCK = 0xFF00
# Fixed value: the empty block that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def compress(data: bytes, level: int = 6) -> bytes:
    """Framed blocks of the data, without the ending block."""
    out = []
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04" + struct.pack("<IBBHBBHH", 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def blocks(f) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, data) of each block of an open binary file, from where it stands."""
    while True:
        at, head = f.tell(), f.read(12)
        if len(head) < 12:
            if head:
                raise ValueError("truncated block")
            return
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-gzip file")
        extra = f.read(struct.unpack("<H", head[10:12])[0])
        size, i = None, 0
        while i + 4 <= len(extra):
            n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("block without its size")
        rest = f.read(size - 12 - len(extra))
        if len(rest) < size - 12 - len(extra):
            raise ValueError("truncated block")
        yield at, zlib.decompress(rest[:-8], -15)


def find(f, begin: int) -> int | None:
    """Where the first block from ``begin`` on starts: a place that looks like one and is followed by another, or by the end."""
    f.seek(begin)
    at, data = begin, f.read(1 << 18)
    while data:
        i = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= i <= len(data) - 18:
            if data[i + 12 : i + 14] == b"BC":
                size = struct.unpack_from("<H", data, i + 16)[0] + 1
                f.seek(at + i + size)
                after = f.read(4)
                if after in (b"", b"\x1f\x8b\x08\x04"):
                    return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(data) - 17)
        f.seek(at)
        data = f.read(1 << 18)
        if len(data) < 18:
            return None
    return None


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the lines of a partition."""
    kept = bytearray()
    for b in batches:
        for x in b.column(0).to_pylist():
            kept += x.encode() + b"\n"
        if len(kept) >= 16 * BLOCK:
            full = len(kept) // BLOCK * BLOCK
            yield pa.record_batch([pa.array([compress(bytes(kept[:full]))], pa.binary())], ["data"])
            del kept[:full]
    if kept:
        yield pa.record_batch([pa.array([compress(bytes(kept))], pa.binary())], ["data"])


def write_lines(rows: DataFrame, path: str, head: str = "") -> None:
    """One file beside the driver from a sorted table of one string column: tasks write and compress the blocks, the driver appends them in order."""
    with open(path, "wb") as f:
        f.write(compress(head.encode()))
        for r in rows.mapInArrow(_framed, "data binary").toLocalIterator():
            f.write(r.data)
        f.write(EOF)


class Writer:
    """A file of tab-separated rows that block-gzip tools can index."""

    def __init__(self, path: str) -> None:
        self.file, self.kept = open(path, "wb"), bytearray()

    def write(self, text: str) -> None:
        self.kept += text.encode()
        while len(self.kept) >= BLOCK:
            self.file.write(compress(bytes(self.kept[:BLOCK])))
            del self.kept[:BLOCK]

    def close(self) -> None:
        self.file.write(compress(bytes(self.kept)) + EOF)
        self.file.close()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()
