"""Secret scans through nested encodings: a worklist of layers, each rescanned and mapped back to the text place by place."""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, sliced

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds. Case is ignored for ASCII letters only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap signs without which no match can be.
_WORDS = ("passw", "secret", "token", "api")

# What shows a layer. All are found in one pass over the text, however long its runs are.
_URL_ONE = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_BLANK = re.compile(r"[ \t\r\n]+")
_PLAIN = str.maketrans("-_", "+/")
#: How compressed data may begin inside other bytes: gzip and zlib. Raw deflate has no sign and is tried at the beginning.
_COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Escapes that give the sign of the next one, over and over. More than LONG such levels differ only in how far the chain has come.
_CHAIN = re.compile(r"%((?:25)+)|\\((?:x5c)+|(?:x5C)+|(?:u005c)+|(?:u005C)+)")
LONG = 64
#: Bytes of a compressed layer that unfold at a time; pieces end where no match and no inner layer can go on.
PIECE = 1 << 20
#: UTF-16 as it may lie in other bytes: order, and at which of two bytes.
WIDE = [("utf-16-le", 0), ("utf-16-be", 0), ("utf-16-le", 1), ("utf-16-be", 1)]
_PRINTED = "".join(map(chr, range(0x21, 0x7F)))
_OPEN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*(?:[:=]\x20*["']?)?\Z""", re.ASCII | re.IGNORECASE)

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Spans of one layer, leftmost and non-overlapping by kind, in order of start and kind."""
    found: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, z) for a, k, z in sorted(found)]


@dataclass(eq=False)
class Layer:
    """A decoded text, the stretch of its parent that it comes from, and how its characters lie in that stretch."""

    text: str
    parent: Layer | None = None
    begin: int = 0
    end: int = 0
    edges: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None  # where each character begins and ends; None: all of it stands for the stretch
    _known: tuple[np.ndarray, np.ndarray] | None = None

    def span(self, a: int, z: int) -> tuple[int, int]:
        """The stretch of the outermost text behind characters a to z."""
        if self.parent is None:
            return a, z
        if self.edges is None:
            return self.parent.span(self.begin, self.end)
        if self._known is None:
            self._known = self.edges()
        first, last = self._known
        return self.parent.span(self.begin + int(first[a]), self.begin + int(last[z - 1]))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _utf8_bytes(text: str) -> np.ndarray:
    """Where in decoded bytes each character begins, and where the last ends; surrogates stand for one byte each."""
    c = _points(text)
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000) - 2 * ((c >= 0xDC80) & (c < 0xDD00))
    return np.concatenate([[0], np.cumsum(n)])


def _utf16_bytes(text: str, start: int, size: int) -> np.ndarray:
    return np.minimum(size, start + np.concatenate([[0], np.cumsum(2 + 2 * (_points(text) >= 0x10000))]))


def _texts(data: bytes, at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[str, Callable]]:
    """Decoded bytes as text, each with its edges, if ``at`` tells where bytes begin and end. Bytes that aren't UTF-8 become
    surrogates, which match nothing; with NULs also read as UTF-16."""
    if data:
        text = data.decode("utf-8", "surrogateescape")
        yield text, lambda: at(_utf8_bytes(text))
    if 0 in data:
        for wide, start in WIDE:
            other = data[start:].decode(wide, "replace")
            yield other, lambda other=other, start=start: at(_utf16_bytes(other, start, len(data)))


def _inflated(data: bytes | memoryview, kind: int) -> Iterator[bytes]:
    """Pieces of gzip or zlib (47) or raw deflate (-15) data to its end, all members of it; none if it isn't such data."""
    rest: bytes | memoryview = data
    while len(rest):
        d, more = zlib.decompressobj(kind), True
        try:
            while more:
                piece = d.decompress(rest, PIECE)
                rest = d.unconsumed_tail
                if piece:
                    yield piece
                more = not d.eof and (len(rest) > 0 or len(piece) == PIECE)
        except zlib.error:
            return
        rest = d.unused_data


def _break(text: str) -> int:
    """The last place behind which a new piece can begin: no stretch of printed characters and no assignment spans it."""
    at = len(text.rstrip(_PRINTED))
    while m := _OPEN.search(text[:at]):
        at = len(text[: m.start()].rstrip(_PRINTED))
    return at


def _pieces(data: bytes | memoryview, zipped: int, kind: str = "utf-8", skip: int = 0) -> Iterator[str]:
    """The text of unfolded data piece by piece, to its end. Bytes that aren't UTF-8 become surrogates, which match nothing; with NULs
    the data is read as UTF-16 as well."""
    decode, held, most, nul = codecs.getincrementaldecoder(kind)("surrogateescape" if kind == "utf-8" else "replace"), "", PIECE, False
    start = skip
    for piece in _inflated(data, zipped):
        nul, n = nul or 0 in piece, len(piece)
        held += decode.decode(piece[skip:])
        skip = max(0, skip - n)
        if len(held) >= most:
            at = _break(held)
            if at:
                yield held[:at]
                held = held[at:]
            most = max(PIECE, 2 * len(held))
    if held:
        yield held
    if nul and kind == "utf-8" and not start:
        for wide, first in WIDE:
            yield from _pieces(data, zipped, wide, first)


def _url(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its escaped bytes in place."""
    text = layer.text
    if "%" not in text or not _URL_ONE.search(text):
        return
    data = unquote_to_bytes(text.encode("utf-8", "surrogatepass"))

    def at(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        inside = np.zeros(len(raw), bool)
        for m in re.finditer(rb"%[0-9A-Fa-f]{2}", raw):
            inside[m.start() + 1 : m.end()] = True
        first = np.append(np.flatnonzero(~inside), len(raw))  # where each decoded byte begins in the raw bytes
        points = _points(text)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        char = np.append(np.repeat(np.arange(len(text)), size), len(text))
        place = char[first[byte]]
        return place[:-1], np.maximum(place[1:], place[:-1] + 1)

    yield from (Layer(inner, layer, 0, len(text), edges) for inner, edges in _texts(data, at))


def _char(m: re.Match) -> str:
    n = int(m[1] or m[2] or m[3], 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def _unicode(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its escaped characters in place."""
    text = layer.text
    if "\\" not in text or not _UNICODE_ONE.search(text):
        return

    def edges() -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(text), bool)
        for m in _UNICODE_ONE.finditer(text):
            inside[m.start() + len(_char(m)) : m.end()] = True
        first = np.flatnonzero(~inside)
        return first, np.append(first[1:], len(text))

    yield Layer(_UNICODE_ONE.sub(_char, text), layer, 0, len(text), edges)


def _chains(layer: Layer) -> list[tuple[int, int, int]]:
    """(first place behind the sign, length of a repeat, repeats) of escapes of their own sign, if these are all escapes of the layer and
    each has more than LONG repeats; otherwise none."""
    if "%" not in layer.text and "\\" not in layer.text:
        return []
    found = [(m.start() + 1, n := 2 if m[1] else 5 if m[2][0] == "u" else 3, (m.end() - m.start() - 1) // n) for m in _CHAIN.finditer(layer.text)]
    if not found or min(k for _, _, k in found) < LONG + 8 or len({layer.text[a - 1] for a, _, _ in found}) > 1:
        return []
    escapes = [m.start() + 1 for one in (_URL_ONE, _UNICODE_ONE) for m in one.finditer(layer.text)]
    return found if sorted(escapes) == [a for a, _, _ in found] else []


def _levels(layer: Layer, chains: list[tuple[int, int, int]], k: int) -> Layer:
    """The layer k levels further down: k repeats less in each chain, whose sign stands for them."""
    text, at, parts = layer.text, 0, []
    for a, n, _ in chains:
        parts.append((at, a))
        at = a + n * k
    parts.append((at, len(text)))

    def edges() -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate([np.arange(a, z) for a, z in parts])
        return first, np.append(first[1:], len(text))

    return Layer("".join(text[a:z] for a, z in parts), layer, 0, len(text), edges)


def _long_chains(layer: Layer, chains: list[tuple[int, int, int]]) -> tuple[set[Span], Layer]:
    """(spans of all levels but the last LONG or so, the level behind them).

    At these levels only the chains' beginnings differ, and four levels on base64 has the same alignment again. So four levels are worked
    on, and what they hold stands in all others with the places inside chains moved on.
    """
    skip = (min(k for _, _, k in chains) - LONG) // 4 * 4
    found: set[Span] = set()
    whole = Layer(layer.text)
    for j in range(4):
        level = _levels(whole, chains, j)
        spans = {(kind, *level.span(a, z)) for kind, a, z in scan(level.text)} | _explored([_base64(level)])
        for kind, a, z in spans:
            move_a, move_z = (sum(n for b, n, k in chains if b <= x < b + n * k) for x in (a, z - 1))
            for t in range(0, skip, 4) if move_a or move_z else (0,):
                found.add((kind, *layer.span(a + move_a * t, z + move_z * t)))
    return found, _levels(layer, chains, skip)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Each stretch of the alphabet, over line breaks too, at all four alignments, since other signs of the alphabet may stand before it."""
    for m in _BASE64.finditer(layer.text):
        body, kept = m[0].rstrip("="), None
        if _BLANK.search(body):
            body = _BLANK.sub("", body)
            kept = lambda m=m: np.array([i for i, c in enumerate(m[0]) if c not in " \t\r\n"])
        body = body.translate(_PLAIN)
        for off in range(4):
            part = body[off:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))

            def at(byte: np.ndarray, off: int = off, kept: Callable | None = kept) -> tuple[np.ndarray, np.ndarray]:
                first, last = off + byte[:-1] * 8 // 6, off + (byte[1:] * 8 - 1) // 6
                if kept:
                    where = kept()
                    first, last = where[first], where[last]
                return first, last + 1

            # compressed data stand for the whole stretch; bytes that only happen to begin like them are scanned as they are, too
            for z in [x.start() for x in _COMPRESSED.finditer(data)]:
                yield from (Layer(t, layer, m.start(), m.end(), None) for t in _pieces(memoryview(data)[z:], 47))
            if off == 0:
                yield from (Layer(t, layer, m.start(), m.end(), None) for t in _pieces(data, -15))
            yield from (Layer(t, layer, m.start(), m.end(), edges) for t, edges in _texts(data, at))


def _below(layer: Layer) -> Iterator[Layer]:
    """All layers right under one, however deep it lies."""
    yield from _url(layer)
    yield from _unicode(layer)
    yield from _base64(layer)


def _explored(work: list[Iterator[Layer]]) -> set[Span]:
    """Spans of all layers that are given and those below them."""
    found, seen = set(), set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if not layer.text:
            continue
        where = layer.parent.span(layer.begin, layer.end) if layer.parent else (0, len(layer.text))
        if (key := (where, hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())) in seen:
            continue
        seen.add(key)
        if chains := _chains(layer):
            spans, layer = _long_chains(layer, chains)
            found |= spans
        found.update((kind, *layer.span(a, z)) for kind, a, z in scan(layer.text))
        work.append(_below(layer))
    return found


def secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(spans of the text itself, all spans): those found in a decoded layer are given as the encoded characters behind them.

    Layers wait in a list until none is left, those of one layer unmade until their turn. A layer that decodes to one already seen at the same stretch is a cycle and ends.
    """
    text = text or ""
    base = scan(text)
    if "%" not in text and "\\" not in text and max(map(len, text.split()), default=0) < 16:
        return base, base
    top = Layer(text)
    found = set(base) | _explored([iter([top]) if _chains(top) else _below(top)])
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; counts and digest are of the undecoded text.

    Null texts count as empty; repeated rows stay, null ids too, and an empty table gives no rows; texts of any length are scanned whole, in time
    linear in them for each layer. One scan in Arrow batches, no shuffle.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Batches) -> Batches:
        for b in sliced(batches, 1):
            n, digest, spans = [[], [], []], [], []
            for t in b.column(1):
                base, every = secrets(t.as_py())
                for k, name in enumerate(KINDS):
                    n[k].append(sum(s[0] == name for s in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.record_batch([b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(digest), pa.array(spans)], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows. Texts without secrets stay as they are."""
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def clean(text: str | None) -> str | None:
        out, to = [], 0
        for a, z in sorted((a, z) for _, a, z in secrets(text)[1]):
            if a >= to:
                out += [text[to:a], mark]
            to = max(to, z)
        return text if not out else "".join([*out, text[to:]])

    def run(batches: Batches) -> Batches:
        for b in sliced(batches, at):
            old = b.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if chars >= 0:
                was = b.column(chars).to_pylist()
                columns[chars] = pa.array([n if a is b_ else len(b_) for n, a, b_ in zip(was, old, new, strict=True)], b.schema.field(chars).type)
            yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, docs.schema)
