"""The sweep's inner loop: blocks packed by (chromosome, bin), and the depths of one bin after the other as arrays.

A block is six bytes: first and last offset within its bin, and its kind with the number of such blocks. A task holds the
running differences of a few bins, however many reads these have, and nothing of a bin that no region meets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from pileflow.functions.cigar import ENDING, located

Batches = Iterator[pa.RecordBatch]

#: Kinds of packed blocks: a deletion, an aligned block of a read that counts for the first depth only, one that counts for all, a read's hull.
GAP, ALIGNED, CLEAN, HULL = range(4)
#: Kinds of rows with places of their own: parts of the regions, of the flank, and hulls that cross a border of bins.
INSIDE, BESIDE, CROSSING = range(3)
#: Offsets take two bytes.
WIDEST = 1 << 16
#: Blocks that are packed at one time, blocks in a row, rows in a batch that is handed on, bytes of blocks and places of bins that are swept at one time.
PACKED, IN_ROW, ROWS, STEP, PLACES = 1 << 20, 1 << 12, 1 << 16, 1 << 22, 1 << 19
#: Such blocks in one record, which has 14 bits for it.
MOST = (1 << 14) - 1

PLACE = pa.struct([(c, pa.int32()) for c in ("s", "e", "start", "stop", "kind", "n")])
SCHEMA = "chrom string, bin int, data binary, place struct<s:int,e:int,start:int,stop:int,kind:int,n:int>"
RUNS = "chrom string, start int, stop int, s int, e int, inside boolean, beside boolean, raw long, rmdup long, cover long"
FACTS = "kind string, value long, cnt long, chrom string, start int, stop int"


def cut(first: np.ndarray, last: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut at borders of bins: (index, bin, first offset, last offset)."""
    low, high = first // bins, last // bins
    n = high - low + 1
    at = np.repeat(np.arange(len(first)), n)
    b = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, b, np.maximum(first[at] - b * bins, 0), np.minimum(last[at] - b * bins, bins - 1)


def pack(refskip: str, bins: int, hulls: bool) -> Callable[[Batches], Batches]:
    """Rows of (chrom, clean, pos, cigar) as rows of SCHEMA. ``hulls``: those of the reads as well; those over several bins come once for each, numbered, same ones of a step together."""
    ending, shown = np.frombuffer("".join(ENDING).encode(), np.uint8), np.frombuffer(b"M=XD", np.uint8)

    def run(batches: Batches) -> Batches:
        codes: dict[str, int] = {}
        held, across, count, task, seen = [], [], 0, TaskContext.get().partitionId(), 0

        def flush() -> Batches:
            nonlocal held, across, count, seen
            if held:
                yield from _packed(codes, *map(np.concatenate, zip(*held, strict=True)), bins)
            if across:
                hull, n = np.unique(np.concatenate(across), axis=0, return_counts=True)
                yield from _crossing(codes, hull, n, bins, task, seen)
                seen += len(hull)
            held, across, count = [], [], 0

        for b in batches:
            names = b.column(0).dictionary_encode()
            code = np.array([codes.setdefault(c, len(codes)) for c in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
            clean = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            row, letter, size, start = located(b.column(2), b.column(3), refskip)
            if hulls:
                there = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
                first = b.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[there]
                spans = np.bincount(row, np.where(np.isin(letter, ending), size, 0), b.num_rows).astype(np.int64)[there]
                last = first + np.maximum(spans, 1) - 1
                over = first // bins != last // bins
                if over.any():
                    across.append(np.stack([code[there][over], first[over], last[over]], axis=1))
                held.append((code[there][~over], first[~over], last[~over], np.full(int((~over).sum()), HULL)))
                count += len(there)
            show = np.isin(letter, shown)
            row, letter, size, start = row[show], letter[show], size[show], start[show]
            held.append((code[row], start, start + size - 1, np.where(letter == ord("D"), GAP, ALIGNED + clean[row])))
            count += len(row)
            if count >= PACKED:
                yield from flush()
        yield from flush()

    return run


def _crossing(codes: dict[str, int], hull: np.ndarray, n: np.ndarray, bins: int, task: int, seen: int) -> Batches:
    at, b, low, high = cut(hull[:, 1], hull[:, 2], bins)
    columns = (b * bins + low + 1, b * bins + high + 1, np.full(len(at), task), seen + at, np.full(len(at), CROSSING), n[at])
    place = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], fields=list(PLACE))
    yield from _handed(pa.array(list(codes), pa.string()).take(pa.array(hull[at, 0])), b, pa.nulls(len(at), pa.binary()), place)


def _packed(codes: dict[str, int], code: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray, bins: int) -> Batches:
    """One row for each (chrom, bin) of these blocks, or a few; same blocks are counted, not repeated."""
    at, b, low, high = cut(first, last, bins)
    if not len(at):
        return
    least = b.min()
    wide = int(b.max() - least) + 1
    group = code[at] * wide + (b - least)
    known = None
    if group.max() >= 1 << 28:
        known, group = np.unique(group, return_inverse=True)
    key, n = np.unique(group << 34 | low << 18 | high << 2 | kind[at], return_counts=True)
    if n.max() > MOST:
        times = -(-n // MOST)
        key, part = np.repeat(key, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        n = np.minimum(np.repeat(n, times) - part * MOST, MOST)
    group = key >> 34
    records = np.empty((len(key), 3), np.uint16)
    records[:, 0], records[:, 1], records[:, 2] = key >> 18 & 0xFFFF, key >> 2 & 0xFFFF, n << 2 | key & 3
    new = np.r_[True, group[1:] != group[:-1]]
    begin = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.r_[begin, len(key)]))
    begin = np.flatnonzero(nth % IN_ROW == 0)
    group = group[begin] if known is None else known[group[begin]]
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.r_[begin, len(key)] * 6).astype(np.int32)), pa.py_buffer(records)])
    yield from _handed(pa.array(list(codes), pa.string()).take(pa.array(group // wide)), group % wide + least, data, pa.nulls(len(begin), PLACE))


def _handed(chrom: pa.Array, b: np.ndarray, data: pa.Array, place: pa.Array) -> Batches:
    made = pa.record_batch([chrom, pa.array(b.astype(np.int32)), data, place], ["chrom", "bin", "data", "place"])
    for i in range(0, made.num_rows, ROWS):
        yield made.slice(i, ROWS)


@dataclass
class Bins:
    """Some bins that regions meet. ``diffs``: (depth, bin, place) changes of the three depths, one place more than a bin has.

    ``places``: columns s, e (offsets), start, stop, kind, n of what has a place in them, ``group`` the bin of each.
    """

    chrom: np.ndarray
    bin: np.ndarray
    diffs: np.ndarray
    places: np.ndarray
    group: np.ndarray

    def flat(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``places`` of a kind in order, with their first place and the one after their last as indices over all bins."""
        row = np.flatnonzero(self.places[:, 4] == kind)
        at = self.group[row] * self.diffs.shape[2]
        first, after = at + self.places[row, 0], at + self.places[row, 1] + 1
        order = np.lexsort((self.places[row, 3], self.places[row, 2], first))
        return row[order], first[order], after[order]

    def covered(self, kind: int) -> np.ndarray:
        """Whether parts of a kind hold a place."""
        _, first, after = self.flat(kind)
        n = self.diffs.shape[1] * self.diffs.shape[2]
        return np.cumsum(np.bincount(first, minlength=n) - np.bincount(after, minlength=n)) > 0

    def runs(self) -> dict[str, np.ndarray]:
        """Runs of equal depth in parts of regions; s, e are indices over all bins. ``row``: the part of the regions it lies in, if inside."""
        wide = self.diffs.shape[2]
        inside, beside = self.covered(INSIDE), self.covered(BESIDE)
        edge = (self.diffs != 0).any(axis=0)
        edge[:, 0] = edge[:, -1] = True
        edge = edge.ravel()
        for kind in (INSIDE, BESIDE):
            _, first, after = self.flat(kind)
            edge[first] = edge[after] = True
        at = np.flatnonzero(edge)
        held = (inside | beside)[at[:-1]]
        s, e = at[:-1][held], at[1:][held] - 1
        depth = np.cumsum(self.diffs, axis=2).reshape(3, -1)[:, s].astype(np.int64)
        row, first, _ = self.flat(INSIDE)
        inside = inside[s]
        part = row[np.searchsorted(first, s, side="right") - 1] if len(row) else np.zeros(len(s), np.int64)
        return {"group": s // wide, "s": s, "e": e, "inside": inside, "beside": beside[s], "row": part, "raw": depth[0], "rmdup": depth[1], "cover": depth[2]}


def _differences(records: np.ndarray, group: np.ndarray, groups: int, bins: int) -> np.ndarray:
    first, after = group * (bins + 1) + records[:, 0], group * (bins + 1) + records[:, 1] + 1
    kind, n = records[:, 2] & 3, (records[:, 2] >> 2).astype(np.float64)
    size, out = groups * (bins + 1), []
    for counts in ((kind == ALIGNED) | (kind == CLEAN), kind == CLEAN, kind != HULL):
        out.append(np.bincount(first[counts], n[counts], size) - np.bincount(after[counts], n[counts], size))
    return np.stack(out).astype(np.float64, copy=False).reshape(3, groups, bins + 1)  # sums of nothing are whole numbers


def _pieces(batches: Batches) -> Batches:
    """Batches in slices of about STEP bytes of blocks; none is empty."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // STEP
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)


def swept(batches: Batches, bins: int, hit: Callable[[Bins, np.ndarray, np.ndarray], None] | None = None) -> Iterator[Bins]:
    """Bins one after the other from rows of SCHEMA that are sorted by chrom and bin, those with a place first. ``hit`` is given the packed hulls."""
    most, held = max(1, PLACES // bins), None
    for b in _pieces(batches):
        names = b.column(0).dictionary_encode()
        code, number = names.indices.to_numpy(), b.column(1).to_numpy()
        new = np.r_[True, (code[1:] != code[:-1]) | (number[1:] != number[:-1])]
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        chrom = np.array(names.dictionary.to_pylist(), object)[code[begin]]
        number = number[begin].astype(np.int64)
        same = held is not None and held.chrom[0] == chrom[0] and held.bin[0] == number[0]
        if held is not None and not same:
            yield held
            held = None
        own = np.flatnonzero(b.column(2).is_null().to_numpy(zero_copy_only=False))
        place = b.column(3).take(pa.array(own))
        places = np.stack([place.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(PLACE))], axis=1)
        where = group[own]
        places[:, :2] -= (number[where] * bins + 1)[:, None]
        ends = np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset :][: b.num_rows + 1].astype(np.int64)
        records = np.frombuffer(b.column(2).buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, 6).view(np.uint16)
        met = np.zeros(len(begin), bool)
        met[where[places[:, 4] != CROSSING]] = True
        met[0] |= same
        of = np.repeat(group, np.diff(ends) // 6)
        records, of = records[met[of]], of[met[of]]
        live = np.flatnonzero(met)
        last, held = held, None
        for i in range(0, len(live), most):
            these = live[i : i + most]
            a, z = np.searchsorted(of, [these[0], these[-1] + 1])
            mine = np.flatnonzero(np.isin(where, these))
            at = np.searchsorted(these, of[a:z])
            made = Bins(chrom[these], number[these], _differences(records[a:z], at, len(these), bins), places[mine], np.searchsorted(these, where[mine]))
            if last is not None and i == 0:
                made.diffs[:, 0] += last.diffs[:, 0]
                made.places, made.group = np.concatenate([last.places, made.places]), np.concatenate([last.group, made.group])
            if hit is not None:
                hull = records[a:z, 2] & 3 == HULL
                hit(made, records[a:z][hull], at[hull])
            if these[-1] < len(begin) - 1:
                yield made
                continue
            # the batch's last bin may go on in the next one
            n = len(these) - 1
            if n:
                yield Bins(made.chrom[:n], made.bin[:n], made.diffs[:, :n], made.places[made.group < n], made.group[made.group < n])
            held = Bins(made.chrom[n:], made.bin[n:], made.diffs[:, n:].copy(), made.places[made.group == n], np.zeros(int((made.group == n).sum()), np.int64))
    if held is not None:
        yield held


def as_runs(bins: int) -> Callable[[Batches], Batches]:
    """Rows of RUNS."""

    def run(batches: Batches) -> Batches:
        for x in swept(batches, bins):
            r = x.runs()
            low = x.bin[r["group"]] * bins + 1 - r["group"] * (bins + 1)
            start, stop = (pa.array(x.places[r["row"], c].astype(np.int32), mask=~r["inside"]) if len(x.places) else pa.nulls(0, pa.int32()) for c in (2, 3))
            columns = [pa.array(x.chrom, pa.string()).take(pa.array(r["group"])), start, stop, *[pa.array((r[c] + low).astype(np.int32)) for c in ("s", "e")], *[pa.array(r[c]) for c in ("inside", "beside", "raw", "rmdup", "cover")]]
            yield pa.record_batch(columns, ["chrom", "start", "stop", "s", "e", "inside", "beside", "raw", "rmdup", "cover"])

    return run


def as_facts(bins: int) -> Callable[[Batches], Batches]:
    """Rows of FACTS: places by depth (tgt, rmdup, flk), whole regions by whole mean depth (reg), reads that meet them (n_tgt, n_flk), and what only
    several tasks know together: sum and places of a region's part (part), reads over several bins by number (hit_tgt, hit_flk)."""

    def run(batches: Batches) -> Batches:
        counts: dict[str, Counter] = {k: Counter() for k in ("tgt", "rmdup", "flk", "reg")}
        reads = Counter()

        def hit(x: Bins, hulls: np.ndarray, group: np.ndarray) -> None:
            if not len(hulls):
                return
            at = group * (bins + 1)
            for kind, name in ((INSIDE, "n_tgt"), (BESIDE, "n_flk")):
                upto = np.r_[0, np.cumsum(x.covered(kind))]
                reads[name] += int((hulls[:, 2] >> 2)[upto[at + hulls[:, 1] + 1] > upto[at + hulls[:, 0]]].sum(dtype=np.int64))

        for x in swept(batches, bins, hit):
            r = x.runs()
            n = r["e"] - r["s"] + 1
            for name, kind, depth in (("tgt", "inside", "cover"), ("rmdup", "inside", "rmdup"), ("flk", "beside", "raw")):
                _add(counts[name], r[depth][r[kind]], n[r[kind]])
            row, size = r["row"][r["inside"]], len(x.places)
            places = np.bincount(row, n[r["inside"]], size).astype(np.int64)
            total = np.bincount(row, (r["raw"] * n)[r["inside"]], size).astype(np.int64)
            whole = (places > 0) & (places == x.places[:, 3] - x.places[:, 2])
            _add(counts["reg"], np.floor(total[whole] / places[whole]).astype(np.int64), np.ones(int(whole.sum()), np.int64))
            part = np.flatnonzero((places > 0) & ~whole)
            if len(part):
                yield _facts("part", total[part], places[part], pa.array(x.chrom[x.group[part]], pa.string()), *[pa.array(x.places[part, c].astype(np.int32)) for c in (2, 3)])
            over, first, after = x.flat(CROSSING)
            for kind, name in ((INSIDE, "hit_tgt"), (BESIDE, "hit_flk")) if len(over) else ():
                upto = np.r_[0, np.cumsum(x.covered(kind))]
                met = over[upto[after] > upto[first]]
                yield _facts(name, x.places[met, 2] << 32 | x.places[met, 3], x.places[met, 5])
        for name, c in counts.items():
            yield _facts(name, np.array(list(c), np.int64), np.array(list(c.values()), np.int64))
        for name, c in reads.items():
            yield _facts(name, np.zeros(1, np.int64), np.array([c], np.int64))

    return run


def _add(counts: Counter, value: np.ndarray, n: np.ndarray) -> None:
    """Counts by value, all of them whole numbers at least 0."""
    if not len(value):
        return
    if value.max() < PLACES:
        total = np.bincount(value, n)
        known = np.flatnonzero(total)
        total = total[known]
    else:
        known, at = np.unique(value, return_inverse=True)
        total = np.bincount(at, n)
    for v, c in zip(known.tolist(), total.astype(np.int64).tolist(), strict=True):
        counts[v] += c


def _facts(kind: str, value: np.ndarray, n: np.ndarray, *region: pa.Array) -> pa.RecordBatch:
    region = region or [pa.nulls(len(value), t) for t in (pa.string(), pa.int32(), pa.int32())]
    return pa.record_batch([pa.array([kind] * len(value), pa.string()), pa.array(value), pa.array(n), *region], ["kind", "value", "cnt", "chrom", "start", "stop"])
