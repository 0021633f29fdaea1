"""Exact Jaccard join of word shingles by set-relation skipping.

Prefix filters over a global order give index lists; in a list, blocks are skipped by size, by position and by known
components; signatures rule most pairs out before any text moves; and a set's answers are derived from those that a highly
similar set has got already, by what the two differ in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pileflow.llm.bloom import bloom
from pileflow.llm.common import Batches, Workspace, guarded, mixed, partitions, runs, sliced, word_hashes
from pileflow.llm.components import Forest, components

WORDS, PERCENT = 5, 75
#: Stars join near copies before their pairs are listed: in the lists of a set's LAST most frequent prefix shingles it is
#: paired with the HUBS members that hold the shingle at the earliest position, those with the least of their own.
LAST, HUBS = 12, 4
#: One of so many documents is asked which shingles are frequent; the list of those is bounded and orders, never decides.
SAMPLE, OFTEN, ORDERED, SAMPLE_BUCKETS = 8, 2, 1 << 21, 1024
#: Rows of an index list that are compared at once, and pairs that are handed on at once.
BLOCK, FLUSH = 256, 1 << 18
#: Index entries of a bucket; expected members beyond which a list is dealt to several tasks.
ENTRIES, CROWD = 1 << 19, 1 << 16
#: Bytes of hashed sets that one task checks, and pairs of one set that are checked in one place.
CHECK_BYTES, TOGETHER = 1 << 26, 64


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole sequence if it has fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Smallest intersection of sets of these sizes that links them."""
    return -((a + b) * -percent // (100 + percent))


def node(s: np.ndarray) -> int:
    """One 63-bit number for equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def signature(s: np.ndarray) -> bytes:
    """For each of about as many bits as there are shingles, whether an odd number of them falls on it."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The bits in which two signatures differ: at most as many as there are shingles that only one of the sets has."""
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    for k in range((8 * len(a) // bits).bit_length() - 1, 0, -1):
        x = (x >> (bits << k - 1)) ^ (x & ((1 << (bits << k - 1)) - 1))
    for k in range((8 * len(b) // bits).bit_length() - 1, 0, -1):
        y = (y >> (bits << k - 1)) ^ (y & ((1 << (bits << k - 1)) - 1))
    return (x ^ y).bit_count()


@dataclass
class Order:
    """What the sample says of frequent shingles, by the upper half of their hashes: how often they occur, in how many parts their lists are dealt."""

    often: np.ndarray
    rank: np.ndarray
    crowd: int

    def places(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, parts) of each."""
        if not len(self.often):
            return np.zeros(len(short), np.int64), np.ones(len(short), np.int64)
        at = np.minimum(np.searchsorted(self.often, short), len(self.often) - 1)
        count = np.where(self.often[at] == short, self.rank[at], 0)
        return count, np.maximum(1, -(-count * SAMPLE // self.crowd))


def ordered(s: np.ndarray, order: Order, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(prefix of a set, parts of each shingle's list): rare shingles by hash, then the frequent ones, most frequent last."""
    count, parts = order.places((s >> np.uint64(32)).astype(np.uint32))  # sets are sorted, so these are too
    at = np.lexsort((s, count))[: len(s) + (len(s) * -percent // 100) + 1]
    return s[at], parts[at]


def packed(nodes: np.ndarray, sizes: np.ndarray, prefixes: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Index entries (node, size, shingle, position) dealt to buckets of shingles; a long list's members to a bucket for each of its parts."""
    many = np.array([len(p) for p, _ in prefixes])
    s, parts = (np.concatenate(x) for x in zip(*prefixes, strict=True))
    owner = np.repeat(np.arange(len(prefixes)), many)
    place = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
    home = (s & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
    home += np.where(parts > 1, buckets * (1 + nodes[owner] % parts), 0)
    order = np.argsort(home, kind="stable")
    keys, starts = np.unique(home[order], return_index=True)
    data = []
    for a, z in zip(starts, np.append(starts[1:], len(order)), strict=True):
        at = order[a:z]
        who, each = np.unique(owner[at], return_counts=True)
        data.append((nodes[who].tobytes(), sizes[who].astype(np.int32).tobytes(), each.astype(np.int32).tobytes(), (s[at] >> np.uint64(32)).astype(np.uint32).tobytes(), place[at].astype(np.int32).tobytes()))
    return pa.record_batch([pa.array(keys, pa.int64()), *[pa.array([d[j] for d in data], pa.binary()) for j in range(5)]], ENTRY)


ENTRY = ["key", "nodes", "sizes", "each", "shingles", "places"]
ENTRIES_SCHEMA = "key long, nodes binary, sizes binary, each binary, shingles binary, places binary"


def _flat(t: pa.Table, columns: list[str], kinds: list[type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in zip(columns, kinds, strict=True)]


def _starts(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], s[1:] != s[:-1]])


LIST = ["a", "b", "home", "bucket", "list", "parts", "node", "size", "shingles", "places"]
LIST_SCHEMA = "a long, b long, home long, bucket long, list long, parts int, node long, size int, shingles binary, places binary"


def lists(t: pa.Table, order: Order, buckets: int, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """From the entries of one bucket: pairs of stars (a, b, home), and what remains of the index.

    Stars are sets and the hubs of their last lists, as many pairs as there are sets at most, times LAST and HUBS; home is
    the set, not the hub. They only save work. Lists of one set can't link anything and go, unless they are a part of a longer one, whose rows stand alone with their shingle in ``list``.
    """
    key = t.column(0)[0].as_py()
    nodes, sizes, each, s, place = _flat(t, ENTRY[1:], [np.int64, np.int32, np.int32, np.uint32, np.int32])
    nodes, sizes, place = np.repeat(nodes, each), np.repeat(sizes, each).astype(np.int64), place.astype(np.int64)
    by = np.lexsort((nodes, place, s))
    nodes, sizes, s, place = nodes[by], sizes[by], s[by], place[by]
    # copies of one set have it in one place, so they follow each other
    keep = _starts(s) | np.concatenate([[True], nodes[1:] != nodes[:-1]])
    nodes, sizes, s, place = nodes[keep], sizes[keep], s[keep], place[keep]
    begin = _starts(s)
    start = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    many = np.bincount(start, minlength=len(s))[start]
    last = place >= sizes + sizes * -percent // 100 + 1 - LAST
    pairs = [np.empty((3, 0), np.int64)]
    for k in range(HUBS):
        i = np.flatnonzero(last & (start + k < np.arange(len(s))))
        hub = start[i] + k
        fits = np.minimum(sizes[i], sizes[hub]) >= needed(sizes[i], sizes[hub], percent)
        i, hub = i[fits], hub[fits]
        pairs.append(np.concatenate([np.sort(np.stack([nodes[i], nodes[hub]]), 0), nodes[i][None]]))
    a, b, home = np.unique(np.concatenate(pairs, 1), axis=1)
    none = lambda n, kinds: [pa.nulls(n, k) for k in kinds]
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(home), *none(len(a), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])], LIST)
    split = key >= buckets
    at = np.flatnonzero((many > 1) | split)
    if not len(at):
        return
    # one row for each set, or in a dealt list for each set and shingle
    at = at[np.lexsort((s[at], nodes[at]))]
    first = _starts(nodes[at]) | (np.concatenate([[True], s[at][1:] != s[at][:-1]]) if split else False)
    rows = at[first]
    ends = np.append(np.flatnonzero(first), len(at))
    cut = lambda x: pa.array([x[at[u:z]].tobytes() for u, z in zip(ends, ends[1:], strict=False)], pa.binary())
    n = len(rows)
    parts = order.places(s[rows])[1] if split else np.ones(n, np.int64)
    yield pa.record_batch(
        [*none(n, [pa.int64()] * 3), pa.array(np.full(n, key % buckets)), pa.array(s[rows].astype(np.int64) if split else np.full(n, -1)), pa.array(parts.astype(np.int32)), pa.array(nodes[rows]), pa.array(sizes[rows].astype(np.int32)), cut(s.astype(np.uint32)), cut(place.astype(np.int32))], LIST
    )


def candidates(t: pa.Table, percent: int = PERCENT) -> Iterator[np.ndarray]:
    """(a, b) of one bucket, columns key, mine, node, comp, size, shingles, places: pairs that size and position leave possible and that aren't known to be
    together. ``mine`` tells the two parts of a dealt list apart that meet here; -1 where all meet all."""
    each = np.array([len(x) // 4 for x in t.column("shingles").to_pylist()])
    s, place = _flat(t, ["shingles", "places"], [np.uint32, np.int32])
    mine, who, comp, size = (np.repeat(t.column(c).to_numpy().astype(np.int64), each) for c in ("mine", "node", "comp", "size"))
    place = place.astype(np.int64)
    by = np.lexsort((who, size, s))
    who, comp, size, s, place, mine = (x[by] for x in (who, comp, size, s, place, mine))
    keep = _starts(s) | np.concatenate([[True], who[1:] != who[:-1]])
    who, comp, size, s, place, mine = (x[keep] for x in (who, comp, size, s, place, mine))

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = (most >= needed(size[i], size[j], percent)) & (comp[i] != comp[j]) & ((mine[i] < 0) | (mine[i] != mine[j]))
        return np.stack([who[i[ok]], who[j[ok]]])

    def distinct(pairs: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.sort(np.concatenate(pairs, 1), 0), axis=1)

    begin = np.flatnonzero(_starts(s))
    end = np.append(begin[1:], len(s))
    two = begin[end - begin == 2]
    pairs = [possible(two, two + 1)]
    waiting = pairs[0].shape[1]
    for a, z in zip(begin[end - begin > 2], end[end - begin > 2], strict=True):
        if comp[a] == comp[z - 1] and (comp[a:z] == comp[a]).all():
            continue
        blocks = np.arange(a, z, BLOCK)
        left = np.maximum.reduceat(size[a:z] - place[a:z], blocks - a)  # what a member can still share from here on
        low, high = np.minimum.reduceat(comp[a:z], blocks - a), np.maximum.reduceat(comp[a:z], blocks - a)
        for x, i in enumerate(blocks):
            i2 = min(z, i + BLOCK)
            # sizes ascend: blocks whose smallest member is too large for this block's largest are skipped, and all after
            last = a + int(np.searchsorted(size[a:z], 100 * size[i2 - 1] // percent, side="right"))
            js = np.arange(x, -(-(last - a) // BLOCK))
            near = np.minimum(left[x], left[js]) >= needed(int(size[i]), size[blocks[js]], percent)
            # blocks of one component have nothing to learn of each other
            near &= ~((low[x] == high[x]) & (low[js] == low[x]) & (high[js] == low[x]))
            for j in blocks[js[near]]:
                j2 = min(last, j + BLOCK)
                x1, y1 = np.nonzero((comp[i:i2, None] != comp[None, j:j2]) & (np.arange(i, i2)[:, None] < np.arange(j, j2)[None, :]))
                pairs.append(possible(i + x1, j + y1))
                waiting += pairs[-1].shape[1]
                if waiting > FLUSH:
                    yield distinct(pairs)
                    pairs, waiting = [], 0
    if waiting:
        yield distinct(pairs)


def links_of(pairs: pd.DataFrame, sets: dict[int, np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Pairs that do link, as a spanning forest: a pair that links before it have joined isn't looked at.

    Answers are derived: for x and y, where y differs little from a set z whose overlap with x is known, x shares with y at
    least what it shares with z less what only z has, and at most that and what only y has. Only where these bounds don't decide the sets are merged.
    """
    out_a, out_b = [], []
    number = {i: k for k, i in enumerate(sets)}
    forest = Forest(len(number))
    known: dict[tuple[int, int], tuple[int, int]] = {}  # bounds of overlaps
    like: dict[int, tuple[int, int, int]] = {}  # a similar set, what only that has, what only this one has

    def derived(x: int, y: int) -> tuple[int, int]:
        z, theirs, own = like[y]
        low, high = known.get((x, z) if x < z else (z, x), (0, 1 << 62))
        return low - theirs, high + own

    for a, b in zip(pairs.a, pairs.b, strict=True):
        n, m = len(sets[a]), len(sets[b])
        need = needed(n, m, percent)
        if min(n, m) < need or forest.find(number[a]) == forest.find(number[b]):
            continue
        low, high = 0, min(n, m)
        for x, y in ((a, b), (b, a)):
            if y in like and like[y][0] != x:
                l2, h2 = derived(x, y)
                low, high = max(low, l2), min(high, h2)
        if low < need <= high:
            low = high = overlap(sets[a], sets[b])
        known[(a, b) if a < b else (b, a)] = low, high
        if low >= need:
            forest.join(number[a], number[b])
            out_a.append(a)
            out_b.append(b)
            if low == high:
                like.setdefault(a, (b, m - low, n - low))
                like.setdefault(b, (a, n - low, m - low))
    return out_a, out_b


def checked(spark: SparkSession, space: Workspace, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b, home).

    Signatures come first, so that few pairs ask for texts. Only texts that are asked for are shuffled, to the tasks of
    their pairs: pairs of one home are checked together, and tasks are cut by the bytes of their sets.
    """
    sig = nodes.select("node", "n", "sig")
    pairs = pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b").select("a", "b", "home", "na", "nb", "sa", "sb")

    def screen(batches: Batches) -> Batches:
        for b in batches:
            na, nb = b.column(3).to_numpy(), b.column(4).to_numpy()
            most = na + nb - 2 * needed(na, nb)
            far = np.fromiter((apart(x, y) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns[:5], ["a", "b", "home", "na", "nb"]).filter(pa.array(far <= most))

    left = space.write(pairs.mapInArrow(screen, "a long, b long, home long, na long, nb long"), f"{name}_pairs")
    size = left.agg(F.count("*").alias("n"), F.sum(F.col("na") + F.col("nb")).alias("shingles")).first()
    tasks = max(partitions(spark), ceil(8 * (size.shingles or 0) / CHECK_BYTES))
    # a set with very many pairs is no place of its own
    groups = left.groupBy("home").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups"))
    dealt = left.join(groups, "home").select("a", "b", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("a", "b"), "groups")), F.lit(tasks)).cast("int").alias("task"))
    wanted = dealt.select(F.col("task").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node").select("key")
    sieve = bloom(keys, 2 * size.n)

    def pick(batches: Batches) -> Batches:
        told: set[int] = set()
        for b in sliced(batches, 1):
            rows = b.filter(pa.array(sieve.has(b.column(0).to_numpy())))
            who = [node(shingles(t.as_py())) for t in rows.column(1)]
            new = [i for i, k in enumerate(who) if not (k in told or told.add(k))]
            yield pa.record_batch([pa.array([who[i] for i in new], pa.int64()), rows.column(1).take(pa.array(new, pa.int64()))], ["node", "text"])

    texts = docs.select(F.xxhash64("doc_id").alias("key"), "text").where("text is not null").mapInArrow(pick, "node long, text string").join(wanted, "node").select("to", "node", "text")

    def check(key: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        sets = {i: shingles(text) for i, text in zip(t.node, t.text, strict=True)}
        a, b = links_of(p.sort_values(["a", "b"]), sets)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    out = dealt.repartition(tasks, "task").groupBy("task").cogroup(texts.repartition(tasks, "to").groupBy("to")).applyInPandas(check, "a long, b long")
    return space.write(out, f"{name}_links")


def _related(spark: SparkSession, space: Workspace, docs: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, node) of each row, (node, component_id) of each set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_shingles", "node", "sig", "bucket", "shingles"]

    def sets(batches: Batches) -> Batches:
        for b in sliced(batches, 1):
            found = [shingles(t.as_py()) for t in b.column(1)]
            nodes = np.array([node(s) for s in found], np.int64)
            sizes = np.array([len(s) for s in found], np.int64)
            signs = pa.array([signature(s) if len(s) else None for s in found], pa.binary())
            yield pa.record_batch([b.column(0), pa.array(sizes), pa.array(nodes), signs, *[pa.nulls(len(found), t) for t in (pa.int32(), pa.binary())]], names)
            picked = [i for i in np.flatnonzero(sizes) if mixed(nodes[i : i + 1].astype(np.uint64))[0] % np.uint64(SAMPLE) == 0]
            if picked:
                # as an order needs no exact counts, half of each hash will do
                flat = np.concatenate([(found[i] >> np.uint64(32)).astype(np.uint32) for i in picked])
                home = (flat % np.uint32(SAMPLE_BUCKETS)).astype(np.int64)
                by = np.argsort(home, kind="stable")
                keys, starts = np.unique(home[by], return_index=True)
                data = [flat[by[u:z]].tobytes() for u, z in zip(starts, np.append(starts[1:], len(by)), strict=True)]
                none = [pa.nulls(len(keys), t) for t in (b.column(0).type, pa.int64(), pa.int64(), pa.binary())]
                yield pa.record_batch([*none, pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names)

    made = space.write(docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, n_shingles long, node long, sig binary, bucket int, shingles binary"), "sets")
    own = made.where("bucket is null")
    nodes = own.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("sig").alias("sig"))
    nodes = space.write(nodes.withColumn("key", F.xxhash64("rep")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(spark), ceil(total * (100 - PERCENT) / 100 / ENTRIES))
    cells = max(partitions(spark), buckets // 4)

    def frequent(batches: Batches) -> Batches:
        for t in runs(batches):
            s, n = np.unique(_flat(t, ["shingles"], [np.uint32])[0], return_counts=True)
            top = np.flatnonzero(n >= OFTEN)
            top = top[np.argsort(-n[top], kind="stable")][: 2 * ORDERED // SAMPLE_BUCKETS]
            yield pa.record_batch([pa.array([s[top].tobytes()], pa.binary()), pa.array([n[top].astype(np.int64).tobytes()], pa.binary())], ["s", "n"])

    sample = made.where("bucket is not null").select("bucket", "shingles")
    got = sample.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(frequent, "s binary, n binary").collect()
    often = np.concatenate([np.frombuffer(r.s, np.uint32) for r in got] or [np.empty(0, np.uint32)])
    rank = np.concatenate([np.frombuffer(r.n, np.int64) for r in got] or [np.empty(0, np.int64)])
    by = np.argsort(often)
    order = Order(often[by], rank[by], crowd)

    def index(batches: Batches) -> Batches:
        told: set[int] = set()
        for b in sliced(batches, 0):
            found = {}
            for t in b.column(0):
                s = shingles(t.as_py())
                if len(s) and (i := node(s)) not in told:
                    told.add(i)
                    found[i] = s
            if found:
                yield packed(np.array(list(found), np.int64), np.array([len(s) for s in found.values()], np.int64), [ordered(s, order) for s in found.values()], buckets)

    def listed(batches: Batches) -> Batches:
        for t in runs(batches):
            yield from lists(t, order, buckets)

    entries = docs.select("text").where("text is not null").mapInArrow(index, ENTRIES_SCHEMA)
    made_lists = space.write(entries.repartition(cells, "key").sortWithinPartitions("key").mapInArrow(listed, LIST_SCHEMA), "lists")
    # first each set with the hubs of its lists, then all that these haven't joined
    star = made_lists.where("a is not null").groupBy("a", "b").agg(F.min("home").alias("home"))
    links = checked(spark, space, docs, nodes, star, "first")
    near = space.write(components(space, links, "near"), "near")
    rest = made_lists.where("a is null").join(near, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    rest = rest.withColumn("part", F.pmod("node", "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = F.xxhash64("bucket", "list", F.least("part", "other"), F.greatest("part", "other"))
    rest = rest.withColumns({"key": F.when(F.col("list") < 0, F.col("bucket")).otherwise(dealt), "mine": F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))})
    rest = rest.select("key", "mine", "node", "comp", "size", "shingles", "places")

    def paired(batches: Batches) -> Batches:
        for t in runs(batches):
            for p in candidates(t):
                yield pa.record_batch([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    pairs = rest.repartition(cells, "key").sortWithinPartitions("key").mapInArrow(paired, "a long, b long").distinct().withColumn("home", F.col("a"))
    more = checked(spark, space, docs, nodes, pairs, "more")
    space.drop("lists", "near", "first_pairs", "more_pairs")
    # components of nodes, named by their smallest document
    joined = components(space, links.unionByName(more), "all")
    labels = nodes.select("node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    return own.select("doc_id", "n_shingles", "node"), labels.join(least, "component").select("node", "component", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Null and blank texts have no shingles and are alone. Equal sets are one node, so copies are never paired. Repeated rows
    stay; rows that share an id are judged each by its own text. Rows with a null id link like others; a component of null ids only
    has a null component_id. An empty table gives no rows, and texts of any length are taken whole. Exact: orders,
    signatures, filters and rounds only save work.
    """
    space = Workspace(spark, "jaccard")
    own, labels = _related(spark, space, docs, crowd)
    out = own.where("n_shingles > 0").join(labels, "node").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(spark: SparkSession, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One document of each component, that of its smallest id (a null one only if there is no other), and every document without words. Columns as they are.

    Rows with one id and one text are one document. Rows that surely stay aren't shuffled: a bit filter holds the ids that go or are
    in doubt, and only rows that it lets through are looked up.
    """
    return guarded(docs, lambda d: _deduplicated(spark, d, crowd))


def _deduplicated(spark: SparkSession, docs: DataFrame, crowd: int) -> DataFrame:
    space = Workspace(spark, "dedup")
    own, labels = _related(spark, space, docs, crowd)
    rows = own.join(labels, "node", "left")
    # of each component, the set of its smallest id; sets without words each stay
    first = rows.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
    rows = rows.join(first, "component", "left")
    stays = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node")))
    judged = space.write(rows.groupBy("doc_id", "node").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "judged")
    per_id = judged.groupBy("doc_id").agg(F.min("stays").alias("stays"), F.sum("n").alias("n"))
    doubt = per_id.where("not stays or n > 1 or doc_id is null").select(F.xxhash64("doc_id").alias("key"))
    sieve = bloom(doubt, doubt.count())
    columns, at = docs.columns, docs.columns.index("text")
    i = len(columns)

    def sure(batches: Batches) -> Batches:
        for b in sliced(batches, at):
            yield pa.RecordBatch.from_arrays(b.columns[:i], columns).filter(pa.array(~sieve.has(b.column(i).to_numpy())))

    def unsure(batches: Batches) -> Batches:
        for b in sliced(batches, at):
            b = b.filter(pa.array(sieve.has(b.column(i).to_numpy())))
            nodes = [node(shingles(t.as_py())) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:i], pa.array(nodes, pa.int64())], [*columns, "_node"])

    keyed = docs.withColumn("_key", F.xxhash64("doc_id"))
    kept = judged.where("stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_n"))
    some = keyed.mapInArrow(unsure, StructType([*docs.schema.fields, StructField("_node", LongType())]))
    some = some.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_n")), "left_semi")
    # of rows with one id and one set any of the first text stays; texts without words that differ are documents of their own
    turn = Window.partitionBy("doc_id", "_node", F.when(F.col("_node") == node(shingles("")), F.col("text"))).orderBy("text")
    some = some.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").select(*columns)
    return keyed.mapInArrow(sure, docs.schema).unionByName(some)
