"""Near-duplicate vectors by spherical-cap filters: product codes, list decoding, a join on filters and a check of each pair."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, Workspace, partitions, runs
from pileflow.llm.components import components

#: Parts of a vector, code words of each part, and the filters that every vector gets at least.
PARTS, WORDS, LEAST = 4, 32, 24
#: In standard deviations of a filter's inner product: all filters above it take the vector.
CAP = 3.9
#: Rows of a cell that one task compares; larger cells are compared piece by piece.
CELL_ROWS = 16384
#: Vectors a cell, if they fell evenly: cells are named by so many parts of a filter that no more remain.
EVEN = 256
BLOCK, SMALL = 1024, 32
#: Vectors and code words are rounded to integers of this unit, so inner products are exact and the same in every task.
UNIT = 1 << 20
_NEVER = -float(1 << 50)


def codes(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(rotated code words, one column each, parts in turn; what is added to a word's product: words that repeat another are never taken)."""
    rng = np.random.default_rng((seed, dim))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    words, extra = [], np.zeros(PARTS * WORDS)
    for k, part in enumerate(np.array_split(np.arange(dim), PARTS)):
        w = rng.standard_normal((WORDS, max(1, len(part))))
        w = (turn[:, part] @ (w / np.linalg.norm(w, axis=1, keepdims=True))[:, : len(part)].T) if len(part) else np.zeros((dim, WORDS))
        w = np.rint(w * UNIT)
        again = np.setdiff1d(np.arange(WORDS), np.unique(w, axis=1, return_index=True)[1])
        extra[k * WORDS + again] = _NEVER
        words.append(w)
    return np.concatenate(words, 1), extra


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, each by itself."""
    x = np.ascontiguousarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def decode(x: np.ndarray, words: np.ndarray, extra: np.ndarray, cap: float = CAP, least: int = LEAST) -> list[np.ndarray]:
    """For each unit vector the numbers of all filters whose cap holds it, and of its ``least`` best ones.

    A filter is one word from each part; its inner product is the sum over parts. Halves are combined first, then only
    sums that can still reach the cap are looked at.
    """
    s = (np.rint(x * UNIT) @ words + extra).reshape(len(x), PARTS, WORDS)
    left = (s[:, 0, :, None] + s[:, 1, None, :]).reshape(len(x), -1)
    right = (s[:, 2, :, None] + s[:, 3, None, :]).reshape(len(x), -1)
    # a code word's product with a part of a random unit vector has variance 1 / dim, so the sum of all parts PARTS / dim
    bar = cap * np.sqrt(PARTS / x.shape[1]) * UNIT * UNIT
    out = []
    for a, b in zip(left, right, strict=True):
        ia, ib = np.argpartition(-a, least)[:least], np.argpartition(-b, least)[:least]
        best = np.partition((a[ia][:, None] + b[ib][None, :]).ravel(), -least)[-least]
        t = max(min(bar, best), _NEVER / 4)
        ia, ib = np.flatnonzero(a >= t - b.max()), np.flatnonzero(b >= t - a.max())
        i, j = np.nonzero(a[ia][:, None] + b[ib][None, :] >= t)
        out.append(np.sort(ia[i].astype(np.int64) * (WORDS * WORDS) + ib[j]))
    return out


def _owned(lists: list[np.ndarray], bucket: int, a: slice, b: slice) -> np.ndarray:
    """Whether no filter smaller than ``bucket`` holds both rows: each pair is counted in one bucket only."""
    lower = [x[x < bucket] for x in lists]
    every, counts = np.unique(np.concatenate([*lower[a], *lower[b]]) if lower else np.empty(0, np.int64), return_counts=True)
    every = every[counts > 1]
    if not len(every):
        return np.ones((a.stop - a.start, b.stop - b.start), bool)

    def marks(part: slice) -> np.ndarray:
        m = np.zeros((part.stop - part.start, len(every)), np.float32)
        for i, x in enumerate(lower[part]):
            at = np.searchsorted(every, x)
            at = at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == x)]
            m[i, at] = 1
        return m

    return marks(a) @ marks(b).T < 0.5


class Cell:
    """Vectors of one cell, or of two groups of a crowded one: compared by filter, with links counted and joined.

    Filters of a vector with a link are decoded anew, which is cheaper than sending all of them with every copy of it.
    """

    def __init__(self, t: pa.Table, cosine: float, cap: float, least: int) -> None:
        self.cosine, self.options = cosine, (cap, least)
        cell, one, two = (t.column(i)[0].as_py() for i in range(3))
        self.dim, self.across = cell >> 32, one != two
        self.mine, self.reps, self.copies = (t.column(i).to_numpy() for i in (3, 4, 5))
        values = t.column("v").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        self.x = units(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim))
        held = [np.frombuffer(f, np.int32) for f in t.column("filters").to_pylist()]
        number, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(number, kind="stable")
        self.number, self.row = number[order], row[order]
        self.links, self.label = np.zeros(len(held), np.int64), np.arange(len(held))
        self.lists: dict[int, np.ndarray] = {}

    def decoded(self, rows: np.ndarray) -> list[np.ndarray]:
        new = [i for i in rows.tolist() if i not in self.lists]
        if new:
            self.lists |= dict(zip(new, decode(self.x[new], *codebook(self.dim), *self.options), strict=True))
        return [self.lists[i] for i in rows.tolist()]

    def buckets(self) -> list[tuple[int, np.ndarray]]:
        """(filter, rows) where links may be: small buckets are looked through many at a time first."""
        edges = np.flatnonzero(np.diff(self.number)) + 1
        start = np.concatenate([[0], edges])
        size = np.diff(np.append(start, len(self.number)))
        out = [(int(self.number[u]), self.row[u : u + n]) for u, n in zip(start[size > SMALL], size[size > SMALL], strict=True)]
        for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            begin, step = start[size == n], max(1, (1 << 20) // (n * self.dim))
            for a in range(0, len(begin), step):
                rows = self.row[begin[a : a + step, None] + np.arange(n)]
                x = self.x[rows]
                # a little below the bar, as sums of another shape may round otherwise
                near = np.triu(x @ x.transpose(0, 2, 1) >= self.cosine - 1e-9, 1).any((1, 2))
                out += [(int(self.number[begin[a + k]]), rows[k]) for k in np.flatnonzero(near)]
        return out

    def join(self, rows: np.ndarray) -> None:
        found = np.unique(self.label[rows])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def compare(self, bucket: int, rows: np.ndarray) -> None:
        n = len(rows)
        for a in range(0, n, BLOCK):
            for b in range(a, n, BLOCK):
                ra, rb = rows[a : a + BLOCK], rows[b : b + BLOCK]
                hit = self.x[ra] @ self.x[rb].T >= self.cosine
                if a == b:
                    hit = np.triu(hit, 1)
                if self.across:
                    hit &= self.mine[ra][:, None] != self.mine[rb][None, :]
                ia, ib = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if not len(ia):
                    continue
                ra, rb, hit = ra[ia], rb[ib], hit[np.ix_(ia, ib)]
                hit &= _owned(self.decoded(np.append(ra, rb)), bucket, slice(0, len(ra)), slice(len(ra), len(ra) + len(rb)))
                self.links[ra] += hit @ self.copies[rb]
                self.links[rb] += self.copies[ra] @ hit
                for i in np.flatnonzero(hit.any(1)):
                    self.join(np.append(rb[hit[i]], ra[i]))

    def result(self) -> pa.RecordBatch:
        """(rep, links, root) of members with links."""
        for bucket, rows in self.buckets():
            self.compare(bucket, rows)
        at = np.flatnonzero(self.links > 0)
        return pa.record_batch([pa.array(c, pa.int64()) for c in (self.reps[at], self.links[at], self.reps[self.label[at]])], ["rep", "links", "root"])


@cache
def codebook(dim: int) -> tuple[np.ndarray, np.ndarray]:
    return codes(dim)


def cap_links(spark: SparkSession, vectors: DataFrame, cosine: float = 0.9, cap: float = CAP, least: int = LEAST, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vec_id.

    Links are pairs that share a filter and have the cosine in double precision, never others. Null, empty and zero vectors and those with
    null or non-finite components are alone, as are null ids; vectors of other lengths don't compare; rows of one
    vec_id count once (the smallest vector). Equal vectors stand behind one of them and are counted by their number.

    A vector is sent once to each cell of filters that share their first words, with its filters there: the more vectors, the
    more words name a cell. A cell's task hands on counts and a spanning forest, not pairs, so that a group of thousands of near copies
    gives as many rows as it has members. Cells above ``cell_rows`` are split into groups that meet pairwise.
    """
    space = Workspace(spark, "caps")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    once = vectors.select("vec_id", "embedding").groupBy("vec_id").agg(F.min("embedding").alias("v"))
    good = F.expr("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    once = space.write(once.withColumn("good", F.coalesce(good, F.lit(False))), "once")
    same = space.write(once.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "same")

    n = same.count()
    depth = next((d for d in range(1, PARTS) if n <= EVEN * WORDS**d), PARTS)
    below = WORDS ** (PARTS - depth)

    def filters(batches: Batches) -> Batches:
        for b in batches:
            v = b.column(2)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            posts: list = [None] * len(v)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                x = units(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                for i, found in zip(at, decode(x, *codebook(dim), cap, least), strict=True):
                    cells, first = np.unique(found // below, return_index=True)
                    posts[i] = [{"cell": (dim << 32) + int(c), "filters": f.astype(np.int32).tobytes()} for c, f in zip(cells, np.split(found, first[1:]), strict=True)]
            kind = pa.list_(pa.struct([("cell", pa.int64()), ("filters", pa.binary())]))
            yield pa.record_batch([*b.columns, pa.array(posts, kind)], ["rep", "copies", "v", "posts"])

    posts = "posts array<struct<cell: long, filters: binary>>"
    decoded = space.write(same.select("rep", "copies", "v").repartition(partitions(spark)).mapInArrow(filters, f"rep long, copies long, v array<{kind}>, {posts}"), "decoded")
    # cells that took very many rows: only ids of their members meet the counts, before vectors are sent anywhere
    members = decoded.select("rep", F.explode("posts.cell").alias("cell"))
    crowd = members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("groups"))
    split = space.write(members.join(crowd, "cell").groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("cell", "groups"))).alias("split")), "split")
    known = decoded.withColumn("split", F.lit(None)) if split.isEmpty() else decoded.join(split, "rep", "left")
    met = known.select("rep", "copies", "v", "split", F.explode("posts").alias("post")).select("rep", "copies", "v", "split", "post.*")
    met = met.withColumn("groups", F.lit(1) if split.isEmpty() else F.coalesce(F.expr("try_element_at(split, cell)"), F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    met = met.select("cell", F.least("mine", "other").alias("g1"), F.greatest("mine", "other").alias("g2"), "mine", "rep", "copies", "v", "filters")
    met = met.repartition(partitions(spark), "cell", "g1", "g2").sortWithinPartitions("cell", "g1", "g2", "rep")

    def compare(batches: Batches) -> Batches:
        for t in runs(batches, 3):
            if t.num_rows > 1:
                yield Cell(t, cosine, cap, least).result()

    found = space.write(met.mapInArrow(compare, "rep long, links long, root long"), "found")
    space.drop("decoded", "split")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(space, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = same.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    alone = once.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    linked = once.where("good").join(known, "v").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
