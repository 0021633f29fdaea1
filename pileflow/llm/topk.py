"""Exact top-k by inner product: a KD-tree per shard, searched best-first for blocks of queries."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, Workspace, runs

LEAF, SHARD_ROWS, QUERY_ROWS = 128, 8192, 2048
#: Products of components up to this stay exact in doubles.
EXACT = float(1 << 52)
PACKED = ["shard", "block", "n", "most", "dim", "ids", "v"]


@dataclass
class Tree:
    """Boxes of all nodes in one array; a node's points are a stretch of the reordered rows."""

    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: list[int]
    end: list[int]
    child: list[int]  # the first of two neighbours, 0 at a leaf

    def widened(self, d: int) -> Tree:
        """With zeros up to d components."""
        if d == self.rows.shape[1]:
            return self
        return Tree(self.ids, _widened(self.rows, d), _widened(self.low, d), _widened(self.high, d), self.begin, self.end, self.child)


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits on the widest side of each tight bounding box."""
    order = np.arange(len(ids))
    low, high, begin, end, child = [], [], [0], [len(ids)], [0]
    k = 0
    while k < len(begin):
        a, z = begin[k], end[k]
        part = rows[order[a:z]]
        lo, hi = part.min(0), part.max(0)
        low.append(lo)
        high.append(hi)
        if z - a > leaf and (hi > lo).any():
            axis, mid = int(np.argmax(hi - lo)), (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, axis], mid)]
            child[k] = len(begin)
            begin += [a, a + mid]
            end += [a + mid, z]
            child += [0, 0]
        k += 1
    return Tree(ids[order], rows[order], np.array(low), np.array(high), begin, end, child)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of what may be among the k best: scores below a query's ``kth`` from elsewhere are left out.

    A box's bound is the largest inner product that any point in it could have. Boxes wait in a heap; the search of a query
    ends when the best of them is below its kth score so far.
    """
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    out_q, out_i, out_s = [], [], []
    for q in range(len(queries)):
        best: list[tuple[float, int]] = []  # smallest score first, and of equal ones the largest id
        least, heap, bound = kth[q], [(-bounds[q, 0], 0)], bounds[q]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if first := tree.child[node]:
                heapq.heappush(heap, (-bound[first], first))
                heapq.heappush(heap, (-bound[first + 1], first + 1))
                continue
            a, z = tree.begin[node], tree.end[node]
            scores = tree.rows[a:z] @ queries[q]
            for i in np.flatnonzero(scores >= least):
                if tree.ids[a + i] != own[q]:
                    item = (scores[i], -int(tree.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        least = max(least, best[0][0])
        out_q += [q] * len(best)
        out_i += [-i for _, i in best]
        out_s += [s for s, _ in best]
    return np.array(out_q, np.int64), np.array(out_i, np.int64), np.array(out_s, np.float64)


def _widened(x: np.ndarray, d: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its k best others by integer inner product.

    Components are floor(scale * x). Null vectors and ids, and vectors with null or non-finite components, take no part;
    rows of one vec_id count once (the smallest vector); shorter vectors are padded with zeros; an empty table gives no rows.
    Raises where products could leave what doubles hold exactly. Equal scores go to the smaller id.

    Shards of about ``shard_rows`` rows are packed and written once. A first round searches one shard for each block of queries;
    its kth scores then cut the search of all other shards short. A task builds a shard's tree once and reads the blocks of
    queries one after the other, so tasks and trees grow with the rows. Only (query, shard) results of k rows are merged.
    """
    space = Workspace(spark, "topk")
    # a component may be null or non-finite only where this finds one
    good = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
    n = vectors.count()
    shards, blocks = max(1, ceil(n / shard_rows)), max(1, ceil(n / every / query_rows))

    def packed(size: int) -> Callable[[Batches], Batches]:
        def run(batches: Batches) -> Batches:
            for t in runs(batches):
                kept: dict[int, list[int]] = {}
                for i, v in zip(t.column("vec_id").to_pylist(), t.column("v").to_pylist(), strict=True):
                    if i not in kept or v < kept[i]:
                        kept[i] = v
                ids = sorted(kept)
                # twice the rows meant at most in one packed row, however unevenly ids fall
                for a in range(0, len(ids), size):
                    part = ids[a : a + size]
                    d = max(len(kept[i]) for i in part)
                    m = np.array([kept[i] + [0] * (d - len(kept[i])) for i in part], np.int64)
                    yield pa.record_batch([t.column("group").slice(0, 1).combine_chunks(), pa.array([part[0]], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([float(np.abs(m).max())]), pa.array([d], pa.int32()), pa.array([np.array(part, np.int64).tobytes()]), pa.array([m.tobytes()])], PACKED)

        return run

    def dealt(df: DataFrame, groups: int, size: int, name: str) -> DataFrame:
        df = df.select(F.pmod(F.xxhash64("vec_id", F.lit(groups)), F.lit(groups)).alias("group"), "vec_id", "v")
        return space.write(df.repartition(groups, "group").sortWithinPartitions("group").mapInArrow(packed(size), "shard long, block long, n int, most double, dim int, ids binary, v binary"), name)

    store = dealt(rows, shards, 2 * shard_rows, "shards")
    asked = dealt(rows.where(F.col("vec_id") % every == 0), blocks, query_rows, "queries")
    known = store.agg(F.max("most").alias("most"), F.max("dim").alias("dim"), F.count("*").alias("n")).first()
    if known.n and known.most * known.most * known.dim > EXACT:
        raise ValueError("components too large for exact inner products")
    def searched(asks: DataFrame) -> DataFrame:
        """Results of blocks of queries, columns shard, block, n, ids, v, kth, each in its shard."""
        none = F.lit(None)
        trees = store.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("block"), "n", "ids", "v", none.cast("binary").alias("kth"))
        both = trees.join(asks.select("shard").distinct(), "shard", "left_semi").unionByName(asks.withColumn("kind", F.lit(1)))
        return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "block long, query_id long, vec_id long, score long")

    def run(batches: Batches) -> Batches:
        shard, trees = -1, []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    shard, trees = r["shard"], []
                m = np.frombuffer(r["v"], np.int64).reshape(r["n"], -1).astype(np.float64)
                ids = np.frombuffer(r["ids"], np.int64)
                if r["kind"] == 0:
                    trees.append(build(ids, m))
                    continue
                kth = np.frombuffer(r["kth"], np.float64) if r["kth"] is not None else np.full(len(ids), -np.inf)
                for tree in trees:
                    d = max(tree.rows.shape[1], m.shape[1])
                    at, got, scores = search(tree.widened(d), _widened(m, d), ids, kth, k)
                    yield pa.record_batch([pa.array(np.full(len(at), r["block"])), pa.array(ids[at]), pa.array(got), pa.array(scores.astype(np.int64))], ["block", "query_id", "vec_id", "score"])

    # the shard that a block is searched in first
    asked = asked.select("block", "n", "ids", "v", F.pmod(F.xxhash64("block"), F.lit(shards)).alias("home"))
    first = space.write(searched(asked.select(F.col("home").alias("shard"), "block", "n", "ids", "v", F.lit(None).cast("binary").alias("kth"))), "first")

    def kth_scores(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(f.ids.iloc[0], np.int64)
        found = f[f.score.notna()].groupby("query_id").score.agg(["min", "count"])
        least = {i: float(m) for i, m, c in zip(found.index, found["min"], found["count"], strict=True) if c >= k}
        return pd.DataFrame({"block": [key[0]], "kth": [np.array([least.get(i, -np.inf) for i in ids], np.float64).tobytes()]})

    told = asked.select("block", "ids").join(first, "block", "left").select("block", "ids", "query_id", F.col("score").cast("double").alias("score"))
    told = told.groupBy("block").applyInPandas(kth_scores, "block long, kth binary")
    others = asked.join(told, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rest = searched(others.where("shard <> home").select("shard", "block", "n", "ids", "v", "kth"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
