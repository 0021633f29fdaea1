"""Mixing sources to target weights: fixed-length blocks, multinomial slots per output shard given the totals, permuted block indexes."""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, Workspace, guarded, mixed, sliced

BLOCK, SLOTS, SEED, MOST = 64, 8192, 20240229, 3
#: Parts of a source whose sizes are summed apart, so that a source with a third of all rows is many tasks' work: so many, or one for each PART rows of the table.
PARTS, PART = 256, 1 << 20
#: Slots up to which numpy draws without replacement; more are first halved in proportion.
DRAWN = 900_000_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess reshared by weight until none is."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] >= most * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left = max(0.0, left - sum(out[i] for i in over))
        free -= over
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each row: four Feistel rounds on the next even number of bits, walked back into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, size))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed(right + k * np.uint64(31) + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Draws:
    """Counts of every source in every shard: multinomial, given that each source has its total.

    A multinomial whose totals are known is a draw without replacement. Halves of a range of shards are drawn from the range,
    with a seed of its own, and so on down to one shard: any task finds its shard's counts alone, and how many a source has in the shards before.
    """

    def __init__(self, totals: np.ndarray, slots: int, seed: int) -> None:
        self.totals, self.slots, self.seed = totals, slots, seed
        self.n = int(totals.sum())
        self.shards = ceil(self.n / slots)
        self.path: list[tuple[int, int, np.ndarray, np.ndarray]] = [(0, self.shards, totals, np.zeros_like(totals))]

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, counts of the shards before)."""
        while not self.path[-1][0] <= k < self.path[-1][1]:
            self.path.pop()
        lo, hi, counts, before = self.path[-1]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self._drawn(counts, (mid - lo) * self.slots, lo, hi)
            lo, hi, counts, before = (lo, mid, left, before) if k < mid else (mid, hi, counts - left, before + left)
            self.path.append((lo, hi, counts, before))
        return counts, before

    def _drawn(self, counts: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
        rng, total = np.random.default_rng((self.seed, lo, hi)), int(counts.sum())
        if total < DRAWN:
            return rng.multivariate_hypergeometric(counts, n, method="marginals")
        share = counts * (n / total)
        out = np.minimum(np.floor(share).astype(np.int64), counts)
        order = np.argsort(out - share, kind="stable")[: n - int(out.sum())]
        out[order] += 1
        return out


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``size``, the words of the text (null: 0), and ``mark``, a hash of the text that tells rows of one id apart, to the columns kept."""
    columns = docs.select(*keep, F.xxhash64("text").alias("mark"), F.col("text").alias("_text"))
    schema = columns.select(*keep, F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mark")).schema
    i = len(keep)

    def run(batches: Batches) -> Batches:
        for b in sliced(batches, i + 1):
            n = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in b.column(i + 1).to_pylist()]
            yield pa.record_batch([*b.columns[:i], pa.array(n, pa.int64()), b.column(i)], [*keep, "size", "mark"])

    return columns.mapInArrow(run, schema)


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, most: int = MOST, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> tuple[DataFrame, DataFrame, Workspace]:
    """(one row per document, one row per used part of a document, the folder of both).

    Documents: doc_id, size, source_size, target, taken. Parts: row (of the document), doc_id, first, words, uses.

    Sources go by code point with null last and take the weights in turn. A source's texts, in a fixed pseudorandom order, are cut
    into blocks of ``block`` words. A source gets as many slots as its target asks for at the mean length of its blocks, and
    the counts of each output shard of ``slots`` slots are multinomial given these totals (``Draws``). Slot j of a source reads
    block permutation[j mod n] of pass j div n, at most ``most`` passes. Sources without words get nothing; null texts have no words;
    null or equal ids and repeated rows are documents of their own. An empty table gives no rows. Same input, same mix.
    The driver and each drawing task hold some numbers for every source: fit for thousands of sources.
    """
    space = Workspace(spark, "mixing")
    parts = max(PARTS, ceil(docs.count() / PART))
    rows = sized(docs, ["doc_id", "source"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(parts)).cast("int"))
    w = Window.partitionBy("source", "part").orderBy("doc_id", "mark", "size")
    rows = rows.withColumns({"place": F.row_number().over(w), "upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = space.write(rows, "rows")
    per_part = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    per_part = per_part.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
    found = [(r.source, int(r.n or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    table = spark.createDataFrame([(s, i, n, g) for i, ((s, n), g) in enumerate(zip(found, goal, strict=True))], "source string, sid int, source_size long, target double")
    n_blocks = np.array([ceil(n / block) for n in sizes], np.int64)
    totals = np.array([min(most * n, round(g * n / size)) if size else 0 for g, n, size in zip(goal, n_blocks.tolist(), sizes, strict=True)], np.int64)
    shards = ceil(int(totals.sum()) / slots)

    def draw(batches: Batches) -> Batches:
        draws = Draws(totals, slots, seed)
        for b in batches:
            sid, first, count = [], [], []
            for k in b.column(0).to_pylist():
                counts, before = draws.shard(k)
                hit = np.flatnonzero(counts)
                sid.append(hit)
                first.append(before[hit])
                count.append(counts[hit])
            sid, first, count = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sid, first, count))
            yield pa.record_batch([pa.array(sid, pa.int32()), pa.array(first, pa.int64()), pa.array(count, pa.int64())], ["sid", "first", "count"])

    def look_up(batches: Batches) -> Batches:
        for b in batches:
            sid, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            n = n_blocks[sid]
            epoch = j // n
            at = permuted(j % n, n, mixed((sid.astype(np.uint64) << np.uint64(8)) + epoch.astype(np.uint64) + np.uint64(seed)))
            yield pa.record_batch([pa.array(sid, pa.int32()), pa.array(at)], ["sid", "block"])

    drawn = spark.range(shards).mapInArrow(draw, "sid int, first long, count long")
    slot = drawn.select("sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("j"))
    uses = slot.mapInArrow(look_up, "sid int, block long").groupBy("sid", "block").agg(F.count("*").cast("int").alias("uses"))
    known = rows.join(table.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.join(per_part.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_s", "_p")
    known = known.withColumn("begin", F.col("base") + F.col("upto") - F.col("size"))
    numbers = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")))
    split = known.withColumn("block", F.explode_outer(numbers))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("begin"))
    split = split.withColumns({"first": first, "words": F.least(F.col("size"), (F.col("block") + 1) * block - F.col("begin")) - first})
    # both sides grow with the rows, though a planner that sees a range of shards thinks one of them small
    used = split.join(uses.hint("merge"), ["sid", "block"], "left")
    used = space.write(used.select("doc_id", "source", "sid", "part", "place", "mark", "size", "source_size", "target", "first", "words", F.coalesce("uses", F.lit(0)).alias("uses")), "parts")
    taken = F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken")
    result = used.groupBy("sid", "part", "place", "doc_id", "size", "source_size", "target").agg(taken).drop("sid", "part", "place")
    return result, used, space


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def mixed_documents(spark: SparkSession, docs: DataFrame, **options: object) -> DataFrame:
    """The mix as documents: for each pass the words that it takes of a text, line breaks and spaces between them kept.

    Columns of ``docs``; n_chars is counted anew. A text taken in full twice gives two rows.
    """
    return guarded(docs, lambda d: _mixed(spark, d, options))


def _mixed(spark: SparkSession, docs: DataFrame, options: dict) -> DataFrame:
    _, used, _ = mix(spark, docs, **options)
    seed = options.get("seed", SEED)
    # rows of one id, source and text are alike, so any of them may stand for a place; 128 bits name them, and texts are dealt once by that name
    name = F.concat_ws("/", F.xxhash64("doc_id", "source", "mark"), F.xxhash64(F.lit(seed), "mark", "source", "doc_id")).alias("_name")
    took = F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("took")
    passes = used.where("uses > 0").select(name, "part", "place", "first", "words", "uses").groupBy("_name", "part", "place").agg(took)
    passes = passes.groupBy("_name").agg(F.sort_array(F.collect_list(F.struct("part", "place", "took"))).alias("_passes"))
    columns = docs.columns
    marked = docs.withColumn("mark", F.xxhash64("text")).select(*columns, name)
    marked = marked.withColumn("_turn", F.row_number().over(Window.partitionBy("_name").orderBy("_name")))
    joined = marked.join(passes, "_name").select(*columns, F.get("_passes", F.col("_turn") - 1)["took"].alias("took")).where("took is not null")
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def cut(batches: Batches) -> Batches:
        for b in sliced(batches, at):
            rows, texts = [], []
            for i, (text, took) in enumerate(zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)):
                data = text.encode("utf-8", "surrogatepass")
                spans = [m.span() for m in _WORD.finditer(data)]
                for k in range(max(t["uses"] for t in took)):
                    out, to = [], -1
                    for t in took:
                        if t["uses"] > k:
                            a, z = t["first"], t["first"] + t["words"] - 1
                            if to >= 0 and a != to + 1:
                                out.append(b"\n")
                            elif to >= 0:
                                out.append(data[spans[to][1] : spans[a][0]])
                            out.append(data[spans[a][0] : spans[z][1]])
                            to = z
                    rows.append(i)
                    texts.append(b"".join(out).decode("utf-8", "surrogatepass"))
            take = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(columns))]
            take[at] = pa.array(texts, b.schema.field(at).type)
            if chars >= 0:
                take[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(b.schema.field(chars).type)
            yield pa.record_batch(take, columns)

    return joined.mapInArrow(cut, docs.schema)
