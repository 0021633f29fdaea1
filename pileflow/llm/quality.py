"""Quality scores by a factorisation machine over hashed words, structure statistics and lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, crc_mod, guarded, sliced, word_hashes

#: Slots of hashed words, slots of statistics after them, factors, and the bound on training rows.
WORD_SLOTS, STATS, LEVELS, FACTORS, ROWS = 1 << 14, 14, 12, 8, 12_000
SIZE = WORD_SLOTS + STATS * LEVELS


def statistics(text: str, n_tokens: int, counts: np.ndarray) -> list[int]:
    """Levels 0 to LEVELS - 1 of what the text looks like, from it and the counts of its distinct words."""
    n, lines = max(1, len(text)), text.split("\n")
    data = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digits, total = c[97:123].sum(), c[65:91].sum(), c[48:58].sum(), max(1, len(data))
    spaces = c[32] + c[9:14].sum()
    marks = c[33:127].sum() - lower - upper - digits
    plain = c[44] + c[46] + c[39] + c[45] + c[58] + c[59] + c[63]
    share = lambda x, of, by=1.0: int(min(LEVELS - 1, (LEVELS * by * x / max(1, of)) if x else 0))
    log = lambda x: int(min(LEVELS - 1, np.log2(1 + x)))
    # 0 stands for none at all, so that rare signs differ from no signs
    rare = lambda x, of: int(min(LEVELS - 1, 0 if not x else max(1, 12 + np.log2(x / max(1, of))))) if x else 0
    return [
        log(n_tokens), log(n / 8), share(upper, lower + upper, 2), rare(digits, total), rare(marks - plain, total), rare(plain, total), share(spaces, total, 3),
        share(len(counts), n_tokens), share(int(counts.max(initial=0)), n_tokens, 3), log(len(lines)), log(max(map(len, lines)) / 8),
        share(len(lines) - len(set(lines)), len(lines)), log(n / max(1, n_tokens)), rare(c[128:].sum(), total),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): words by logarithm of their count, as a unit vector; each statistic's level."""
    text = text or ""
    distinct, counts = np.unique(word_hashes(text), return_counts=True)
    ids, to = np.unique((distinct & np.uint64(WORD_SLOTS - 1)).astype(np.int64), return_inverse=True)
    n = np.bincount(to, counts, len(ids))
    value = np.log1p(n)
    value /= max(1e-9, np.sqrt((value * value).sum()))
    levels = WORD_SLOTS + np.arange(STATS) * LEVELS + np.array(statistics(text, int(counts.sum()), counts))
    return np.concatenate([ids, levels]), np.concatenate([value, np.full(STATS, STATS**-0.5)])


def margin(slots: np.ndarray, values: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> float:
    """All pairwise terms in linear time: half of the square of the sum less the sum of squares."""
    f = factors[slots] * values[:, None]
    s = f.sum(0)
    return float(bias + linear[slots] @ values + 0.5 * (s @ s - (f * f).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, l2: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, linear, factors) by Adagrad on the logistic loss."""
    rng = np.random.default_rng(3)
    prior = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS))
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    for _ in range(epochs if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            slots, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
            f = v[slots] * x[:, None]
            s = np.add.reduceat(f, starts)
            z = bias + np.add.reduceat(w[slots] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((f * f).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            hit, to = np.unique(slots, return_inverse=True)
            each = g[owner] * x
            dw = np.bincount(to, each, len(hit)) + l2 * w[hit]
            dv = np.stack([np.bincount(to, each * (s[owner, k] - f[:, k]), len(hit)) for k in range(FACTORS)], 1) + l2 * v[hit]
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            gb += g.sum() ** 2
            w[hit] -= rate * dw / np.sqrt(gw[hit])
            v[hit] -= rate * dv / np.sqrt(gv[hit])
            bias -= rate * g.sum() / np.sqrt(gb)
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, rows: int = ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """A model from the ``rows`` first labelled ids by a hash, ids with crc32 mod ``mod`` equal to ``held`` left out.

    Rows that share an id take its smallest label. The sample's size is bounded, so it is broadcast to the documents.
    """
    known = labels.where("quality is not null and doc_id is not null").where(f"{crc_mod('doc_id', mod)} <> {held}").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(rows))
    joined = docs.select("doc_id", "text").join(sample, "doc_id").select("quality", "text", "doc_id")

    def run(batches: Batches) -> Batches:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int32()), pa.array([a.astype(np.uint16).tobytes() for a, _ in x], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in x], pa.binary()), b.column(2).cast(pa.string())], ["y", "slots", "x", "id"])

    # in a fixed order, so that a model doesn't depend on how the rows came; repeated ids are in there once
    got = {r.id: r for r in sorted(joined.mapInArrow(run, "y int, slots binary, x binary, id string").collect(), key=lambda r: (r.id, r.slots))}
    data = [(np.frombuffer(r.slots, np.uint16).astype(np.int64), np.frombuffer(r.x, np.float32).astype(np.float64)) for r in got.values()]
    return fit(data, np.array([float(r.y) for r in got.values()]))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns kept, with ``score`` (0 to 1) of the whole text; null texts are scored as empty."""
    bias, linear, factors = model
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Batches) -> Batches:
        for b in sliced(batches, len(keep)):
            z = np.array([margin(*features(t.as_py()), bias, linear, factors) for t in b.column(len(keep))])
            yield pa.record_batch([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; repeated rows stay, null ids too. Null texts count as empty, texts of any length are
    scored whole, an empty table gives no rows. Without labels of both kinds all scores are the prior."""
    rows = score(docs, train(docs, labels, mod, held), ["doc_id"])
    return rows.select("doc_id", F.expr(f"{crc_mod('doc_id', mod)} = {held}").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, columns as they are."""
    model = train(docs, labels)
    return guarded(docs, lambda d: score(d, model, d.columns).where("score >= 0.5").drop("score"))
