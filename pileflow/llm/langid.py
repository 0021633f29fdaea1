"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, crc_mod, mixed

#: Bits of a hashed n-gram's slot, orders of n-grams, and the bound on training rows of each language.
BITS, ORDERS, ROWS = 12, (1, 2, 3), 500
SLOTS = 1 << BITS
#: N-grams of a long text that are hashed at once.
STEP = 1 << 18
#: Below this distance between the shares of the two nearest codewords a text is called ambiguous.
AMBIGUOUS = 0.2

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; runs of anything else count as one space, and one stands at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    c = np.where(letter, c, 32)
    return np.concatenate([[32], c[letter | np.concatenate([[True], letter[:-1]])], [32]])


def slots(c: np.ndarray, order: int) -> np.ndarray:
    """Slots of the n-grams of one order over code points."""
    c = c.astype(np.uint64)
    h = np.full(max(0, len(c) - order + 1), order, np.uint64)
    for i in range(order):
        h = h * np.uint64(0x100000001B3) + c[i : i + len(h)]
    return (mixed(h) >> np.uint64(64 - BITS)).astype(np.int64)


def profile(text: str, step: int = STEP) -> np.ndarray:
    """How often each slot occurs. Long texts go in steps that overlap by what an n-gram needs, so that each is counted once."""
    c, out = letters(text), np.zeros(SLOTS, np.int64)
    for order in ORDERS:
        for a in range(0, max(1, len(c) - order + 1), step):
            out += np.bincount(slots(c[a : a + step + order - 1], order), minlength=SLOTS)
    return out


def codewords(classes: int) -> np.ndarray:
    """Rows of +-1: all distinct splits for few classes, else the best spread of several random codes."""
    if classes <= 5:
        bits = max(1, 2 ** (classes - 1) - 1)
        return np.array([[-1 if (b + 1) >> (classes - 1 - k) & 1 and k else 1 for b in range(bits)] for k in range(classes)], np.float64)
    rng, bits = np.random.default_rng(7), ceil(10 * log2(classes))
    apart = lambda c: (c.shape[1] - np.where(np.eye(classes, dtype=bool), -c.shape[1], c @ c.T)).min()
    tries = [rng.choice([-1.0, 1.0], (classes, bits)) for _ in range(20)]
    return max((c for c in tries if (abs(c.sum(0)) < classes).all()), key=apart, default=tries[0])


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 60, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias, weight of each bit): one logistic classifier per bit, by full gradients with Adam."""
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)
    x = x * scale
    target = code[y].astype(np.float32)
    rows = 1 / np.bincount(y, minlength=len(code))[y]
    rows = (rows / rows.sum()).astype(np.float32)
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30))) * rows[:, None]
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        for p, q, s, r in ((w, gw, m, v), (bias, gb, mb, vb)):
            s += 0.1 * (q - s)
            r += 0.001 * (q * q - r)
            p -= 0.1 * (s / (1 - 0.9**t)) / (np.sqrt(r / (1 - 0.999**t)) + 1e-9)
    right = (((x @ w + bias) * target > 0) * rows[:, None]).sum(0)
    return w * scale[:, None], bias, np.clip(2 * right - 1, 0.05, 1)


def identify(spark: SparkSession, docs: DataFrame, mod: int = 4, held: int = 2, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each row.

    Learns from rows with text, letters and a language whose crc32(doc_id) mod ``mod`` isn't ``held``: per language the ``rows``
    first by a hash, which bounds what the driver gets. A text gets the nearest codeword by loss-weighted decoding; its
    score is that codeword's share among all; of codewords at one distance the first language by name wins. ``und`` with score 0: null or empty
    text, no letters, or no language to learn from. Repeated rows and rows with null ids are predicted each, an empty table gives no rows,
    and texts of any length are counted whole.
    """
    is_held = F.expr(f"{crc_mod('doc_id', mod)} = {held}")
    labelled = docs.where("text is not null and lang is not null").where(~is_held).select("doc_id", "lang", "text", F.xxhash64("doc_id", F.lit(5)).alias("_h"))
    # hashes are even, so the first ``rows`` lie in a known share of their range: only about twice as many rows are shuffled
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if counts:
        upto = {lang: int(-(2**63) + 2**64 * min(1.0, 2 * (rows + 50) / n)) for lang, n in counts.items()}
        bar = F.create_map(*[F.lit(x) for lang, to in upto.items() for x in (lang, min(to, 2**63 - 1))])
        labelled = labelled.where(F.col("_h") <= bar[F.col("lang")])
    ids = labelled.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_r") <= rows).select("lang", "text")

    def count(batches: Batches) -> Batches:
        for b in batches:
            langs, data = [], []
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if any(map(str.isalpha, text)):
                    n = profile(text).astype(np.float32)
                    langs.append(lang.as_py())
                    data.append((n / n.sum()).astype(np.float32).tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "x"])

    sample = ids.mapInArrow(count, "lang string, x binary").collect()
    names = sorted({r.lang for r in sample})
    code = codewords(len(names))
    weights, bias, trust = np.zeros((SLOTS, 1)), np.zeros(1), np.ones(1)
    if len(names) > 1:
        x = np.frombuffer(b"".join(r.x for r in sample), np.float32).reshape(len(sample), SLOTS)
        weights, bias, trust = fit(x, np.array([names.index(r.lang) for r in sample]), code)
    del sample

    def predict(batches: Batches) -> Batches:
        for b in batches:
            pred, score, unsure = [], [], []
            for text in b.column(2):
                text = text.as_py()
                if not names or not text or not any(map(str.isalpha, text)):
                    best, share, second = "und", 0.0, 0.0
                elif len(names) == 1:
                    best, share, second = names[0], 1.0, 0.0
                else:
                    n = profile(text)
                    hit = np.flatnonzero(n)
                    loss = np.logaddexp(0, -code * (n[hit] @ weights[hit] / n.sum() + bias)) @ trust
                    p = np.exp(loss.min() - loss)
                    p /= p.sum()
                    order = np.argsort(-p, kind="stable")
                    best, share, second = names[order[0]], float(p[order[0]]), float(p[order[1]])
                pred.append(best)
                score.append(share)
                unsure.append(share - second < AMBIGUOUS)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held.alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
