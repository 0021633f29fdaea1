"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, and the smoothed unigram beside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileflow.llm.common import Batches, Workspace, crc_mod, mixed, partitions, sliced, word_hashes

#: Words with weights of their own, in classes of PER; all other words share one more class, and are told apart in it by two digits of
#: their hash, each with weights of its own, then by their counts.
CLASSES, PER = 16, 32
VOCABULARY = CLASSES * PER
BINS, NODES = PER * PER, 1 + PER
#: Rows of weights that hashed features fall into: of the class model and of the word model.
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 10
assert max(CLASS_ROWS, WORD_ROWS * CLASSES, WORD_ROWS * NODES) <= 1 << 16
#: Counts that every task has at hand; other words meet theirs in a join.
HEAD, HEAD_SLOTS = 1 << 16, 1 << 20
#: Rounds of updates; round r learns from training documents whose hash mod ROUNDS is r, so all rounds together from every one.
ROUNDS, RATE = 3, 0.25
TOKENS, CHUNK = 1 << 22, 1 << 12
#: Tokens of a text that features are made for at one time, and bytes of text for each bucket of counts.
PIECE, BUCKET = 1 << 16, 1 << 25
#: Rows of weights and tasks whose changes are summed at one place, and places that merge the buckets' frequent words.
RANGE, TEAM, MERGERS = 1 << 11, 512, 64
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and the end."""
    return np.append(word_hashes(text), END)


def bins(h: np.ndarray) -> np.ndarray:
    """Both digits of words without weights of their own, as one number."""
    return (mixed(h) >> np.uint64(24)).astype(np.int64) % BINS


@dataclass
class Counts:
    """Totals, and the frequent words' counts in a table addressed by hash; only its used places go to tasks."""

    total: int
    distinct: int
    keys: np.ndarray
    counts: np.ndarray
    vocabulary: np.ndarray  # number of a word of the model, -1 for others
    rest_total: int
    rest_distinct: int
    rest_bins: np.ndarray  # counts and distinct words of the rest by bin, added up

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.counts > 0)
        return self.total, self.distinct, self.rest_total, self.rest_distinct, self.rest_bins, at.astype(np.int32), self.keys[at], self.counts[at], self.vocabulary[at].astype(np.int16)

    def __setstate__(self, state: tuple) -> None:
        self.total, self.distinct, self.rest_total, self.rest_distinct, self.rest_bins, at, keys, counts, vocabulary = state
        self.keys, self.counts, self.vocabulary = np.zeros(HEAD_SLOTS, np.uint64), np.zeros(HEAD_SLOTS, np.int64), np.full(HEAD_SLOTS, -1, np.int64)
        self.keys[at], self.counts[at], self.vocabulary[at] = keys, counts, vocabulary

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Places in the table, -1 where a word isn't there."""
        at = (mixed(h) >> np.uint64(40)).astype(np.int64) & (HEAD_SLOTS - 1)
        return np.where((self.keys[at] == h) & (self.counts[at] > 0), at, -1)


@dataclass
class Model:
    """Weights of features for classes and, within classes, for words, or for the digits of the rest; row 0 is always on."""

    by_class: np.ndarray
    by_word: np.ndarray
    by_bin: np.ndarray


def contexts(h: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of class weights, one column per feature; rows of word weights) of every token of one text, or of a piece and the three tokens before it.

    Features: the last word, the last two words, and skips to the second and third last.
    """
    p = np.concatenate([[START] * 3 if before is None else before, h[:-1]]).astype(np.uint64)
    one, two, three = p[2:], p[1:-1], p[:-2]
    k = np.uint64(0x9DDFEA08EB382D69)
    mixes = [mixed(one + np.uint64(1)), mixed(one * k + two + np.uint64(2)), mixed(two + np.uint64(3)), mixed(three + np.uint64(4))]
    rows = np.stack([(m >> np.uint64(20)).astype(np.int64) % (CLASS_ROWS - 1) + 1 for m in mixes], 1)
    return rows, (mixes[0] >> np.uint64(40)).astype(np.int64) % (WORD_ROWS - 1) + 1


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place. Rows are short, where numpy's sums and largest values by row take longer than the powers do."""
    if len(z) and (z.max() > 60 or z.min() < -60):
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def probabilities(m: Model, rows: np.ndarray, last: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class probabilities, which tokens have a word of the model, word probabilities of those within their class)."""
    z = m.by_class.take(rows[:, 0], 0)
    z += m.by_class[0]
    for k in range(1, rows.shape[1]):
        z += m.by_class.take(rows[:, k], 0)
    own = np.flatnonzero(word >= 0)
    kind = word[own] // PER
    table = m.by_word.reshape(WORD_ROWS * CLASSES, PER)
    return _softmax(z), own, _softmax(table.take(kind, 0) + table.take(last[own] * CLASSES + kind, 0))


def bin_probabilities(m: Model, last: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of weights, probabilities of digits) of words of the rest: first digits, then second ones given the first."""
    node = np.concatenate([np.zeros(len(bin_), np.int64), 1 + bin_ // PER])
    table = m.by_bin.reshape(WORD_ROWS * NODES, PER)
    rows = np.concatenate([last, last]) * NODES + node
    return rows, _softmax(table.take(node, 0) + table.take(rows, 0))


def _descend(weights: np.ndarray, past: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Adagrad by row: gradients of tokens with the same row are summed first. Row numbers fit 16 bits, which numpy sorts by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    hit = rows[first]
    seen[hit] += np.diff(first, append=len(rows))
    _step(weights, past, hit, np.add.reduceat(g.take(order, 0), first))


def _step(weights: np.ndarray, past: np.ndarray, hit: np.ndarray | slice, total: np.ndarray) -> None:
    past[hit] += np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
    total *= (RATE / np.sqrt(past[hit]))[:, None]
    weights[hit] -= total


def learn(m: Model, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray]:
    """(changed weights, how often each class row, each word row and each digit row was seen) after steps over chunks of tokens."""
    a, b, d = m.by_class.copy(), m.by_word.reshape(WORD_ROWS * CLASSES, PER).copy(), m.by_bin.reshape(WORD_ROWS * NODES, PER).copy()
    now = Model(a, b, d)
    pa_, pb, pd_ = (np.full(len(x), 1.0, np.float32) for x in (a, b, d))
    seen_a, seen_b, seen_d = (np.zeros(len(x), np.float32) for x in (a, b, d))
    for rows, last, word in batches:
        p, own, q = probabilities(now, rows, last, word)
        kind = np.where(word >= 0, word // PER, CLASSES)
        p[np.arange(len(p)), kind] -= 1
        _step(a, pa_, slice(0, 1), p.sum(0, keepdims=True))
        for k in range(rows.shape[1]):
            _descend(a, pa_, seen_a, rows[:, k], p)
        if len(own):
            q[np.arange(len(q)), word[own] % PER] -= 1
            at = last[own] * CLASSES + kind[own]
            _step(b, pb, slice(0, CLASSES), (kind[own] == np.arange(CLASSES)[:, None]).astype(np.float32) @ q)
            _descend(b, pb, seen_b, at, q)
        rest = np.flatnonzero(word < 0)
        if len(rest):
            bin_ = -1 - word[rest]
            at, q = bin_probabilities(now, last[rest], bin_)
            q[np.arange(len(q)), np.concatenate([bin_ // PER, bin_ % PER])] -= 1
            first, second = q[: len(rest)], q[len(rest) :]
            _step(d, pd_, slice(0, NODES), np.concatenate([first.sum(0, keepdims=True), (bin_ // PER == np.arange(PER)[:, None]).astype(np.float32) @ second]))
            _descend(d, pd_, seen_d, at, q)
    seen_a[0] = seen_a.sum()
    seen_b[:CLASSES] = seen_b.sum()
    seen_d[:NODES] = seen_d.sum()
    return now, seen_a, seen_b, seen_d


def count_words(space: Workspace, train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts): every distinct token of the training texts with its count, packed by bucket of hashes.

    Tasks count what they read before anything is shuffled.
    """

    def local(batches: Batches) -> Batches:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            return packed(h, n)

        def packed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            home = (mixed(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            h, n, ends = h[order], n[order].astype(np.int64), np.searchsorted(home[order], np.arange(buckets + 1))
            k = [i for i in range(buckets) if ends[i] < ends[i + 1]]
            cut = lambda x: pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in k], pa.binary())
            return pa.record_batch([pa.array(k, pa.int32()), cut(h), cut(n)], ["bucket", "hashes", "counts"])

        for b in sliced(batches, 0):
            for t in b.column(0):
                kept.append(tokens(t.as_py()))
                size += len(kept[-1])
                if size > TOKENS:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in f.hashes])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in f.counts])
        order = np.argsort(h, kind="stable")
        h, first = np.unique(h[order], return_index=True)
        n = np.add.reduceat(n[order], first)
        # words are dealt by hash, so the most frequent HEAD of all are among these, but for odds beyond 1 to 10^9; one left out meets its count in the join
        top = np.argsort(-n, kind="stable")[: 2 * HEAD // buckets + 64]
        return pd.DataFrame({"bucket": [f.bucket.iloc[0]], "hashes": [h.tobytes()], "counts": [n.tobytes()], "top_hashes": [h[top].tobytes()], "top_counts": [n[top].tobytes()], "total": [int(n.sum())], "distinct": [len(h)], "bins": [(np.bincount(bins(h), n, BINS) + np.bincount(bins(h), minlength=BINS)).astype(np.int64).tobytes()]})

    raw = train.select("text").mapInArrow(local, "bucket int, hashes binary, counts binary")
    return space.write(raw.groupBy("bucket").applyInPandas(merge, "bucket int, hashes binary, counts binary, top_hashes binary, top_counts binary, total long, distinct long, bins binary"), "counts")


def frequent(counts: DataFrame) -> tuple[Counts, Model]:
    """The head of all counts, and a model that starts at the unigram shares. The head's size is fixed."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in f.top_hashes])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in f.top_counts])
        order = np.lexsort((h, -n))[:HEAD]
        return pd.DataFrame({"top_hashes": [h[order].tobytes()], "top_counts": [n[order].tobytes()], "total": [f.total.sum()], "distinct": [f.distinct.sum()], "bins": [sum(np.frombuffer(x, np.int64) for x in f.bins).tobytes()]})

    tops = counts.select((F.col("bucket") % MERGERS).alias("merger"), "top_hashes", "top_counts", "total", "distinct", "bins")
    rows = tops.groupBy("merger").applyInPandas(merge, "top_hashes binary, top_counts binary, total long, distinct long, bins binary").collect()
    total, distinct = sum(r.total for r in rows), sum(r.distinct for r in rows)
    h = np.concatenate([np.frombuffer(r.top_hashes, np.uint64) for r in rows] or [np.empty(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r.top_counts, np.int64) for r in rows] or [np.empty(0, np.int64)])
    order = np.lexsort((h, -n))[:HEAD]
    h, n = h[order], n[order]
    keys, table, vocabulary = np.zeros(HEAD_SLOTS, np.uint64), np.zeros(HEAD_SLOTS, np.int64), np.full(HEAD_SLOTS, -1, np.int64)
    at = (mixed(h) >> np.uint64(40)).astype(np.int64) & (HEAD_SLOTS - 1)
    # where two share a place, the rarer one is left to the join
    at, first = np.unique(at, return_index=True)
    keys[at], table[at] = h[first], n[first]
    chosen = at[np.argsort(first)][:VOCABULARY]
    # ranks are dealt to the classes in turn, so that classes weigh about the same
    vocabulary[chosen] = np.arange(len(chosen)) % CLASSES * PER + np.arange(len(chosen)) // CLASSES
    share = np.full(VOCABULARY, 1e-3)
    share[vocabulary[chosen]] = table[chosen]
    rest = total - int(table[chosen].sum())
    by_class, by_word = np.zeros((CLASS_ROWS, CLASSES + 1), np.float32), np.zeros((WORD_ROWS * CLASSES, PER), np.float32)
    rest_bins = sum((np.frombuffer(x.bins, np.int64) for x in rows), np.zeros(BINS, np.int64)) - np.bincount(bins(keys[chosen]), table[chosen] + 1, BINS).astype(np.int64)
    by_bin = np.zeros((WORD_ROWS * NODES, PER), np.float32)
    parts = (rest_bins + 1.0).reshape(PER, PER)
    by_bin[0], by_bin[1:NODES] = np.log(parts.sum(1) / parts.sum()), np.log(parts / parts.sum(1, keepdims=True))
    mass = np.append(share.reshape(CLASSES, PER).sum(1), rest + 1)
    by_class[0] = np.log(mass / mass.sum())
    by_word[:CLASSES] = np.log(share.reshape(CLASSES, PER) / mass[:-1, None])
    return Counts(total, distinct, keys, table, vocabulary, rest, distinct - len(chosen), rest_bins), Model(by_class, by_word, by_bin)


def _prepared(texts: Iterator[str | None], c: Counts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, hashes, places in the head, class rows, word rows, numbers of model words or -1 - bin of others) of each piece of each text."""
    for i, t in enumerate(texts):
        whole = tokens(t)
        for a in range(0, len(whole), PIECE):
            h = whole[a : a + PIECE]
            at = c.slots(h)
            word = np.where(at >= 0, c.vocabulary[at], -1)
            yield i, h, at, *contexts(h, whole[a - 3 : a] if a else None), np.where(word < 0, -1 - bins(h), word)


def _total(f: pd.DataFrame, kind: type) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(part, first row, rows that were seen, how often, summed changes) of one range of rows, added in the order of tasks."""
    part, first = int(f.part.iloc[0]), int(f["first"].iloc[0])
    width = (CLASSES + 1, PER, PER)[part]
    up, down = np.zeros((RANGE, width)), np.zeros(RANGE)
    f = f.sort_values("task")
    for rows, seen, change in zip(f.rows, f.seen, f.change, strict=True):
        rows, seen = np.frombuffer(rows, np.int32) - first, np.frombuffer(seen, np.float64)
        change = np.frombuffer(change, kind).reshape(-1, width).astype(np.float64)
        # a task's changes count by how often it saw the row; those of teams are weighted already
        up[rows] += change * seen[:, None] if kind is np.float16 else change
        down[rows] += seen
    hit = np.flatnonzero(down)
    return part, first, hit, down[hit], up[hit]


def train_rounds(train: DataFrame, c: Counts, m: Model, rounds: int = ROUNDS) -> Model:
    """Each round, tasks step through their documents of the round's share from the same weights; what they changed is averaged,
    row by row and by how often a task saw the row. Changes travel as 16-bit rows that were seen, are summed by ranges of rows, first over teams
    of tasks, and always in the order of tasks: the same input in the same parts gives the same model."""
    for r in range(rounds):
        start = m

        def gradients(batches: Batches, start: Model = start) -> Batches:
            def chunks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                kept, size = [], 0
                for b in sliced(batches, 0):
                    for _, _, _, rows, last, word in _prepared((t.as_py() for t in b.column(0)), c):
                        kept.append((rows, last, word))
                        size += len(last)
                        if size >= CHUNK:
                            yield from _cut(kept)
                            kept, size = [], 0
                if kept:
                    yield from _cut(kept)

            now, *seen_rows = learn(start, chunks())
            task, out = TaskContext.get().partitionId(), []
            for part, (new, old, seen) in enumerate(zip((now.by_class, now.by_word, now.by_bin), (start.by_class, start.by_word, start.by_bin), seen_rows, strict=True)):
                hit = np.flatnonzero(seen)
                for h in np.split(hit, np.flatnonzero(np.diff(hit // RANGE)) + 1) if len(hit) else ():
                    out.append((part, int(h[0]) // RANGE * RANGE, task, h.astype(np.int32).tobytes(), seen[h].astype(np.float64).tobytes(), (new[h] - old[h]).astype(np.float16).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["part", "first", "task", "rows", "seen", "change"])

        def team(f: pd.DataFrame) -> pd.DataFrame:
            part, first, hit, seen, up = _total(f, np.float16)
            return pd.DataFrame({"part": [part], "first": [first], "task": [f.task.min()], "rows": [(hit + first).astype(np.int32).tobytes()], "seen": [seen.tobytes()], "change": [up.tobytes()]})

        def total(f: pd.DataFrame) -> pd.DataFrame:
            part, first, hit, seen, up = _total(f, np.float64)
            return pd.DataFrame({"part": [part], "rows": [(hit + first).astype(np.int32).tobytes()], "change": [(up / seen[:, None]).astype(np.float32).tobytes()]})

        mine = train.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(rounds)) == r).select("text")
        schema = "part int, first int, task long, rows binary, seen binary, change binary"
        teams = mine.mapInArrow(gradients, schema).groupBy("part", "first", F.expr(f"task div {TEAM}")).applyInPandas(team, schema)
        m = Model(m.by_class.copy(), m.by_word.copy(), m.by_bin.copy())
        for x in teams.groupBy("part", "first").applyInPandas(total, "part int, rows binary, change binary").collect():
            table = (m.by_class, m.by_word, m.by_bin)[x.part]
            table[np.frombuffer(x.rows, np.int32)] += np.frombuffer(x.change, np.float32).reshape(-1, table.shape[1])
    return m


def _cut(kept: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    parts = [np.concatenate(x) for x in zip(*kept, strict=True)]
    for a in range(0, len(parts[0]), CHUNK):
        yield tuple(p[a : a + CHUNK] for p in parts)


def lm_scores(spark: SparkSession, docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, scores as log10.

    Counts come from all rows whose crc32(doc_id) mod ``mod`` isn't ``held``; null texts are empty, one end token; repeated rows
    count and are scored each. With no training rows c, N and V are 0. The model gives P(class | context) * P(word | class,
    context) to its own words. All others, however many, have P(rest | context) * P(first digit | context) * P(second digit | first, context)
    * (c + 1) / (N_bin + V_bin + 1), digits of their hash and N and V those of the rest's words with both digits, so it sums to 1.

    Empty tables give no rows. Long texts are scored in pieces whose contexts reach back over the cut, so the result is that of the whole text.
    Other columns are not read.

    Words outside the bounded head are sent, packed by bucket of their hash, to the one place that has their count; the sums come back by batch.
    """
    space = Workspace(spark, "maxent")
    is_held = F.expr(f"{crc_mod('doc_id', mod)} = {held}")
    train = docs.where(~is_held).select("doc_id", "text")
    buckets = max(2 * partitions(spark), ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUCKET))
    counts = count_words(space, train, buckets)
    c, m = frequent(counts)
    m = train_rounds(train, c, m)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["batch", "bucket", "doc_id", "held_out", "at", "n_tokens", "n_known", "base_score", "score", "hashes", "owners"]
    types = [pa.int64(), pa.int32(), None, pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]

    def score(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        log_counts, log_bins = np.log10(c.counts + 1.0), np.log10(c.rest_bins + 1.0)
        for k, b in enumerate(sliced(batches, 2)):
            n = b.num_rows
            kinds = [t or b.column(0).type for t in types]
            size, known, base, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            tails, owners, kept, who = [], [], [], []

            def flush(kept: list, who: list, model: np.ndarray) -> None:
                rows, last, word = (np.concatenate(x) for x in zip(*kept, strict=True))
                p, own, q = probabilities(m, rows, last, word)
                got = np.log10(p[np.arange(len(p)), np.where(word >= 0, word // PER, CLASSES)].astype(np.float64))
                got[own] += np.log10(q[np.arange(len(own)), word[own] % PER].astype(np.float64))
                rest = np.flatnonzero(word < 0)
                bin_ = -1 - word[rest]
                _, q = bin_probabilities(m, last[rest], bin_)
                got[rest] += np.log10(q[np.arange(len(q)), np.concatenate([bin_ // PER, bin_ % PER])].astype(np.float64)).reshape(2, -1).sum(0)
                model += np.bincount(np.concatenate(who), got, len(model))

            waiting = 0
            for i, h, at, rows, last, word in _prepared((t.as_py() for t in b.column(2)), c):
                size[i] += len(h)
                head = at[at >= 0]
                known[i] += len(head)
                base[i] += log_counts[head].sum()
                others = word < 0
                model[i] += log_counts[at[others & (at >= 0)]].sum() - log_bins[-1 - word[others]].sum()
                lost = h[at < 0]
                tails.append(lost)
                owners.append(np.full(len(lost), i, np.int32))
                for a in range(0, len(h), CHUNK):
                    z = slice(a, a + CHUNK)
                    kept.append((rows[z], last[z], word[z]))
                    who.append(np.full(len(last[z]), i, np.int64))
                    waiting += len(last[z])
                    if waiting >= CHUNK:
                        flush(kept, who, model)
                        kept, who, waiting = [], [], 0
            if kept:
                flush(kept, who, model)
            key = (task << 33) + k
            none = lambda t, n: pa.nulls(n, t)
            yield pa.record_batch(
                [pa.array(np.full(n, key)), none(kinds[1], n), b.column(0), b.column(1), pa.array(np.arange(n, dtype=np.int32)), pa.array(size), pa.array(known), pa.array(base), pa.array(model), none(kinds[9], n), none(kinds[10], n)], names
            )
            h, o = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (tails, owners))
            home = (mixed(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[order], np.arange(buckets + 1))
            hit = [i for i in range(buckets) if ends[i] < ends[i + 1]]
            cut = lambda x, order=order, ends=ends, hit=hit: pa.array([x[order[ends[i] : ends[i + 1]]].tobytes() for i in hit], pa.binary())
            yield pa.record_batch([pa.array([key] * len(hit), pa.int64()), pa.array(hit, pa.int32()), *[none(t, len(hit)) for t in kinds[2:9]], cut(h), cut(o)], names)

    made = space.write(
        docs.select("doc_id", is_held.alias("held_out"), "text").mapInArrow(score, f"batch long, bucket int, doc_id {kind}, held_out boolean, at int, n_tokens long, n_known long, base_score double, score double, hashes binary, owners binary"), "scored"
    )

    def look_up(key: tuple, asked: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(have.hashes.iloc[0], np.uint64) if len(have) else np.empty(0, np.uint64)
        n = np.frombuffer(have.counts.iloc[0], np.int64) if len(have) else np.empty(0, np.int64)
        out = []
        for batch, q, o in zip(asked.batch, asked.hashes, asked.owners, strict=True):
            q, o = np.frombuffer(q, np.uint64), np.frombuffer(o, np.int32)
            at = np.minimum(np.searchsorted(h, q), max(0, len(h) - 1))
            got = np.where(h[at] == q, n[at], 0) if len(h) else np.zeros(len(q), np.int64)
            who, to = np.unique(o, return_inverse=True)
            out.append((batch, who.astype(np.int32).tobytes(), np.bincount(to, got > 0, len(who)).astype(np.int32).tobytes(), np.bincount(to, np.log10(got + 1.0), len(who)).tobytes()))
        return pd.DataFrame(out, columns=["batch", "who", "known", "logs"])

    def gather(key: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        known, logs = rows.n_known.to_numpy().copy(), np.zeros(len(rows))
        for who, k, x in zip(sums.who, sums.known, sums.logs, strict=True):
            who = np.frombuffer(who, np.int32)
            known[who] += np.frombuffer(k, np.int32)
            logs[who] += np.frombuffer(x, np.float64)
        size = rows.n_tokens.to_numpy()
        return pd.DataFrame(
            {
                "doc_id": rows.doc_id, "held_out": rows.held_out, "n_tokens": size, "n_known": known, "train_tokens": c.total,
                "base_score": rows.base_score.to_numpy() + logs - size * np.log10(c.total + c.distinct + 1.0), "score": rows.score.to_numpy() + logs,
            }
        )

    tails = made.where("bucket is not null").select("batch", "bucket", "hashes", "owners")
    sums = tails.groupBy("bucket").cogroup(counts.select("bucket", "hashes", "counts").groupBy("bucket")).applyInPandas(look_up, "batch long, who binary, known binary, logs binary")
    rows = made.where("bucket is null").select("batch", "doc_id", "held_out", "at", "n_tokens", "n_known", "base_score", "score")
    return rows.groupBy("batch").cogroup(sums.groupBy("batch")).applyInPandas(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
