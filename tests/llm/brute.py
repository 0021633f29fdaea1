"""Plain versions of the operators over rows in memory, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers


def packing_faults(docs, rows, capacity=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    key = lambda x: (x[0] is not None, x)
    faults = [] if sorted(got, key=key) == sorted(want, key=key) else ["pieces differ"]
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for k, parts in held.items():
        at = 0
        for offset, length in sorted(parts):
            if offset != at:
                faults.append(f"gap in {k}")
            at += length
        if at > capacity:
            faults.append(f"{k} holds {at}")
    return faults, len(held), -(-sum(x[3] for x in want) // capacity)


def base_secrets(text):
    """(counts by kind, digest) straight from the patterns, letter by letter as they are given."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{z}" for a, k, z in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest(), set(joined.split(",")) - {""}


def top_k(rows, k=10, every=100):
    v = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x in rows}
    out = []
    for q in sorted(i for i in v if i % every == 0):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def grouped(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def cosine_links(rows, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    return [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_links(sets):
    """Pairs of ids with 100 * intersection >= 75 * union, by an index of all shingles."""
    index, links = defaultdict(list), []
    for i, s in sorted(sets.items()):
        seen = defaultdict(int)
        for x in s:
            for j in index[x]:
                seen[j] += 1
            index[x].append(i)
        links += [(j, i) for j, c in seen.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    return links
