"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from hashlib import md5, sha256

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    found = WORD.findall(text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found


def substring_dedup(docs: list[tuple[int | None, str | None]], window: int = 20) -> dict:
    """doc_id -> (n_words, n_removed, sha); a null id sorts last."""
    place = lambda i: (i is None, i or 0)
    first: dict[tuple, tuple] = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            here = (place(i), k)
            if key not in first or here < first[key]:
                first[key] = here
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (place(i), k):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingles(text: str | None, k: int = 5) -> set:
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_components(docs: list[tuple[int, str | None]], percent: int = 85) -> dict:
    """doc_id -> (n_shingles, component)."""
    sets = {i: shingles(t) for i, t in docs}
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.8) -> dict:
    """(doc_id, item_id) -> best similarity, over all item-sized windows."""
    out = {}
    for i, t in docs:
        w = words(t, lower=True)
        for item, u in items:
            v = words(u, lower=True)
            if not v or not w:
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            bag = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            if not any(tuple(w[j : j + k]) in bag for j in range(len(w) - k + 1)):
                continue
            for s in range(len(w) - n + 1):
                own = Counter(tuple(w[j : j + k]) for j in range(s, s + n - k + 1))
                both = sum((own & bag).values())
                sim = both / (sum(own.values()) + sum(bag.values()) - both) if own or bag else 0
                if sim >= least:
                    out[i, item] = max(out.get((i, item), 0), round(sim, 6))
    return out


def shares(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of all sizes by weight; whoever would get more than ``most`` times its size gets that, and the others share again."""
    full: set[int] = set()
    while True:
        left = sum(sizes) - sum(most * sizes[k] for k in full)
        weight = sum(w for k, w in enumerate(weights) if k not in full)
        out = [Fraction(most * n) if k in full else Fraction(left * weights[k], weight) for k, n in enumerate(sizes)]
        if over := {k for k, x in enumerate(out) if k not in full and x > most * sizes[k]}:
            full |= over
        else:
            return out


def seats(votes: list, n: int) -> list[int]:
    """One seat after the other to the highest quotient."""
    got = [0] * len(votes)
    for _ in range(n if any(votes) else 0):
        got[max(range(len(votes)), key=lambda k: (votes[k] / Fraction(2 * got[k] + 1), -k))] += 1
    return got


def mixed(docs: list[tuple[int | None, str | None, str | None]], block: int = 32, shards: int = 8, most: int = 3, seed: int = 17) -> dict:
    """doc_id -> words that the mix takes, from (doc_id, text, source) with one row for each id."""
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    line: dict = {}
    for i, t, s in docs:
        digest = md5(f"{seed}:{'-' if i is None else i}:{t or ''}".encode()).hexdigest()
        line.setdefault((s, int(digest[16:24], 16) % shards), []).append((int(digest[:15], 16), i, len(words(t))))
    size = {s: sum(n for key, own in line.items() if key[0] == s for *_, n in own) for s in sources}
    target = [Fraction(float(x)) for x in shares([size[s] for s in sources], [k % 3 + 1 for k in range(len(sources))], most)]
    total = sum(size.values())
    out = {}
    for s, goal, n in zip(sources, target, seats(target, (2 * total + block) // (2 * block)), strict=True):
        own = sorted(k for t, k in line if t == s)
        cell = [sum(w for *_, w in line[s, k]) for k in own]
        for k, have, q in zip(own, cell, seats(cell, n), strict=True):
            quota = most * have if goal >= most * size[s] else min(block * q, most * have)
            whole, rest = divmod(quota, have) if have else (0, 0)
            for _, i, w in sorted(line[s, k], key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
                out[i] = whole * w + min(w, rest)
                rest -= min(w, rest)
    return out


def curve(dims: int, bits: int) -> dict[tuple, int]:
    """Cell -> place on the curve, by the operator's own index; that this is a Hilbert curve is another test."""
    from helixframe.llm.sharding import hilbert_index

    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    return dict(zip(map(tuple, grid.T.tolist()), hilbert_index(list(grid), bits).tolist(), strict=True))


def places(rows: list[tuple], bits: int, walk: dict[tuple, int]) -> dict[int, int]:
    """doc_id -> place on the curve of rows (doc_id, text, dimension, ...): cells by exact quantiles; equal texts share the cell of the smallest id."""
    dims = range(2, len(rows[0]))
    cuts = [len(rows) * c / (1 << bits) for c in range(1, 1 << bits)]
    edges = {}
    for d in dims:
        own = sorted(("" if r[d] is None else r[d]) for r in rows)
        below = {v: k for k, v in reversed(list(enumerate(own)))}  # rows before the value
        edges[d] = {min((v for v, k in below.items() if k >= cut), default=None) for cut in cuts} - {None}
    first: dict = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(r[1], r)
    cell = {t: tuple(sum(("" if r[d] is None else r[d]) >= e for e in edges[d]) for d in dims) for t, r in first.items()}
    return {r[0]: walk[cell[r[1]]] for r in rows}


def merges(data: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece by the rule of the vocabulary: join the neighbours of the lowest rank until none is known."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        rank, at = min(((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)
