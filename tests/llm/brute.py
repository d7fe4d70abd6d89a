"""Plain Python versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def quality(text: str | None) -> tuple:
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n, r = len(w), len(repeated)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def fingerprint(text: str | None) -> int:
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(values: list[int], budget: int = 2) -> list[int]:
    """For each value the place of the first one that links reach."""
    up = list(range(len(values)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def near_components(texts: list[str | None], size: int = 5) -> list[int]:
    """For each text the place of the first one that links of Jaccard similarity 4/5 reach."""
    own = [words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in own]
    up = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if up[i] != up[j] and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                a, b = min(up[i], up[j]), max(up[i], up[j])
                up = [a if x == b else x for x in up]
    return up


def substring(docs: list[tuple], size: int = 13) -> list[tuple]:
    """(n_words, n_removed, kept words) for each (doc_id, text)."""
    never = 1 << 63
    first: dict = {}
    own = [(never if d is None else d, words(t)) for d, t in docs]
    for d, w in own:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, never), d)
    out = []
    for d, w in own:
        gone = {k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for k in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeated_bytes(texts: list[str | None], size: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept sha256) for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def base_scores(docs: list[tuple]) -> list[tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) for each (doc_id, text)."""
    out_of = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    own = [[*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), b""] for _, t in docs]
    c: Counter = Counter(w for held, ws in zip(out_of, own) if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for held, ws in zip(out_of, own)]


def leaks(docs: list[tuple], items: list[tuple], share: float = 0.8) -> set[tuple]:
    """Items of fewer than five words are sought as one run of words."""

    def runs(text: str | None, size: int) -> set[tuple]:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        k = size or min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    each: dict = {}
    for i, t in items:
        each.setdefault(i, set()).update(runs(t, 0))
    have = list(each.items())
    out = set()
    for d, t in docs:
        own = {x for k in range(1, 6) for x in runs(t, k)}
        out |= {(d, i, len(s), len(s & own)) for i, s in have if s and len(s & own) >= math.ceil(share * len(s))}
    return out
