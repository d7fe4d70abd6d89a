"""Vector codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from ridgeline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n int"
r = random.Random(3)
near = [[r.gauss(0, 0.2) for _ in range(32)] for _ in range(9)]


def vector(k: int) -> list[float]:
    return [c + r.gauss(0, 0.03) for c in near[k % 9]]


def coded(rows, parts, entries, rounds):
    """(code, error) of each row (vec_id, vector, label), all of one length, and the codebooks' text."""
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    own = len(ints[0]) // parts
    cut = [[v[p * own : (p + 1) * own] for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], ",".join(str(x) for b in books for e in b for x in e)


ROWS = [(k, vector(k), k % 4 or None) for k in range(300)] + [(k, near[2], 1) for k in range(400, 620)] + [(7, vector(1), 2), (None, vector(2), 2), (-5, [0.0] * 32, 3), (1000, [90_000.0, *[-0.5] * 31], 3)]
ODD = [(2000, None, 1), (2001, [None] + [0.1] * 31, 1), (2002, [float("nan")] + [0.1] * 31, 1), (2003, [float("inf")] * 32, 1), (2004, [float("-inf")] + [0.0] * 31, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 5, 6) for i, v, x in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [4, 32])
def test_equals_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    want, text = coded([(i, np.float32(v).tolist(), x) for i, v, x in ROWS], 16, 64, 2)
    out = vector_codes.code_report(frame(spark, ROWS + ODD)).collect()
    labels: dict = {}
    for (_, _, x), (_, e) in zip(ROWS, want):
        labels[x] = labels.get(x, 0) + e
    assert sorted((r.vec_id if r.vec_id is not None else -99, r.code, r.error, r.label_error) for r in out) == sorted((i if i is not None else -99, c, e, labels[x]) for (i, _, x), (c, e) in zip(ROWS, want))
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("parts, entries, rounds, n", [(4, 8, 3, 200), (16, 64, 2, 40), (2, 1, 1, 50), (32, 5, 0, 60)])
def test_other_sizes(spark, parts, entries, rounds, n):
    rows = ROWS[:n]
    want, text = coded([(i, np.float32(v).tolist(), x) for i, v, x in rows], parts, entries, rounds)
    out, books = vector_codes.vector_codes(frame(spark, rows), parts, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in out.collect()} == {i: w for (i, _, _), w in zip(rows, want)}
    assert vector_codes.codebooks_text(books) == text


def test_odd_tables(spark):
    assert vector_codes.code_report(frame(spark, [])).collect() == vector_codes.code_report(frame(spark, ODD)).collect() == []
    ragged = [(1, [0.5, 0.25], None), (2, [], None), (3, [0.5] * 17, None)]
    filled = [(i, v + [0.0] * (32 - len(v)), x) for i, v, x in ragged]
    want, text = coded(filled, 16, 64, 2)
    assert {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in vector_codes.code_report(frame(spark, ragged)).collect()} == {i: (*w, hashlib.sha256(text.encode()).hexdigest()) for (i, _, _), w in zip(filled, want)}
    blank = vector_codes.code_report(frame(spark, [(1, [], 1), (2, [], None)])).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in blank} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}
    large = vector_codes.code_report(frame(spark, [(k, [1e9 * (k % 3)] * 16, 1) for k in range(100)])).collect()  # distances beyond int64
    assert all(r.error == 0 and r.label_error == 0 for r in large)
    with pytest.raises(Exception, match="2\\^44"):
        vector_codes.code_report(frame(spark, [(1, [1e30] * 16, 1)]))


def test_boxes_bound_distances():
    """No entry that is nearest to a piece is off its block's shortlist, and few are on it."""
    g = np.random.default_rng(4)
    points = g.normal(0, 40, (16384, 4)).astype(np.int64)
    points = points[np.argsort(vector_codes.hilbert_keys(points), kind="stable")]
    book = points[g.choice(16384, 64, replace=False)]
    starts = np.arange(0, 16384, 16)
    may = vector_codes.shortlists(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), book)
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert may[np.arange(16384) // 16][d == d.min(axis=1)[:, None]].all()
    assert may.mean() < 0.2


def test_hilbert_curve_has_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = vector_codes.hilbert_keys(grid)
    assert len(set(keys.tolist())) == 512
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
