"""The conversation trie against plain Python, over one run and over many."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, name string, depth int, run string"


def brute(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append((c, d == len(new)))
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = {q for q in below if len(q) == len(p) + 1}
        leaves = sum(not any(len(s) > len(q) and s[: len(q)] == q for s in below) for q in below)
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), parent, len(m), len(children), leaves, sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed: int, n: int):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 4 * n), n):
        for t in range(r.choice([1, 1, 2, 3, 9, 12, 14])):
            rows.append((c, t, r.choice(["user", "user", None]), r.choice(["a", "a", "bä", "", None])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1080) for t in range(10)]  # copies, more than a run has
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2030) for t in range(8 + c % 7)]  # one is another's start
    rows += [(3000, None, "x", "b"), (3000, 1, "y", "b"), (3000, 1, "x", "c"), (3000, 1, "x", "b"), (3000, 1, "x", "b"), (3000, None, "w", "b"), (None, 1, "x", "b"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "p", "n", 7, "r") for x in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 3), (3, 13), (4, 40)])
def test_equals_plain_python(spark, seed, partitions):
    rows = rows_of(seed, 60)
    paths = prefix_trie.rebuilt(frame(spark, rows))
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = prefix_trie.trie(paths)
        assert out.columns == prefix_trie.NODE_COLUMNS
        assert found(out) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_tables(spark):
    assert found(prefix_trie.trie_report(frame(spark, []))) == found(prefix_trie.trie_report(frame(spark, [(None, 1, "a", "b")]))) == []
    none = [(3, 1, "user", "a")]  # h is 5, and conversation 0 is absent
    assert zlib.crc32(b"3") % 9 > 0 and found(prefix_trie.trie_report(frame(spark, none))) == brute(none)
    long = [(5, t, "user", "x" * (t % 3)) for t in range(3000)] + [(6, t, "user", "x" * (t % 3)) for t in range(2000)]
    out = found(prefix_trie.trie_report(frame(spark, long)))
    assert len(out) == 3001 and max(x[1] for x in out) == 3000
    assert [x for x in out if x[1] == 2000] == [(5, 2000, 5, 2, 1, 1, 1999 % 3, hashlib.sha256(b"6").hexdigest())]
    text = "é" * 500_000
    big = [(10, 0, "user", text), (11, 0, "user", text), (10, 1, "user", "b")]
    assert found(prefix_trie.trie_report(frame(spark, big))) == brute(big)


def forest(paths, before=None, after=None):
    """Rows of one run over (id, path as a list of small numbers)."""
    coded = sorted((b"".join(bytes([x]) * prefix_trie.KEY for x in p), c) for c, p in paths)
    distinct = sorted({p for p, _ in coded})
    ids = [[c for q, c in coded if q == p] for p in distinct]
    return prefix_trie.Forest(distinct, ids, [np.ones(len(p) // prefix_trie.KEY, int) for p in distinct], before, after).rows


def test_one_run():
    rows = forest([(1, [1, 2, 3]), (2, [1, 2, 4]), (3, [1, 2]), (4, [5])])
    found = sorted(zip(rows["depth"], rows["conv_id"], rows["n_convs"], rows["n_children"], rows["n_leaves"], rows["saved_tokens"], map(str, rows["parent_conv_id"])))
    assert found == [(0, 1, 4, 2, 3, 4, "None"), (1, 1, 3, 1, 2, 4, "1"), (1, 4, 1, 0, 1, 0, "1"), (2, 1, 3, 2, 2, 2, "1"), (3, 1, 1, 0, 1, 0, "1"), (3, 2, 1, 0, 1, 0, "1")]
    assert not any(rows["name"])


def test_open_nodes_are_contracted():
    """Only prefixes that a neighbouring run shares leave their run."""
    after = b"".join(bytes([x]) * prefix_trie.KEY for x in (1, 2, 9))
    rows = forest([(1, [0, 5]), (2, [1, 2, 3]), (3, [1, 2, 4])], after=after)
    assert sorted(d for d, n in zip(rows["depth"], rows["name"]) if n) == [0, 1, 2]
    at = {d: k for k, (d, n) in enumerate(zip(rows["depth"], rows["name"])) if n}
    assert rows["n_children"][at[0]] == 1 and rows["n_children"][at[1]] == 0 and rows["n_children"][at[2]] == 2  # node 1 and 2 count as children in their last run
