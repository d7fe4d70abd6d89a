"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit for each of 64 places, set if it is set in
over half of the XXH64 hashes of the document's three-word shingles.
Fingerprints that differ in at most ``budget`` bits are linked, and documents
belong to the components that links make.

The join works on distinct fingerprints. With budget + 1 segments, two linked
fingerprints agree in at least one segment, so there is one trie for each
segment, over the fingerprints turned so that the segment comes first. Below
a common first segment pairs of nodes are traversed together: each step goes
one bit down, adds the bit by which two nodes differ, and drops the pair when
the budget is passed. A node pair of more than ``most`` fingerprints is cut
before it is dealt, into pairs of subtrees ``deep`` bits below whose paths
differ in no more than the budget, and so on until all are small enough.

A task reports no list of all pairs but a spanning forest of the links in its
subtree, which keeps every component and at most one row for a fingerprint.

Defined cases: words are in lower case (A-Z only); one or two words are one
shingle; a null text, an empty one or one without words has fingerprint zero,
linked like any other; a very long text is hashed whole; a bit set in just half
of the hashes is 0; documents without an id take part but get no row of
their own in the components' least ids; repeated rows fall together; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_nothing, sized_broadcast, slices, stored, text_bytes
from .components import connected

BITS = 64
WORDS = 3
SEED = 42
#: Ids (of 17 bytes at most) that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: BYTE_BITS[v, k]: bit k of the byte v.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: bytes, size: int = WORDS) -> np.ndarray:
    """The hash of each run of ``size`` words, repeats included; fewer words are one run."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.array([xxh64_intdigest(s, SEED) for s in runs], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    # how often each value occurs in each of the eight bytes, and from that each bit
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``."""

    def prints(batches):
        keep_nothing()
        for b in slices(batches):
            fp = [majority(shingle_hashes(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(prints, "doc_id long, fp long")


def _turned(by: int):
    """The fingerprint column turned left by ``by`` bits."""
    fp = F.col("fp")
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def segments(budget: int) -> list[tuple[int, int]]:
    """(start, width) of each of budget + 1 segments."""
    ends = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, z - a) for a, z in zip(ends, ends[1:])]


class Forest:
    """Union-find over positions 0 to n - 1; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def trie_pairs(keys: np.ndarray, roots: np.ndarray, budget: int, report, most: int = 1 << 19) -> None:
    """Traverse pairs of trie nodes over the sorted, distinct ``keys``.

    A node is a range of keys with a common path. ``roots`` holds pairs
    (a, a_end, b, b_end, bits that differ so far, depth). ``report`` gets
    the positions of pairs within the budget. Pairs of nodes wait on a stack in
    lots of at most ``most``, so memory doesn't follow their number.
    """
    stack = [roots] if len(roots) else []
    while stack:
        lot = stack.pop()
        if len(lot) > most:
            stack.extend([lot[most:], lot[:most]])
            continue
        a, a_end, b, b_end, off, depth = lot.T
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            x, y, d = a[single], b[single], off[single]
            # what differs above was counted on the way; the keys differ in the same bits
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            report(x[near], y[near])
            a, a_end, b, b_end, off, depth = lot[~single].T
        if not len(a):
            continue
        bit = np.uint64(1) << (np.uint64(BITS - 1) - depth.astype(np.uint64))

        def middle(lo, hi):
            path = keys[lo] & ~(bit | (bit - np.uint64(1)))
            return np.clip(np.searchsorted(keys, path | bit), lo, hi)

        am, bm, same = middle(a, a_end), middle(b, b_end), a == b
        down = np.concatenate([
            np.stack([a, am, b, bm, off, depth + 1]), np.stack([am, a_end, bm, b_end, off, depth + 1]),
            np.stack([a, am, bm, b_end, off + 1, depth + 1]),
            np.stack([am, a_end, b, bm, off + 1, depth + 1]) + np.where(same, budget + 1, 0) * np.array([0, 0, 0, 0, 1, 0])[:, None],
        ], axis=1).T
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        alone = (down[:, 0] == down[:, 2]) & (down[:, 1] - down[:, 0] == 1)
        down = down[~alone]
        if len(down):
            stack.append(down)


def _starts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the end."""
    change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], change, [len(group)]])


def _whole_groups(batches):
    """Arrow batches as tables of numbers (segment, left, first, right, key), cut between groups."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1)
        if held and (rows[-1, :4] == held[0][-1, :4]).all():
            held.append(rows)  # the last group goes on
            continue
        rows = np.concatenate([*held, rows])
        starts = _starts(rows[:, :4])
        if len(starts) > 2:
            yield rows[: starts[-2]]
        held = [rows[starts[-2] :]]
    if held:
        yield np.concatenate(held)


def _subtree_links(batches, budget: int, width: int):
    """(key, key, segment) of the links within groups of sorted rows.

    A group with left = right = -1 is all of a first segment's subtree; such
    groups of one segment follow each other in the order of their keys and are
    traversed at once. The rows of any other group lie in the subtrees ``left``
    and ``right``, whose depth is in ``segment``, and pairs are sought between the two.
    """
    for rows in _whole_groups(batches):
        lots = _starts(np.where(rows[:, 1:2] < 0, np.stack([rows[:, 0], rows[:, 1] * 0 - 1, rows[:, 1], rows[:, 1]], axis=1), rows[:, :4]))
        for lo, hi in zip(lots[:-1].tolist(), lots[1:].tolist()):
            own, forest = np.ascontiguousarray(rows[lo:hi, 4]).view(np.uint64), Forest(hi - lo)
            segment, left, _, right = rows[lo, :4].tolist()
            depth = segment >> DEPTH_AT
            if left < 0:
                starts = _starts(rows[lo:hi, 2:3])
                pairs = np.zeros((len(starts) - 1, 6), np.int64)
                pairs[:, 0] = pairs[:, 2] = starts[:-1]
                pairs[:, 1] = pairs[:, 3] = starts[1:]
                pairs[:, 5] = width
                trie_pairs(own, pairs[pairs[:, 1] - pairs[:, 0] > 1], budget, forest.join)
            elif left == right:
                trie_pairs(own, np.array([[0, hi - lo, 0, hi - lo, 0, width + depth]]), budget, forest.join)
            else:
                path = (own >> np.uint64(BITS - width - depth)) & np.uint64((1 << depth) - 1)
                cut = int(np.searchsorted(path, np.uint64(right)))
                if 0 < cut < hi - lo:
                    trie_pairs(own, np.array([[0, cut, cut, hi - lo, (left ^ right).bit_count(), width + depth]]), budget, forest.join)
            for x, y in forest.links:
                yield own[x], own[y], segment & ((1 << DEPTH_AT) - 1)


#: The column ``segment`` holds the segment's number, and from this bit on the depth of the subtrees below it.
DEPTH_AT = 8


def _cut(rows: DataFrame, budget: int, width: int, depth: int, deep: int) -> DataFrame:
    """Rows of node pairs at ``depth`` below the first segment, dealt to the pairs of nodes ``deep`` bits below."""
    number = lambda x: F.lit(x).cast("long")
    path = lambda d: F.shiftrightunsigned("key", BITS - width - d).bitwiseAND(number((1 << d) - 1))
    own, lower = path(depth) if depth else number(0), F.shiftrightunsigned("key", BITS - width - depth - deep).bitwiseAND(number((1 << deep) - 1))
    left, right = (F.greatest(number(0), F.col(c)) for c in ("left", "right"))  # -1 stands for the whole subtree
    other = F.when(own == left, right).otherwise(left)
    spent = F.bit_count(left.bitwiseXOR(right))
    flips = [sum(1 << i for i in c) for r in range(budget + 1) for c in combinations(range(deep), r)]
    below = F.explode(F.array(*[F.when(spent + x.bit_count() <= budget, number(x)) for x in flips])).alias("flip")
    found = rows.select("segment", "first", "key", F.shiftleft(own, deep).bitwiseOR(lower).alias("own"), F.shiftleft(other, deep).alias("other"), lower.alias("lower"), below).where("flip IS NOT NULL")
    other = F.col("other").bitwiseOR(F.col("lower").bitwiseXOR(F.col("flip")))
    return found.select((F.col("segment") + (deep << DEPTH_AT)).alias("segment"), F.least("own", other).alias("left"), "first", F.greatest("own", other).alias("right"), "key")


def near_pairs(prints: DataFrame, budget: int = 2, most: int = 20_000, deep: int = 8) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp``: a spanning forest of each subtree's pairs."""
    parts = segments(budget)
    turned = [prints.select(F.lit(k).cast("long").alias("segment"), _turned(start).alias("key")) for k, (start, _) in enumerate(parts)]
    rows = turned[0]
    for t in turned[1:]:
        rows = rows.unionByName(t)
    width, whole = min(w for _, w in parts), F.lit(-1).cast("long")
    rows = rows.select("segment", whole.alias("left"), F.shiftrightunsigned("key", BITS - width).alias("first"), whole.alias("right"), "key")
    node, depth, done = ["segment", "left", "first", "right"], 0, []
    while width + depth + deep <= BITS:
        large = stored(rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*node))
        if large.isEmpty():
            break
        some = sized_broadcast(large, BROADCAST_ROWS)
        done.append(rows.join(some, node, "left_anti"))
        rows = stored(_cut(rows.join(some, node, "left_semi"), budget, width, depth, deep))
        depth += deep
    for part in done:
        rows = rows.unionByName(part)
    # keys as unsigned: the order of the key with its first bit flipped
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = rows.select(*node, "key").repartition(*node).sortWithinPartitions(*node, order)

    def search(batches):
        found = _subtree_links(batches, budget, width)
        lot: list[tuple] = []
        for x in found:
            lot.append(x)
            if len(lot) == 10_000:
                yield _links(lot, parts)
                lot = []
        if lot:
            yield _links(lot, parts)

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _links(lot: list[tuple], parts: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array([x[k] for x in lot], np.uint64) for k in (0, 1))
    back = np.array([parts[int(x[2])][0] for x in lot], np.uint64)
    turn = lambda v: np.where(back == 0, v, (v >> back) | (v << (np.uint64(BITS) - back) % np.uint64(BITS)))
    return pa.RecordBatch.from_arrays([pa.array(turn(v).view(np.int64)) for v in (a, b)], ["a", "b"])


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach."""
    prints = stored(fingerprints(docs))
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(near_pairs(each.select("fp"), budget))
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp")


def near_duplicate_report(docs: DataFrame, budget: int = 2) -> DataFrame:
    return near_duplicates(docs, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, budget: int = 2, classes: DataFrame | None = None) -> DataFrame:
    """One row of ``docs`` for each component, that with the least doc_id; rows without an id stay.

    ``classes`` has (doc_id, component_id) for each row of ``docs``, by
    fingerprints where it isn't given. Only ids travel, unless they pass the bound of a broadcast; texts are
    shuffled for ids that several rows share.
    """
    classes = (near_duplicates(docs, budget) if classes is None else classes).groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    ids = stored(classes.where("doc_id <> component_id OR doc_id = component_id AND n > 1").select(F.col("doc_id").alias("_copy_id"), (F.col("doc_id") == F.col("component_id")).alias("_first")))
    own = lambda x: docs["doc_id"].cast("long") == x["_copy_id"]
    every, first = sized_broadcast(ids, BROADCAST_ROWS), ids.where("_first")
    rest = docs.join(every, own(every), "left_anti")
    if first.isEmpty():
        return rest
    return rest.unionByName(docs.join(sized_broadcast(first, BROADCAST_ROWS), own(first), "left_semi").dropDuplicates(["doc_id"]))
