"""Near copies by the share of five-word shingles: SimHash first, then all the rest.

Two documents are linked if the Jaccard similarity of their sets of shingles is
4/5 or more; documents belong to the components that links make. At 4/5 the
SimHash fingerprints of two sets differ in about 10 of 64 bits, more than a
trie join can follow, so fingerprints alone would lose links (README has the
recall). Hence candidates come from two sides, and both are verified exactly:

1. The trie self-join of ``simhash`` gives pairs within ``budget`` bits.
2. With the shingles of all documents in one common order, two linked ones
   share a shingle among the first n - ceil(4n/5) + 1 of each (n is a set's
   size), so each document deals those out. Shingles that many documents
   of a sample share come last in the order, so that common passages meet only
   where hardly anything else stands; any order gives the same result.
3. In each shingle's group the sets are paired with the one, of those near enough
   by size, that has the fewest rarer shingles. Of a set's pairs one is verified, with those of the trie.
   That joins a large group of near copies without its pairs.
4. In groups with more than one component by then, all other pairs of different
   components are compared by small parities, and those that these allow are
   verified. Nothing but such pairs leaves a group's task. A group of more than
   20,000 sets is cut into parts, and each two parts are compared in a task of their own.

Before a pair is verified, the parities of both sets' shingles over two to four
cells for each shingle are held against each other: they differ in no more
cells than the sets differ in shingles, so no link is lost, and few other pairs
need their sets. Verifying counts the shingles that both sets hold, and only
documents in such a pair are read for it. Sets are named by 64-bit hashes, and
so are shingles; equal sets are one.

Defined cases: words are those of ``simhash``; one to four words are one
shingle; documents without words (null, empty) are copies of each other;
repeated rows and rows that share a doc_id each keep a row; very long texts
have as many shingles as they have, none is left out; further columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_nothing, list_array, sized_broadcast, slices, stored, text_bytes
from .components import connected
from .simhash import BROADCAST_ROWS, majority, near_pairs, shingle_hashes

WORDS = 5
#: Bits by which fingerprints of the trie's candidates may differ.
BUDGET = 3
#: One of so many documents is looked at for common shingles; those found in COMMON of them come last, at most MOST.
SAMPLE = 16
COMMON = 8
MOST = 200_000
#: Cells of the parities that are compared within a shingle's group.
SMALL = 256
#: Rows of a shingle's group that are compared in one task.
MOST_ROWS = 20_000
SKETCH = [f"s{k}" for k in range(SMALL // 64)]


def name_of(found: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, WORDS).view("<i8"))


def parities(found: np.ndarray) -> bytes:
    """For each of a power of two of cells, two to four for each hash, whether an odd number of them fall there."""
    cells = 1 << max(6, (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (cells - 1), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def small_parities(found: np.ndarray) -> np.ndarray:
    """Parities over SMALL cells, as 64-bit numbers."""
    return np.packbits(np.bincount(found & (SMALL - 1), minlength=SMALL).astype(np.uint8) & 1).view("<i8")


def differing(a: bytes, b: bytes) -> int:
    """In how many cells two parities differ; the longer ones are folded to the length of the others."""
    if len(a) < len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(a)
    while size >= 8 * len(b):
        x, size = x >> size ^ x & (1 << size) - 1, size // 2
    return (x ^ y).bit_count()


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text); the key of a row without doc_id comes from its text."""
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.xxhash64("text")).alias("key"), text_bytes().alias("text"))


def names(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, sim, n, bits, s0 ...) for each row: the name of its set, its fingerprint, size and parities."""

    def name(batches):
        keep_nothing()
        for b in slices(batches):
            every = [shingle_hashes(t, WORDS) for t in b.column(2).to_pylist()]
            own = [np.unique(x.view("<i8")) for x in every]
            numbers = [pa.array(map(f, x), pa.int64()) for f, x in ((name_of, own), (majority, every), (len, own))]
            small = np.array([small_parities(x) for x in own]).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.array(map(parities, own), pa.binary()), *map(pa.array, small.T)], ["doc_id", "key", "fp", "sim", "n", "bits", *SKETCH])

    return _texts(docs).mapInArrow(name, "doc_id long, key long, fp long, sim long, n long, bits binary, " + ", ".join(f"{s} long" for s in SKETCH))


def sets(texts: DataFrame) -> DataFrame:
    """(fp, own): the set of each row of ``texts`` (as by ``_texts``) under its name."""

    def take(batches):
        keep_nothing()
        for b in slices(batches, 300):
            own = [shingles(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in own], pa.int64()), list_array(own, pa.int64())], ["fp", "own"])

    return texts.mapInArrow(take, "fp long, own array<long>")


def common_shingles(docs: DataFrame) -> np.ndarray:
    some = sets(_texts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))).dropDuplicates(["fp"])
    found = some.select(F.explode("own").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(found.orderBy(F.desc("n"), "h").limit(MOST).select("h").toArrow().column(0).to_numpy())


def first_shingles(docs: DataFrame) -> DataFrame:
    """(h, n, fp, at): shingles that a linked set must share, with the set's size and their place in the order."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def deal(batches):
        keep_nothing()
        last, seen = common.value, set()
        for b in slices(batches, 300):
            h, n, fp = [], [], []
            for t in b.column(2).to_pylist():
                own = shingles(t)
                name, size = name_of(own), len(own)
                if not size or name in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    own = np.concatenate([own[~late], own[late]])
                h.append(own[: size - -(-4 * size // 5) + 1])
                n.append(size)
                fp.append(name)
            k = [len(x) for x in h]
            at = np.concatenate([np.arange(x) for x in k]) if k else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h) if h else [], pa.int64()), pa.array(np.repeat(n, k).astype(np.int64)), pa.array(np.repeat(np.array(fp, np.int64), k)), pa.array(at.astype(np.int64))], ["h", "n", "fp", "at"])

    return _texts(docs).mapInArrow(deal, "h long, n long, fp long, at long")


def _groups(batches, columns: int):
    """Tables of whole groups of equal ``h``, of two rows or more, one row for a name."""
    held = np.zeros((0, columns), np.int64)

    def cut(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])]
        ends = np.flatnonzero(np.concatenate([rows[1:, 0] != rows[:-1, 0], [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            yield rows[a:z]

    lots: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)], axis=1)
        if lots and rows[-1, 0] == lots[0][-1, 0]:
            lots.append(rows)  # the last group goes on
            continue
        held = np.concatenate([*lots, rows])
        last = int(np.searchsorted(held[:, 0], held[-1, 0]))
        if last:
            yield from cut(held[:last])
        lots = [held[last:]]
    if lots:
        yield from cut(np.concatenate(lots))


def _centres(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sizes in ascending order the place that each set is paired with first:
    of sets near enough by size that with the fewest rarer shingles, which differs least from the others."""
    out, a = np.empty(len(n), np.int64), 0
    while a < len(n):
        z = int(np.searchsorted(n, n[a] * 5 // 4, side="right"))
        out[a:z], a = a + int(at[a:z].argmin()), z
    return out


def _possible(g: np.ndarray, a, b) -> np.ndarray:
    """Whether sets can be near enough by size and by what follows the shared shingle."""
    both = g[a, 1] + g[b, 1]
    return 9 * np.minimum(np.minimum(g[a, 1], g[b, 1]), np.minimum(g[a, 1] - g[a, 3], g[b, 1] - g[b, 3])) >= 4 * both


def _pairs(rows: DataFrame, find, columns: int) -> DataFrame:
    """Possible pairs (a, b) that ``find`` gives for the groups of ``rows``, repeats included."""

    def search(batches):
        held, size = [], 0
        for g in _groups(batches, columns):
            for a, b in find(g):
                keep = _possible(g, a, b)
                held.append((g[a, 2][keep], g[b, 2][keep]))
                size += int(keep.sum())
                if size > 20_000 or len(held) > 20_000:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    dealt = rows.repartition("h").sortWithinPartitions("h", "n", "fp")
    return dealt.mapInArrow(search, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lesser name first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in held])) for k in (0, 1)], ["a", "b"])


def _first(g: np.ndarray):
    centre, own = _centres(g[:, 1], g[:, 3]), np.arange(len(g))
    yield centre[centre != own], own[centre != own]


def _others(g: np.ndarray):
    """Pairs of different components (column 4) whose parities (the columns after
    5) allow a link; of a group that was cut, pairs of its two sides (column 5).

    One of each such pair is outside the largest component, so a large group
    of near copies costs its size times the number of the others."""
    n, root, side, sketch = g[:, 1], g[:, 4], g[:, 5], g[:, 6:].view(np.uint64)
    kinds, count = np.unique(root, return_counts=True)
    large = root == kinds[count.argmax()]
    starts, ends = np.searchsorted(n, -(-4 * n // 5)), np.searchsorted(n, n * 5 // 4, side="right")
    cut = (side != side[0]).any()
    for a in np.flatnonzero(~large).tolist():
        b = np.arange(starts[a], ends[a])
        keep = (root[b] != root[a]) & (large[b] | (b > a))
        b = b[keep & (side[b] != side[a])] if cut else b[keep]
        if len(b):
            b = b[9 * np.bitwise_count(sketch[b] ^ sketch[a]).sum(1, dtype=np.int64) <= n[b] + n[a]]
        if len(b):
            yield np.full(len(b), a), b


def cut_groups(mixed: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(h, n, fp, at, root, side, ...): groups of more than ``most`` rows are cut into parts, and each
    two parts meet in a group of their own, so that no task compares a whole one."""
    parts = F.ceil(F.col("size") / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("h", F.least("own", k), F.greatest("own", k)))
    dealt = mixed.withColumn("parts", parts).withColumn("own", own).withColumn("h", F.explode(F.when(F.col("parts") > 1, meets).otherwise(F.array("h"))))
    return dealt.select("h", "n", "fp", "at", "root", F.when(F.col("parts") > 1, F.col("own")).otherwise(0).cast("long").alias("side"))


def likely(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs whose sizes and parities allow a link."""

    def hold(batches):
        for b in slices(batches, 2000):
            n_a, n_b, x, y = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = pa.array([9 * min(i, j) >= 4 * (i + j) and 9 * differing(p, q) <= i + j for i, j, p, q in zip(n_a, n_b, x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    one = named.select("fp", "n", "bits").dropDuplicates(["fp"])
    both = pairs.join(one.toDF("a", "n_a", "bits_a"), "a").join(one.toDF("b", "n_b", "bits_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(hold, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose sets are near enough."""
    pairs = stored(likely(pairs, named))
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    # a document for each set in a pair
    keys = stored(named.join(sized_broadcast(ids, BROADCAST_ROWS), "fp", "left_semi").groupBy("fp").agg(F.min("key").alias("key")).select("key"))
    own = stored(sets(_texts(docs).join(sized_broadcast(keys, BROADCAST_ROWS), "key", "left_semi").select("doc_id", "key", "text")).join(sized_broadcast(ids, BROADCAST_ROWS), "fp", "left_semi").dropDuplicates(["fp"]))
    both = pairs.join(own.toDF("a", "own_a"), "a").join(own.toDF("b", "own_b"), "b")
    return both.where(9 * F.size(F.array_intersect("own_a", "own_b")) >= 4 * (F.size("own_a") + F.size("own_b"))).select("a", "b")


def print_pairs(named: DataFrame, budget: int) -> DataFrame:
    """Pairs (a, b) of names whose fingerprints differ in ``budget`` bits or fewer: those
    of one fingerprint with its least name, and the least names of linked fingerprints."""
    each = named.where("n > 0").select("fp", "sim").distinct()
    least = stored(each.groupBy("sim").agg(F.min("fp").alias("least")))
    links = near_pairs(least.select(F.col("sim").alias("fp")), budget)
    ends = links.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    own = each.join(least, "sim").where("fp <> least").select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b"))
    return ends.unionByName(own)


def links(docs: DataFrame, named: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pairs (a, b) of names of linked sets, which make all components."""

    rows = stored(_whole_groups(first_shingles(docs), 4))
    # of all its groups' centres a set is paired with the most frequent, which most of a group of near copies share
    centred = _pairs(rows, _first, 4).groupBy("b", "a").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    near = stored(verified(_ordered(print_pairs(named, budget).unionByName(centred.select("a", "b"))), docs, named))
    roots = connected(near)
    rooted = rows.join(roots, rows["fp"] == roots["node"], "left").select("h", "n", "fp", "at", F.coalesce("root", "fp").alias("root"))
    mixed = cut_groups(_whole_groups(rooted, 5, lambda g: (g[:, 4] != g[0, 4]).any()), MOST_ROWS)
    sketched = mixed.join(named.select("fp", *SKETCH).dropDuplicates(["fp"]), "fp").select("h", "n", "fp", "at", "root", "side", *SKETCH)
    return near.unionByName(verified(_ordered(_pairs(sketched, _others, 6 + len(SKETCH))), docs, named))


def _whole_groups(rows: DataFrame, columns: int, keep=lambda g: True) -> DataFrame:
    """The rows of whole groups of two or more, with the group's ``size``, where ``keep`` of the group is true."""
    names = rows.columns[:columns] + ["size"]

    def take(batches):
        held, size = [], 0
        for g in _groups(batches, columns):
            if keep(g):
                held.append(np.column_stack([g, np.full(len(g), len(g))]))
                size += len(g)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held).T], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held).T], names)

    return rows.repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(take, ", ".join(f"{n} long" for n in names))


def components(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, component_id) for each row: component_id is the least doc_id that links reach."""
    own = stored(names(docs))
    each = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(docs, own, budget))
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")
