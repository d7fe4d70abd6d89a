"""Passages that may repeat, found by the least gram of each window.

Both exact substring operators ask which windows of a fixed number of units
(words or bytes) occur elsewhere. Every window is named after the least hash
among its grams. Equal windows have equal grams and so the same name, and
neighbouring windows mostly share one, so the names that occur more than once
lead to all repeats at a few rows for each hundred bytes. Names only filter:

1. ``repeated_names`` gathers (name, document) and keeps names seen twice;
2. ``blocks`` cuts from each document the stretches of windows with such
   names, at places that the names themselves set, so that copies are cut
   alike; equal blocks travel on as one, with the number of their places;
3. ``runs`` deals each block's windows to the groups of their names: suffixes
   from a window's least gram on, which is their first prefix. A group of more
   than ``most`` different rows is dealt by longer prefixes of its windows (``by_prefix``);
4. in a group the operator's own method decides which windows repeat, those of
   copies included, as each row counts for all its places;
5. ``told_back`` brings that to the blocks and to each document's row.

Nothing is dropped on the way: a window whose name occurs once occurs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_nothing, sized_broadcast, slices, stored, text_bytes

#: Groups, or windows of at most some 200 bytes, that may be broadcast.
BROADCAST_ROWS = 300_000
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their order."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` units, by doubling."""
    h, have, by = units, 1, int(STEP)
    while have < size:
        more = min(have, size - have)
        n = len(h) - more
        if n <= 0:
            return h[:0]
        # where the last step's parts overlap they fix the gram all the same
        h = h[:n] * np.uint64(by if more == have else by ^ int(MIX) | 1) + h[more : more + n]
        by = by * by % (1 << 64)
        have += more
    return mixed(h)


def _sliding(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    have = 1
    while have < width and len(x):
        more = min(have, width - have)
        x = of(x[: len(x) - more], x[more:]) if len(x) > more else x[:0]
        have += more
    return x


def window_names(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring grams."""
    return _sliding(grams, width, np.minimum)


def name_runs(names: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal names, cut at ``longest`` windows."""
    starts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1]) if len(names) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(names)))
    if len(sizes) and sizes.max() > longest:
        cuts = (sizes + longest - 1) // longest
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = np.repeat(starts, cuts) + within * longest
        sizes = np.diff(np.append(starts, len(names)))
    return starts, sizes


def least_places(grams: np.ndarray, names: np.ndarray, width: int) -> np.ndarray:
    """Where the grams that name a window stand."""
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, names, pad]), width, np.maximum) == grams)


def own_twice(grams: np.ndarray, names: np.ndarray, width: int) -> np.ndarray:
    """Names that a text's grams have at two places or more."""
    values, counts = np.unique(grams[least_places(grams, names, width)], return_counts=True)
    return values[counts > 1]


def parted(starts: np.ndarray, sizes: np.ndarray, grams: np.ndarray, names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs, with those cut in two whose name stands at two places within
    them: only they can have equal windows, and then their name occurs twice."""
    places = least_places(grams, names, width)
    pairs = np.flatnonzero(grams[places[1:]] == grams[places[:-1]])
    cuts = set()
    for p, q in zip(places[pairs].tolist(), places[pairs + 1].tolist()):
        for r in range(max(0, int(np.searchsorted(starts, q - width + 1, "right")) - 1), int(np.searchsorted(starts, p, "right"))):
            if sizes[r] > 1 and names[starts[r]] == grams[p] and starts[r] <= p and q < starts[r] + sizes[r] + width - 1:
                cuts.add(int(starts[r] + sizes[r] // 2))
    if cuts:
        starts = np.union1d(starts, sorted(cuts))
        sizes = np.diff(np.append(starts, len(names)))
    return starts, sizes


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text as bytes, row) of each row; the key of a row without
    doc_id comes from its text. ``row`` holds all columns but the text."""
    doc = F.col("doc_id").cast("long")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"])
    return docs.select(F.coalesce(doc, F.xxhash64("text")).alias("key"), doc.alias("doc_id"), text_bytes().alias("text"), rest.alias("row"))


#: What a row of ``repeated_names`` is: a name met once in its lot, one told twice already, a document's share of such a one.
SINGLE, KNOWN, SETTLED = 0, 1, 2


def repeated_names(rows: DataFrame, scheme, within: bool, lot: int = 300_000) -> DataFrame:
    """(key, names): for each document the names that occur at two places.

    ``within`` counts places in one document; otherwise two documents are
    needed. A task first compares lots of about ``lot`` names of its own: what
    occurs twice there is settled and only tells the others so, in one row for a
    lot, so that a name of any number of documents is no hot key. The rest is
    dealt by name and sorted, and only neighbours are compared.
    """

    def told(keys: np.ndarray, names: np.ndarray):
        x = np.stack([names, keys], axis=1)
        x = x[np.lexsort([keys, names])]
        if not within:
            x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
        same = x[1:, 0] == x[:-1, 0]
        twice = np.append(False, same) | np.append(same, False)
        once, many = x[~twice], x[twice]
        first = many[np.append(True, many[1:, 0] != many[:-1, 0])] if len(many) else many
        for kind, part in ((SINGLE, once), (KNOWN, first), (SETTLED, many)):
            for at in range(0, len(part), 20_000):
                p = part[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(np.full(len(p), kind, np.int32)), pa.array(p[:, 1])], ["name", "kind", "key"])

    def gather(batches):
        keep_nothing()
        held, size = [], 0
        for b in slices(batches, 500):
            own = []
            for text in b.column(1).to_pylist():
                _, grams = scheme.grams(text)
                names = window_names(grams, scheme.width)
                values = np.unique(names)
                own.append(np.concatenate([values, own_twice(grams, names, scheme.width)]) if within and len(names) else values)
            if own:
                keys = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
                held.append((keys, np.concatenate(own).view(np.int64)))
                size += len(keys)
            if size > lot:
                yield from told(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from told(*map(np.concatenate, zip(*held)))

    def twice(batches):
        held = np.zeros((0, 3), np.int64)
        known = False  # whether the held row's name was seen before it
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            settled = x[:, 1] == SETTLED
            if settled.any():
                yield _names(x[settled])
            x = np.concatenate([held, x[~settled]])
            if not within and len(x) > 1:
                x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
            if len(x):
                same = x[1:, 0] == x[:-1, 0]
                before = np.append(known, same)
                keep = before[:-1] | same
                yield _names(x[:-1][keep])
                held, known = x[-1:], bool(before[-1])
        if len(held) and known:
            yield _names(held)

    found = rows.select("key", "text").mapInArrow(gather, "name long, kind int, key long")
    dealt = found.repartition(F.when(F.col("kind") == SETTLED, F.col("key")).otherwise(F.col("name"))).sortWithinPartitions("name", F.desc("kind"), "key")
    return dealt.mapInArrow(twice, "key long, name long").groupBy("key").agg(F.collect_set("name").alias("names"))


def _names(x: np.ndarray) -> pa.RecordBatch:
    """(key, name) of rows of (name, kind, key), less those without a document of their own."""
    x = x[x[:, 1] != KNOWN]
    return pa.RecordBatch.from_arrays([pa.array(x[:, 2]), pa.array(x[:, 0])], ["key", "name"])


def steps(size: int, factor: int) -> list[int]:
    """Steps that split a large group, largest first: powers of ``factor`` of a third of
    the window at most, down to 1. For 13 words (factor 2) the prefixes have 10, 12 and 13 words,
    for 200 bytes (factor 4) 137, 185, 197 and 200 bytes."""
    out = [1]
    while 3 * out[-1] * factor <= size:
        out.append(out[-1] * factor)
    return out[::-1]


#: A block starts at one in so many names, and has at most so many runs.
CUT, MOST_RUNS = np.uint64(8), 64
BLOCK = "block binary, key long, text_hash long, doc_id long, start long, content binary, names array<long>, sizes array<long>"
RUN = {"name": pa.int64(), "block": pa.binary(), "start": pa.int64(), "content": pa.binary(), "first_doc": pa.int64(), "places": pa.int64()}
RUNS = ", ".join(f"{n} {'binary' if pa.types.is_binary(t) else 'long'}" for n, t in RUN.items())


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int64()))


def blocks(rows: DataFrame, repeated: DataFrame, scheme, within: bool) -> DataFrame:
    """A row for each stretch of a document's windows with repeated names, with
    the names and sizes of its runs; ``block`` is the content's hash."""
    # the lists of names are hashed, so that the texts needn't be sorted
    both = rows.join(repeated.hint("shuffle_hash"), "key").select("key", "doc_id", "text", F.xxhash64("text").alias("text_hash"), "names")

    def cut(batches):
        from xxhash import xxh3_128_digest

        keep_nothing()
        for b in slices(batches, 200):
            out: list[tuple] = []
            flat: list[tuple] = []
            for row, (key, doc, text, text_hash) in enumerate(zip(*[b.column(k).to_pylist() for k in range(4)])):
                units, grams = scheme.grams(text)
                names = window_names(grams, scheme.width)
                starts, sizes = name_runs(names, scheme.width)
                if within and len(names):
                    starts, sizes = parted(starts, sizes, grams, names, scheme.width)
                names = names[starts]
                take = among(names, np.sort(b.column(4)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                if not take.any():
                    continue
                head = take & (~np.append(False, take[:-1]) | (names % CUT == 0))
                run = np.arange(len(take))
                head |= take & ((run - np.maximum.accumulate(np.where(head, run, 0))) % MOST_RUNS == 0)
                first = np.flatnonzero(head)
                windows, runs = np.add.reduceat(np.where(take, sizes, 0), first), np.add.reduceat(take.astype(np.int64), first)
                for s, n in zip(starts[first].tolist(), windows.tolist()):
                    content = scheme.content(units, s, n)
                    out.append((xxh3_128_digest(content), key, text_hash, doc, s, content))
                flat.append((names[take].view(np.int64), sizes[take], runs))
            if out:
                columns = [pa.array(list(c), pa.binary() if k in (0, 5) else pa.int64()) for k, c in enumerate(zip(*out))]
                names, sizes, runs = (np.concatenate(x) for x in zip(*flat))
                yield pa.RecordBatch.from_arrays([*columns, _lists(names, runs), _lists(sizes, runs)], [c.split()[0] for c in BLOCK.split(", ")])

    return both.mapInArrow(cut, BLOCK)


def runs(found: DataFrame, scheme) -> DataFrame:
    """A row for each run of windows of one name of the distinct blocks.

    Equal blocks are one, with the least of their documents and their number.
    """
    columns = ["block", "content", "names", "sizes", "first_doc", "places"]
    each = found.groupBy(*columns[:4]).agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first_doc"), F.count(F.lit(1)).alias("places"))

    def cut(batches):
        for b in slices(batches, 1000):
            out: list[tuple] = []
            for row, (block, text, first, places) in enumerate(zip(*[b.column(k).to_pylist() for k in (0, 1, 4, 5)])):
                names, sizes = (b.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                units = scheme.units(text)
                for name, s, n in zip(names.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                    out.append((name, block, s, scheme.part(units, s, n), first, places))
            for at in range(0, len(out), 5_000):
                yield _run_rows(out[at : at + 5_000])

    return each.select(*columns).mapInArrow(cut, RUNS)


def _run_rows(out: list[tuple], kinds: dict = RUN) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds.values())], list(kinds))


def run_lengths(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """For each stretch of ``counts`` values: value, count, value, count ... of its runs of equal values."""
    border = np.concatenate([[0], np.cumsum(counts)])
    change = np.append(True, values[1:] != values[:-1])
    change[border[:-1]] = True
    starts = np.flatnonzero(change)
    flat = np.empty(2 * len(starts), np.int64)
    flat[::2], flat[1::2] = values[starts], np.diff(np.append(starts, len(values)))
    return _lists(flat, 2 * np.diff(np.searchsorted(starts, border)))


def window_starts(spans: list[dict] | None, wanted: Callable) -> np.ndarray:
    """Starts of the windows whose told value is ``wanted``."""
    out = [np.zeros(0, np.int64)]
    for span in spans or ():
        at, told = span["start"], span["told"]
        for value, n in zip(told[::2], told[1::2]):
            if wanted(value):
                out.append(np.arange(at, at + n))
            at += n
    return np.concatenate(out)


TOLD = "block binary, start long, told array<long>"


def in_groups(found: DataFrame, by: str, resolve: Callable, lot: int) -> DataFrame:
    """(block, start, told) for rows of ``runs``: what ``resolve`` tells of their windows, as run lengths.

    ``resolve(contents, first_docs, places)`` gets the rows of whole groups of
    equal ``by``, about ``lot`` at a time, and returns a value for each window
    of each, and how many windows each has.
    """

    def told(t: pa.Table):
        groups = t.column(0).to_numpy()
        cuts = np.unique(np.searchsorted(groups, groups[np.arange(0, len(groups), lot)])).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(groups)]):
            x = t.slice(a, z - a)
            values, counts = resolve(x.column("content").to_pylist(), x.column("first_doc").to_numpy(), x.column("places").to_numpy())
            yield pa.RecordBatch.from_arrays([x.column(k).combine_chunks() for k in ("block", "start")] + [run_lengths(values, counts)], ["block", "start", "told"])

    def lots(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(h.num_rows for h in held) < lot:
                continue
            t = pa.Table.from_batches(held)
            groups = t.column(0).to_numpy()
            last = int(np.searchsorted(groups, groups[-1]))  # this group may go on in the next batch
            if last:
                yield from told(t.slice(0, last))
                held = t.slice(last).to_batches()
        if held:
            yield from told(pa.Table.from_batches(held))

    dealt = found.select(F.col(by).alias("group"), "block", "start", "content", "first_doc", "places").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lots, TOLD)


def apart(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose group of equal ``by`` has at most ``most`` rows, and the others or None."""
    large = stored(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(by))
    if large.isEmpty():
        return rows, None
    few = sized_broadcast(large, BROADCAST_ROWS)
    return rows.join(few, by, "left_anti"), rows.join(few, by, "left_semi")


def resolved(found: DataFrame, scheme, resolve: Callable, lot: int = 2_000, most: int = 2_500) -> tuple[DataFrame, list[DataFrame]]:
    """(block, start, told): what is known of the windows of each row of ``runs``
    (a stored table), and the stored tables that it reads besides."""
    read: list[DataFrame] = []
    return by_prefix(found, "name", scheme.steps, scheme, resolve, lot, most, read), read


def by_prefix(found: DataFrame, by: str, steps: list[int], scheme, resolve: Callable, lot: int, most: int, read: list[DataFrame]) -> DataFrame:
    """As ``resolved``, for rows that are dealt by their name or prefix (``by``).

    In a group of more than ``most`` rows equal ones become one, that counts for
    all their places; what it is told is told to each of them. Only if the
    different rows are still more than ``most`` are they cut into shorter ones.

    A window lies some units before its gram. Places at each ``step`` units
    before the gram cut a run into shorter ones, whose windows all hold the
    size - step + 1 units from such a place on: the prefix of the suffix that
    starts there. Shorter runs are dealt by it in the same way; where a group is
    still too large, the next of ``steps`` gives a longer prefix. The last step
    is 1: there the prefix is the whole window, so a group is one row.
    """
    few, large = apart(found, by, most)
    told = in_groups(few, by, resolve, lot)
    if large is None:
        return told
    digest = F.unhex(F.md5("content"))
    one = large.groupBy("content").agg(*[F.first(c).alias(c) for c in dict.fromkeys(["name", by])], F.min("first_doc").alias("first_doc"), F.sum("places").alias("places"))
    one = stored(one.withColumns({"block": digest, "start": F.lit(0).cast("long")}))
    few, many = apart(one, by, most) if steps else (one, None)
    own = in_groups(few, by, resolve, lot)
    read.append(one)
    if many is not None:
        pieces = stored(many.select(*RUN).mapInArrow(shorter(scheme, steps[0]), f"{RUNS}, prefix long"))
        read.append(pieces)
        own = own.unionByName(by_prefix(pieces, "prefix", steps[1:], scheme, resolve, lot, most, read))
    own = stored(told_blocks(own).withColumnRenamed("block", "digest"))
    read.append(own)
    return told.unionByName(large.select("block", "start", digest.alias("digest")).join(sized_broadcast(own, BROADCAST_ROWS), "digest").drop("digest"))


def shorter(scheme, step: int) -> Callable:
    """For rows of ``runs``: shorter ones and the hashes of their prefixes, for ``by_prefix``."""

    def cut(batches):
        from xxhash import xxh3_64_intdigest

        for b in slices(batches, 500):
            out: list[tuple] = []
            for name, block, start, content, first, places in zip(*[b.column(k).to_pylist() for k in range(6)]):
                _, grams = scheme.grams(content)
                units, at = scheme.units(content), np.flatnonzero(grams.view(np.int64) == name)
                j = np.arange(scheme.count(content))
                gram = at[np.searchsorted(at, j)]  # the first one from the window's start on
                k = (gram - j) // step
                cuts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (k[1:] != k[:-1])]))
                for a, z, place in zip(cuts.tolist(), [*cuts[1:].tolist(), len(j)], (gram - k * step)[cuts].tolist()):
                    prefix = xxh3_64_intdigest(scheme.part(units, place, 2 - step), int(k[a])) - (1 << 63)
                    out.append((name, block, start + a, scheme.part(units, a, z - a), first, places, prefix))
            for at in range(0, len(out), 5_000):
                yield _run_rows(out[at : at + 5_000], {**RUN, "prefix": pa.int64()})

    return cut


def told_blocks(told: DataFrame) -> DataFrame:
    """(block, told): the runs of each block put together."""
    own = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("start", "told"))).alias("parts"))
    joined = own.select("block", F.flatten(F.transform("parts", lambda p: p["told"])).alias("told"))

    def merge(batches):
        for b in slices(batches, 2000):
            if not b.num_rows:
                continue
            counts = b.column(1).value_lengths().to_numpy(zero_copy_only=False) // 2
            value, n = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).T
            change = np.append(True, value[1:] != value[:-1])
            change[np.cumsum(counts) - counts] = True
            at = np.flatnonzero(change)
            flat = np.stack([value[at], np.add.reduceat(n, at)], axis=1).ravel()
            border = np.searchsorted(at, np.append(0, np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(flat, 2 * np.diff(border))], ["block", "told"])

    return joined.mapInArrow(merge, "block binary, told array<long>")


def told_back(rows: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, text, spans, row) for each of ``rows``; spans is an array of (start, told) or null."""
    own = found.select("block", "key", "text_hash", "start")
    spans = own.join(told, "block").groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "told")).alias("spans"))  # a set: repeated rows have the same
    whole = rows.withColumn("text_hash", F.xxhash64("text"))
    return whole.join(spans.hint("shuffle_hash"), ["key", "text_hash"], "left").select("doc_id", "text", "spans", "row")


def with_spans(rows: DataFrame, scheme, within: bool, resolve: Callable) -> DataFrame:
    """All the steps: ``rows`` (key, doc_id, text) with what is known of their windows."""
    found = stored(blocks(rows, repeated_names(rows, scheme, within), scheme, within))
    parts = stored(runs(found, scheme))
    known, read = resolved(parts, scheme, resolve)
    told = stored(told_blocks(known))
    forget(parts, *read)
    return told_back(rows, found, told)


def covered(n_units: int, starts: Iterable[int], size: int) -> np.ndarray:
    """Which units lie in a window of ``size`` units with one of these starts."""
    change = np.zeros(n_units + 1, np.int32)
    s = np.asarray(starts, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, s + size, -1)
    return np.cumsum(change[:-1]) > 0
