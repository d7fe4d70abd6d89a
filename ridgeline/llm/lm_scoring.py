"""Document scores under a hashed maximum-entropy language model.

A token's probability is factored: P(class | what stands before) times
P(part of the class | class, what stands before) times the token's share of
that part. Both softmaxes have hashed n-gram and skip features of the tokens
themselves: the token before, the pair of the two tokens before, the second
token before on its own (a skip), and the classes of the three tokens before; in
the second softmax each feature is joined with the class. Most frequent tokens have
a part of their own, all others share one with some of their kind, where they
have their smoothed training counts.

1. Training tokens are counted. The ``HEAD`` most frequent types (a fixed
   bound) go to all tasks; the rest stay in a table and are joined.
2. All texts are turned into token codes once, and these are stored.
3. Units - the most frequent tokens, and buckets of word endings for all
   others - get classes by k-means over how often each stands near the most
   frequent tokens, counted over all training texts; a class's units are dealt
   to its parts by their counts.
4. Features are hashed to ``table_rows`` rows, a number that grows with the
   training tokens up to a bound. What was seen of each row and class is summed over
   all training texts, which gives the first weights. Then each round sums the gradient
   over another part of the texts and takes a step up their likelihood, less a penalty
   on large weights. The weights that suit a part that was set aside best are kept.
   Sums go through two levels.
5. All texts are scored in numpy batches. Tokens beyond the head are scored by
   a join of (document, token) with the counts.

What goes to the driver is bounded: HEAD counts, UNITS x ANCHORS sums, and the
weights. Everything else follows the corpus and stays in tables.

Defined cases: a null or empty text is its end token alone; without training
rows every count is 0 and scores are those of the smoothing; a null doc_id
hashes as the empty text; repeated rows are scored alike and each counts for
training; types with equal counts are ordered by their hashes; a very long text
is one row of codes like any other, and so is one unbroken run of letters, which
is one token; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import forget, kept, slices, stored, text_bytes

#: Bounds and sizes of the model.
HEAD = 1 << 18
TOP = 2048
ENDINGS = 4096
UNITS = TOP + ENDINGS
ANCHORS = 128
CLASSES = 32
PARTS = 32
NEAR = (1, 2, 3)
ROUNDS, SHARDS = 4, 4
#: One in so many training texts only tells which round's weights are best.
CHECK = 32
#: Training tokens that a task may read in a pass.
TASK_TOKENS = 1 << 26
#: Weights stay within it either way: five of them are within what a float32 exponential can hold.
LIMIT = 16.0
#: A row of a weight table for so many training tokens; least and largest number of rows.
TOKENS_A_ROW = 1024
ROWS = (1 << 12, 1 << 18)
#: Tokens that a task works on at once, and feature rows in a piece of a sum.
CHUNK = 1 << 14
PIECE = 1 << 12
#: Added to each count within a part, one more type standing for unseen ones.
ADDED = 1.0
END = b""


def word_hash(word: bytes) -> int:
    return xxh3_64_intdigest(word) - (1 << 63)


def ending(word: bytes) -> int:
    return int.from_bytes(word[-3:], "little") * 2654435761 % (1 << 32) >> 20


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


# ---- counts


def type_counts(train: DataFrame) -> DataFrame:
    """(h, ending, c) for each token type of ``train`` (text as bytes)."""

    def count(batches):
        seen: Counter = Counter()
        for b in slices(batches, 500):
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
            if len(seen) > 400_000:
                yield _type_rows(seen)
                seen = Counter()
        if seen:
            yield _type_rows(seen)

    rows = train.select("text").mapInArrow(count, "h long, ending int, c long")
    return rows.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def word_hashes(words) -> np.ndarray:
    """``word_hash`` of each word."""
    return (np.array([xxh3_64_intdigest(w) for w in words], np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def word_endings(words) -> np.ndarray:
    """``ending`` of each word."""
    last = np.array([int.from_bytes(w[-3:], "little") for w in words], np.uint64)
    return (last * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(20)).astype(np.int32)


def _type_rows(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word_hashes(seen)), pa.array(word_endings(seen)), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["h", "ending", "c"])


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and endings of the most frequent types, at most ``most``: all from some count on."""
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # no more than ``most`` counts can matter: each has a type at least
    left, least = most, None
    for r in by_count.orderBy(F.desc("c")).limit(most).toLocalIterator():
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(F.col("c") >= least).select("h", "c", "ending").toArrow()
    h, c, e = (found.column(k).to_numpy().astype(np.int64) for k in ("h", "c", "ending"))
    order = np.lexsort([h, -c])
    return h[order], c[order], e[order]


# ---- codes


class Codes(dict):
    """word -> its place in the head, or -1 - (ending << 19 | 19 bits of its hash).

    The first ``limit`` different words are kept.
    """

    def __init__(self, head: np.ndarray, limit: int = 400_000):
        self.place = {int(h): k for k, h in enumerate(head)}
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word) - (1 << 63)
        code = self.place.get(h, -1)
        if code < 0:
            code = -1 - (int.from_bytes(word[-3:], "little") * 2654435761 % (1 << 32) >> 20 << 19 | h & 0x7FFFF)
        if len(self) < self.limit and len(word) < 64:
            self[word] = code
        return code


CODED = "doc_id long, row long, train boolean, codes binary, rare array<long>"


def encoded(texts: list[bytes], codes: Codes) -> tuple[pa.Array, pa.Array]:
    """Columns of the texts' codes, as bytes, and of the hashes of their tokens beyond the head."""
    words, ends = [], [0]
    for text in texts:
        words += tokens(text)
        ends.append(len(words))
    own = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    beyond = np.flatnonzero(own < 0)
    rare = pa.array(word_hashes([words[k] for k in beyond.tolist()]))
    ends = np.array(ends)
    data = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * 4), pa.py_buffer(own)])
    return data.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(np.searchsorted(beyond, ends).astype(np.int32)), rare)


def coded(rows: DataFrame, head, name: str) -> DataFrame:
    """(doc_id, row, train, codes, rare) for each of ``rows`` (doc_id, text, train): the
    texts' codes, and the hashes of the tokens beyond the head. ``name`` tells models apart in a worker."""

    def encode(batches):
        codes, part, row_id = kept(f"lm_scoring {name}", name, lambda: Codes(head.value)), TaskContext.get().partitionId(), 0
        for b in slices(batches, 500):
            data, rare = encoded(b.column(1).to_pylist(), codes)
            ids = np.arange(row_id, row_id + b.num_rows) + (part << 40)
            row_id += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), b.column(2), data, rare], ["doc_id", "row", "train", "codes", "rare"])

    return rows.mapInArrow(encode, CODED)


def _lots(batches, column: int):
    """Codes, places in the text and row numbers of whole texts, about CHUNK tokens or one text at a time."""
    held, size = [], 0
    for b in slices(batches, 200):
        for data in b.column(column).to_pylist():
            held.append(np.frombuffer(data, np.int32))
            size += len(held[-1])
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts])
    return np.concatenate(parts), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(parts)), sizes)


def units_of(codes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """The unit of each code; ``endings`` are those of the head's types."""
    inside = codes >= 0
    own = np.where(inside, 0, -1 - codes) >> 19
    if len(endings):
        place = np.where(inside, codes, 0)
        return np.where(inside & (codes < TOP), codes, TOP + np.where(inside, endings[place], own))
    return TOP + own


# ---- classes


def near_anchors(train: DataFrame, endings) -> np.ndarray:
    """UNITS x ANCHORS: how often an anchor stands up to NEAR places beside a unit."""

    def count(batches):
        sums = np.zeros(UNITS * ANCHORS, np.int64)
        for codes, _, _ in _lots(batches, 0):
            u = units_of(codes, endings.value)
            for gap in NEAR:
                for a, z in ((codes[:-gap], u[gap:]), (codes[gap:], u[:-gap])):
                    is_anchor = (a >= 0) & (a < ANCHORS)
                    np.add.at(sums, z[is_anchor] * ANCHORS + a[is_anchor], 1)
        yield from _pieces(sums.reshape(UNITS, ANCHORS), 0)

    return _table(added_up(train.mapInArrow(count, SUMS)), [(UNITS, ANCHORS)])[0]


SUMS = "part long, sub long, sums binary"


def _pieces(sums: np.ndarray, table: int):
    """A table of sums, in pieces of PIECE rows; empty pieces are left out."""
    sub = TaskContext.get().partitionId() // 32
    for at in range(0, len(sums), PIECE):
        part = sums[at : at + PIECE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([table << 32 | at]), pa.array([sub], pa.int64()), pa.array([part.astype("<f4").tobytes()], pa.binary())], ["part", "sub", "sums"])


def added_up(rows: DataFrame) -> DataFrame:
    """(part, sub, sums): arrays of equal ``part`` added element by element, one
    at a time; first those of some tasks (``sub``), then all."""

    def add(batches):
        at, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([0], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["part", "sub", "sums"])
        for b in batches:
            for part, sub, data in zip(*[b.column(k).to_pylist() for k in range(3)]):
                x = np.frombuffer(data, "<f4")
                if (part, sub) == at:
                    total += x
                    continue
                if at is not None:
                    yield done()
                at, total = (part, sub), x.astype(float)
        if at is not None:
            yield done()

    some = rows.repartition("part", "sub").sortWithinPartitions("part", "sub").mapInArrow(add, SUMS)
    return some.repartition("part").sortWithinPartitions("part", "sub").mapInArrow(add, SUMS)


def _table(sums: DataFrame, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The summed tables, on the driver; their sizes are fixed or bounded."""
    found = stored(sums)
    out = [np.zeros(shape, np.float32) for shape in shapes]
    for r in found.select("part", "sums").toLocalIterator():
        x = np.frombuffer(r["sums"], "<f4").reshape(-1, shapes[r["part"] >> 32][1])
        at = r["part"] & 0xFFFFFFFF
        out[r["part"] >> 32][at : at + len(x)] = x
    forget(found)
    return out


def grouped(x: np.ndarray, weight: np.ndarray, k: int, steps: int = 25) -> np.ndarray:
    """k-means over the rows of ``x``, started from heavy rows that lie far apart."""
    centre = [int(weight.argmax())]
    far = ((x - x[centre[0]]) ** 2).sum(1)
    while len(centre) < k:
        centre.append(int((far * weight).argmax()))
        far = np.minimum(far, ((x - x[centre[-1]]) ** 2).sum(1))
    c = x[centre]
    for _ in range(steps):
        own = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        total = np.bincount(own, weights=weight, minlength=k)
        c = np.where(total[:, None] > 0, np.stack([np.bincount(own, weights=weight * x[:, j], minlength=k) for j in range(x.shape[1])], axis=1) / np.maximum(total, 1e-9)[:, None], c)
    return own


def classes(near: np.ndarray) -> np.ndarray:
    """The class of each unit."""
    weight = np.log1p(near.sum(1, dtype=float))
    x = np.sqrt((near + 0.01) / (near + 0.01).sum(1, keepdims=True))
    return grouped(x, weight, CLASSES)


def parts(class_of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of each unit in its class: the largest units have one of their own, the others share the rest."""
    out = np.zeros(len(class_of), np.int64)
    for c in range(CLASSES):
        own = np.flatnonzero(class_of == c)
        own = own[np.argsort(-size[own], kind="stable")]
        alone = len(own) if len(own) <= PARTS else PARTS * 3 // 4
        shared = PARTS - alone
        k = np.arange(len(own))
        out[own] = np.where(k < alone, k, alone + (k - alone) % max(shared, 1))
    return out


# ---- features and weights


def table_rows(n_tokens: int) -> int:
    """Rows of a weight table: a power of two that follows the training tokens within ROWS."""
    return max(ROWS[0], min(ROWS[1], 1 << (n_tokens // TOKENS_A_ROW).bit_length()))


def _hashed(x: np.ndarray, template: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(template * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _row(x: np.ndarray, template: int, size: int) -> np.ndarray:
    """``_hashed`` modulo ``size``, by a quotient of 32 bits, which numpy finds several times as fast."""
    h = _hashed(x, template).astype(np.uint32)
    h -= h // np.uint32(size) * np.uint32(size)
    return h.astype(np.int64)


#: The templates' shares of a table's rows, in eighths.
SHARES = (3, 2, 2, 1)


def features(codes: np.ndarray, cls: np.ndarray, start: np.ndarray, end: tuple[int, int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both weight tables that each token's past switches on: (templates, tokens) each.

    ``start`` is each token's place in its text; before a text there are ends,
    whose code and class are ``end``.
    """

    def earlier(x: np.ndarray, gap: int, fill: int) -> np.ndarray:
        return np.where(start >= gap, np.concatenate([np.full(min(gap, len(x)), fill, x.dtype), x[:-gap]]), fill).astype(np.int64) & 0xFFFFFFFF

    t1, t2 = earlier(codes, 1, end[0]), earlier(codes, 2, end[0])
    c1, c2, c3 = (earlier(cls, g, end[1]) for g in NEAR)
    keys = t1, t1 << 31 ^ t2, t2, (c1 * CLASSES + c2) * CLASSES + c3
    at, first, within = 0, [], []
    for k, (share, key) in enumerate(zip(SHARES, keys)):
        size = rows * share // 8
        first.append(at + _row(key, k, size))
        within.append(at + _row(key * CLASSES + cls, k, size))
        at += size
    # what holds everywhere: one row, and one for each class
    return np.stack([*first, np.full(len(codes), rows)]), np.stack([*within, rows + cls])


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The weights of each outcome added up, for each token. They keep within LIMIT, so no exponential of a sum overflows."""
    s = weights.take(rows[0], axis=0)
    for k in rows[1:]:
        s += weights.take(k, axis=0)
    return s


def log_chance(weights: np.ndarray, rows: np.ndarray, met: np.ndarray) -> np.ndarray:
    """log P (natural) of each token's outcome ``met``."""
    s = logits(weights, rows)
    own = s[np.arange(len(s)), met]
    return own - np.log(np.exp(s, out=s).sum(1))


def surprise(weights: np.ndarray, rows: np.ndarray, met: np.ndarray) -> np.ndarray:
    """For each token 1 for the outcome ``met``, less P of each outcome."""
    s = logits(weights, rows)
    np.exp(s, out=s)
    s *= -1 / s.sum(1, keepdims=True)
    s[np.arange(len(s)), met] += 1.0
    return s


def shapes(rows: int) -> list[tuple[int, int]]:
    return [(rows + 1, CLASSES), (rows + CLASSES, PARTS)]


def _rows_added(total: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """total[rows] += x, rows that occur more than once added up; by pairs of numbers, which numpy adds as
    fast as single ones if they are complex."""
    total, x = total.view(np.complex64), x.view(np.complex64)
    np.add.at(total.reshape(-1), (rows[:, None] * x.shape[1] + np.arange(x.shape[1])).reshape(-1), x.reshape(-1))


class Layout:
    """What tells classes, parts and features of codes."""

    def __init__(self, endings: np.ndarray, class_of: np.ndarray, part_of: np.ndarray, end_code: int, rows: int):
        self.endings, self.class_of, self.part_of, self.rows = endings, class_of, part_of, rows
        self.end = end_code, int(class_of[units_of(np.array([end_code]), endings)][0])

    def __call__(self, codes: np.ndarray, start: np.ndarray):
        u = units_of(codes, self.endings)
        cls = self.class_of[u]
        return cls, self.part_of[u], *features(codes, cls, start, self.end, self.rows)


def seen_sums(train: DataFrame, layout) -> list[np.ndarray]:
    """How often each row met each outcome, for both tables."""

    def count(batches):
        lay = layout.value
        sums = [np.zeros(a * b) for a, b in shapes(lay.rows)]
        for codes, start, _ in _lots(batches, 0):
            cls, part, f1, f2 = lay(codes, start)
            for total, f, wide, own in zip(sums, (f1, f2), (CLASSES, PARTS), (cls, part)):
                for k in f:
                    np.add.at(total, k * wide + own, 1.0)
        for k, shape in enumerate(shapes(lay.rows)):
            yield from _pieces(sums[k].reshape(shape), k)

    return _table(added_up(train.mapInArrow(count, SUMS)), shapes(layout.value.rows))


def gradient_sums(train: DataFrame, layout, shared) -> list[np.ndarray]:
    """How much more often each row met each outcome than the weights expect, for both tables."""

    def count(batches):
        # not of the broadcast arrays' own type object, which numpy adds slowly
        lay, weights = layout.value, [w.view(np.float32) for w in shared.value]
        sums = [np.zeros(shape, np.float32) for shape in shapes(lay.rows)]
        everywhere = [np.zeros((1, CLASSES)), np.zeros((CLASSES, PARTS))]  # the last rows, which all tokens switch on
        for codes, start, _ in _lots(batches, 0):
            cls, part, f1, f2 = lay(codes, start)
            for at in range(0, len(codes), CHUNK):  # a long text in pieces
                own = slice(at, at + CHUNK)
                for total, last, f, w, met in zip(sums, everywhere, (f1[:, own], f2[:, own]), weights, (cls[own], part[own])):
                    more = surprise(w, f, met)
                    some = np.zeros(last.shape, np.float32)
                    if len(some) == 1:
                        some[0] = more.sum(0)
                    else:
                        _rows_added(some, f[-1] - (len(total) - len(last)), more)
                    last += some
                    for k in f[:-1]:
                        _rows_added(total, k, more)
        for k, (total, last) in enumerate(zip(sums, everywhere)):
            total[-len(last) :] += last.astype(np.float32)
            yield from _pieces(total, k)

    return _table(added_up(train.mapInArrow(count, SUMS)), shapes(layout.value.rows))


def log_likelihood(texts: DataFrame, layout, shared) -> float | None:
    """Log10 probability a token of the classes and parts of ``texts`` (codes); None without a text."""

    def total(batches):
        lay, weights, nothing = layout.value, shared.value, np.zeros(CLASSES * PARTS)
        score, n = 0.0, 0
        for codes, start, row in _lots(batches, 0):
            none = np.zeros(int(codes.max(initial=0)) + 2)
            found, _, _, size = score_lot(codes, start, row, lay, weights, nothing, none, none)
            score, n = score + float(found.sum()), n + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([score]), pa.array([n], pa.int64())], ["score", "n"])

    r = texts.mapInArrow(total, "score double, n long").agg(F.sum("score").alias("score"), F.sum("n").alias("n")).first()
    return r["score"] / r["n"] if r["n"] else None


def first_weights(seen: list[np.ndarray], prior: float = 30.0, share: float = 0.5) -> list[np.ndarray]:
    """Log shares of the outcomes in the rows that hold everywhere; in all others
    ``share`` of the log ratio to them, less where little was seen."""
    out = []
    for k, s in enumerate(seen):
        everywhere = slice(len(s) - (CLASSES if k else 1), len(s))
        total = s[everywhere] + 0.1
        base = np.log(total / total.sum(1, keepdims=True))
        mean = total.sum(0) / total.sum()
        w = share * np.log((s + prior * mean) / (s.sum(1, keepdims=True) + prior) / mean)
        if k:  # rows within classes: their classes' own shares are the measure, unknown here, so they start at 0
            w[:] = 0.0
        w[everywhere] = np.maximum(base, -LIMIT)
        out.append(w.astype(np.float32))
    return out


def next_weights(weights: list[np.ndarray], seen: list[np.ndarray], gradient: list[np.ndarray], shards: int, rate: float = 0.4, penalty: float = 5.0, steady: float = 6.0) -> list[np.ndarray]:
    """A step up the penalised likelihood of one round's texts, which are 1 / ``shards`` of all:
    the gradient less ``penalty`` times the weight (a Gaussian prior; rows that hold everywhere have
    none), over what such texts have seen of the outcome and a little more. A weight moves by 0.7 at most."""
    out = []
    for k, (w, s, g) in enumerate(zip(weights, seen, gradient)):
        own = np.full((len(w), 1), penalty / shards)
        own[-(CLASSES if k else 1) :] = 0.0
        step = rate * (g - own * w) / ((s + penalty) / shards + steady)
        out.append(np.clip(w + np.clip(step, -0.7, 0.7), -LIMIT, LIMIT).astype(np.float32))
    return out


def trained(learn: DataFrame, check: DataFrame, layout, seen: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The weights that make ``check`` (codes) likeliest among the first ones and those after each
    of ``rounds`` gradient steps. A step goes over one of ``SHARDS`` parts of ``learn`` (shard, codes) at
    most, in turn, so up to that many rounds use each text once."""
    spark = learn.sparkSession
    weights, best, likelihood, shards = first_weights(seen), None, None, min(rounds, SHARDS)
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(weights)
        now = log_likelihood(check, layout, shared)
        if best is None or now is None or now > likelihood:
            best, likelihood = weights, now
        if r < rounds:
            own = learn.where(F.pmod("shard", F.lit(shards)) == r % shards).select("codes")
            weights = next_weights(weights, seen, gradient_sums(own, layout, shared), shards)
        shared.unpersist()
    return best


# ---- scores


def scores(docs: DataFrame, train: Column, name: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row
    of ``docs``; ``train``, over doc_id, marks the rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), train.alias("train"))
    counts = stored(type_counts(rows.where("train")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total[0]), int(total[1])
    hashes, c, endings = most_frequent(counts, HEAD)
    head, own_endings = spark.sparkContext.broadcast(hashes), spark.sparkContext.broadcast(endings)
    texts = stored(coded(rows, head, name))
    # a task's sums are as large as the tables, however little it reads; it reads some TASK_TOKENS at most
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK_TOKENS)
    marked = texts.where("train").select(F.xxhash64(F.lit("shard"), "doc_id").alias("shard"), (F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(CHECK)) == 0).alias("check"), "codes").coalesce(tasks)
    learn, check = marked.where("NOT check"), stored(marked.where("check").select("codes"))  # read after each round
    class_of = classes(near_anchors(learn.select("codes"), own_endings)) if n else np.zeros(UNITS, np.int64)
    size, types = unit_totals(counts, hashes, c, endings)
    part_of = parts(class_of, size)
    layout = spark.sparkContext.broadcast(Layout(endings, class_of, part_of, Codes(hashes)[END], table_rows(n)))
    weights = [np.zeros(shape, np.float32) for shape in shapes(table_rows(n))]
    if n:
        weights = trained(learn, check, layout, seen_sums(learn.select("codes"), layout), rounds)
    forget(check)
    leaf = class_of * PARTS + part_of
    by_leaf = np.log10(np.bincount(leaf, weights=size, minlength=CLASSES * PARTS) + ADDED * (np.bincount(leaf, weights=types, minlength=CLASSES * PARTS) + 1))
    model = spark.sparkContext.broadcast((c, by_leaf, weights))
    base_all = float(np.log10(n + v + 1))

    def score(batches):
        (c, by_leaf, weights), lay = model.value, layout.value
        log_head, log_own = np.log10(np.append(c, 0) + 1.0), np.log10(np.append(c, 0) + ADDED)  # the last is for tokens beyond the head
        for b in slices(batches, 200):
            full, base, inside, size = (np.zeros(b.num_rows, t) for t in (float, float, np.int64, np.int64))
            at = 0
            for codes, start, row in _lots([b], 2):
                f, s, known, number = score_lot(codes, start, row, lay, weights, by_leaf, log_own, log_head)
                k = slice(at, at + len(f))
                full[k], base[k], inside[k], size[k] = f, s - base_all * number, known, number
                at += len(f)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (size, inside, base, full)), b.column(3)], ["doc_id", "row", "n_tokens", "n_head", "base", "full", "rare"])

    out = stored(texts.select("doc_id", "row", "codes", "rare").mapInArrow(score, "doc_id long, row long, n_tokens long, n_head long, base double, full double, rare array<long>"))
    forget(texts)
    # a document's share of a token comes as one row with its number
    rare = out.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("k")).join(counts.select("h", "c"), "h")  # types without a count add log10(1) = 0
    rare = rare.groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + ADDED)).alias("own"))
    both = out.drop("rare").join(rare, "row", "left")
    unseen = (F.col("n_tokens") - F.col("n_head") - F.coalesce("k", F.lit(0))) * float(np.log10(ADDED))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("full") + F.coalesce("own", F.lit(0.0)) + unseen).alias("score"),
    )


def score_lot(codes, start, row, layout, weights, by_leaf, log_own, log_head):
    """For each text of a lot: its log10 probability and its sum of log10 (count + 1),
    both less what tokens beyond the head have of their own, its tokens in the head and all its tokens."""
    cls, part, f1, f2 = layout(codes, start)
    inside = codes >= 0
    place = np.where(inside, codes, len(log_own) - 1)
    each = -by_leaf[cls * PARTS + part]
    for at in range(0, len(codes), CHUNK):  # a long text in pieces
        k = slice(at, at + CHUNK)
        each[k] += (log_chance(weights[0], f1[:, k], cls[k]) + log_chance(weights[1], f2[:, k], part[k])) / np.log(10)
    own = np.where(inside, log_own[place], 0.0)
    texts = int(row[-1]) + 1
    add = lambda x: np.bincount(row, weights=x, minlength=texts)
    return add(each + own), add(np.where(inside, log_head[place], 0.0)), add(inside).astype(np.int64), np.bincount(row, minlength=texts)


def unit_totals(counts: DataFrame, hashes: np.ndarray, c: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types of each unit: endings' sums, less the types that are units themselves."""
    size, types = np.zeros(UNITS), np.zeros(UNITS)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # ENDINGS rows at most
        size[TOP + r["ending"]], types[TOP + r["ending"]] = r["c"], r["n"]
    k = min(TOP, len(hashes))
    np.add.at(size, TOP + endings[:k], -c[:k])
    np.add.at(types, TOP + endings[:k], -1)
    size[:k], types[:k] = c[:k], 1
    return size, types


def lm_report(docs: DataFrame, name: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = scores(docs, ~held_out, name)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
