"""Vector code compression: a product quantizer over Hilbert-sorted flat blocks.

Vectors become integers and are cut into equal parts. Each task puts its
vectors into chunks; within a chunk the pieces of each part position are sorted
along a Hilbert curve and cut into flat blocks with the box (least and greatest
component) and the sums of their pieces. Chunks are stored once; no vector
travels between tasks. In each round a block's distances to the codebook's
entries are bounded by its box: the entry whose greatest distance to the box is
the least is the rival, and an entry stays on the block's shortlist only if it
isn't farther than the rival from the box's corner on its side. A block with one entry left adds its sums as they are; the others are
evaluated exactly, in integers, over their shortlists. Only sums for each entry
are shuffled, and only codebooks (64 entries) go through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; a vector shorter than the longest one, and one whose length isn't a
multiple of the parts, is filled up with zeros; a null vec_id comes after all
others in the choice of the first entries, and rows with one vec_id are ordered
by their vectors; with fewer vectors than entries each codebook has as many
entries as there are vectors; distances beyond int64 are computed in Python
integers, and an error or a sum of errors beyond a long is null; components of 2^44 or more raise;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, sized_broadcast, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Pieces in a block, and components in a chunk.
BLOCK = 16
CHUNK = 1 << 21
#: Labels whose sums may be broadcast.
BROADCAST_ROWS = 200_000
_LIMIT = 1 << 52


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles without a fraction."""
    out = np.floor(SCALE * x.astype(np.float64))
    if len(out) and np.abs(out).max() >= _LIMIT:
        raise ValueError("a vector has components of 2^44 or more")
    return out


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each row of integer ``points`` on a Hilbert curve through their box
    (Skilling, 2004). It only decides which pieces share a block."""
    n, width = points.shape
    if not n or not width:
        return np.zeros(n, np.uint64)
    points = points[:, np.argsort(-np.ptp(points, axis=0), kind="stable")[:63]]  # the widest axes, a bit each at least
    axes = points.shape[1]
    bits = max(1, min(15, 63 // axes))
    x = (points - points.min(axis=0)).astype(np.uint64)
    over = int(x.max()).bit_length() - bits
    x = x >> np.uint64(over) if over > 0 else x
    for level in range(bits - 1, 0, -1):
        q, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | x[:, i] >> np.uint64(level) & np.uint64(1)
    return key


def squares(diff: np.ndarray, width: int) -> np.ndarray:
    """Sums of squares over the last axis; Python integers where int64 could overflow."""
    most = int(np.abs(diff).max()) if diff.size else 0
    wide = most * most * max(width, 1) >= 1 << 63
    d = diff.astype(object) if wide else diff
    return (d * d).sum(axis=-1)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry may be nearest to a piece in the block's box.

    The rival is the entry whose greatest distance to the box is the least. Another
    entry may win only if it isn't farther than the rival from the corner of the
    box that lies most towards it, as seen from the rival."""
    width = book.shape[1]
    farthest = squares(np.maximum(np.abs(low[:, None, :] - book[None]), np.abs(book[None] - high[:, None, :])), width)
    rival = book[farthest.argmin(axis=1)][:, None, :]
    corner = np.where(book[None] > rival, high[:, None, :], low[:, None, :])
    return (squares(book[None] - corner, width) <= squares(rival - corner, width)).astype(bool)


def _assigned(values: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray, known: bool):
    """Nearest entry of each piece (ties: the lower index) and the distances to them.

    ``known``: distances of blocks with one entry on their shortlist aren't needed."""
    n, width = values.shape
    codes, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    may = shortlists(low, high, book)
    ends = np.append(starts[1:], n)
    many = may.sum(axis=1)
    order = np.argsort(~may, axis=1, kind="stable")  # a block's shortlist first, in the order of the entries
    size = 1
    left = np.arange(len(starts))
    while len(left):
        own, left = left[many[left] <= size], left[many[left] > size]
        for length in (set((ends - starts)[own].tolist())):
            some = own[(ends - starts)[own] == length]
            rows = starts[some][:, None] + np.arange(length)
            if size == 1 and known:
                codes[rows] = order[some, :1]
                continue
            place = np.minimum(np.arange(size), (many[some] - 1)[:, None])  # the last one is repeated
            entries = np.take_along_axis(order[some], place, axis=1)
            d = squares(values[rows][:, :, None, :] - book[entries][:, None, :, :], width)
            best = d.argmin(axis=2)
            codes[rows] = np.take_along_axis(entries, best, axis=1)
            found = np.take_along_axis(d, best[:, :, None], axis=2)[:, :, 0]
            if found.dtype == object and far.dtype != object:
                far = far.astype(object)
            far[rows] = found
        size *= 2
    return codes, far, many


def _chunk(ids: pa.Array, labels: pa.Array, x: np.ndarray, parts: int) -> dict:
    """Flat arrays of one chunk: for each part position the order of its pieces along
    the curve, the pieces in that order, and the blocks' boxes and sums."""
    n, width = len(x), x.shape[1] // parts
    order = np.empty((parts, n), np.int32)
    values = np.empty((parts, n, width), np.int64)
    for p in range(parts):
        piece = x[:, p * width : (p + 1) * width]
        order[p] = np.argsort(hilbert_keys(piece), kind="stable")
        values[p] = piece[order[p]]
    starts = np.arange(0, n, BLOCK)
    box = [f(values, starts, axis=1) if width else np.zeros((parts, len(starts), 0), np.int64) for f in (np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat)]
    return {"ids": ids, "labels": labels, "order": order, "values": values, "low": box[0], "high": box[1], "sums": box[2]}


def _packed(a: np.ndarray) -> bytes:
    """An integer array in its least width, which the first byte tells."""
    most = max(-int(a.min()) - 1, int(a.max()), 0) if a.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
    return bytes([width]) + a.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(shape)


def _blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """A row for each chunk: ids, labels and the flat arrays of ``_chunk``."""
    full = parts * -(-width // parts)
    rows = max(1, CHUNK // max(full, 1))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        vector = batch.column(2)
        flat = integers(vector.flatten().to_numpy(zero_copy_only=False))
        lengths = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((batch.num_rows, full), np.int64)
        at = np.repeat(np.arange(len(lengths)), lengths)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out

    def chunks(batches):
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                count += held[-1].num_rows
                if count >= rows:
                    yield record(held)
                    held, count = [], 0
        if held:
            yield record(held)

    def record(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        c = _chunk(ids, labels, np.concatenate([matrix(b) for b in held]), parts)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (c.pop("ids"), c.pop("labels"))]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (len(ids), full // parts)] + lists + [pa.array([_packed(v)], pa.binary()) for v in c.values()], ["n", "width", "ids", "labels", *c])

    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"n int, width int, ids array<long>, labels array<{kind}>, order binary, values binary, low binary, high binary, sums binary"
    return vectors.select("vec_id", "label", "embedding").mapInArrow(chunks, schema)


def _read(batch: pa.RecordBatch, parts: int):
    """The chunks of a stored batch, arrays in their shapes."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        n, width = row.column("n")[0].as_py(), row.column("width")[0].as_py()
        shape = {"order": (parts, n), "values": (parts, n, width)} | dict.fromkeys(("low", "high", "sums"), (parts, -(-n // BLOCK), width))
        arrays = {c: _unpacked(row.column(c)[0].as_py(), *x) for c, x in shape.items()}
        yield arrays | {"n": n, "ids": row.column("ids").flatten(), "labels": row.column("labels").flatten(), "starts": np.arange(0, n, BLOCK)}


def _totals(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: (parts, entries, width) of floor(sum / count); unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for c in _read(batch, parts):
                for p in range(parts):
                    codes, _, many = _assigned(c["values"][p], c["starts"], c["low"][p], c["high"][p], books[p], known=True)
                    whole = many == 1  # a block with one entry adds the sums it was stored with
                    lengths = np.diff(np.append(c["starts"], c["n"]))
                    single = ~np.repeat(whole, lengths)
                    to = np.concatenate([codes[c["starts"][whole]], codes[single]])
                    what = np.concatenate([c["sums"][p][whole], c["values"][p][single]])
                    weight = np.concatenate([lengths[whole], np.ones(int(single.sum()), np.int64)])
                    order = np.argsort(to, kind="stable")
                    used, first = np.unique(to[order], return_index=True)
                    total[p, used] += np.add.reduceat(what[order], first, axis=0) if width else 0
                    count[p, used] += np.add.reduceat(weight[order], first)
        used = np.argwhere(count > 0)
        flat = [(int(p), int(e), int(k)) for p, e in used for k in range(width)]
        cells = [[p for p, _, _ in flat], [e for _, e, _ in flat], [k for _, _, k in flat], [int(count[p, e]) for p, e, _ in flat], [Decimal(int(total[x])) for x in flat]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cells, kinds)], ["part", "entry", "place", "n", "total"])

    found = blocks.mapInArrow(sums, "part int, entry int, place int, n long, total decimal(38,0)")
    out = books.copy()
    for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each component of the codebooks
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def _coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """(vec_id, label, code, error) of all vectors."""
    parts, entries, _ = books.shape
    hexes = np.array([f"{e:02x}" for e in range(entries)])

    def codes(batches):
        for batch in batches:
            for c in _read(batch, parts):
                own, error = np.empty((c["n"], parts), np.int64), np.zeros(c["n"], object)
                for p in range(parts):
                    found, far, _ = _assigned(c["values"][p], c["starts"], c["low"][p], c["high"][p], books[p], known=False)
                    own[c["order"][p], p] = found
                    error[c["order"][p]] += far
                text = [row.tobytes().decode("utf-32-le") for row in hexes[own]]
                within = [int(e) if e < 1 << 63 else None for e in error]
                for at in range(0, c["n"], 8192):
                    part = slice(at, at + 8192)
                    yield pa.RecordBatch.from_arrays([c["ids"].slice(at, 8192), c["labels"].slice(at, 8192), pa.array(text[part], pa.string()), pa.array(within[part], pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def first_books(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The codebooks of the ``entries`` smallest vec_ids: (parts, entries, width of a part)."""
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    own = -(-width // parts)
    x = np.zeros((len(head), parts * own), np.int64)
    for row, r in zip(x, head):
        row[: len(r.embedding)] = integers(np.array(r.embedding, np.float64))
    return np.ascontiguousarray(x.reshape(len(head), parts, own).transpose(1, 0, 2))


def codebooks_text(books: np.ndarray) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each kept row of ``df`` (vec_id, embedding,
    label), as a stored table, and the codebooks."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = df.select(F.col("vec_id").cast("long"), "label", "embedding").where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    books = first_books(vectors, width, parts, entries)
    blocks = stored(_blocks(vectors, width, parts))
    for _ in range(rounds if books.shape[1] else 0):
        books = _totals(blocks, books)
    coded = stored(_coded(blocks, books, df.schema["label"].dataType.simpleString()))
    forget(blocks)
    return coded, books


def code_report(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept vector."""
    coded, books = vector_codes(df)
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    same = coded["label"].eqNullSafe(by_label["label"])
    return coded.join(sized_broadcast(by_label, BROADCAST_ROWS), same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: ``{embeddings}``: the table, whose vectors have a multiple of 16 components.
SQL = """
WITH kept AS (SELECT vec_id, label, embedding FROM {embeddings} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT vec_id, label, CAST(p AS INTEGER) AS p, list_transform(embedding[p * len(embedding) // 16 + 1 : (p + 1) * len(embedding) // 16], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM kept, range(16) AS r(p)),
book0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, v FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{rounds}
final AS (SELECT p, e, v FROM book2),
{last}
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM final) AS codebooks_sha256
FROM coded"""
_NEAR = """near{k} AS (
  SELECT vec_id, any_value(label) AS label, p, arg_min(e, d * 64 + e) AS e, min(d) AS d, any_value(v) AS v
  FROM (SELECT pieces.*, e, list_sum(list_transform(list_zip(pieces.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pieces JOIN book{k} b USING (p)) GROUP BY vec_id, p),"""
_NEXT = """sums{k} AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY p, e, i),
book{n} AS (SELECT p, e, coalesce(s.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM sums{k} GROUP BY p, e) s USING (p, e)),"""
SQL = SQL.replace("{rounds}", "\n".join(_NEAR.replace("{k}", str(k)) + "\n" + _NEXT.replace("{k}", str(k)).replace("{n}", str(k + 1)) for k in range(2))).replace("{last}", _NEAR.replace("{k}", "2"))
