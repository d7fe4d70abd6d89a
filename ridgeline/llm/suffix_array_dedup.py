"""Suffix-array dedup over bytes by bucket-pointer refinement.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere
else, in the same document or another. Strings are judged on the input and
never cross documents; overlapping places count.

Positions that can share a string are found as in ``winnow`` and dealt over the
cluster in the buckets of their least grams; a bucket that is too large for a
task is refined there, by prefixes of 137, 185, 197 or all 200 bytes. In a
task the suffixes are put in buckets by their first eight bytes; then each
bucket with two suffixes or more is refined by sorting on the bucket identifiers
that its suffixes have one bucket length further on. Identifiers are updated in
place, so each round's buckets serve the next at twice the length, up to
``size``. Nothing but the last buckets removes a byte.

Defined cases: a null or empty text has no bytes; repeated rows are separate
places, so their strings repeat; rows without a doc_id take part and keep null
as theirs; all of several equal strings go, whichever document they are in;
texts shorter than ``size`` stay whole; a very long text, one byte repeated
included, is cut into blocks like any other; an empty table gives an empty
result; further columns are not read. What is kept may split a character,
so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import list_array, slices

Q = 8
#: A number for each byte.
BYTE_HASH = winnow.mixed(np.arange(1, 257, dtype=np.uint64) * winnow.STEP)


class ByteWindows:
    """Windows of ``size`` bytes, named by grams of ``gram`` bytes."""

    def __init__(self, size: int = 200, gram: int = 64):
        self.size, self.gram, self.width, self.steps = size, gram, size - gram + 1, winnow.steps(size, 4)

    def grams(self, text: bytes) -> tuple[bytes, np.ndarray]:
        return text, winnow.gram_hashes(BYTE_HASH[np.frombuffer(text, np.uint8)], self.gram)

    def content(self, text: bytes, start: int, windows: int) -> bytes:
        return text[start : start + windows + self.size - 1]

    def units(self, content: bytes) -> bytes:
        return content

    part = content

    def count(self, content: bytes) -> int:
        return len(content) - self.size + 1


def refined_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """A bucket identifier for each position: equal ones mean equal strings of ``size`` bytes there.

    Positions nearer to the end than ``size`` get identifiers without meaning.
    """
    n = len(data)
    gram = np.zeros(n, np.uint64)
    for k in range(Q):
        gram[: n - k] = gram[: n - k] << np.uint64(8) | data[k:]
    _, bucket, count = np.unique(gram, return_inverse=True, return_counts=True)
    bucket = np.concatenate([bucket, np.zeros(size, np.int64)])
    alive = np.flatnonzero(count[bucket[:n]] > 1)
    top, have = len(count), Q
    while have < size and len(alive):
        step = min(have, size - have)
        _, part, count = np.unique(bucket[alive] * (top + n) + bucket[alive + step], return_inverse=True, return_counts=True)
        bucket[alive] = top + part  # those that are single now keep this name for good
        top += len(count)
        alive = alive[count[part] > 1]
        have += step
    return bucket[:n]


def repeats(contents: list[bytes], first_docs: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each passage 1 if its string has another place, else 0, and each passage's number of windows."""
    lengths = np.array([len(c) for c in contents])
    bucket = refined_buckets(np.frombuffer(b"".join(contents), np.uint8), size)
    counts = lengths - size + 1
    owner = np.repeat(np.arange(len(contents)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    _, string = np.unique(bucket[np.repeat(np.cumsum(lengths) - lengths, counts) + within], return_inverse=True)
    total = np.bincount(string, weights=places[owner])
    return (total[string] > 1).astype(np.int64), counts


def removed_bytes(docs: DataFrame, size: int = 200, gram: int = 64) -> DataFrame:
    """(doc_id, kept, n_bytes, spans) for each row of ``docs``: spans are the removed (start, end), flattened."""
    scheme = ByteWindows(size, gram)
    rows = winnow.keyed(docs)
    known = winnow.with_spans(rows, scheme, True, resolve=lambda c, f, p: repeats(c, f, p, size))

    def remove(batches):
        for b in slices(batches, 500):
            kept, n, spans = [], [], []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = winnow.covered(len(text), winnow.window_starts(own, bool), size)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text)
                n.append(len(text))
                spans.append(edges)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), list_array(spans, pa.int64())], ["doc_id", "kept", "n_bytes", "spans"])

    return known.drop("row").mapInArrow(remove, "doc_id long, kept binary, n_bytes long, spans array<long>")


def suffix_array_report(docs: DataFrame, size: int = 200) -> DataFrame:
    out = removed_bytes(docs, size)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for ``suffix_array_report`` over ``{documents}``; texts are cut in overlapping stretches, as long strings are slow to index.
SQL = r"""
WITH b_d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM {documents}),
b_c AS (
  SELECT doc_id, n, c, substr(h, 2 * c + 1, 1398) AS piece
  FROM (SELECT doc_id, h, n, unnest(range(0, greatest(n - 199, 0), 500)) AS c FROM b_d)),
b_w AS (
  SELECT doc_id, c + k AS i, md5(substr(piece, 2 * k + 1, 400)) AS w
  FROM (SELECT doc_id, c, piece, unnest(range(0, least(500, n - 199 - c))) AS k FROM b_c)),
b_rep AS (SELECT doc_id, i FROM b_w QUALIFY count(*) OVER (PARTITION BY w) > 1),
b_run AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b_rep)),
b_span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM b_run GROUP BY doc_id, g),
b_gap AS (
  SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, z FROM b_span),
b_kept AS (
  SELECT b_d.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k, sum(z - a) AS gone, count(*) AS spans
  FROM b_d JOIN b_gap USING (doc_id) GROUP BY b_d.doc_id)
SELECT b_d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM b_d LEFT JOIN b_kept ON b_kept.doc_id = b_d.doc_id
"""
