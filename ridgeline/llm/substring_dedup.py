"""Substring dedup over words with prefix-partitioned suffix trees.

A word goes if it lies in a window of ``size`` words whose sequence also
starts in a document with a smaller doc_id. Windows are judged on the input.

Candidates are found as in ``winnow`` and dealt over the cluster by prefixes:
a window's first prefix is its least gram, on which its suffix starts; groups
that are too large for a task are dealt by prefixes of 10, 12 or 13 words, the
shortest that makes them small. In a task prefixes of words
split the suffixes once more, each as long as it takes for its group to fit in
memory, and a group's suffix tree grows breadth first: each step adds a word
to the paths of all internal nodes, those with two places or more. The internal
nodes at depth ``size`` are the repeats, and nothing else removes a word: a
node's least document settles the windows of all its suffixes.

Defined cases: a null or empty text has no words and loses none; a null doc_id
counts as larger than any; rows that share a doc_id are one document and don't
remove each other's words; of documents with equal passages that with the
smallest doc_id keeps its own (ties are such rows); texts shorter than a window
stay whole; a very long text is cut into blocks like any other, and one unbroken
run of letters is one word; an empty table gives an empty result; further
columns are kept by ``deduplicated_documents``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import winnow
from .common import list_array, slices

NEVER = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


#: A number for each byte, 0 for white space, and powers of an odd number with their inverses.
_BYTE = winnow.mixed(np.arange(1, 257, dtype=np.uint64) * winnow.STEP)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_ODD = int(winnow.STEP)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base % (1 << 64), np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and a hash of each word.

    The hash is a polynomial of the word's bytes, taken from running sums over
    the whole text; equal words have equal hashes wherever they stand.
    """
    values = _BYTE[np.frombuffer(text, np.uint8)]
    n = len(values)
    inside = np.concatenate([[False], values != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", _ODD, n), out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * _power("down", pow(_ODD, -1, 1 << 64), n)[starts]


class WordWindows:
    """Windows of ``size`` words, named by grams of ``gram`` words."""

    def __init__(self, size: int = 13, gram: int = 5):
        self.size, self.gram, self.width, self.steps = size, gram, size - gram + 1, winnow.steps(size, 2)

    def grams(self, text: bytes) -> tuple[tuple, np.ndarray]:
        starts, ends, hashes = word_hashes(text)
        return (text, starts, ends), winnow.gram_hashes(hashes, self.gram)

    def content(self, units: tuple, start: int, windows: int) -> bytes:
        text, starts, ends = units
        return b" ".join(text[starts[start] : ends[start + windows + self.size - 2]].split())

    def units(self, content: bytes) -> list[bytes]:
        return content.split(b" ")

    def part(self, units: list[bytes], start: int, windows: int) -> bytes:
        return b" ".join(units[start : start + windows + self.size - 1])

    def count(self, content: bytes) -> int:
        return content.count(b" ") + 2 - self.size


def prefix_groups(units: np.ndarray, suffixes: np.ndarray, depth: int, most: int):
    """(indexes into ``suffixes``, prefix length) of groups with at most ``most`` suffixes, or with the full depth in common."""
    waiting = [(np.arange(len(suffixes)), 0)]
    while waiting:
        group, length = waiting.pop()
        if len(group) <= most or length == depth:
            yield group, length
            continue
        following = units[suffixes[group] + length]
        order = np.argsort(following, kind="stable")
        cuts = np.flatnonzero(np.diff(following[order])) + 1
        waiting.extend((part, length + 1) for part in np.split(group[order], cuts))


def deep_nodes(units: np.ndarray, suffixes: np.ndarray, places: np.ndarray, prefix: int, depth: int) -> np.ndarray:
    """For each suffix its node at ``depth`` in the tree of the suffixes, -1 where it is a leaf.

    All suffixes share their first ``prefix`` units; each stands for ``places``
    equal ones. A step splits the internal nodes, those with two places or
    more, by the next unit; what has one place only is a leaf. Repeats of more
    units lie below the nodes at ``depth``, which cover the same windows, so
    the tree ends there.
    """
    node, alive = np.zeros(len(suffixes), np.int64), np.arange(len(suffixes))
    if places.sum() < 2:
        return np.full(len(suffixes), -1)
    top = int(units.max()) + 1 if len(units) else 1
    for length in range(prefix, depth):
        _, child = np.unique(node[alive] * top + units[suffixes[alive] + length], return_inverse=True)
        count = np.bincount(child, weights=places[alive])
        node[alive] = np.where(count[child] > 1, child, -1)
        alive = alive[node[alive] >= 0]
    return node


def first_documents(contents: list[bytes], first_docs: np.ndarray, places: np.ndarray, size: int, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each passage the least document of its node in the suffix
    tree (NEVER for a leaf), and each passage's number of windows."""
    known: dict[bytes, int] = {}
    parts = [[known.setdefault(w, len(known)) for w in c.split(b" ")] for c in contents]
    lengths = np.array([len(p) for p in parts])
    units = np.concatenate([np.array(p, np.int64) for p in parts])
    counts = lengths - size + 1
    owner = np.repeat(np.arange(len(parts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = np.repeat(np.cumsum(lengths) - lengths, counts) + within
    firsts, weights, least = first_docs[owner], places[owner], np.full(len(owner), NEVER)
    for group, prefix in prefix_groups(units, suffixes, size, most):
        node = deep_nodes(units, suffixes[group], weights[group], prefix, size)
        shared = np.flatnonzero(node >= 0)
        if len(shared):
            order = shared[np.argsort(node[shared], kind="stable")]
            starts = np.flatnonzero(np.append(True, np.diff(node[order]) != 0))
            low = np.minimum.reduceat(firsts[group[order]], starts)
            least[group[order]] = np.repeat(low, np.diff(np.append(starts, len(order))))
    return least, counts


def _gone(words: int, spans: list[dict] | None, doc: int | None, size: int) -> np.ndarray:
    """Start and end, in turn, of each run of removed words."""
    mine = NEVER if doc is None else doc
    gone = winnow.covered(words, winnow.window_starts(spans, lambda first: first < mine), size)
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))


def _known(docs: DataFrame, size: int, gram: int) -> DataFrame:
    return winnow.with_spans(winnow.keyed(docs), WordWindows(size, gram), False, resolve=lambda c, f, p: first_documents(c, f, p, size))


def removed_words(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """(doc_id, text, kept, n_words, spans) for each row of ``docs``: kept are
    the words that stay, joined by blanks; spans are the removed (start, end)
    in words, flattened."""

    def remove(batches):
        for b in slices(batches, 500):
            kept, n, spans = [], [], []
            for doc, text, own in zip(*[b.column(k).to_pylist() for k in range(3)]):
                words = text.split()
                edges = _gone(len(words), own, doc, size)
                kept.append(b" ".join([w for a, z in zip([0, *edges[1::2].tolist()], [*edges[::2].tolist(), len(words)]) for w in words[a:z]]))
                n.append(len(words))
                spans.append(edges)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), list_array(spans, pa.int64())], ["doc_id", "text", "kept", "n_words", "spans"])

    return _known(docs, size, gram).drop("row").mapInArrow(remove, "doc_id long, text binary, kept binary, n_words long, spans array<long>")


def deduplicated_documents(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """``docs`` with the removed words cut from their texts, white space around
    the rest as it was; a document that loses its last word goes. ``n_chars``,
    where there is one, follows the text."""
    columns = docs.columns

    def cut(batches):
        for b in slices(batches, 500):
            texts = []
            for doc, text, own in zip(*[b.column(k).to_pylist() for k in range(3)]):
                places = [m.start() for m in WORD.finditer(text)] if own else []
                edges = _gone(len(places), own, doc, size)
                if len(edges):
                    at = [*places, len(text)]
                    parts = [text[at[a] if a else 0 : at[z]] for a, z in zip([0, *edges[1::2].tolist()], [*edges[::2].tolist(), len(places)])]
                    text = b"".join(parts)
                    text = text if text.split() else None
                texts.append(text.decode() if text is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(texts, pa.string())], ["row", "text"])

    known = _known(docs, size, gram)
    rest = [f for f in docs.schema.fields if f.name.lower() != "text"]
    out = known.mapInArrow(cut, T.StructType([T.StructField("row", T.StructType(rest)), T.StructField("text", T.StringType())])).where("text IS NOT NULL")
    own = {f.name: F.length("text").cast(f.dataType) if f.name == "n_chars" else F.col("row").getField(f.name) for f in rest}
    return out.select(*[F.col("text").alias(c) if c.lower() == "text" else own[c].alias(c) for c in columns])


def substring_report(docs: DataFrame, size: int = 13) -> DataFrame:
    out = removed_words(docs, size)
    pairs = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # end - (start - (end - ...)): starts count with the other sign
    return out.select("doc_id", "n_words", pairs.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for ``substring_report`` over ``{documents}``.
SQL = r"""
WITH s_d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {documents}),
s_win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM s_d WHERE len(w) >= 13)),
s_first AS (SELECT s, min(doc_id) AS m FROM s_win GROUP BY s),
s_gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT s_win.doc_id, i FROM s_win JOIN s_first USING (s) WHERE m < s_win.doc_id), range(13) AS r(k)),
s_n AS (SELECT doc_id, count(*) AS n FROM s_gone GROUP BY doc_id),
s_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM s_d),
s_kept AS (
  SELECT s_word.doc_id, string_agg(word, ' ' ORDER BY s_word.p) AS k
  FROM s_word LEFT JOIN s_gone ON s_gone.doc_id = s_word.doc_id AND s_gone.p = s_word.p
  WHERE s_gone.p IS NULL GROUP BY s_word.doc_id)
SELECT s_d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM s_d LEFT JOIN s_n ON s_n.doc_id = s_d.doc_id LEFT JOIN s_kept ON s_kept.doc_id = s_d.doc_id
"""
