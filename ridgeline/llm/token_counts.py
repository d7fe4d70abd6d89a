"""Token counts: an exact histogram of encoded lengths.

Documents are aggregated by encoded length. Over the histogram, which has one
row for each distinct length however many documents there are, running sums
from the long end answer totals, quantiles and truncated totals for every
context limit.

Defined cases: a null text counts as empty and has length 0; rows with the
same doc_id count once each, and documents of equal length share a row; a very
long text is encoded whole, and its piece without spaces at once; an empty table
gives an empty histogram; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices, stored

#: A space after white space: there the split at single spaces isn't a token border.
_RAGGED = re.compile(r"\s ")

class _PieceCounts(dict):
    """Number of tokens of a space and what follows it up to the next space.

    Kept for the first ``limit`` different pieces; the rest are encoded anew.
    """

    def __init__(self, encoding, limit: int):
        self.encoding, self.limit = encoding, limit

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(" " + piece))
        if len(self) < self.limit and len(piece) < 64:
            self[piece] = n
        return n


def _counter(ranks_path: str, pattern: str, limit: int = 300_000) -> _PieceCounts:
    def make() -> _PieceCounts:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return _PieceCounts(tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), limit)

    return kept("token_counts", (ranks_path, pattern), make)


def count_tokens(text: str, counts: _PieceCounts) -> int:
    """Tokens of a text. A space after a visible character always starts a new
    token, so the pieces between such spaces can be counted one by one."""
    if _RAGGED.search(text):
        return len(counts.encoding.encode_ordinary(text))
    first, _, rest = text.partition(" ")
    n = len(counts.encoding.encode_ordinary(first))
    return n + sum(map(counts.__getitem__, rest.split(" "))) if _ else n


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``."""

    def lengths(batches):
        counts = _counter(ranks_path, pattern)
        for b in slices(batches):
            n = [count_tokens(t or "", counts) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lengths, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame, block: int = 128) -> DataFrame:
    """For every distinct length, taken as context limit L: n_docs of that
    length, docs_longer, tokens_longer (of documents longer than L),
    total_docs, total_tokens, truncated_tokens (the sum of min(length, L)) and
    quantile (the share of documents no longer than L).

    Sums from the long end go in two steps, over blocks of ``block``
    neighbouring lengths and within each block, so no task sees the whole.
    """
    # read twice below; texts are encoded once
    hist = stored(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_longer", F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)))
        .withColumn("tokens_longer", F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0)))
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "docs_longer",
            "tokens_longer",
            "total_docs",
            "total_tokens",
            (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
            (1 - F.col("docs_longer") / F.col("total_docs")).alias("quantile"),
        )
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens) for any limits, from ``length_table``:
    between two lengths the total grows by docs_longer for each step."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "wanted long")
    below = sums.join(F.broadcast(wanted), F.col("context_limit") <= F.col("wanted"))
    at = below.groupBy("wanted").agg(F.max_by(F.struct("context_limit", "truncated_tokens", "docs_longer"), "context_limit").alias("x"))
    n = sums.agg(F.max("total_docs").alias("n"))
    return (
        wanted.join(at, "wanted", "left")
        .crossJoin(F.broadcast(n))
        .select(
            F.col("wanted").alias("context_limit"),
            F.coalesce(F.col("x.truncated_tokens") + (F.col("wanted") - F.col("x.context_limit")) * F.col("x.docs_longer"), F.col("wanted") * F.col("n"), F.lit(0)).alias("truncated_tokens"),
        )
    )


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least ``share`` of the documents don't exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    enough = sums.join(F.broadcast(wanted), (F.col("total_docs") - F.col("docs_longer")) >= F.ceil(F.col("share") * F.col("total_docs")))
    return enough.groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
