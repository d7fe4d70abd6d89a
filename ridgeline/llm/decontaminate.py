"""Benchmark decontamination: test items inside longer documents.

An item counts as leaked into a document that holds at least ``share`` of the
item's distinct five-word shingles; an item of one to four words is one
shingle of that many words. Items are partitioned by size; in a
partition whose largest item has u shingles each item's MinHash sketch is its
u - ceil(share * u) + 1 smallest shingle hashes. A document with the needed
share misses too few shingles to miss a whole sketch, so probing sketches with
the documents' shingles finds every leak, however long the document or short
the item. Pairs found are then verified by exact containment.

Probing is one join of the exploded shingle hashes with the sketches; documents
are exploded into the shingle lengths that occur among the items. The
sketches are broadcast when their counted rows allow it and shuffled otherwise.

Defined cases: words are runs of letters and digits in lower case; a text
without words, or null, neither leaks nor is leaked into; rows are told apart by
doc_id and text, so repeated rows are reported once; items of equal id are one
item, and of shingles with equal hashes in a sketch's last place either will do;
very long texts are exploded in the row's own task, none of it left out; without
documents or items the result is empty; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_broadcast, stored, table

WORDS = 5
NO_WORD = r"[^\p{L}\p{N}]+"


def _words(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), NO_WORD), "").alias("w"))


def _hash(length: int) -> Column:
    """The hash of the ``length`` words from place p on; lengths are told apart."""
    return F.xxhash64(F.lit(length), *[F.get("w", F.col("p") + k) for k in range(length)])


def shingles(texts: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, h): a row for each shingle's hash of each of ``lengths``, repeats included."""
    rows = _words(texts, keys)
    last = F.size("w") - F.col("length")
    starts = F.explode(F.array(*[F.lit(k) for k in lengths])).alias("length") if len(lengths) > 1 else F.lit(lengths[0]).alias("length")
    rows = rows.select(*keys, "w", starts).where(last >= 0)
    rows = rows.select(*keys, "w", "length", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    h = _hash(lengths[0])
    for k in lengths[1:]:
        h = F.when(F.col("length") == k, _hash(k)).otherwise(h)
    return rows.select(*keys, h.alias("h"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, length, h): five-word shingles, or all of an item with fewer words."""
    rows = _words(items, ["item_id"]).where(F.size("w") > 0).withColumn("length", F.least(F.lit(WORDS), F.size("w")))
    rows = rows.select("item_id", "w", "length", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("p"))
    h = _hash(WORDS)
    for k in range(1, WORDS):
        h = F.when(F.col("length") == k, _hash(k)).otherwise(h)
    return rows.select("item_id", "length", h.alias("h"))


def sketches(items: DataFrame, share: float) -> DataFrame:
    """(item_id, length, h, n, in_sketch) for each distinct shingle of the items; n counts them.

    Items of equal id are one item. The size partitions are powers of two.
    """
    own = item_shingles(items).distinct()
    own = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    own = own.withColumn("size_class", F.floor(F.log2(F.col("n"))))
    largest = own.groupBy("size_class").agg(F.max("n").alias("u"))
    ranked = own.join(largest, "size_class").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    return ranked.select("item_id", "length", "h", "n", (F.col("rank") <= F.col("u") - F.ceil(F.lit(share) * F.col("u")) + 1).alias("in_sketch"))


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, item_shingles, shared): the verified pairs."""
    items = stored(sketches(items, share))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect()) or [WORDS]  # five at most
    items = items.drop("length")
    probe = sized_broadcast(items.where("in_sketch").select("h", "item_id"), broadcast_rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    key = ["doc_id", "text_hash"]
    found = stored(shingles(docs, key, lengths).join(probe, "h").select(*key, "item_id").distinct())
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    hit = found.select(*key).distinct()
    near = docs.join(hit, same(docs, hit), "left_semi").dropDuplicates(key)
    full = sized_broadcast(items.drop("in_sketch"), broadcast_rows)
    both = shingles(near, key, lengths).join(full, "h").groupBy(*key, "item_id", "n").agg(F.count_distinct("h").alias("shared"))
    both = both.where(F.col("shared") >= F.ceil(F.lit(share) * F.col("n")))
    return both.join(found, same(both, found) & (both["item_id"].eqNullSafe(found["item_id"])), "left_semi").withColumnRenamed("n", "item_shingles")


def clean_documents(docs: DataFrame, items: DataFrame, share: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with its columns."""
    bad = stored(leaks(docs, items, share).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct())
    return docs.join(sized_broadcast(bad, broadcast_rows), docs["doc_id"].cast("long").eqNullSafe(bad["_leak_id"]) & (F.xxhash64(docs["text"]) == bad["_leak_hash"]), "left_anti")


def leak_report(spark, sf_dir: str, share: float = 0.8) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share)
    return found.select("doc_id", F.col("item_id").cast("long").alias("item_id"), F.col("item_shingles").cast("long").alias("item_shingles"), "shared")


#: DuckDB SQL for the pairs of ``{documents}`` and ``benchmark``.
SQL = r"""
WITH d_w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM {documents}),
i_w AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i_s AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, 2 + greatest(len(w) - 5, 0))) AS p FROM i_w WHERE len(w) > 0)),
i_n AS (SELECT item_id, count(*) AS n FROM i_s GROUP BY item_id),
i_k AS (SELECT DISTINCT least(5, len(w)) AS k FROM i_w WHERE len(w) > 0),
d_s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, 2 + len(w) - k)) AS p FROM d_w, i_k WHERE len(w) >= k))
SELECT d.doc_id, i.item_id, CAST(n AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared
FROM d_s d JOIN i_s i ON d.s = i.s JOIN i_n k ON k.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n HAVING 10 * count(*) >= 8 * n
"""
