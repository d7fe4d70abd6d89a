"""From raw documents to token ids: five stages over the ``documents`` table.

Each stage gets what the one before has written. A stage's decisions take
effect: rejected documents, copies and documents with test items are gone from
what follows, and repeated passages are cut from the texts.

Defined cases: null and empty texts have too few words and go in the first
stage, and so does a host with all its documents that the first stage rejects;
of rows that share a doc_id and belong to one group of copies one stays, and rows
without a doc_id stay unless a rule or a test item rejects them; of equal
passages those in the smallest doc_id stay, and a document that loses its last
word goes; very long texts go through whole; an empty table gives an empty
result; further columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, near_copies, pieces, quality_rules, simhash, substring_dedup
from ridgeline.llm.common import bound_batches, forget, ship, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.representatives(docs, classes=near_copies.components(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return substring_dedup.deduplicated_documents(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives back the text."""
    import public_tokenizers

    bound_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", test_items),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: SQL can't encode pieces; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = stored(STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir))
    for _, stage in STAGES[1:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
