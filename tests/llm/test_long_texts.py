"""Very long texts: many words, and one unbroken run of letters."""

import random

import pytest

from ridgeline.llm import decontaminate, lm_scoring, near_copies, pieces, quality_rules, simhash, substring_dedup, suffix_array_dedup, token_binary, token_counts, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
N_WORDS, RUN = 150_000, 500_000
ITEM = "never shown item words stand here at the very end of the text"


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(11)
    words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(40_000)}" for _ in range(N_WORDS)]
    text = " ".join(words)
    rows = [(1, f"{text} {ITEM}"), (2, "x" * RUN), (3, " ".join(words[-40:])), (4, "x" * (RUN - 1)), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "length(text) AS n_chars").repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_rules_and_leaks(spark, long):
    out = by_id(quality_rules.quality_report(long))
    assert out[1].n_words == N_WORDS + 13 and out[2].n_words == 1 and out[2].word_chars == RUN and out[5].n_words == 0
    items = spark.createDataFrame([(7, ITEM), (8, "very end")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(long, items).collect()} == {(1, 7), (1, 8)}


def test_repeats(long):
    words = by_id(substring_dedup.substring_report(long))
    assert words[3].n_removed == 40 and words[1].n_removed == words[2].n_removed == 0
    out = by_id(suffix_array_dedup.suffix_array_report(long))
    assert out[2].n_removed == RUN and out[4].n_removed == RUN - 1 and out[2].n_spans == 1
    assert 0 < out[1].n_removed < 400 and out[1].n_bytes > N_WORDS * 5


def test_near_copies(long):
    assert {r.component_id for r in simhash.near_duplicate_report(long).collect()} >= {1, 3}
    assert {r.doc_id: r.component_id for r in near_copies.components(long).collect()} == {k: k for k in range(1, 6)}


def test_tokens(spark, long, tmp_path):
    path = tokenizers.path("piece_bpe_32k.model")
    assert all(r.round_trip for r in pieces.piece_report(long, path).collect())
    path = tokenizers.path("word_bpe_49k.json")
    token_binary.write_shards(long, f"{tmp_path}/shards", path, end_id=2, vocabulary=49_408)
    out = by_id(token_binary.read_documents(spark, f"{tmp_path}/shards"))
    assert out[1].start == 0 and out[2].start == out[1].n_tokens > N_WORDS and out[5].n_tokens == 1
    lengths = by_id(token_counts.token_lengths(long, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))
    assert lengths[1].n_tokens > N_WORDS and lengths[2].n_tokens > 1000


def test_scores(spark, long):
    out = by_id(lm_scoring.lm_report(long, "long"))
    assert out[1].n_tokens == N_WORDS + 14 and out[2].n_tokens == 2 and all(r.score < 0 for r in out.values())
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(long, labels).count() == 5
    assert toxicity.feature_table(long, [{"xx*": 3}]).count() == 5
