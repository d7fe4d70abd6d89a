"""Helpers of the language model that work on many words or rows at once, against one at a time."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import lm_scoring


def test_hashes_and_endings_of_many_words():
    r = random.Random(4)
    words = list(dict.fromkeys([b"", b"a", b"\xff", b"\xff\xff\xff\xff", *(r.randbytes(r.randrange(1, 12)) for _ in range(3000))]))
    assert lm_scoring.word_hashes(words).tolist() == [lm_scoring.word_hash(w) for w in words]
    assert lm_scoring.word_endings(words).tolist() == [lm_scoring.ending(w) for w in words]
    assert lm_scoring.word_hashes([]).dtype == np.int64 and len(lm_scoring.word_hashes([])) == 0
    rows = lm_scoring._type_rows(Counter({w: k for k, w in enumerate(words)}))
    assert rows.column("c").to_pylist() == list(range(len(words))) and rows.schema.names == ["h", "ending", "c"]
    codes = lm_scoring.Codes(lm_scoring.word_hashes(words[:5]))
    assert [codes[w] for w in words] == [k if k < 5 else -1 - (lm_scoring.ending(w) << 19 | lm_scoring.word_hash(w) & 0x7FFFF) for k, w in enumerate(words)]


def test_rows_are_added_one_after_the_other():
    r = np.random.default_rng(4)
    rows, x = r.integers(0, 50, 4000), r.normal(size=(4000, 32)).astype(np.float32)
    found, want = np.zeros((50, 32), np.float32), np.zeros((50, 32), np.float32)
    lm_scoring._rows_added(found, rows, x)
    for k, own in zip(rows, x):
        want[k] += own
    assert (found == want).all()


def test_chances_and_surprises():
    r = np.random.default_rng(5)
    weights, rows, met = r.normal(size=(40, 32)).astype(np.float32), r.integers(0, 40, (5, 300)), r.integers(0, 32, 300)
    e = np.exp(weights[rows].sum(0, dtype=float))
    p = e / e.sum(1, keepdims=True)
    assert np.allclose(lm_scoring.log_chance(weights, rows, met), np.log(p[np.arange(300), met]), atol=1e-4)
    found = lm_scoring.surprise(weights, rows, met)
    assert found.dtype == np.float32 and np.allclose(found, np.eye(32)[met] - p, atol=1e-5)


def test_what_training_reads(spark, monkeypatch):
    """The part that is set aside is a table of its own, so that no round reads all texts for it, and a pass has no more tasks than cores."""
    seen = {}

    def trained(learn, check, layout, sums, rounds):
        seen.update(n=check.count(), apart=not set(check.inputFiles()) & set(learn.inputFiles()), tasks=learn.rdd.getNumPartitions(), learn=learn.count())
        return lm_scoring.first_weights(sums)

    monkeypatch.setattr(lm_scoring, "trained", trained)
    docs = spark.range(0, 640, 1, 12).selectExpr("id AS doc_id", "concat('a b w', id % 50) AS text")
    assert lm_scoring.scores(docs, F.lit(True), "set aside").count() == 640
    aside = docs.where(F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(lm_scoring.CHECK)) == 0).count()
    assert 0 < aside == seen["n"] and seen["learn"] == 640 - aside
    assert seen["apart"] and seen["tasks"] <= spark.sparkContext.defaultParallelism


def test_texts_of_a_batch_are_encoded_at_once():
    texts = [b"", b"A b", b"zz b zz", b"", b"q" * 80]
    codes = lm_scoring.Codes(lm_scoring.word_hashes([b"", b"b"]))
    data, rare = lm_scoring.encoded(texts, codes)
    words = [lm_scoring.tokens(t) for t in texts]
    assert [np.frombuffer(x, np.int32).tolist() for x in data.to_pylist()] == [[codes[w] for w in own] for own in words]
    assert rare.to_pylist() == [[lm_scoring.word_hash(w) for w in own if w not in (b"", b"b")] for own in words]
    assert lm_scoring.encoded([], codes)[0].to_pylist() == []
    x = np.arange(-9, 100_000, 7)
    assert (lm_scoring._row(x, 2, 1536) == (lm_scoring._hashed(x, 2) % np.uint64(1536)).astype(np.int64)).all()
