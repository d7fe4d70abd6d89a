"""The pipeline against plain Python, over a small given table."""

import os
import re

import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from ridgeline.llm import pieces
from ridgeline.llm.common import stored

from . import brute

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def kept_by_quality(rows: list[dict]) -> list[dict]:
    failed = []
    for r in rows:
        t = r["text"] or ""
        n, chars, symbols, dup, _, base = brute.quality(t)
        lines = sum(bool(brute.words(x)) for x in t.split("\n"))
        shout = 10 * len(re.findall("[A-Z]", t)) > 3 * chars or 10 * t.count("!") > 3 * n
        failed.append([base, 10 * symbols > n, 100 * dup > 40 * lines, shout])
    hosts: dict = {}
    for r, f in zip(rows, failed):
        hosts.setdefault(r["source"], []).append(f)
    bad = set()
    for k in range(4):
        rates = {h: sum(f[k] for f in x) / len(x) for h, x in hosts.items()}
        for h, x in hosts.items():
            others = [rates[o] for o in hosts if o != h]
            if not others:
                continue
            m = sum(others) / len(others)
            v = sum((y - m) ** 2 for y in others) / len(others)
            n = sum(len(hosts[o]) for o in hosts if o != h) / len(others)
            s = max(1.0, min(n, m * (1 - m) / v - 1)) if v > 1e-12 else n
            if (sum(f[k] for f in x) + m * s) / (len(x) + s) > max(0.3, m + 4 * (m * (1 - m) / (s + 1)) ** 0.5):
                bad.add(h)
    return [r for r, f in zip(rows, failed) if not any(f) and r["source"] not in bad]


def plain(rows: list[dict], items: list[tuple]) -> dict:
    rows = sorted(kept_by_quality(rows), key=lambda r: r["doc_id"])
    roots = brute.near_components([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    cut = []
    for r, (_, gone, kept) in zip(rows, brute.substring([(r["doc_id"], r["text"]) for r in rows])):
        if not gone or kept:
            cut.append((r["doc_id"], r["text"].split() if not gone else kept.decode().split(), r["text"] if not gone else None))
    bad = {d for d, *_ in brute.leaks([(d, t if t is not None else " ".join(w)) for d, w, t in cut], items)}
    return {d: w for d, w, _ in cut if d not in bad}


def test_pipeline(spark):
    rows = pd.read_parquet(f"{SF}/documents.parquet").to_dict("records")
    items = [(r["item_id"], r["text"]) for r in pd.read_parquet(f"{SF}/benchmark.parquet").to_dict("records")]
    want = plain(rows, items)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(want) and 50 < len(out) < len(rows) and all(r.round_trip for r in out)
    model = pieces.piece_model(tokenizers.path("piece_bpe_32k.model"), pieces.PieceTexts)
    for r in out:
        assert model.decode(r.ids).split() == want[r.doc_id] and r.n_pieces == len(r.ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns


def test_near_copies_go(spark):
    """Of two texts that differ in a word, by 0.8 or more of their five-word shingles alike, one stays."""
    words = [f"w{k * k % 331}" for k in range(150)]
    other = [*words[:70], "changed", *words[71:]]
    far = [*words[:75], *(f"z{k}" for k in range(75))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([words, other, far])], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2]


def test_odd_rows(spark, tmp_path):
    """Null, empty and repeated texts, repeated and null doc_ids and columns with clashing names go through all stages."""
    words = [f"w{k * k % 1009}" for k in range(300)]
    text = lambda a, z: " ".join(words[a:z])
    rows = [(1, text(0, 80)), (2, text(0, 80)), (3, None), (4, ""), (5, "   "), (None, text(80, 140)), (6, text(140, 200)), (6, text(140, 200)), (7, text(200, 240) + " " + text(0, 40)), (8, text(240, 300))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, name string, h int, `key` string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    items = spark.createDataFrame([(1, text(250, 270)), (2, None), (None, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()}
    assert set(out) == {1, None, 6, 7} and all(r.round_trip for r in out.values())
    model = pieces.piece_model(tokenizers.path("piece_bpe_32k.model"), pieces.PieceTexts)
    assert model.decode(out[7].ids).split() == words[200:240] and model.decode(out[1].ids).split() == words[:80]
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    items.write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_a_very_long_text(spark, tmp_path):
    """150,000 words go through all stages whole, less the passage that a smaller doc_id has."""
    words = [f"word{k * 7919 % 200_003}" for k in range(150_000)]
    passage = [f"shared{k}" for k in range(60)]
    rows = [(1, " ".join([f"own{k}" for k in range(40)] + passage)), (2, " ".join(words[:90_000] + passage + words[90_000:])), (3, " ".join(f"third{k}" for k in range(50)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such item is anywhere in these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, 3} and all(r.round_trip for r in out.values())
    model = pieces.piece_model(tokenizers.path("piece_bpe_32k.model"), pieces.PieceTexts)
    assert model.decode(out[2].ids).split() == words and out[2].n_chars == len(" ".join(words))


def test_batches_of_texts_are_small(spark):
    """The stages that hand texts to Python do so in some 4 MB, however many rows a batch could have; a bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 40) AS text", "'en' AS lang", "'s' AS source", "2560L AS n_chars")
    before = spark.conf.getAll.get(key)
    try:
        for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.piece_ids):
            spark.conf.unset(key)
            stage(spark, docs.limit(5), SF)
            found = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 15e6 and max(found) < 5e6
        spark.conf.set(key, 1 << 20)
        corpus_pipeline.repeated_passages(spark, docs.limit(5), SF)
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
