"""Repeats of periodic texts for several window sizes and group bounds, and groups beyond the bound."""

import functools
import hashlib
import random

import pytest

from ridgeline.llm import substring_dedup, suffix_array_dedup, winnow

from . import brute


def test_steps():
    assert winnow.steps(200, 4) == [64, 16, 4, 1] and winnow.steps(13, 2) == [4, 2, 1]
    for size in range(1, 300):
        for factor in (2, 4):
            found = winnow.steps(size, factor)
            assert found[-1] == 1 and found == sorted(set(found), reverse=True) and all(s < size or s == 1 for s in found)


def periodic(r: random.Random, length: int, letters: str) -> str:
    """Runs of short periods, between odd letters."""
    out = ""
    while len(out) < length:
        unit = "".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 7])))
        out += unit * r.randrange(1, 40) + "".join(r.choice("xyz") for _ in range(r.randrange(4)))
    return out[:length]


@pytest.mark.parametrize("most", [0, 1, 5])
@pytest.mark.parametrize("size", [20, 60, 200])
def test_periodic_bytes(spark, monkeypatch, size, most):
    monkeypatch.setattr(winnow, "resolved", functools.partial(winnow.resolved, most=most))
    r = random.Random(size * 10 + most)
    rows = [(k, periodic(r, r.randrange(size // 2, 4 * size), "ab")) for k in range(50)]
    out = suffix_array_dedup.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string"), size=size, gram=min(64, size // 3)).collect()
    want = brute.repeated_bytes([t for _, t in rows], size)
    assert {x.doc_id: (x.n_bytes - len(x.kept), len(x.spans) // 2, hashlib.sha256(x.kept).hexdigest()) for x in out} == {d: w[1:] for (d, _), w in zip(rows, want)}
    assert sum(w[1] > 0 for w in want) > 10 and sum(w[1] == 0 for w in want) < 50


@pytest.mark.parametrize("most", [0, 1, 5])
@pytest.mark.parametrize("size", [3, 6, 13])
def test_periodic_words(spark, monkeypatch, size, most):
    monkeypatch.setattr(winnow, "resolved", functools.partial(winnow.resolved, most=most))
    r = random.Random(size * 10 + most)
    rows = [(k, " ".join(periodic(r, r.randrange(size, 6 * size), "abc"))) for k in range(60)]
    out = substring_dedup.removed_words(spark.createDataFrame(rows, "doc_id long, text string"), size=size, gram=max(1, size // 3)).collect()
    want = brute.substring(rows, size)
    assert {x.doc_id: (x.n_words, x.kept) for x in out} == {d: (n, kept) for (d, _), (n, _, kept) in zip(rows, want)}
    assert sum(w[1] > 0 for w in want) > 10


def test_a_passage_in_more_documents_than_a_group_holds(spark):
    """3,000 documents that share a passage and nothing else: their group is dealt by longer prefixes."""
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 100 + k).randrange(10**9)}" for k in range(n))
    passage = words(10**6, 30)
    rows = [(k, f"{words(k, 14)} {passage} {words(k + 5000, 14)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    scheme = substring_dedup.WordWindows()
    keyed = winnow.keyed(df)
    parts = winnow.runs(winnow.blocks(keyed, winnow.repeated_names(keyed, scheme, False), scheme, False), scheme)
    assert parts.groupBy("name").count().agg({"count": "max"}).first()[0] > 2500
    assert {(x.doc_id, x.n_removed) for x in substring_dedup.substring_report(df).collect()} == {(k, 30 * (k > 0)) for k in range(3000)}
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_array_dedup.suffix_array_report(df).collect()}
    assert found == {d: w for (d, _), w in zip(rows, brute.repeated_bytes([t for _, t in rows], 200))}
    assert all(len(passage) < x[1] < x[0] and x[2] == 1 for x in found.values())


def test_equal_rows_of_a_large_group_travel_as_one(spark, monkeypatch):
    """A group of 60 rows, 3 of them different: it is dealt as 3 rows, none of which is cut."""
    cut, shorter = [], winnow.shorter
    monkeypatch.setattr(winnow, "shorter", lambda *a: cut.append(a) or shorter(*a))
    scheme = substring_dedup.WordWindows()
    names = lambda text: set(winnow.window_names(scheme.grams(text.encode())[1], scheme.width).view("int64").tolist())
    passage = next(p for i in range(99) if len(names(" ".join((p := " ".join(f"p{i}-{k}" for k in range(13))).split()[1:] + ["q"])) | names(p)) == 1)
    longer = [t for k in range(99) if names(t := f"{passage} q{k}") == names(passage)][:2]
    rows = [(*names(passage), f"b{k}".encode(), 2 * k, [passage, *longer][k % 3].encode(), 100 + k, 1) for k in range(60)]
    found = winnow.stored(spark.createDataFrame(rows, winnow.RUNS))
    resolve = lambda c, f, p: substring_dedup.first_documents(c, f, p, 13)
    want = {(r[1], r[2]): [100, 1] if r[3] == passage.encode() else [100, 1, 101 + (r[3] == longer[1].encode()), 1] for r in rows}
    for most, cuts in ((60, False), (3, False), (2, True)):
        told, _ = winnow.resolved(found, scheme, resolve, most=most)
        assert {(bytes(r.block), r.start): r.told for r in told.collect()} == want
        assert bool(cut) == cuts
