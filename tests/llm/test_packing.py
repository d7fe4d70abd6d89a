"""Packing: ids against the tokenizer, windows against all ways to cut, pieces against their definition."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import packing

tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN
r = random.Random(8)
WORDS = ["the", "Cat", "sat", "élan", "über", "don't", "we'll", "3.14", "42", "x1", "1x", "#$%", "...", "a.b", "Ж", "漢字", " ", "é́", "\U0001f600", "<|endoftext|>", "|", "U.S.", ",", "", "'s", "’s", " ", "\x1c", "\0", "ª", "µ", "×", "Ǆ"]
TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "\na", "a\n", "a \nb", "a\n b", "a..b", "a., b", "a.,", ". a", "a\r\nb", "a\tb", "one two. Three, four.\nFive", "x" * 3000, "A." * 50, "a  b", "a'\ns"] + [
    "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", ", ", "\n", "\n\n", "  ", "", ".\n"]) for _ in range(r.randrange(1, 60))) for _ in range(400)
]


def ids(text):
    return packing.piece_ids(PATH, PATTERN).tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_ids_are_the_tokenizers(monkeypatch, size):
    monkeypatch.setattr(packing, "TEXT", size)
    own = packing.piece_ids(PATH, PATTERN)
    for text in TEXTS:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == ids(text), repr(text)


@pytest.mark.parametrize("window, seed", [(8, 1), (16, 2), (64, 3), (1, 4), (12, 5)])
def test_windows_are_the_cheapest(window, seed):
    r = random.Random(seed)
    for _ in range(60):
        steps = [r.randint(1, min(window, r.choice([2, 5, 20]))) for _ in range(r.randint(1, 60))]
        place = np.append(0, np.cumsum(steps))
        cost = np.array([0, *[r.choice([0, 4, 24]) for _ in steps]])
        least = [0] + [10**9] * len(steps)
        for j in range(1, len(place)):
            for i in range(j):
                n = int(place[j] - place[i])
                if n <= window:
                    least[j] = min(least[j], least[i] + packing.padded(n, window) - n + int(cost[j]) + packing.EACH)
        ends = packing.best_windows(place, cost, window)
        sizes = np.diff(np.append(0, ends))
        price = dict(zip(place.tolist(), cost.tolist()))
        assert ends[-1] == place[-1] and sizes.max() <= window
        assert sum(packing.padded(int(n), window) - int(n) + packing.EACH for n in sizes) + sum(price[int(e)] for e in ends) == least[-1]


def test_places_are_never_a_window_apart():
    stops, gaps = np.zeros(10, bool), np.zeros(10, bool)
    stops[1] = gaps[2] = True
    own = np.array([0] * 5000 + [1, 2, 1, 0] + [0] * 10, np.int64)
    place, cost = packing.cut_places(own, np.array([3, len(own)]), stops, gaps, 1024)
    assert place[:2].tolist() == [0, 3] and np.diff(place).max() <= 64 and cost[place == 5001] == packing.AT_SENTENCE and place[-1] == len(own) and 5003 not in place
    for window in (1, 2, 3, 7):
        place, _ = packing.cut_places(own, np.array([3, len(own)]), stops, gaps, window)
        assert np.diff(place).max() <= max(1, window)


def check(rows, pieces, window=1024):
    """``pieces`` hold each id of ``rows`` once, in order, in windows without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    want = defaultdict(list)
    for d, text in rows:
        want[d].append(tuple([*ids(text or ""), 0]))
    assert set(want) == set(docs)
    for d, texts in want.items():
        left = list(docs[d])
        for own in texts:  # rows that share an id are told apart by their pieces
            at = 0
            while at < len(own):
                p = next(p for p in left if p.start == at and p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes()))
                left.remove(p)
                at += p.length
            assert at == len(own)
        assert not left
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    return {s: sum(p.length for p in own) for s, own in sequences.items()}


SCHEMA = "doc_id long, text string, ids string, length int, sequence_id string, pieces int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "i", 1, "s", 2) for d, t in rows], SCHEMA).repartition(parts)


def test_pieces(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id here"), (None, "no id here"), (7, "again"), (900, None), (901, "word " * 9000), (902, "y" * 40_000)]
    out = packing.sequences(frame(spark, rows), PATH, PATTERN)
    found = packing.piece_report(out).collect()
    lengths = check(rows, found)
    stored = {s.sequence_id: s for s in out.collect()}
    assert {k: s.length for k, s in stored.items()} == lengths
    assert all(s.padded == packing.padded(s.length, 1024) and len(s.ids) == s.length * s.id_width for s in stored.values())
    padding = sum(s.padded - s.length for s in stored.values())
    assert padding < 0.05 * sum(lengths.values())
    assert packing.sequences(frame(spark, []), PATH, PATTERN).count() == packing.piece_report(packing.sequences(frame(spark, []), PATH, PATTERN)).count() == 0


def test_many_stretches_keep_the_order(spark):
    rows = [(k, f"Sentence {k} ends here. And another one, of more words, ends too. " * (k % 40 + 1)) for k in range(300)]
    found = packing.piece_report(packing.sequences(frame(spark, rows, 1).orderBy("doc_id").coalesce(1), PATH, PATTERN, stretch_tokens=3000)).collect()
    check(rows, found)
    order = sorted(found, key=lambda p: (p.sequence_id, p.offset))
    assert [p.doc_id for p in order] == sorted(p.doc_id for p in found)
    inside = [p for p in order if p.start + p.length < p.doc_tokens]
    assert 0 < len(inside) < len(order)


def test_padding_is_small_on_prose():
    """Windows of 1,024 over prose of short and long documents: about one token in a hundred is padding."""
    r = random.Random(2)
    ends = np.cumsum([r.choice([30, 200, 700, 3000]) + r.randrange(50) for _ in range(400)])
    own = np.array([r.random() < 0.05 for _ in range(int(ends[-1]))], np.int64)
    place, cost = packing.cut_places(own, ends, np.array([False, True]), np.array([True, True]), 1024)
    sizes = np.diff(np.append(0, packing.best_windows(place, cost, 1024)))
    assert sum(packing.padded(int(n), 1024) - int(n) for n in sizes) < 0.02 * ends[-1]
