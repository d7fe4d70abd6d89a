"""Each operator against plain Python, over odd rows and an empty table."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import decontaminate, lm_scoring, near_copies, pieces, quality_rules, simhash, substring_dedup, suffix_array_dedup, token_binary, token_counts, toxicity, winnow
from ridgeline.llm.components import connected

from . import brute

tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, source string, n_chars long, ids int, n_words string, key string, name string, h string, _Q int"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", ". ", "\t "]) for _ in range(n))


PASSAGE = prose(60, 1)
ROWS = [
    (1, prose(80, 2), "a"), (2, prose(80, 2), "a"), (3, prose(40, 3) + PASSAGE + prose(30, 4), "a"), (4, PASSAGE + prose(20, 5), "b"),
    (5, None, "b"), (6, "", None), (7, " \n\t", "b"), (8, "one two", "b"), (None, prose(50, 6) + PASSAGE, "b"), (None, "x y z", None),
    (9, prose(30, 7), "a"), (9, prose(30, 7), "a"), (9, PASSAGE, "c"), (10, prose(2500, 8) + PASSAGE + prose(10, 9), "c"), (11, "spam spam " * 60, "c"),
    (12, "ÄÖÜ ß é ́x \U0001f600 ▁ <|endoftext|> A.B c.", "c"), (13, "a" * 900, "c"), (14, prose(80, 2).replace(" ", "  "), "a"), (-3, PASSAGE.upper(), "a"), (15, "WORD!! " * 30, "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, s, len(t or ""), 1, "w", "k", "n", "h", 2) for d, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)


def test_quality(docs, empty):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(docs).collect()]
    assert order(got) == order((d, *brute.quality(t)) for d, t, _ in ROWS)
    assert quality_rules.quality_report(empty).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3} and not {5, 6, 7, 8, 11, 15} & {r.doc_id for r in kept.collect()}


def test_host_rates_are_shrunk(spark):
    """A small host with failures only is judged between its rate and the others'."""
    rows = [("big", k < 10) for k in range(100)] + [("small", True)] * 2 + [(None, False)] * 50
    judged = spark.createDataFrame([(s, f, False, False, False) for s, f in rows], "source string, fail_base boolean, fail_symbols boolean, fail_dup_lines boolean, fail_shouting boolean")
    rate = {r.source: r.host_rate for r in quality_rules.host_rates(judged).collect()}
    assert 0.02 < rate["small"] < 0.6 and abs(rate["big"] - 0.1) < 0.1 and rate[None] < 0.1


def test_a_bad_host_goes_and_a_small_one_stays(spark):
    """All of a bad host's documents go, good ones too; a small host's good document
    stays, although two of its three fail: the prior outweighs them. SQL says the same."""
    duckdb = pytest.importorskip("duckdb")
    rows = []
    for host, good, bad in [*((f"h{k}", 38, k % 3) for k in range(9)), ("worst", 4, 36), ("small", 1, 2), (None, 30, 0)]:
        rows += [(host, prose(40, 7000 + 50 * len(rows) + k)) for k in range(good)] + [(host, "SHOUT! " * (20 + k)) for k in range(bad)]
    rows = [(k, t, h) for k, (h, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.quality_report(df).collect()}
    for k, t, h in rows:
        assert out[k].host_rejected == (h == "worst") and out[k].kept == (h != "worst" and not t.startswith("SHOUT"))
    assert {r.source for r in quality_rules.kept_documents(df).collect()} == {None, "small", *(f"h{k}" for k in range(9))}
    one = df.where("source = 'worst'")
    assert not any(r.host_rejected for r in quality_rules.quality_report(one).collect())  # no others to be judged by
    table = df.toPandas()  # noqa: F841
    found = duckdb.sql(quality_rules.SQL.replace("{documents}", "table").replace("{floor}", "0.3").replace("{spread}", "4.0").replace("FROM table", "FROM \"table\""))
    at = [found.columns.index(c) for c in ("doc_id", "n_repeat_words", "base_failed", "kept", "host_rejected")]
    assert {tuple(r[k] for k in at) for r in found.fetchall()} == {(r.doc_id, r.n_repeat_words, r.base_failed, r.kept, r.host_rejected) for r in out.values()}


def test_token_shards(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for k, df in enumerate((docs, empty)):
        token_binary.write_shards(df, f"{tmp_path}/{k}", path, end_id=2, vocabulary=49_408, shard_tokens=400)
    got = order((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in token_binary.read_documents(spark, f"{tmp_path}/0").collect())
    want, start = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), start))
        start += len(ids)
    assert got == order(want)
    assert token_binary.read_documents(spark, f"{tmp_path}/1").count() == 0


def test_latin_words_go_straight_to_the_tokenizer_s_model():
    words = token_binary.WordIds(tokenizers.path("word_bpe_49k.json"), 2, limit=0)
    ids = lambda text: np.frombuffer(words.encode(text.encode()), "<u2").tolist()
    whole, tok, asked = lambda text: tok.encode(text, add_special_tokens=False).ids, words.tok, []
    r = random.Random(9)
    letters = [*"abcxyzABC.,'0-éÉñÑßœŒ×÷ÿŸİı\u0301日ÞµªÖ", "'s", "...", ".,", "Ó.", "ñ,"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 8)))
        assert ids(text) == whole(text)
    words.tok = type("Asked", (), {"encode": lambda _, text, **more: asked.append(text) or tok.encode(text, **more)})()
    for text in ("Ñieó.", "ciónraadoó,", "Éœuvre", "straße.", "Ø,"):
        assert ids(text) == whole(text) and set(asked) <= {".", ","}


@pytest.mark.parametrize("values", [[0], [5, 5, 5], list(range(0, 9000, 7)), [1 << 20], sorted(random.Random(3).choices(range(5000), k=1000))])
def test_elias_fano(values):
    code = token_binary.EliasFano.of(np.array(values), values[-1])
    assert code.values().tolist() == values and [code.select(i) for i in range(len(values))] == values


def test_pieces(docs, empty):
    path = tokenizers.path("piece_bpe_32k.model")
    out = pieces.piece_report(docs, path).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)
    assert pieces.piece_report(empty, path).count() == 0
    model = pieces.piece_model(path)

    def best(text):
        """The highest score, by trying all pieces that end at each place."""
        score = {p: v[1] for p, v in model.automaton.items()}
        top = [0.0]
        for e in range(1, len(text) + 1):
            ways = [top[e - n] + score[text[e - n : e]] for n in range(1, min(16, e) + 1) if text[e - n : e] in score]
            top.append(max(ways + ([top[e - 1] + model.unknown] if text[e - 1] not in score else [])))
        return top[-1]

    def worth(ids):
        score = {v[2]: v[1] for _, v in model.automaton.items()}
        return sum(score[i] for i in ids)

    for text in ("hello", "thnd", "  two", "a", "ñandú", "reeeead"):
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert abs(worth(model.encode(text).tolist()) - best(marked)) < 1e-6


def test_piece_ids_are_the_library_s(docs):
    path = tokenizers.path("piece_bpe_32k.model")
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    for r in pieces.encode_pieces(docs, path).collect():
        if pieces.SPACE not in (r.text or ""):  # a space to the library, byte pieces here
            assert r.ids == library.encode(r.text or "")
    r = random.Random(12)
    letters = [*"abcdefghijklmnopqrstuvwxyz    \n.,éüñß日本\U0001f600\t0123'-", "th", "ing ", "tion", " the "]
    noise = ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(400)]
    assert [pieces.encoder(path).encode(t).tolist() for t in noise] == library.encode(noise)
    more = ["Elle", "hello", "  two", "ñandú", " ", " " * 47, "a" * 300, "Elle\n\n est\t là ", "x  y   z" + " " * 33 + "w", "日本語 text \U0001f600\U0001f600", "<s> <0x0A> </s>", " ".join(VOCABULARY)]
    assert [pieces.encoder(path).encode(t).tolist() for t in more] == library.encode(more)


def test_words_that_are_not_kept_are_read_side_by_side():
    path = tokenizers.path("piece_bpe_32k.model")
    model, single = pieces.MergeModel(path, limit=0), pieces.MergeModel(path)
    r = random.Random(5)
    letters = [*"aeinrsthlou", "E", ".", ",", "\n", "é", "ñ", "ß", "'", "0", "日", "tion", "ing"]
    word = lambda: "".join(r.choice(letters) for _ in range(r.choice((1, 3, 6, 9, 9, 14, 30))))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)] + ["", " a", "a  b", "a ", "▁", "x\n\ny\n", "e" * 500]
    want = [single.encode(t).tolist() for t in texts]
    assert [x.tolist() for x in model.encode_all(texts)] == want and not model.words and not model.ahead
    alone, one_by_one = [], model.path
    model.path = lambda text: alone.append(text) or one_by_one(text)
    model.encode_all([" ".join(w for w in t.replace("\n", "").split(" ") if w and "日" not in w and len(w) < 40) for t in texts[:60]])
    assert not alone
    pairs = {p: v[2] for p, v in model.automaton.items()}
    for lanes in (pieces.Lanes(pairs, model.apart, bits=4), pieces.Lanes(pairs, model.apart, most=40, lot=7)):  # a full table; lots of few words
        words = sorted({w for t in texts[:60] for w in t.split(" ")})
        got = lanes(words)
        assert all(x is None or x == model.chunk_ids(w) for w, x in zip(words, got))
        assert sum(x is not None for x in got) > 100
    assert pieces.Lanes(pairs, model.apart, most=3)(["q", "xyz", ""]) == [None] * 3


def test_substring(docs, empty):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_report(docs).collect()]
    want = [(d, n, gone, hashlib.sha256(kept).hexdigest()) for (d, _, _), (n, gone, kept) in zip(ROWS, brute.substring([r[:2] for r in ROWS]))]
    assert order(got) == order(want) and sum(w[2] for w in want) > 150
    assert substring_dedup.substring_report(empty).count() == 0
    out = substring_dedup.deduplicated_documents(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert left[1].text == prose(80, 2) and left[3].text == ROWS[2][1] and 2 not in left and left[4].text.split() == prose(20, 5).split() and left[4].n_chars == len(left[4].text)
    assert left[5].text == "" and left[7].text == " \n\t"


def test_suffix_array(docs, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup.suffix_array_report(docs).collect()]
    assert order(got) == order((d, *x) for (d, _, _), x in zip(ROWS, brute.repeated_bytes([r[1] for r in ROWS], 200)))
    assert suffix_array_dedup.suffix_array_report(empty).count() == 0


@pytest.mark.parametrize("lot,most,names", [(3, 10_000, 50), (1, 0, 300_000), (2, 3, 1)])
def test_small_lots_and_large_groups(spark, lot, most, names, monkeypatch):
    """Lots that end within groups, and windows dealt by longer prefixes up to whole ones, change nothing."""
    resolved, repeated = winnow.resolved, winnow.repeated_names
    monkeypatch.setattr(winnow, "resolved", lambda *a, **k: resolved(*a, **k, lot=lot, most=most))
    monkeypatch.setattr(winnow, "repeated_names", lambda *a, **k: repeated(*a, **k, lot=names))
    shared = [prose(15, 100 + k) for k in range(4)]
    rows = [(k, prose(5, k) + shared[k % 4] + prose(3, 50 + k) + shared[(k * 3) % 4] + prose(4, 90 + k)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order((r.doc_id, r.n_removed) for r in substring_dedup.substring_report(df).collect())
    assert got == order((d, x[1]) for (d, _), x in zip(rows, brute.substring(rows)))
    out = suffix_array_dedup.removed_bytes(df, size=60, gram=16).collect()
    assert order((r.doc_id, r.n_bytes - len(r.kept)) for r in out) == order((d, x[1]) for (d, _), x in zip(rows, brute.repeated_bytes([t for _, t in rows], 60)))


def test_the_tree_and_the_buckets_decide(spark, docs, monkeypatch):
    """Without them nothing is removed, copies of whole texts included."""
    words = lambda contents, size: np.array([len(c.split(b" ")) - size + 1 for c in contents])
    counts = lambda contents, size: np.array([len(c) - size + 1 for c in contents])
    monkeypatch.setattr(substring_dedup, "first_documents", lambda c, f, p, size: (np.full(words(c, size).sum(), substring_dedup.NEVER), words(c, size)))
    monkeypatch.setattr(suffix_array_dedup, "repeats", lambda c, f, p, size: (np.zeros(counts(c, size).sum(), np.int64), counts(c, size)))
    assert {r.n_removed for r in substring_dedup.substring_report(docs).collect()} == {0}
    assert {r.n_removed for r in suffix_array_dedup.suffix_array_report(docs).collect()} == {0}


def test_prefix_groups():
    units = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9])
    groups = [sorted(g.tolist()) for g, _ in substring_dedup.prefix_groups(units, np.array([0, 3, 6]), 3, 1)]
    assert sorted(groups) == [[0, 2], [1]]
    one = np.ones(3, np.int64)
    assert substring_dedup.deep_nodes(units, np.array([0, 3, 6]), one, 0, 3).tolist() == [0, -1, 0]
    assert substring_dedup.deep_nodes(units, np.array([3]), one[:1], 0, 3).tolist() == [-1] and substring_dedup.deep_nodes(units, np.array([3]), 2 * one[:1], 0, 3).tolist() == [0]


def test_simhash(docs, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_report(docs).collect()]
    prints = [brute.fingerprint(t) for _, t, _ in ROWS]
    roots = brute.components(prints)
    least: dict = {}
    for (d, _, _), r in zip(ROWS, roots):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    assert order(got) == order((d, f"{f:016x}", least[r]) for (d, _, _), f, r in zip(ROWS, prints, roots))
    assert simhash.near_duplicate_report(empty).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids) - {None}) + ids.count(None) and 1 in ids and 2 not in ids


def test_parities_bound_the_difference():
    """Cells never differ more often than sets do, whatever the sizes."""
    r = random.Random(8)
    for _ in range(300):
        a = {r.getrandbits(63) for _ in range(r.choice([1, 30, 33, 400, 3000]))}
        b = set(r.sample(sorted(a), r.randint(0, len(a)))) | {r.getrandbits(63) for _ in range(r.randint(0, 60))}
        found = [near_copies.parities(np.array(sorted(x), np.int64)) for x in (a, b)]
        assert near_copies.differing(*found) <= len(a ^ b) and near_copies.differing(found[0], found[0]) == 0


@pytest.mark.parametrize("common,most", [(8, 20_000), (1, 20_000), (1, 5)])
def test_near_copies(spark, docs, empty, common, most, monkeypatch):
    """Components of Jaccard similarity 0.8 against all pairs, with few or most shingles put last, and with groups cut."""
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "MOST_ROWS", most)
    monkeypatch.setattr(near_copies, "SAMPLE", 1 if common == 1 else 16)
    r, rows = random.Random(9), [(d, t) for d, t, _ in ROWS if d is not None]
    for k in range(12):
        words = prose(r.randint(20, 120), 300 + k).split() + PASSAGE.split()[: 20 * (k % 3)]
        for c in range(8):  # each is a change or two away from an earlier one, so some links go over others
            rows.append((100 + 10 * k + c, " ".join(words)))
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randrange(900)}"
    up = brute.near_components([t for _, t in rows])
    least: dict = {}
    for (d, _), u in zip(rows, up):
        least[u] = min(d, least.get(u, d))
    got = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert order(map(tuple, got)) == order((d, least[u]) for (d, _), u in zip(rows, up))
    assert 20 < len(least) < len(rows) - 20
    assert near_copies.components(empty).count() == 0 and near_copies.components(docs).count() == len(ROWS)


def test_a_large_group_of_near_copies(spark):
    """5,000 texts a word apart from one, and 40 others that share a passage with all of them."""
    r = random.Random(4)
    base, passage = prose(70, 900).split(), [f"p{k}" for k in range(12)]
    texts = []
    for k in range(5000):
        own = [*base]
        own[r.randrange(70)] = f"x{k}"
        texts.append(own + passage)
    texts += [[f"y{k}-{j}" for j in range(70)] + passage for k in range(40)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.component_id for x in near_copies.components(df).collect()}
    assert got == {k: 0 if k < 5000 else k for k in range(5040)}


@pytest.mark.parametrize("most,deep", [(20_000, 8), (2, 8), (1, 3)])
def test_trie_pairs_cut_and_not(spark, most, deep):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(r.randint(0, 6)):
            x = r.choice(values[-5:] + [v])
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            values.append(x)
    values += [k for k in range(40)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most, deep=deep)
    root = {r.node: r.root for r in connected(links).collect()}
    want: dict = {}
    for v, c in zip(signed, brute.components(values)):
        want.setdefault(c, set()).add(v)
    got: dict = {}
    for v in signed:
        got.setdefault(root.get(v, v), set()).add(v)
    assert order(map(sorted, got.values())) == order(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in connected(edges).collect()} == {0}


def test_decontamination(spark, docs, empty):
    short = "three four five"
    items = [(7, short), (8, "b"), (1, PASSAGE), (2, " ".join(PASSAGE.split()[5:40])), (3, None), (4, "one two"), (5, prose(30, 77)), (6, "..."), (6, "!"), (None, " ".join(PASSAGE.split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    inside = spark.createDataFrame([(1, "one two three, FOUR five six seven eight"), (2, "three four six five")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(inside, bench.where("item_id IN (1, 7)")).collect()] == [(1, 7)]
    found = decontaminate.leaks(docs, bench)
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in found.collect()}
    assert got == brute.leaks([r[:2] for r in ROWS], items) and len(got) > 5
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    bad = {d for d, *_ in got}
    assert {r.doc_id for r in clean.collect()} == {d for d, t, _ in ROWS if d not in bad or d == 9 or d is None} and clean.count() == sum((d, t) not in {(x, y) for x, y, _ in ROWS if brute.leaks([(x, y)], items)} for d, t, _ in ROWS)


def test_lm_scoring(docs, empty):
    got = order((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.lm_report(docs, "test").collect())
    assert got == order((d, *x[:4], round(x[4], 6)) for (d, _, _), x in zip(ROWS, brute.base_scores([r[:2] for r in ROWS])))
    assert lm_scoring.lm_report(empty, "none").count() == 0


def test_lm_scores_are_a_model_s(spark, docs, monkeypatch):
    """With the weights it was given a score is what plain Python finds, and probabilities sum to 1 over all types and an unseen one."""
    r = np.random.default_rng(3)
    rows, types = 64, sorted({w for _, t, _ in ROWS for w in lm_scoring.tokens((t or "").encode())})
    hashes = np.array([lm_scoring.word_hash(w) for w in types])
    class_of, part_of = (r.integers(0, k, lm_scoring.UNITS) for k in (lm_scoring.CLASSES, lm_scoring.PARTS))
    w1, w2 = (r.normal(0, 1, shape).astype(np.float32) for shape in lm_scoring.shapes(rows))
    counts = r.integers(1, 50, len(types))
    codes, endings = lm_scoring.Codes(hashes), np.array([lm_scoring.ending(w) for w in types])
    layout = lm_scoring.Layout(endings, class_of, part_of, codes[lm_scoring.END], rows)
    leaf = lambda w: (lambda u: (int(class_of[u]), int(part_of[u])))(codes[w] if 0 <= codes[w] < lm_scoring.TOP else lm_scoring.TOP + lm_scoring.ending(w))
    sizes: dict = {}
    for w, c in zip(types, counts.tolist()):
        n, k = sizes.get(leaf(w), (0, 0))
        sizes[leaf(w)] = n + c, k + 1

    def softmax(weights, active):
        s = [sum(float(weights[f, j]) for f in active) for j in range(weights.shape[1])]
        z = sum(np.exp(s))
        return [np.exp(x) / z for x in s]

    by_leaf = np.log10([sum(sizes.get((c, p), (0, 0))) + 1.0 for c in range(lm_scoring.CLASSES) for p in range(lm_scoring.PARTS)])
    log_count = np.log10(np.append(counts, 0) + 1.0)
    for text in (b"one two", b"", PASSAGE.encode()[:150]):
        words = lm_scoring.tokens(text)
        own = np.array([codes[w] for w in words], np.int32)
        cls, part, f1, f2 = layout(own, np.arange(len(own)))
        want = 0.0
        for k, w in enumerate(words):
            p1, p2 = softmax(w1, f1[:, k].tolist()), softmax(w2, f2[:, k].tolist())
            n, kinds = sizes[leaf(w)]
            want += np.log10(p1[cls[k]] * p2[part[k]] * (counts[types.index(w)] + 1) / (n + kinds + 1))
            assert (cls[k], part[k]) == leaf(w) and abs(sum(p1) - 1) < 1e-9 and abs(sum(p2) - 1) < 1e-9
        got = lm_scoring.score_lot(own, np.arange(len(own)), np.zeros(len(own), int), layout, [w1, w2], by_leaf, log_count, log_count)
        assert abs(got[0][0] - want) < 1e-4 * abs(want) and got[2][0] == len(words)
    for n, kinds in sizes.values():  # a part's types and one unseen share it
        assert sum((c + 1) / (n + kinds + 1) for w, c in zip(types, counts.tolist()) if sizes[leaf(w)] == (n, kinds)) >= (n + kinds) / (n + kinds + 1) - 1e-9
    # each feature of a token changes with what stands before it
    a, b = (layout(np.array(x, np.int32), np.arange(4))[2] for x in ([1, 2, 3, 4], [9, 2, 3, 4]))
    assert (a[:, 1] != b[:, 1]).any() and (a[:, 2] != b[:, 2]).any() and (a[:, 0] == b[:, 0]).all()


def test_a_gradient_is_plain_python_s(spark):
    """Seen less expected for each row and outcome, summed token by token; and a step from it."""
    r = np.random.default_rng(5)
    rows, words = 64, [f"w{k}".encode() for k in range(30)]
    hashes, endings = np.array([lm_scoring.word_hash(w) for w in [b"", *words]]), np.array([lm_scoring.ending(w) for w in [b"", *words]])
    class_of, part_of = (r.integers(0, k, lm_scoring.UNITS) for k in (lm_scoring.CLASSES, lm_scoring.PARTS))
    layout = lm_scoring.Layout(endings, class_of, part_of, lm_scoring.Codes(hashes)[b""], rows)
    weights = [r.normal(0, 1, shape).astype(np.float32) for shape in lm_scoring.shapes(rows)]
    texts = [np.append(r.integers(1, 31, n), 0).astype(np.int32) for n in (0, 1, 5, 40, 300)]
    sums = [np.zeros(shape) for shape in lm_scoring.shapes(rows)]
    for own in texts:
        cls, part, *f = layout(own, np.arange(len(own)))
        for t in range(len(own)):
            for total, w, k, met in zip(sums, weights, f, (cls, part)):
                active = k[:, t].tolist()
                z = [math.exp(sum(float(w[a, j]) for a in active)) for j in range(w.shape[1])]
                for a in active:
                    for j in range(w.shape[1]):
                        total[a, j] += (j == met[t]) - z[j] / sum(z)
    df = spark.createDataFrame([(x.tobytes(),) for x in texts], "codes binary").repartition(3)
    context = spark.sparkContext
    got = lm_scoring.gradient_sums(df, context.broadcast(layout), context.broadcast(weights))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, sums))
    seen = [np.abs(x).round() for x in sums]
    for k, (w, s, g, new) in enumerate(zip(weights, seen, sums, lm_scoring.next_weights(weights, seen, got, 2, rate=0.4, penalty=5.0, steady=6.0))):
        for a in range(len(w)):
            for j in range(w.shape[1]):
                penalty = 0.0 if a >= len(w) - (lm_scoring.CLASSES if k else 1) else 2.5
                step = 0.4 * (g[a, j] - penalty * float(w[a, j])) / (s[a, j] / 2 + 8.5)
                assert abs(float(w[a, j]) + max(-0.7, min(0.7, step)) - new[a, j]) < 1e-4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_more_rounds_do_no_harm(spark):
    """Log10 a token of held-out texts: training gains on the first weights, and ten rounds lose nothing against two."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2

    def held(rounds):
        out = lm_scoring.scores(df, ~held_out, f"rounds {rounds}", rounds).where(held_out).agg(F.sum("score"), F.sum("n_tokens")).first()
        return out[0] / out[1]

    none, two, ten = held(0), held(2), held(10)
    assert two > none and ten > none and ten > two - 0.002


def test_lm_tables_grow_with_the_tokens():
    sizes = [lm_scoring.table_rows(n) for n in (0, 10**7, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == lm_scoring.ROWS[0] and sizes[1] < sizes[2] < sizes[3] == lm_scoring.ROWS[1]


def test_lm_beats_counts(spark):
    """Two kinds of texts with words of their own: what stands before tells which."""
    r = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "pq"]
    rows = [(d, " ".join(r.choice(kinds[d % 2]) for _ in range(50))) for d in range(200)]
    out = lm_scoring.lm_report(spark.createDataFrame(rows, "doc_id long, text string"), "kinds").where("held_out").collect()
    assert sum(x.score for x in out) / sum(x.n_tokens for x in out) > sum(x.base_score for x in out) / sum(x.n_tokens for x in out) + 0.15


def test_token_counts(spark, docs, empty):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(encoding.encode_ordinary(t or "")) for _, t, _ in ROWS)
    own = token_counts.token_lengths(docs, path, tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in own.collect()) == lengths
    sums = token_counts.length_table(own, block=8).cache()
    for r in sums.collect():
        limit = r.context_limit
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.total_docs, r.total_tokens, r.truncated_tokens) == (
            lengths.count(limit), sum(x > limit for x in lengths), sum(x for x in lengths if x > limit), len(lengths), sum(lengths), sum(min(x, limit) for x in lengths)
        )
    assert sums.count() == len(set(lengths))
    limits = [0, 1, 7, 50, 10**6]
    assert sorted((r.context_limit, r.truncated_tokens) for r in token_counts.truncated_totals(sums, limits).collect()) == [(k, sum(min(x, k) for x in lengths)) for k in limits]
    shares = {r.share: r.n_tokens for r in token_counts.length_quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert shares == {s: lengths[int(np.ceil(s * len(lengths))) - 1] for s in (0.1, 0.5, 1.0)}
    assert token_counts.length_table(token_counts.token_lengths(empty, path, tokenizers.PATTERN)).count() == 0


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity_report(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity_report(empty, labels).count() == 0 and toxicity.toxicity_report(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity_on_held_out(spark):
    r = random.Random(1)
    bad = ["grob", "mistig", "blarg"]

    def text(toxic, k):
        w = [r.choice(VOCABULARY) for _ in range(40)]
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(40), r.choice(bad) if k % 9 else "m1stig")
        return " ".join(w)

    rows = [(k, text(k % 4 == 0, k), int(k % 4 == 0)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {x.doc_id: x for x in toxicity.toxicity_report(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [(out[d], t) for d, _, t in rows if out[d].held_out]
    assert len(held) > 100 and sum(x.predicted == t for x, t in held) >= 0.97 * len(held)
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, x in out.items())


def test_no_calibration_row_reaches_the_lexicon_or_the_trees(spark, monkeypatch):
    """Each part of the labelled rows has a word of its own; what is learned from shows by them."""
    names = ["zero", "one", "two"]
    part = {r.id: r.p for r in spark.range(600).select("id", toxicity.part_of("id").alias("p")).collect()}
    rows = [(k, f"{names[part[k]]}{'bad' if k % 3 == 0 else 'good'} filler{k % 7} filler{k % 5}", int(k % 3 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = {}
    learn, table = toxicity.learn_lexicons, toxicity.feature_table
    monkeypatch.setattr(toxicity, "learn_lexicons", lambda labelled, **k: seen.setdefault("lexicons", learn(labelled, **k)))
    monkeypatch.setattr(toxicity, "feature_table", lambda docs, lexicons, which=None: seen.setdefault(which or "all", (docs, table(docs, lexicons, which)))[1])
    out = toxicity.toxicity_report(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    assert len(out) == 600
    words = [{w for w in x if not w.endswith("*")} for x in seen["lexicons"]]
    assert words == [{"zerobad"}, {"onebad"}, {"zerobad", "onebad"}]
    used = {(part[r.doc_id], r.which) for r in seen["which"][0].select("doc_id", "which").collect()}
    assert used == {(0, 1), (1, 0), (2, 2)}


def test_few_labels_give_one_score(spark):
    df = spark.createDataFrame([(k, "a b" if k % 2 else "c d") for k in range(60)], "doc_id long, text string")
    labels = spark.range(30).selectExpr("id AS doc_id", "CAST(id < 8 AS int) AS toxic")
    assert len({r.score for r in toxicity.toxicity_report(df, labels).collect()}) == 1


def test_unmasked():
    assert toxicity.unmasked("l0s3r") == "loser" and toxicity.unmasked("i.d.i.o.t") == "idiot" and toxicity.unmasked("scuuuum") == "scum"


def test_schema_of_encoded(docs):
    path = tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_pieces(docs, path)
    assert out.schema["ids"].dataType == T.ArrayType(T.IntegerType()) and len(out.columns) == len(docs.columns)
