"""Toxicity scores from gradient-boosted trees over dense features.

A lexicon of words and word stems is learned from labelled documents by their
log odds, in three tiers of strength. A document's features are the tiers'
densities, how often such words stand near a second-person word, and the rates
of capitals, punctuation, obfuscated words and lexicon words behind an
obfuscation. Spark ML's boosted trees are fitted to them, and isotonic
regression calibrates the scores.

Labelled rows are parted before anything is learned. A quarter is for
calibration alone: neither the lexicon nor the trees see it. The rest is in two
folds, and each fold's features come from the lexicon of the other one, so that
the trees are fitted to features of unseen texts, as those that they score. All
texts are scored with the lexicon of both folds.

The fit uses at most about ``fit_rows`` labelled rows, drawn by a hash of
doc_id. Log odds are taken in Spark for every unit of those rows; the lexicon is
the ``size`` units with the highest, of those in ``least_docs`` toxic documents
or more. Scoring reads every document once and shuffles features only.

Defined cases: a null or empty text has zero features and is scored; labels of
one doc_id count once, as toxic if any is; a null label isn't learned from; a
null doc_id counts as held out; with fewer than ``least_labels`` toxic or clean
labels nothing is fitted and every score is the training share of toxic rows (0
without any); units with equal odds are taken in their own order, and equal
texts score alike; a very long text is one row of features; an empty table gives
an empty result; further columns, lang and source among them, are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, slices, stored, text_bytes

#: Second-person words (fixed values).
SECOND_PERSON = frozenset("you your yours yourself you're ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros vuestro tus".split())
#: Letters that digits and signs stand for (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
STEMS = (4, 5, 6, 7)
NEAR = 5
FEATURES = ["strong", "medium", "weak", "stems", "hidden", "second_person", "near_second_person", "capitals", "capital_words", "punctuation", "exclaims", "obfuscated", "any_lexicon", "log_strong", "log_words"]

#: ASCII signs at a word's ends.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_edges = re.compile(r"^\W+|\W+$")
_odd = re.compile(r"\w[^\w\s'’-]+\w|[^\W\d_]\d|\d[^\W\d_]")
_stretched = re.compile(r"(.)\1\1")


def plain(word: str) -> str:
    w = word.strip(SIGNS)
    return w if w.isalpha() else _edges.sub("", word)


def unmasked(word: str) -> str:
    """The word behind digits, signs and stretched letters."""
    w = re.sub(r"[\W_]", "", word.translate(LEET))
    return re.sub(r"(.)\1{2,}", r"\1", w)


def units(text: str) -> set[str]:
    """Words of a text in lower case, and their stems, marked by ``*``."""
    words = set(map(plain, set(text.lower().split()))) - {""}
    return words.union(*[{w[:k] + "*" for w in words if len(w) > k} for k in STEMS])


def _counted(rows: DataFrame) -> DataFrame:
    """(unit, kind, docs): in how many texts of ``rows`` (text, kind) of each kind a unit occurs."""

    def count(batches):
        seen: dict[int, Counter] = {}
        for b in slices(batches, 500):
            for t, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(kind, Counter()).update(units(t or ""))
            if sum(map(len, seen.values())) > 400_000:
                yield from map(_counts, seen, seen.values())
                seen = {}
        yield from map(_counts, seen, seen.values())

    return rows.select("text", "kind").mapInArrow(count, "unit string, kind int, docs long").groupBy("unit", "kind").agg(F.sum("docs").alias("docs"))


def _counts(kind: int, seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([kind] * len(seen), pa.int32()), pa.array(seen.values(), pa.int64())], ["unit", "kind", "docs"])


def learn_lexicons(labelled: DataFrame, least_docs: int = 4, size: int = 5_000) -> list[dict[str, int]]:
    """unit -> tier (3 strong, 2 medium, 1 weak) of the ``size`` units with the highest
    log odds, learned from fold 0, from fold 1 and from both of ``labelled`` (text, fold, toxic).

    Odds are those of being in a toxic text; a unit in fewer than ``least_docs`` toxic texts has none.
    """
    total = {(r["fold"], r["toxic"]): r["n"] for r in labelled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # 4 rows
    counts = stored(_counted(labelled.withColumn("kind", (2 * F.col("fold") + F.col("toxic")).cast("int"))))
    out = []
    for folds in ([0], [1], [0, 1]):
        n = [sum(total.get((f, toxic), 0) for f in folds) for toxic in (0, 1)]
        in_docs = [F.coalesce(F.sum(F.when(F.col("kind").isin([2 * f + toxic for f in folds]), F.col("docs"))), F.lit(0)).alias(name) for toxic, name in ((0, "clean"), (1, "toxic"))]
        each = counts.groupBy("unit").agg(*in_docs).where(F.col("toxic") >= least_docs)
        odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
        best = each.select("unit", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "unit").limit(size).collect()
        out.append({r["unit"]: 3 if r["odds"] > 4 else 2 if r["odds"] > 2.5 else 1 for r in best})
    forget(counts)
    return out


class _Codes(dict):
    """A word's code: bits 0-1 its tier, 2 by its stem, 3 behind an obfuscation, 4 second person, 5 obfuscated."""

    def __init__(self, lexicon: dict[str, int], limit: int = 400_000):
        self.words = {u: tier for u, tier in lexicon.items() if not u.endswith("*")}
        self.stems = {u[:-1]: tier for u, tier in lexicon.items() if u.endswith("*")}
        self.starts, self.limit = {u[: min(STEMS)] for u in self.stems}, limit

    def _tier(self, word: str) -> tuple[int, int]:
        tier = self.words.get(word, 0)
        if word[: min(STEMS)] not in self.starts:
            return tier, 0
        stem = max([self.stems.get(word[:k], 0) for k in STEMS if len(word) > k], default=0)
        return max(tier, stem), 4 * (stem > tier)

    def __missing__(self, word: str) -> int:
        low = word.lower()
        w = low.strip(SIGNS)
        if w.isalpha() and word.strip(SIGNS).isalpha():  # letters between signs: not obfuscated, and nothing but stretched letters to undo
            tier, code = self._tier(w)
            if not tier and len(w) > 3 and _stretched.search(w):
                tier = self._tier(unmasked(w))[0]
                code |= 8 if tier else 0
        else:
            w = plain(low)
            tier, code = self._tier(w)
            if _odd.search(word):
                code |= 32
                if not tier:
                    tier, code = self._tier(unmasked(low))[0], code | 32
                    code |= 8 if tier else 0
            elif not tier and len(w) > 3 and (u := unmasked(w)) != w:
                tier = self._tier(u)[0]
                code |= 8 if tier else 0
        code |= tier | (16 if w in SECOND_PERSON else 0)
        if len(self) < self.limit and len(word) < 64:
            self[word] = code
        return code


def features(text: bytes, codes: _Codes) -> list[float]:
    words = text.decode().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.frombuffer(bytes(map(codes.__getitem__, words)), np.uint8)
    tier, you = c & 3, np.flatnonzero(c & 16)
    hits = np.flatnonzero(tier)
    near = 0
    if len(hits) and len(you):
        k = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - hits), np.abs(you[np.maximum(k - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(raw, minlength=256)
    capitals, letters = int(kinds[65:91].sum()), int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[192:].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    after = raw[1:]
    pairs = int(((raw[:-1] >= 65) & (raw[:-1] <= 90) & (after >= 65) & (after <= 90)).sum())
    strong = int((tier == 3).sum())
    return [
        strong / n, int((tier == 2).sum()) / n, int((tier == 1).sum()) / n, int((c & 4 > 0).sum()) / n, int((c & 8 > 0).sum()) / n,
        len(you) / n, near / n, capitals / max(letters, 1), pairs / max(letters, 1), marks / len(raw), int(kinds[33]) / n, int((c & 32 > 0).sum()) / n,
        len(hits) / n, float(np.log1p(strong)), float(np.log1p(n)),
    ]


def feature_table(docs: DataFrame, lexicons: list[dict[str, int]], which: str | None = None) -> DataFrame:
    """(doc_id, one double for each of FEATURES) for each row of ``docs``, by the
    lexicon whose number is in the column ``which``, or by the only one."""
    at, name = F.lit(0) if which is None else F.col(which), uuid.uuid4().hex

    def rows(batches):
        codes = kept(f"toxicity {name}", name, lambda: [_Codes(x, 400_000 // len(lexicons)) for x in lexicons])
        for b in slices(batches, 500):
            x = np.array([features(t, codes[k]) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), at.cast("int").alias("which")).mapInArrow(rows, schema)


def bucket(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


#: Parts of the labelled rows: folds 0 and 1 for the lexicons and the trees, this one for calibration.
CALIBRATION = 2


def part_of(doc_id: str = "doc_id") -> Column:
    """3/8 of the ids each for the two folds, a quarter for calibration."""
    k = F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(8))
    return F.when(k < 3, 0).when(k < 6, 1).otherwise(CALIBRATION).cast("int")


def scores(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = 200_000, trees: int = 30, depth: int = 4, least_labels: int = 10) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; ``held_out``, over doc_id, marks rows whose labels stay unread."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(n, 1)))
    known = stored(known.where(draw).withColumn("fold", part_of()))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_toxic, n_clean = share.get(1, 0), share.get(0, 0)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if min(n_toxic, n_clean) < least_labels:
        return own.select("doc_id", F.lit(n_toxic / max(n_toxic + n_clean, 1)).alias("score"))
    labelled = own.join(F.broadcast(known), "doc_id")  # at most about fit_rows ids
    lexicons = learn_lexicons(labelled.where(F.col("fold") != CALIBRATION).select("text", "fold", "toxic"))
    table = stored(feature_table(docs, lexicons[2:]))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x")
    # each fold by the other's lexicon, calibration rows by that of both
    unseen = feature_table(labelled.withColumn("which", F.when(F.col("fold") == CALIBRATION, 2).otherwise(1 - F.col("fold"))), lexicons, "which")
    ready = stored(vectors.transform(unseen.join(F.broadcast(known), "doc_id").coalesce(8)).select("doc_id", "x", "fold", F.col("toxic").cast("double").alias("toxic")))
    fitted, rest = ready.where(F.col("fold") != CALIBRATION), ready.where(F.col("fold") == CALIBRATION)
    trees_model = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=7, minInstancesPerNode=5).fit(fitted)
    raw = lambda df: trees_model.transform(df).withColumn("p", vector_to_array("probability")[1])
    if rest.isEmpty():  # a few labels, none of them drawn for calibration
        return raw(vectors.transform(table)).select("doc_id", F.col("p").alias("score"))
    calibrate = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="c").fit(raw(rest).select("p", "toxic"))
    out = calibrate.transform(raw(vectors.transform(table)).select("doc_id", "p"))
    # a thousandth of the trees' own score keeps the order within the flat parts
    return out.select("doc_id", (0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")) + 0.001 * F.col("p")).alias("score"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = bucket(5) == 0
    out = scores(docs, labels, held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
