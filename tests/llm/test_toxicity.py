"""Toxicity's lexicons and features against plain Python."""

import math
import random
import re

from ridgeline.llm import toxicity

r = random.Random(6)
WORDS = ["you", "YOUR", "tu", "idiot", "Idiots", "idi0t", "i.d.i.o.t", "scum", "scuuuum", "sc*m", "nice", "day", "a", "don't", "x1", "(hey)", "!!!", "Ärger", "1d10t!", "--", "stupid,", "stup!d", "Vous", "fine."]
LEXICON = {"idiot": 3, "scum": 2, "stup*": 2, "idio*": 1, "nice": 1, "ärge*": 3}


def tier_of(word: str) -> tuple[int, bool]:
    """The tier of a plain word and whether its stem has a higher one than itself."""
    own = LEXICON.get(word, 0)
    stem = max([LEXICON.get(word[:k] + "*", 0) for k in (4, 5, 6, 7) if len(word) > k] or [0])
    return max(own, stem), stem > own


def described(word: str) -> dict:
    w = re.sub(r"^\W+|\W+$", "", word.lower())
    masked = bool(re.search(r"\w[^\w\s'’-]+\w|[^\W\d_]\d|\d[^\W\d_]", word))
    tier, by_stem = tier_of(w)
    hidden = False
    if not tier and (masked or len(w) > 3):
        behind = toxicity.unmasked(word.lower() if masked else w)
        if masked or behind != w:
            tier, hidden = tier_of(behind)[0], tier_of(behind)[0] > 0
            by_stem = by_stem and not masked
    return {"tier": tier, "stem": by_stem, "hidden": hidden, "you": w in toxicity.SECOND_PERSON, "masked": masked}


def plain_features(text: str) -> list[float]:
    found = [described(w) for w in text.split()]
    n, raw = len(found), text.encode()
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    share = lambda test: sum(map(test, found)) / n
    near = sum(any(f["tier"] and g["you"] for g in found[max(0, i - 5) : i + 6]) for i, f in enumerate(found)) / n
    capital = [65 <= b <= 90 for b in raw]
    letters = max(1, sum(c or 97 <= b <= 122 or b >= 192 for c, b in zip(capital, raw)))
    strong = sum(f["tier"] == 3 for f in found)
    marks = sum(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in raw)
    return [
        strong / n, share(lambda f: f["tier"] == 2), share(lambda f: f["tier"] == 1), share(lambda f: f["stem"]), share(lambda f: f["hidden"]), share(lambda f: f["you"]), near,
        sum(capital) / letters, sum(a and b for a, b in zip(capital, capital[1:])) / letters, marks / len(raw), raw.count(b"!") / n, share(lambda f: f["masked"]),
        share(lambda f: f["tier"] > 0), math.log1p(strong), math.log1p(n),
    ]


def test_features_equal_plain_python(spark):
    texts = ["", " ", "you idiot", "idiot " + "x " * 5 + "you", "idiot " + "x " * 4 + "you"] + [r.choice([" ", "\n"]).join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    got = {x.doc_id: [x[f] for f in toxicity.FEATURES] for x in toxicity.feature_table(df, [LEXICON]).collect()}
    for k, text in enumerate(texts):
        for name, a, b in zip(toxicity.FEATURES, got[k], plain_features(text)):
            assert math.isclose(a, b, abs_tol=1e-12), (name, a, b, text)
    assert got[None] == [0.0] * len(toxicity.FEATURES)


def test_lexicons_equal_plain_python(spark):
    rows = []
    for k in range(400):
        toxic = int(k % 4 == 0)
        words = r.choices(["calm", "sky", "road", "blue"], k=6) + (r.choices(["scum", "idiots", "wretch", "fool"], k=3) if toxic or k % 37 == 0 else [])
        rows.append((" ".join(words), k // 4 % 2, toxic))
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, fold int, toxic int"), least_docs=4, size=7)
    for folds, lexicon in zip(([0], [1], [0, 1]), got):
        own = [(toxicity.units(t), toxic) for t, f, toxic in rows if f in folds]
        n = [sum(x == kind for _, x in own) for kind in (0, 1)]
        odds = {}
        for u in {u for us, _ in own for u in us}:
            t, c = (sum(u in us and x == kind for us, x in own) for kind in (1, 0))
            if t >= 4:
                odds[u] = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        best = sorted((-o, u) for u, o in odds.items() if o > 1)[:7]
        assert lexicon == {u: 3 if -o > 4 else 2 if -o > 2.5 else 1 for o, u in best} and len(lexicon) == 7


def test_words_of_letters_are_coded_without_unmasking(monkeypatch):
    asked, unmasked = [], toxicity.unmasked
    monkeypatch.setattr(toxicity, "unmasked", lambda w: asked.append(w) or unmasked(w))
    codes = toxicity._Codes({"idiot": 3, "stup*": 2, "été": 1})
    assert [codes[w] for w in ("harmless", "(Words),", "Idiot!", "stupide", "ÉTÉ", "you")] == [0, 0, 3, 2 | 4, 1, 16] and not asked
    assert [codes[w] for w in ("stuuupid", "id1ot", "1d1ot.", "i.diot", "iddiot", "idiooot")] == [2 | 8, 3 | 8 | 32, 3 | 8 | 32, 3 | 8 | 32, 0, 3 | 8]
    assert asked == ["stuuupid", "id1ot", "1d1ot.", "i.diot", "idiooot"]
