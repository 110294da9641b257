import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborstream.llm import langid, toxicity
from arborstream.llm.common import fold, load
from arborstream.llm.letters import LetterWords

from .conftest import SCHEMA


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark, edge, empty):
    assert langid.predict_documents(empty).count() == 0
    got = {r.doc_id: r for r in langid.predict_documents(edge).collect() if r.doc_id is not None}
    for i in (4, 5, 6, 60):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1].lang_pred == "en" and langid.predict_documents(edge).count() == edge.count()
    none = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_documents(none).collect()} == {"und"}
    assert langid.keep_identified(edge).columns == edge.columns


def brute_language(train, text):
    """(language, score) by the definition, with dictionaries: known words first, then at each letter the longest known n-gram."""
    words, grams = Counter(), Counter()
    slot = lambda w, end, n: (n, int(langid.gram_slots(LetterWords([w]), np.array([end]), n)[0]))
    for t, lang in train:
        for w in t.lower().split():
            words[w, lang] += 1
            for n in range(1, langid.ORDERS + 1):
                grams.update((slot(w, end, n), lang) for end in range(n - 1, len(w)))
    langs = sorted({lang for _, lang in train})
    every = Counter()
    for (w, _), n in words.items():
        every[w] += n
    vocab = {w for w, n in every.items() if n >= langid.LEAST}
    seen = {g for g, _ in grams}
    score = dict.fromkeys(langs, 0.0)
    for lang in langs:
        all_words = sum(n for (w, x), n in words.items() if x == lang and w in vocab) + 0.5 * len(vocab)
        all_grams = {k: sum(n for ((m, _), x), n in grams.items() if x == lang and m == k) + 0.5 * langid.SLOTS for k in range(1, langid.ORDERS + 1)}
        for w in text.lower().split():
            if w in vocab:
                score[lang] += math.log((words[w, lang] + 0.5) / all_words)
                continue
            for end in range(len(w)):
                for n in range(min(langid.ORDERS, end + 1), 0, -1):
                    if slot(w, end, n) in seen:
                        score[lang] += langid.GRAM_WEIGHT * math.log((grams[slot(w, end, n), lang] + 0.5) / all_grams[n])
                        break
    best = max(langs, key=lambda x: score[x])
    return best, 1 / sum(math.exp(langid.SOFTEN * (score[x] - score[best])) for x in langs)


def test_language_matches_brute_force(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "efghij"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))), x) for i in range(120) for x in [rng.choice(list(letters))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r for r in langid.predict_documents(docs).collect()}
    for i, text, _ in rows:
        lang, score = brute_language(train, text)
        assert math.isclose(got[i].score, score, rel_tol=1e-4)
        assert got[i].lang_pred == lang or math.isclose(score, 0.5, abs_tol=1e-3)


def test_language_of_long_repeated_and_extra(spark, edge):
    rows = [(1, "the word of the day " * 60_000, "en"), (2, "das wort des tages", "de"), (2, "das wort des tages", "de"), (3, "das wort", None), (3, None, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows] * 3, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.predict_documents(docs).collect()
    assert len(got) == 15 and {(r.doc_id, r.lang_pred) for r in got} == {(1, "en"), (2, "de"), (3, "de"), (3, "und")}


def test_held_out_folds(spark, edge):
    rows = edge.select("doc_id", langid.held_out().alias("a"), toxicity.held_out().alias("b"), fold("doc_id", 4).alias("four"), fold("doc_id", 5).alias("five")).collect()
    for r in rows:
        assert r.a == (r.four == 2) and r.b == (r.five == 0)


def naive_segments(scores):
    """All maximal scoring segments by their definition: repeatedly the best, then left and right of it."""
    def best(a, b):
        top, at = 0.0, None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > top + 1e-12:
                    top, at = s, (i, j)
        return at, top

    def split(a, b):
        at, s = best(a, b)
        if at is None:
            return []
        return split(a, at[0]) + [(*at, s)] + split(at[1] + 1, b)

    return split(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=14))
def test_segments_match_their_definition(values):
    # small distinct fractions break ties, so that the maximal segments are unique
    scores = np.array([v + 2.0 ** -(i + 8) for i, v in enumerate(values)])
    good = np.flatnonzero(scores > 0)
    after = np.cumsum(scores)[good]
    got = [(int(good[a]), int(good[b]), s) for a, b, s in toxicity.segments(after - scores[good], after)]
    want = naive_segments(scores.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], y[2]) for x, y in zip(got, want))


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95 and (got[got.toxic == 1].predicted == 1).mean() > 0.75
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (11, 0), (12, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        assert toxicity.score_documents(empty, labels).count() == 0
        got = toxicity.score_documents(edge, labels).collect()
        assert len(got) == edge.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.keep_civil(edge, odd).columns == edge.columns
    assert SCHEMA


STEMS = {"en": ["scumbag", "vermin"], "de": ["widerlich", "ekelhaft"], "fr": ["salop", "ordur"], "es": ["imbecil", "basur"]}
ENDS = ["", "a", "en", "er", "ost", "ung", "ible", "amos", "ette", "ish"]


def multilingual(n, seed=5):
    """Texts in four invented languages, a tenth of them with a toxic passage of inflected stems, one language rare."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choices(list(STEMS), [60, 20, 14, 6])[0]
        words = [lang + "".join(rng.choice("abcdeirst") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120))]
        toxic = rng.random() < 0.12
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(STEMS[lang]) + rng.choice(ENDS) for _ in range(rng.randrange(2, 6))]
        out.append((i, " ".join(words), lang, int(toxic)))
    return out


@pytest.mark.parametrize("n", [3000, 9000])
def test_toxicity_of_rare_languages_and_unseen_inflections(spark, n):
    rows = multilingual(n)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels, per_class=2000).collect()}
    for lang in STEMS:
        hit = [got[i].predicted for i, _, x, toxic in rows if x == lang and toxic and got[i].held_out]
        clean = [got[i].predicted for i, _, x, toxic in rows if x == lang and not toxic and got[i].held_out]
        assert np.mean(hit) >= 0.9 and np.mean(clean) <= 0.02, (lang, np.mean(hit), np.mean(clean))


def brute_forms(word):
    """A word's forms from short to long; the word itself is marked."""
    return [word[:k] + "-" for k in range(toxicity.SHORTEST, toxicity.LONGEST + 1) if len(word) >= k] + [word]


def brute_fit(rows):
    """The model of (text, toxic) rows by its definition, with dictionaries of strings: log-odds by form, law, and a text's surprise."""
    texts, bad = Counter(), Counter()
    for text, toxic in rows:
        forms = {f for w in text.split() for f in brute_forms(w)}
        texts.update(forms)
        bad.update(forms if toxic else ())
    whole = [f for f in texts if not f.endswith("-")]
    q0 = sum(bad[f] for f in whole) / sum(texts[f] for f in whole)
    least = 2 * math.log(sum(n > 1 for n in texts.values()))
    logit = lambda q: math.log(q / (1 - q))
    share, told = {}, {}
    for text, _ in rows:
        for w in text.split():
            before = q0
            for f in brute_forms(w):
                n, a = texts[f], bad[f]
                g = 2 * sum(x * math.log(x / (n * q)) for x, q in ((a, before), (n - a, 1 - before)) if x)
                after = (a + toxicity.PRIOR * before) / (n + toxicity.PRIOR)
                if n > 1 and g >= least and abs(logit(after) - logit(before)) >= toxicity.LEAST_ODDS:
                    told[f] = logit(after) - logit(q0)
                    before = after
                share[f] = before

    def score(word):
        own = [told[f] for f in brute_forms(word) if f in told]
        return own[-1] if own and abs(own[-1]) >= toxicity.LEAST_ODDS else toxicity.DRIFT

    return told, score


def test_fit_and_score_match_brute_force(spark):
    rows = [r for r in multilingual(2500, seed=9)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    train = [(r[1], r[3]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    told, score = brute_fit(train)
    model = toxicity.fit(docs, labels)
    assert len(model.vocab) == len(told) > 5
    words = sorted({w for t, _ in train for w in t.split()} | {s + e for own in STEMS.values() for s in own for e in ENDS} | {"ab", "salo"})
    assert np.allclose(model.scores(LetterWords([" ".join(words)])), [score(w) for w in words])

    def found(text):
        return [s for *_, s in naive_segments([score(w) for w in text.split()])]

    other = [t for t, toxic in train if not toxic]
    size = sum(len(t.split()) for t in other)
    good = [w for w in told.values() if w >= toxicity.LEAST_ODDS]
    hits = [score(w) for t in other for w in t.split() if score(w) != toxicity.DRIFT]
    counted = [(0.5, s) for s in good] + [(1.0, s) for s in hits] + [(size - len(hits), toxicity.DRIFT)]
    total = sum(c for c, _ in counted)
    assert math.isclose(sum(c / total * math.exp(model.rate * s) for c, s in counted), 1, abs_tol=1e-6)
    assert math.isclose(model.log_k, math.log((sum(len(found(t)) for t in other) + 0.5) / size) + model.rate * min(good))

    def surprise(text):
        n = len(text.split())
        return math.log1p(sum(max(0.0, model.rate * s - max(0.0, model.log_k + math.log(n))) for s in found(text)))

    x = np.array([surprise(t) for t, _ in train])
    y = np.array([toxic for _, toxic in train])
    p = 1 / (1 + np.exp(-(model.base + model.slope * x)))
    assert abs((y - p).sum() - 1e-3 * model.base) < 1e-4 and abs(((y - p) * x).sum() - 1e-3 * model.slope) < 1e-4
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for i, text, *_ in rows[:300]:
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model.base + model.slope * surprise(text)))), rel_tol=1e-6, abs_tol=1e-12)


def test_law_without_hits_and_with_too_many():
    rate, log_k = toxicity.law(np.array([5.0, 7.0]), 100_000, 0, np.empty(0))
    assert rate > 0 and math.isfinite(log_k)
    rate, _ = toxicity.law(np.array([1.5]), 100, 60, np.full(60, 1.5))  # most words score: still no fall-back
    assert rate > 0
    assert toxicity.law(np.array([-3.0]), 100, 0, np.empty(0)) == (1.0, 0.0)


def calibration(n, gap):
    """log1p surprise, label and weight of n clean texts, a fiftieth of them up to 2.2, and n toxic ones from 2.2 + gap on."""
    some = n // 50
    x = np.concatenate([np.zeros(n - some), np.linspace(0.9, 2.2, some), 2.2 + gap + 1.4 * -np.log1p(-np.linspace(0, 0.99, n))])
    y = np.repeat([0.0, 1.0], n)
    return x, y, np.where(y > 0, 1.0, 11.5)


@pytest.mark.parametrize("n", [500, 2000, 8000, 20000])
@pytest.mark.parametrize("gap", [-0.2, 0.0, 0.05, 0.1, 0.2, 0.3, 0.6])
def test_calibration_reaches_its_minimum(n, gap):
    x, y, w = calibration(n, gap)
    base, slope = toxicity._logistic(x, y, w)
    p = (1 + np.tanh((base + slope * x) / 2)) / 2
    assert abs((w * (y - p)).sum() - 1e-3 * base) < 1e-4 and abs((w * (y - p) * x).sum() - 1e-3 * slope) < 1e-4
    assert (p[y > 0] >= 0.5).mean() > 0.8 and (p[y == 0] < 0.5).mean() > 0.99


def test_calibration_outlasts_repeated_chance_words_and_backward_labels():
    x, y, w = calibration(8000, 0.3)
    x, y, w = np.append(x, [5.85] * 6), np.append(y, [0.0] * 6), np.append(w, [11.5] * 6)
    base, slope = toxicity._logistic(x, y, w)
    assert (base + slope * x[y > 0] >= 0).mean() > 0.99
    base, slope = toxicity._logistic(np.array([0.0, 0.0, 1.0, 2.0]), np.array([1.0, 1.0, 0.0, 0.0]), np.array([1.0, 1.0, 1.0, 5.0]))
    assert slope == 0 and math.isclose(1 / (1 + math.exp(-base)), 0.25, abs_tol=1e-3)


def test_toxicity_of_long_repeated_and_extra(spark, edge):
    rows = multilingual(2500)
    texts = [(r[0], r[1]) for r in rows] + [(9000, "calm " * 60_000 + "vermina verminen verminost"), (9001, "calm " * 60_000), (9002, None), (9002, None), (9003, "!!")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in texts], "doc_id long, text string, toxicity int, score string, passages double")
    labels = spark.createDataFrame([(r[0], r[3], 1) for r in rows] * 2, "doc_id long, toxic int, text int")
    got = {}
    for r in toxicity.score_documents(docs, labels).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score
    assert got[9000] > 0.5 > got[9001] and got[9002] == got[9003] < 0.5


def test_passages_are_found(spark):
    rows = [(i, ("calm words here again " * 8) + ("vile nasty slur " * 2 if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, spans=True).where("doc_id = 1").first()
    assert got.toxicity > 0.9 and [(p["first"], p["last"]) for p in got.passages] == [(32, 37)]
    assert toxicity.score(docs, model).where("doc_id = 2").first().toxicity < 0.1


def test_choices_are_validated_on_training_folds_alone(spark):
    docs, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, "the house and the garden " * 3 + ("vilifying slurword slurring " * 2 if bad else "flower meadow walking ")))
        marks.append((i, int(bad)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.validated(d, m, [2.0, 3.0])
    assert [g[0] for g in got] == [2.0, 3.0]
    assert all(found == 1 and lost == 0 and loss < 0.3 for _, loss, found, lost in got)
    # labels of the held-out fold have no part: turned around they change nothing
    turned = m.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.validated(d, turned, [2.0, 3.0]) == got
