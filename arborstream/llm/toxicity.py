"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and other texts under a Dirichlet prior.  A
word's forms are itself and its beginnings of 3 to 8 letters: a form's prior is
what its next shorter form says, so an inflected word that no labelled text
holds still counts as its stem does.  In each text every maximal segment of the
running score is found in one pass (each positive word is pushed and merged at
most once), and a segment counts by how far it lies beyond what chance gives a
text of that length under the extreme-value law of segment scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, U64, arrow_rows, fold, hold, mix64
from .letters import LetterWords, find, letter_chunks

#: Labelled rows of each class that the model is fitted on (chosen by a hash of the id).
SAMPLE_PER_CLASS = 8000
#: Letters of the beginnings of a word that count as its forms; a word itself is the level WHOLE.
SHORTEST, LONGEST, WHOLE = 3, 8, 9
#: Weight of the Dirichlet prior, in texts: a form behaves in so many more texts as its shorter form does.
PRIOR = 2.0
#: A form is told from its shorter form if its odds are further apart than this (natural logarithm) ...
LEAST_ODDS = 3.0
#: ... and a word is scored at all if its odds lie so far from even.  All others score DRIFT, so that running scores fall outside passages.
DRIFT = -0.02
#: Forms that a partition counts before it adds up what it has.
HELD_FORMS = 400_000
HELD_OUT = (5, 0)


def segments(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments over positive items: (first item, last item, score).

    before, after: the running score before and after each positive item, in
    order.  A stack holds candidates; a new one joins back to the nearest
    candidate that starts lower, if it does not end higher.
    """
    stack: list[list[float]] = []  # first item, last item, running score before it and after it
    for i, (lo, hi) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
        new = [i, i, lo, hi]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], i, stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in stack]


def beginnings(words: LetterWords, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, which of the words `at` have k letters or more, hash of their first k letters) for k from SHORTEST to LONGEST."""
    size = (words.ends - words.starts)[at]
    sums, power = np.zeros(len(at), U64), 1
    own = np.arange(len(at))
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            own = own[size[own] >= k]
            sums[own] += words.values[words.starts[at[own]] + k - 1] * U64(power)
            power = power * _BASE & (1 << 64) - 1
            if k >= SHORTEST:
                yield k, own, mix64(sums[own] ^ U64(0xA3B195354A39B70D * k & (1 << 64) - 1))


@dataclass
class Model:
    """vocab: ascending hashes of the forms that are told from their shorter forms; weight: their log-odds.

    roots: ascending hashes of the first letters of those forms.  rate and
    log_k: the extreme-value law; base and slope: from surprise to probability;
    least_odds: how far from even the odds of a word that is scored lie.
    """

    vocab: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    roots: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    rate: float = 1.0
    log_k: float = 0.0
    base: float = -2.0
    slope: float = 0.0
    least_odds: float = LEAST_ODDS

    def scores(self, words: LetterWords) -> np.ndarray:
        """Each word's score: the log-odds of its longest form in the model, or DRIFT."""
        out = np.zeros(len(words.starts))
        if len(self.vocab):
            size = words.ends - words.starts
            some = np.flatnonzero(size < SHORTEST)
            for k, own, h in beginnings(words, np.flatnonzero(size >= SHORTEST)):
                if k == SHORTEST:  # the other forms of a word are looked up only where some form begins alike
                    some = np.append(some, np.flatnonzero(size >= SHORTEST)[own[find(self.roots, h)[1]]])
                break
            for _, own, h in beginnings(words, some):
                at, seen = find(self.vocab, h)
                out[some[own[seen]]] = self.weight[at[seen]]
            at, seen = find(self.vocab, words.hash[some])
            out[some[seen]] = self.weight[at[seen]]
        return np.where(np.abs(out) >= self.least_odds, out, DRIFT)

    def passages(self, words: LetterWords) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """(row, number of words, maximal segments as word ranges of the row) for each row with words."""
        score = self.scores(words)
        first = np.searchsorted(words.row, np.arange(words.rows + 1))
        good = np.flatnonzero(score > 0)
        mine = np.searchsorted(good, first)
        for i in range(words.rows):
            a, b = first[i], first[i + 1]
            own = good[mine[i] : mine[i + 1]]
            if not len(own):
                if b > a:
                    yield i, int(b - a), []
                continue
            total = np.cumsum(score[a:b])
            after = total[own - a]
            yield i, int(b - a), [(int(own[x] - a), int(own[y] - a), s) for x, y, s in segments(after - score[own], after)]

    def surprise(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """How far the significant segments of a text of n words lie beyond the law: sum of rate * S - ln(K n)."""
        chance = max(0.0, self.log_k + math.log(max(n, 1)))
        return sum(max(0.0, self.rate * s - chance) for _, _, s in found)

    def probability(self, surprise: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(500.0, max(-500.0, self.base + self.slope * math.log1p(surprise)))))


_FORMS = ["h", "shorter", "root", "level", "toxic", "texts"]
_FORM_TYPES = "h long, shorter long, root long, level int, toxic long, texts long"


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to a row for each form: its hash, that of its shorter form (0: none), of its first letters, its level, and in how many toxic texts and texts it stands."""
    held: list[np.ndarray] = []

    def add_up() -> None:
        rows = np.concatenate(held, axis=1)
        order = np.argsort(rows[0], kind="stable")
        rows = rows[:, order]
        new = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        held[:] = [np.concatenate([rows[:4, new], np.add.reduceat(rows[4:], new, axis=1)])]

    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, words in letter_chunks(batch.column(0)):
            if not len(words.hash):
                continue
            order = np.lexsort((words.hash, words.row))
            new = np.append(True, (np.diff(words.row[order]) != 0) | (words.hash[order][1:] != words.hash[order][:-1]))
            at = order[new]  # each row's distinct words
            row = words.row[at]
            shorter, root = np.zeros(len(at), U64), words.hash[at].copy()
            some = []
            for k, own, h in beginnings(words, at):
                if k == SHORTEST:
                    root[own] = h
                some.append((row[own], h, shorter[own], root[own], np.full(len(own), k)))
                shorter[own] = h
            some.append((row, words.hash[at], shorter, root, np.full(len(at), WHOLE)))
            row, h, shorter, root, level = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.lexsort((h, row))
            once = order[np.append(True, (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1]))]
            own = labels[lo:hi][row[once]]
            held.append(np.stack([h[once].view(np.int64), shorter[once].view(np.int64), root[once].view(np.int64), level[once], own, np.ones(len(once), np.int64)]))
            if sum(x.shape[1] for x in held) > HELD_FORMS:
                add_up()
    if held:
        add_up()
        for a in range(0, held[0].shape[1], 1 << 16):
            rows = held[0][:, a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if name == "level" else x) for name, x in zip(_FORMS, rows, strict=True)], names=_FORMS)


def _logit(q):
    return np.log(q) - np.log1p(-q)


def evidence(a, n, q):
    """Twice the log-likelihood ratio of a toxic texts among n against the share q."""
    b = n - a
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / (n * q)), 0.0) + np.where(b > 0, b * np.log(b / (n * (1 - q))), 0.0))


def tell_apart(table: pa.Table, q0: float, least: float, least_odds: float = LEAST_ODDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forms (columns of _presence) to (vocab, weight, roots): from short to long, those whose share of toxic texts their shorter form does not explain."""
    h, shorter, root = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "shorter", "root"))
    order = np.argsort(h)
    h, shorter, root = h[order], shorter[order], root[order]
    level, a, n = (table.column(c).to_numpy()[order] for c in ("level", "toxic", "texts"))
    up, known = find(h, shorter)
    q, kept = np.full(len(h), q0), np.zeros(len(h), bool)
    for k in range(SHORTEST, WHOLE + 1):
        own = np.flatnonzero(level == k)
        before = np.where(known[own], q[up[own]], q0)
        after = (a[own] + PRIOR * before) / (n[own] + PRIOR)
        kept[own] = (evidence(a[own], n[own], before) >= least) & (np.abs(_logit(after) - _logit(before)) >= least_odds)
        q[own] = np.where(kept[own], after, before)
    return h[kept], (_logit(q) - _logit(q0))[kept], np.unique(root[kept])


def _rate(score: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p e^(rate s) = 1 over scores of words of other texts (some positive, the mean negative)."""
    f = lambda x: float((p * np.exp(np.minimum(700.0, x * score))).sum()) - 1.0
    lo, hi = 0.0, 1e-3
    while f(hi) < 0:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return hi


def law(weight: np.ndarray, words: int, segments_seen: int, hits: np.ndarray, least_odds: float = LEAST_ODDS) -> tuple[float, float]:
    """(rate, ln K) of the extreme-value law from the other texts: their number of words, of positive segments, and the scores of their words in the model.

    Every positive form counts half a word more than was seen, so that forms
    of toxic texts alone have a finite rate.  If even so the mean score is not
    negative, all scores are lowered in the law until it is.  K is what the
    number of segments seen says of a segment of the least positive score.
    """
    good = weight[weight >= least_odds]
    if not len(good):
        return 1.0, 0.0
    score = np.concatenate([good, hits, [DRIFT]])
    count = np.concatenate([np.full(len(good), 0.5), np.ones(len(hits)), [max(1.0, words - len(hits))]])
    p = count / count.sum()
    mean = float((p * score).sum())
    if mean >= DRIFT / 2:
        score = score - (mean - DRIFT / 2)
    rate = _rate(score, p)
    return rate, math.log((segments_seen + 0.5) / max(1, words)) + rate * float(good.min())


def _newton(rows: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of least weighted logistic loss with a slight ridge.

    Steps are halved until the loss falls: where the classes hardly overlap,
    whole Newton steps leap past the minimum and circle around it.
    """
    loss = lambda b: float((w * (np.logaddexp(0, rows @ b) - y * (rows @ b))).sum() + 5e-4 * (b @ b))
    b = np.zeros(rows.shape[1])
    for _ in range(500):
        p = (1 + np.tanh(rows @ b / 2)) / 2
        grad = rows.T @ (w * (y - p)) - 1e-3 * b
        hess = (rows * (w * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        if np.abs(step).max() < 1e-8:
            break
        now, gain, part = loss(b), float(grad @ step), 1.0
        while part > 1e-12 and loss(b + part * step) > now - 1e-4 * part * gain + 1e-13 * now:
            part /= 2
        b = b + part * step
    return b


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, the slope 0 at least; where it would be negative, the intercept alone is fitted."""
    rows = np.stack([np.ones(len(x)), x], axis=1)
    b = _newton(rows, y, w)
    if b[1] < 0:
        b = np.append(_newton(rows[:, :1], y, w), 0.0)
    return float(b[0]), float(b[1])


def marked(labels: DataFrame, without: int | None = None) -> DataFrame:
    """(id, toxic) of the labelled ids outside the held-out fold, and outside the training fold `without`."""
    own = labels.select(F.col("doc_id").alias("id"), "toxic").where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
    own = own if without is None else own.where(fold("id", HELD_OUT[0]) != without)
    return own.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, without: int | None = None) -> DataFrame:
    """(text, toxic, weight) of the training sample: at most about `per_class` rows of each label, by a hash of the id.

    Rows of the held-out fold, and null ids and labels, are left out; an id
    with several labels is toxic if one says so.  weight restores the shares
    of the classes.
    """
    own = marked(labels, without)
    share = own.groupBy(F.col("toxic").alias("t")).agg(F.least(F.lit(1.0), F.lit(float(per_class)) / F.count("*")).alias("share"))
    chosen = own.join(F.broadcast(share), F.col("toxic") == F.col("t")).where(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # two classes of per_class rows each: the broadcast is bounded
    chosen = F.broadcast(chosen.select("id", "toxic", (1.0 / F.col("share")).alias("weight")))
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("text", "toxic", "weight")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, least_odds: float = LEAST_ODDS, without: int | None = None) -> Model:
    """The model of the labelled rows (but for those of the training fold `without`); with no toxic or no other text, one that gives every text the same low probability."""
    spark = docs.sparkSession
    arrow_rows(spark)
    train = hold(labelled(docs, labels, per_class, without))
    counts = train.select("text", "toxic").mapInArrow(_presence, _FORM_TYPES)
    counts = hold(counts.groupBy("h").agg(*[F.first(c).alias(c) for c in ("shorter", "root", "level")], *[F.sum(c).alias(c) for c in ("toxic", "texts")]))
    # a form of a single text is never told from its shorter form
    whole = F.col("level") == WHOLE
    sums = counts.agg(F.sum(F.when(whole, F.col("toxic"))).alias("a"), F.sum(F.when(whole, F.col("texts"))).alias("n"), F.count_if(F.col("texts") > 1).alias("forms")).first()
    if not sums.n or not 0 < sums.a < sums.n:
        return Model()
    q0 = sums.a / sums.n
    least = 2 * math.log(max(2, sums.forms))  # by chance about one of all forms has more evidence
    counts = counts.where("texts > 1")
    a, n = F.col("toxic"), F.col("texts")
    both = 2 * (F.when(a > 0, a * F.log(a / (n * q0))).otherwise(0.0) + F.when(a < n, (n - a) * F.log((n - a) / (n * (1 - q0)))).otherwise(0.0))
    # what has no longer form with evidence against q0 tells nothing apart
    families = counts.where(both >= least).select(F.col("root").alias("family")).distinct()
    table = counts.join(families, F.col("root") == F.col("family"), "left_semi").select(*_FORMS).toArrow()  # bounded by the sample
    model = Model(*tell_apart(table, q0, least, least_odds), least_odds=least_odds)
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n, every, hits = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for lo, _, words in letter_chunks(batch.column(0)):
                for i, k, found in m.passages(words):
                    n[lo + i], every[lo + i] = k, [s for *_, s in found]
                score = m.scores(words)
                for j in np.flatnonzero(score != DRIFT).tolist():
                    hits[lo + int(words.row[j])].append(float(score[j]))
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (every, hits)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int64()), *lists], names=["toxic", "weight", "n", "every", "hits"])

    got = train.mapInArrow(measure, "toxic int, weight double, n long, every array<double>, hits array<double>").toArrow()  # the bounded sample
    toxic, size = got.column("toxic").to_numpy(), got.column("n").to_numpy()
    every, hits = got.column("every").to_pylist(), got.column("hits").to_pylist()
    other = np.flatnonzero(toxic == 0)
    model.rate, model.log_k = law(model.weight, int(size[other].sum()), sum(len(every[i]) for i in other), np.array([s for i in other for s in hits[i]]), least_odds)
    x = np.log1p([model.surprise(int(n), [(0, 0, s) for s in e]) for n, e in zip(size, every, strict=True)])
    model.base, model.slope = _logistic(x, toxic.astype(float), got.column("weight").to_numpy())
    train.unpersist()
    counts.unpersist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The columns of `keep` (default: all), toxicity (0 to 1) and, with `spans`, the significant passages.

    passages: array of (first word, last word, score), words counted in the
    text from 0 as runs of letters.  Null, empty and letterless texts have no
    segment and get the base probability.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = keep if keep is not None else docs.columns
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    sent = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    held = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out, where = [m.probability(0.0)] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for lo, _, words in letter_chunks(batch.column(batch.num_columns - 1)):
                for i, n, found in m.passages(words):
                    if found:
                        out[lo + i] = m.probability(m.surprise(n, found))
                        where[lo + i] = [f for f in found if m.surprise(n, [f]) > 0]
            extra = [pa.array([[{"first": a, "last": b, "score": s} for a, b, s in w] for w in where], span)] if spans else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64()), *extra], names=[*batch.schema.names[:-1], "toxicity", *["passages"] * spans])

    schema = [*[f"k{i} {kinds[c].simpleString()}" for i, c in enumerate(keep)], "toxicity double", *["passages array<struct<first:int,last:int,score:double>>"] * spans]
    done = sent.mapInArrow(run, ", ".join(schema))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "toxicity", *["passages"] * spans)


def validated(docs: DataFrame, labels: DataFrame, choices: list[float], per_class: int = SAMPLE_PER_CLASS) -> list[tuple[float, float, float, float]]:
    """(least odds, loss, share of toxic rows found, share of clean rows lost) of each choice, over the training folds.

    Each training fold is scored by a model of the others, at 0.5; the loss is
    the logistic one, both classes weighing alike.  The held-out fold has no
    part in it: its labels choose nothing.
    """
    own = marked(labels)
    out = []
    for odds in choices:
        got = []
        for r in [f for f in range(HELD_OUT[0]) if f != HELD_OUT[1]]:
            model = fit(docs, labels, per_class, odds, r)
            rows = docs.select("doc_id", "text").join(own.where(fold("id", HELD_OUT[0]) == r), F.col("doc_id") == F.col("id"))
            p = F.least(F.greatest(F.when(F.col("toxic") == 1, F.col("toxicity")).otherwise(1 - F.col("toxicity")), F.lit(1e-15)), F.lit(1.0))
            each = score(rows, model, keep=["toxic"]).groupBy("toxic").agg(F.avg(-F.log(p)).alias("loss"), F.avg((F.col("toxicity") >= 0.5).cast("double")).alias("found"))
            got.append({row.toxic: (row.loss, row.found) for row in each.collect()})  # two rows
        both = [g for g in got if len(g) == 2]
        mean = lambda t, i: float(np.mean([g[t][i] for g in both])) if both else math.nan
        out.append((odds, (mean(0, 0) + mean(1, 0)) / 2, mean(1, 1), mean(0, 1)))
    return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold(id_col, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Only labelled rows outside the held-out fold are learnt from; a null id is
    never held out and has no label.  Null, empty and letterless texts get the
    probability of a text without passages.  Very long texts are read whole,
    a chunk of rows or one row at a time.  Repeated rows and rows with one id
    are scored each for itself and equal texts alike; a score of exactly 0.5
    is predicted toxic.  An empty table gives no rows; no labels, or labels of
    one kind only, give every text the same score below 0.5.  Other columns,
    whatever their names, are ignored.
    """
    model = fit(docs, labels, per_class)
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `most`; columns as they were."""
    model = fit(docs, labels)
    names = [f"p{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), model, text_col=names[docs.columns.index("text")])
    return scored.where(F.col("toxicity") < most).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
