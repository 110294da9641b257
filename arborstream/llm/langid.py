"""Language identification by words first, backing off to shorter character n-grams.

A known word adds its log frequency in each language.  At each character of an
unseen word the longest known n-gram that ends there (four characters down to
one, inside the word) adds its log frequency instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_rows, fold, hold, mix64
from .letters import LetterWords, find, letter_chunks

#: Rows of each language that the model is fitted on (chosen by a hash of the id).
SAMPLE_PER_LANG = 2000
#: Words that the model holds, the most frequent ones, each seen LEAST times.
MAX_WORDS = 100_000
LEAST = 3
ORDERS = 4
#: Hash slots of the n-grams of one order.
SLOTS = 1 << 16
#: Neighbouring n-grams share characters: one counts as so much of a word.
GRAM_WEIGHT = 0.25
#: Words are not independent: the posterior is softened by this factor.
SOFTEN = 0.25
#: Languages whose sampling shares stand in the plan itself; with more, they are joined.
MAX_INLINE = 512
UNDETERMINED = "und"


def gram_slots(words: LetterWords, at: np.ndarray, n: int) -> np.ndarray:
    """Slots of the n-grams that end at these characters."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), n, U64)
        for k in range(n - 1, -1, -1):
            h = h * U64(0x9E3779B97F4A7C15) + words.code[at - k].astype(U64) + U64(1)
        return (mix64(h) & U64(SLOTS - 1)).astype(np.int64)


def _inside(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the characters of these words, their place in the word (from 1), and the word's index."""
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[word] + place, place + 1, word


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (kind, h, lang, n): kind 0 a word's hash, kind n an n-gram's slot; summed in the partition."""
    total: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for lo, hi, words in letter_chunks(batch.column(0)):
            own = langs[lo:hi][words.row] if len(words.row) else np.empty(0, object)
            at, place, word = _inside(words.starts, words.ends)
            for lang in set(own):
                mine = own == lang
                total.setdefault((0, lang), []).append(np.unique(words.hash[mine].view(np.int64), return_counts=True))
                chars = mine[word]
                for n in range(1, ORDERS + 1):
                    ends = at[chars & (place >= n)]
                    total.setdefault((n, lang), []).append(np.unique(gram_slots(words, ends, n), return_counts=True))
    for (kind, lang), some in total.items():
        keys, inverse = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([c for _, c in some]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array([lang] * len(keys), pa.string()), pa.array(n)], names=["kind", "h", "lang", "n"])


class Model:
    """languages; vocab (ascending hashes) and word (log frequencies, a row a word); gram[n], known[n]: by slot."""

    def __init__(self, table: pa.Table):
        kind, h, n = (table.column(c).to_numpy() for c in ("kind", "h", "n"))
        lang = np.array(table.column("lang").to_pylist(), dtype=object)
        self.languages = sorted(set(lang))
        number = {x: i for i, x in enumerate(self.languages)}
        col = np.array([number[x] for x in lang], np.int64)
        width = len(self.languages)
        word = kind == 0
        self.vocab, place = np.unique(h[word].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(self.vocab), width))
        counts[place, col[word]] = n[word]
        self.word = self._log(counts)
        self.gram, self.known = {}, {}
        for k in range(1, ORDERS + 1):
            own = kind == k
            counts = np.zeros((SLOTS, width))
            counts[h[own], col[own]] = n[own]
            self.known[k] = counts.sum(axis=1) > 0
            self.gram[k] = self._log(counts)

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts)))).astype(np.float32) if counts.size else counts

    def scores(self, words: LetterWords) -> np.ndarray:
        """Log score of each row in each language."""
        out = np.zeros((words.rows, len(self.languages)))
        at, seen = find(self.vocab, words.hash)
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(words.row[seen], weights=self.word[at[seen], j], minlength=words.rows)
        rest = ~seen
        chars, place, word = _inside(words.starts[rest], words.ends[rest])
        row = words.row[rest][word]
        for k in range(ORDERS, 0, -1):
            long = place >= k
            slots = gram_slots(words, chars[long], k)
            hit = self.known[k][slots]
            where = np.flatnonzero(long)[hit]
            for j in range(out.shape[1]):
                out[:, j] += GRAM_WEIGHT * np.bincount(row[where], weights=self.gram[k][slots[hit], j], minlength=words.rows)
            left = np.ones(len(chars), bool)
            left[where] = False
            chars, place, row = chars[left], place[left], row[left]
        return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Fit on rows with a language: at most about `per_lang` of each, chosen by a hash of the id. None without rows."""
    arrow_rows(train.sparkSession)
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share"))
    some = share.limit(MAX_INLINE + 1).collect()
    if len(some) <= MAX_INLINE:  # a bounded table in the plan, so that no text is moved by its language
        inline = F.create_map(*[F.lit(x) for r in some for x in (r.lang, r.share)]) if some else F.create_map().cast("map<string,double>")
        chosen = rows.withColumn("share", F.element_at(inline, F.col("lang")))
    else:
        chosen = rows.join(share.withColumnRenamed("lang", "own"), F.col("lang") == F.col("own"))
    chosen = chosen.where(F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = chosen.select("text", "lang").mapInArrow(_counts, "kind int, h long, lang string, n long").groupBy("kind", "h", "lang").agg(F.sum("n").alias("n"))
    counts = hold(counts)
    best = counts.where("kind = 0").groupBy("h").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).orderBy(F.desc("all"), "h").limit(MAX_WORDS)
    words = counts.where("kind = 0").join(best.select(F.col("h").alias("bh")), F.col("h") == F.col("bh")).drop("bh")
    table = counts.where("kind > 0").unionByName(words).toArrow()  # bounded by MAX_WORDS, SLOTS and the languages
    counts.unpersist()
    return Model(table) if table.num_rows else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (default: all), then lang_pred and score (the language's softened posterior, 0 to 1).

    A text that is null or has no letter, and any text where no model could be
    fitted, is `und` with score 0.  Ties go to the first language in
    alphabetical order.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = keep if keep is not None else docs.columns
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    sent = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            pred, score = [], []
            for lo, hi, words in letter_chunks(batch.column(batch.num_columns - 1)):
                some = np.bincount(words.row, minlength=hi - lo) > 0
                if m is None:
                    pred += [UNDETERMINED] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                s = m.scores(words) * SOFTEN
                best = s.argmax(axis=1)
                p = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [m.languages[b] if x else UNDETERMINED for b, x in zip(best, some, strict=True)]
                score += np.where(some, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join([*[f"k{i} {kinds[c].simpleString()}" for i, c in enumerate(keep)], "lang_pred string", "score double"])
    done = sent.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


HELD_OUT = (4, 2)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold(id_col, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def predict_documents(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, fitted on the rows outside the held-out fold.

    A null id is never held out.  Null, empty and letterless texts are `und`
    with score 0, and so is every text where no row has a language to learn
    from.  Very long texts are read whole, a chunk of rows or one row at a
    time.  Equal texts, repeated rows and rows with one id are predicted alike;
    ties go to the first language in alphabetical order.  An empty table gives
    no rows.  Other columns, whatever their names, are ignored.
    """
    model = fit(docs.where(~held_out()), per_lang=per_lang)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model, keep=["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text has a language with a posterior of `least` or more; columns as they were."""
    model = fit(docs.where(~held_out()))
    names = [f"p{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    found = identify(renamed, model, text_col=names[docs.columns.index("text")])
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
