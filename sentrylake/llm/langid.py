"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of a bounded sample of labelled documents, a
matrix of fixed size per task, and adds the matrices up. Scoring broadcasts the matrix of
log-probabilities; a batch of whole texts is a sparse matrix that is multiplied with it in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fold_of, keep_rows, map_batches

#: Labelled documents a model is fitted on, at most (in expectation: a hash draws them).
TRAINING_DOCUMENTS = 20_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: N-grams of each order hashed at a time, whatever the lengths of the texts.
PIECE = 1 << 18
#: Languages that a model may tell apart, a column of the matrix each.
MOST_LANGUAGES = 1000
#: Stands after each text in a line of code points.
END = np.uint32(0xFFFFFFFF)
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass
class LanguageModel:
    languages: list[str]
    #: buckets x languages
    log_probability: np.ndarray
    log_prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _line(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one line of code points, and where each begins in it.

    Letters are lower-cased and every run of anything else becomes one space; each text has
    a space at either end and an END after it, which no n-gram may hold.
    """
    codes = np.frombuffer("\n\0\n".join(t.lower().replace("\0", "\n") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    line = np.where(_letters()[codes], codes, 32).astype(np.uint32)
    line[codes == 0] = END
    line = np.concatenate(([np.uint32(32)], line, np.array([32, END], np.uint32)))
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 32) | (line[:-1] != 32)
    line = line[keep]
    return line, np.concatenate(([0], np.flatnonzero(line == END)[:-1] + 1))


def _buckets(line: np.ndarray, first: int, last: int):
    """Hash bucket of every n-gram that begins in ``line[first:last]``, an array per order; BUCKETS
    where it would reach beyond its text."""
    for order in ORDERS:
        size = last - first
        here = line[first : last + order - 1]
        if len(here) < size + order - 1:  # the line's end
            here = np.append(here, np.full(size + order - 1 - len(here), END, np.uint32))
        mixed = np.zeros(size, np.uint32)
        beyond = np.zeros(size, bool)
        for k in range(order):
            code = here[k : size + k]
            beyond |= code == END
            mixed = (mixed ^ code) * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
        mixed = (mixed + np.uint32(order)) * _FACTORS[0]
        found = (mixed >> np.uint32(32 - int(math.log2(BUCKETS)))).astype(np.int64)
        found[beyond] = BUCKETS
        yield found


def shares(sizes: list[int], bound: int) -> list[float]:
    """Share of the documents of each language to draw: all of a small one, what is left of ``bound`` alike for the others."""
    out, left = [1.0] * len(sizes), bound
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for k, i in enumerate(order):
        own = min(sizes[i], left / (len(order) - k))
        out[i] = own / sizes[i]
        left -= own
    return out


def train(docs: DataFrame, bound: int = TRAINING_DOCUMENTS, smoothing: float = 0.5) -> LanguageModel | None:
    """Fit on ``docs`` (doc_id, text, lang): those with a text and a language.

    At most about ``bound`` documents are drawn, by a hash of the id, so the draw does not
    depend on their order; a language with few documents gives all of them. The prior is
    that of all rows. More than MOST_LANGUAGES languages are refused. None where there is nothing to learn from.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: lang does not hold languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    total = sum(sizes.values())
    if total > bound:
        drawn = F.create_map(*[F.lit(x) for name, part in zip(languages, shares([sizes[x] for x in languages], bound), strict=True) for x in (name, math.ceil(part * (1 << 20)))])
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < drawn[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}

    def each():
        def turn(batch: pa.RecordBatch):
            counts = np.zeros((len(languages), BUCKETS + 1), np.int64)
            rows = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            line, starts = _line(batch.column("text").to_pylist())
            owner = np.repeat(rows, np.diff(np.append(starts, len(line))))
            for at in range(0, len(line), PIECE):
                for found in _buckets(line, at, min(at + PIECE, len(line))):
                    counts += np.bincount(owner[at : at + PIECE] * (BUCKETS + 1) + found, minlength=counts.size).reshape(counts.shape)
            row, bucket = np.nonzero(counts[:, :BUCKETS])
            return {"row": row.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[row, bucket]}

        return turn

    # at most languages x buckets sums reach the driver
    sums = map_batches(docs, "row int, bucket int, n long", each).groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["row"], sums["bucket"]] = sums["n"]
    documents = np.array([sizes[x] for x in languages])
    smooth = counts + smoothing
    return LanguageModel(
        languages,
        np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)),
        np.log((documents + 1) / (documents.sum() + len(languages))),
    )


def posteriors(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each language for each text, and which texts have a letter.

    A batch is a sparse matrix of texts by buckets, a one for each n-gram; its product with the matrix
    of log-probabilities is taken a slice of n-grams at a time, so long texts need no more memory.
    """
    line, starts = _line([t or "" for t in texts])
    total = np.tile(model.log_prior.astype(float), (len(texts), 1))
    matrix = np.vstack([model.log_probability, np.zeros((1, len(model.languages)))]).astype(float)
    step = max(1024, 8 * PIECE // max(8, len(model.languages)))
    for at in range(0, len(line), step):
        last = min(at + step, len(line))
        first = int(np.searchsorted(starts, at, "right")) - 1
        inside = np.concatenate(([at], starts[(starts > at) & (starts < last)])) - at
        for found in _buckets(line, at, last):
            total[first : first + len(inside)] += np.add.reduceat(matrix[found], inside, axis=0)
    lettered = np.zeros(len(texts), bool)
    lettered[np.searchsorted(starts, np.flatnonzero((line != 32) & (line != END)), "right") - 1] = True
    odds = np.exp(total - total.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True), lettered


def predict(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; `und` with 0 without a letter or a model."""
    if model is None or not texts:
        return ["und"] * len(texts), np.zeros(len(texts))
    found, lettered = posteriors(texts, model)
    best = found.argmax(1)
    return [model.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], np.where(lettered, found[np.arange(len(texts)), best], 0.0)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text), by the whole text.

    ``score`` is the posterior of the predicted language. A null text, or one without a
    letter, is `und` with score 0, and so is every row where no model could be learnt.
    Ties go to the language that sorts first. Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each():
        model = sent.value

        def turn(batch: pa.RecordBatch):
            languages, scores = predict(batch.column("text").to_pylist(), model)
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": languages, "score": scores}

        return turn

    return map_batches(
        docs.select("doc_id", "text", (fold_of("doc_id", 4) == 2).alias("held_out")),
        "doc_id long, held_out boolean, lang_pred string, score double",
        each,
    )


def keep_identified(docs: DataFrame, model: LanguageModel | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a known language with a posterior of ``least``, their columns as
    they are. Without a model all stay."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each():
        model = sent.value

        def chosen(batch: pa.RecordBatch):
            languages, scores = predict(batch.column("text").to_pylist(), model)
            return [lang != "und" and score >= least for lang, score in zip(languages, scores, strict=True)]

        return chosen

    return keep_rows(docs, each)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from three of four folds (by crc32 of the id), predict every document."""
    return identify(docs, train(docs.where(fold_of("doc_id", 4) != 2)))
