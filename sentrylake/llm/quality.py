"""Document quality by Bradley-Terry pairwise ranking.

A document's score is a sum of weights over its features, surface statistics cut into
ranges. Preference pairs (a good document over a poor one) teach the weights by
logistic loss on the difference of the two documents' features. The scores of all
documents are then cut at a quantile: the share of poor documents among the labelled ones says
where to look, and the sparsest stretch of the scores thereabouts is the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import beside_rows, fold_of, keep_rows, map_batches
from .scratch import materialise, release

#: Labelled documents the ranking is learnt from, at most (in expectation: a hash draws them).
TRAINING_DOCUMENTS = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
#: Ranges that a statistic is cut into.
RANGES = 12
#: How far from the labelled share of poor documents the threshold's quantile may lie.
SLACK = 0.04
#: Score at the threshold.
CUT = 0.7
FOLDS = 4

_KINDS = np.full(256, 0, np.int64)  # letters a-z and non-ASCII bytes
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[48:58] = 2
_KINDS[65:91] = 3
_KINDS[[33, 63]] = 4
_KINDS[[44, 46, 58, 59]] = 5
_KINDS[[39, 34, 40, 41, 45]] = 6
_KINDS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 7
_KINDS[0:9] = _KINDS[14:32] = _KINDS[127] = 8

STATISTICS = (
    "log_words", "space", "digit", "upper", "loud", "stop", "quote", "symbol", "control", "beyond_ascii", "common_symbol",
    "mean_word", "spread_word", "short_words", "long_words", "distinct_words", "distinct_triples", "most_common_word",
    "lines_per_word", "distinct_lines", "mean_line", "bare_words", "number_words", "shouted_words", "marked_words", "sentence_starts", "repeats_previous",
)


def statistics(text: str | None) -> np.ndarray:
    """Surface statistics of a whole text, one per name in ``STATISTICS``; zeros without words."""
    out = np.zeros(len(STATISTICS), np.float32)
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KINDS, weights=seen, minlength=9) / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    hashed = np.fromiter(map(hash, words), np.int64, n)
    order = np.sort(hashed)
    runs = np.diff(np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True]))))
    if n >= 3:
        triples = hashed[:-2] * 31 + hashed[1:-1] * 17 + hashed[2:]
        triple_share = len(np.unique(triples)) / len(triples)
    else:
        triple_share = 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    # each word kind once per distinct word, weighed by how often it occurs
    bare = number = shouted = marked = starts = 0
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, k in counts.items():
        first, last = w[0], w[-1]
        if w.isalpha():
            if len(w) > 1 and w.isupper():
                shouted += k
            if first.isupper():
                starts += k
        else:
            if not any(map(str.isalpha, w)):
                if any(map(str.isdigit, w)):
                    number += k
                else:
                    bare += k
            elif w.upper() == w and len(w) > 1:
                shouted += k
            elif first.isupper():
                starts += k
            if last in "#$%&*!|<>{}~^_=+@/\\" or first in "#$%&*!|<>{}~^_=+@/\\":
                marked += k
    out[:] = (
        math.log(n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        seen[128:].sum() / len(raw), seen[_KINDS == 7].max() / len(raw),
        lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(), len(counts) / n, triple_share, runs.max() / n,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), math.log(len(text) / max(1, len(lines))),
        bare / n, number / n, shouted / n, marked / n, starts / n, (hashed[1:] == hashed[:-1]).sum() / n,
    )
    return out


@dataclass
class Ranking:
    """Cuts of every statistic and the weight of each of its ranges."""

    cuts: np.ndarray
    weights: np.ndarray

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Number of the range each statistic of each row lies in, counted through."""
        width = self.cuts.shape[1] + 1
        inside = (rows[:, :, None] > self.cuts[None]).sum(2)
        return inside + np.arange(rows.shape[1]) * width

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        return self.weights[self.places(rows)].sum(1)


def learn(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, rounds: int = 250) -> Ranking | None:
    """Bradley-Terry weights from pairs of a good and a poor row; None if a side is missing."""
    if good.all() or not good.any():
        return None
    # cuts from both sides alike: else the rare side has no range of its own
    ends = np.linspace(0, 1, RANGES // 2 + 2)[1:-1]
    cuts = np.sort(np.concatenate([np.quantile(rows[good], ends, axis=0), np.quantile(rows[~good], ends, axis=0)]), axis=0).T.astype(np.float32)
    ranking = Ranking(cuts, np.zeros(cuts.shape[0] * (cuts.shape[1] + 1)))
    places = ranking.places(rows)
    draw = np.random.default_rng(7)
    up = places[draw.choice(np.flatnonzero(good), pairs)]
    down = places[draw.choice(np.flatnonzero(~good), pairs)]
    w = ranking.weights
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        some = slice((t * 4096) % pairs, (t * 4096) % pairs + 4096)
        a, b = up[some], down[some]
        lost = 1 / (1 + np.exp(np.clip(w[a].sum(1) - w[b].sum(1), -40, 40)))  # d loss / d margin
        pull = np.repeat(lost, a.shape[1]) / len(a)
        gradient = np.bincount(b.ravel(), pull, len(w)) - np.bincount(a.ravel(), pull, len(w)) + penalty * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return ranking


def _measure():
    def turn(batch: pa.RecordBatch):
        return {"statistics": [statistics(t).tobytes() for t in batch.column("text").to_pylist()]}

    return turn


def measured(docs: DataFrame) -> DataFrame:
    """row (struct of the columns of ``docs``), statistics (binary float32) of every row."""
    return beside_rows(docs, "statistics binary", _measure)


def _matrix(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, len(STATISTICS))


def threshold(scores: DataFrame, share: float, slack: float = SLACK) -> float:
    """The score at a quantile near ``share``: in the middle of the widest gap between neighbouring
    quantiles of all ``scores`` (column raw) that lie within ``slack`` of it."""
    steps = np.linspace(max(0.0, share - slack), min(1.0, share + slack), 81)
    values = scores.select(F.percentile_approx("raw", [float(s) for s in steps], 20_000).alias("q")).first()["q"]
    if values is None:
        return 0.0
    widest = int(np.argmax(np.diff(values)))
    return (values[widest] + values[widest + 1]) / 2


def fit(table: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> tuple[Ranking | None, float]:
    """The ranking and its threshold, from a table of :func:`measured` and ``labels`` (doc_id, label).

    Without a ranking (labels of one class or none) the second value is everyone's score.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    total = labels.count()
    if total > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(bound / total * (1 << 20)))
    # about ``bound`` labels at most, and a row for each of them however often its document occurs
    taught = table.select("row.doc_id", "statistics").join(F.broadcast(labels), "doc_id")
    taught = taught.groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.min("label").alias("label")).toPandas()
    good = taught["label"].to_numpy() > 0
    ranking = learn(_matrix(taught["statistics"]), good) if len(taught) else None
    if ranking is None:
        return None, CUT if not len(taught) else 0.99 if good.all() else 0.01
    return ranking, threshold(_raw(table, ranking), 1 - float(good.mean()))


def _raw(table: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, raw score of every row of a table of :func:`measured`."""
    sent = table.sparkSession.sparkContext.broadcast(ranking)

    def each():
        ranking = sent.value
        return lambda batch: {"doc_id": batch.column("doc_id"), "raw": ranking.scores(_matrix(batch.column("statistics").to_pylist()))}

    return map_batches(table.select("row.doc_id", "statistics"), "doc_id long, raw double", each)


def score(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text), by the whole text.

    ``labels`` (doc_id, label 0/1) are all that is learnt from. The score is the logistic of a
    document's lead over the threshold, CUT at the threshold. Null and empty texts have the
    statistics 0. Repeated rows are scored each; of several labels of a document the smallest
    counts; rows without id or label teach nothing; other columns are ignored. Where the labels hold one
    class only (or none), every document gets that class's end of the range (or CUT).
    """
    table = materialise(measured(docs.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "statistics"), "quality_statistics")
    ranking, cut = fit(table, labels, bound)
    if ranking is None:
        return table.select("row.doc_id", F.lit(cut).alias("score"))
    lead = F.col("raw") - F.lit(cut) + F.lit(math.log(CUT / (1 - CUT)))
    return _raw(table, ranking).select("doc_id", (1 / (1 + F.exp(-lead))).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` with a score of CUT at least, their columns as they are.

    Texts are neither copied nor shuffled: a first pass measures them for the ranking and its
    threshold, a second one filters them where they lie. Nulls, repeated rows and labels
    of one class are as in :func:`score`; where nothing can be learnt, all stay.
    """
    table = materialise(measured(docs.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "statistics"), "quality_statistics")
    ranking, cut = fit(table, labels, bound)
    release(table)
    if ranking is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(ranking)

    def each():
        ranking = sent.value
        return lambda batch: ranking.scores(np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(STATISTICS))) >= cut

    return keep_rows(docs, each)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels of three of four folds (by crc32 of the id)."""
    return labels.where(fold_of("doc_id", FOLDS) != 2).select("doc_id", F.col("quality").alias("label"))


def score_held_out(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Learn from three of four folds (by crc32 of the id), score every document."""
    return score(docs, training_labels(labels), bound).select(
        "doc_id", (fold_of("doc_id", FOLDS) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
