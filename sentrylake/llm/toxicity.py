"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters say "toxic" or nothing about a text: small fixed lexicons and phrases, and word
   patterns (whole words and word beginnings) mined from labelled rows, so that words
   no fixed list knows are found in any language.
2. A label model with a hidden class explains the votes of all documents: per voter how
   often it fires in either class (its accuracy), and how far voters agree beyond that
   (their correlation); votes that only repeat each other are discounted.
   A row's own label, where it has one, is a voter too, whose accuracy the model estimates.
3. The model's posterior labels of all documents, labelled or not, train a logistic regression on words
   and word beginnings, which gives the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fold_of, map_batches
from .scratch import materialise, release

#: Labelled documents that patterns are mined from and whose labels vote, at most
#: (in expectation: a hash of the id draws them).
TRAINING_DOCUMENTS = 20_000
#: Words and beginnings the classifier has a weight for.
FEATURES = 2048
#: Patterns dealt to the mined voters, and those voters.
MINED_PATTERNS, MINED_VOTERS = 96, 8
#: The classifier's steps: rounds over all documents, passes over each batch in a round.
ROUNDS, LOCAL_PASSES, MINIBATCH = 2, 4, 32
RATE, PENALTY = 0.2, 1e-4
PREFIXES = (3, 4, 5, 6, 7, 8)
FOLDS = 5

# The seed lexicons.
INSULTS = frozenset(
    "airhead bozo clown coward cretin creep dimwit dolt dumb dumbass dunce fool freak halfwit idiot idiotic imbecile jerk "
    "loser moron moronic nitwit pathetic pig scum simpleton slob stupid twit weirdo weakling worthless useless".split()
)
CONTEMPT = frozenset("abomination cockroach degenerate disgusting filth filthy garbage parasite rat repulsive subhuman trash vermin vile".split())
PROFANITY = frozenset("arse ass asshole bastard bitch bollocks bullshit crap cunt damn dick fuck fucked fucker fucking prick shit shitty slut twat wanker whore".split())
THREATS = ("kill you", "hurt you", "beat you", "hate you", "shut up", "go to hell", "drop dead", "i will find you")
MASKED = re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]+\b")
SEEDS = ("insult", "contempt", "profanity", "threat", "masked word", "several seed words")
VOTERS = (*SEEDS, *(f"mined {k}" for k in range(MINED_VOTERS)), "several mined patterns")

_words = re.compile(r"[^\W\d_]+").findall


def terms_of(lowered: str) -> set[str]:
    """The patterns a text holds: `=word` for each word, `^beginning` for its beginnings."""
    words = set(_words(lowered))
    out = {"=" + w for w in words}
    for k in PREFIXES:
        out.update({"^" + w[:k] for w in words if len(w) >= k})
    return out


@dataclass
class Vocabulary:
    """Where words and beginnings lead: to the classifier's features and to mined voters."""

    features: list[str]
    mined: list[str]
    #: beginning length (0: whole word) -> text -> (feature or -1, mined voter or -1)
    by_length: dict[int, dict[str, tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self):
        voter = {p: k % MINED_VOTERS for k, p in enumerate(self.mined)}
        number = {p: k for k, p in enumerate(self.features)}
        for p in {*voter, *number}:
            self.by_length.setdefault(0 if p[0] == "=" else len(p) - 1, {})[p[1:]] = (number.get(p, -1), voter.get(p, -1))

    def read(self, text: str | None) -> tuple[list[int], int]:
        """The features of a text and its votes as a bit mask."""
        if not text:
            return [], 0
        lowered = text.lower()
        words = set(_words(lowered))
        features, mined = [], set()
        mask, hits = 0, 0
        for k, table in self.by_length.items():
            found = table.keys() & words if k == 0 else table.keys() & {w[:k] for w in words}
            for piece in found:
                feature, voter = table[piece]
                if feature >= 0:
                    features.append(feature)
                if voter >= 0:
                    hits += 1
                    mined.add(voter)
        seeds = 0
        for bit, lexicon in enumerate((INSULTS, CONTEMPT, PROFANITY)):
            n = len(words & lexicon)
            seeds += n
            mask |= (n > 0) << bit
        mask |= any(t in lowered for t in THREATS) << 3
        mask |= (any(x in lowered for x in ("**", "@@", "##", "$$")) and MASKED.search(lowered) is not None) << 4
        mask |= (seeds > 1) << 5
        for voter in mined:
            mask |= 1 << (len(SEEDS) + voter)
        mask |= (hits > 1) << (len(VOTERS) - 1)
        return sorted(features), mask


def _label_sample(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, label of about ``bound`` labelled documents at most, the largest label of each."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = labels.count()
    if total > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(bound / total * (1 << 20)))
    return labels


def mine(sample: DataFrame) -> Vocabulary:
    """Patterns that tell the classes of ``sample`` (doc_id, text, label) apart."""

    def each():
        def turn(batch: pa.RecordBatch):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for term in terms_of((text or "").lower()):
                    counts.setdefault(term, [0, 0])[label > 0] += 1
            return {"term": list(counts), "no": [c[0] for c in counts.values()], "yes": [c[1] for c in counts.values()]}

        return turn

    totals = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    no, yes = totals.get(False, 0), totals.get(True, 0)
    if not no or not yes:
        return Vocabulary([], [])
    counted = (
        map_batches(sample, "term string, no long, yes long", each)
        .groupBy("term")
        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .where("no + yes >= 2")
    )
    a, b = (F.col("yes") + 0.1) / (yes + 0.2), (F.col("no") + 0.1) / (no + 0.2)
    together = (F.col("yes") + F.col("no") + 0.2) / (yes + no + 0.4)
    z = (a - b) / F.sqrt(together * (1 - together) * (1.0 / yes + 1.0 / no))
    ranked = counted.withColumn("z", z).withColumn("lift", F.log(a / b))
    told = ranked.orderBy(F.abs("z").desc(), F.length("term").desc(), "term").limit(FEATURES).select("term", "z", "lift", "yes").collect()
    mined: list[str] = []
    kept: list[tuple[str, int]] = []
    for r in told:
        if r["z"] < 4 or r["lift"] < 2.5 or r["yes"] < max(3, 0.01 * yes):
            continue
        # of beginnings of one another that fire in the same documents, the first is enough
        stem = r["term"][1:]
        if any((stem.startswith(s) or s.startswith(stem)) and abs(n - r["yes"]) <= 0.1 * n for s, n in kept):
            continue
        kept.append((stem, r["yes"]))
        mined.append(r["term"])
        if len(mined) == MINED_PATTERNS:
            break
    return Vocabulary([r["term"] for r in told], mined)


@dataclass
class LabelModel:
    prior: float
    #: classes x voters: probability that the voter fires
    fires: np.ndarray
    #: share of a voter's evidence that other voters don't repeat
    weight: np.ndarray
    correlation: np.ndarray
    #: per class the probability that a given label says toxic
    gold: np.ndarray = field(default_factory=lambda: np.array([0.05, 0.95]))

    def gold_odds(self, label: int) -> float:
        """Evidence of a given label."""
        says = self.gold if label else 1 - self.gold
        return float(np.log(says[1] / says[0]))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0])
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return np.log(self.prior / (1 - self.prior)) + np.where(votes, on, off) @ self.weight


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation on distinct vote patterns (rows of the boolean ``votes``).

    ``counts`` are documents per pattern; ``known`` (patterns x 2) those of them whose
    label is given, by label: they start the estimate, and the labels vote with an accuracy that is estimated
    like any voter's.
    """
    n, known_n = counts.astype(float), known.astype(float)
    free = np.maximum(n - known_n.sum(1), 0)
    if known_n[:, 1].sum() and known_n[:, 0].sum():
        fires = np.array([(known_n[:, y] @ votes + 0.5) / (known_n[:, y].sum() + 1) for y in (0, 1)])
        prior = known_n[:, 1].sum() / known_n.sum()
    else:
        fires, prior = np.array([np.full(votes.shape[1], 0.02), np.full(votes.shape[1], 0.4)]), 0.1
    model = LabelModel(float(np.clip(prior, 1e-3, 0.5)), np.clip(fires, 1e-4, 1 - 1e-4), np.ones(votes.shape[1]), np.eye(votes.shape[1]))
    for turn in range(rounds):
        odds = model.log_odds(votes)
        p = _sigmoid(odds)
        told = np.stack([_sigmoid(odds + model.gold_odds(label)) for label in (0, 1)], axis=1)
        mass = np.stack([free * (1 - p) + (known_n * (1 - told)).sum(1), free * p + (known_n * told).sum(1)])
        total = mass.sum(1)
        if not total.all():
            break
        model.fires = np.clip((mass @ votes + 0.5) / (total[:, None] + 1), 1e-4, 1 - 1e-4)
        model.prior = float(np.clip(total[1] / total.sum(), 1e-3, 0.5))
        says = np.array([(known_n * side).sum(0) for side in (1 - told, told)])  # class x label
        model.gold = np.clip((says[:, 1] + [0.05, 0.95]) / (says.sum(1) + 1), 1e-3, 1 - 1e-3)
        covariance = sum((mass[y][:, None] * (votes - model.fires[y])).T @ (votes - model.fires[y]) for y in (0, 1)) / total.sum()
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        model.correlation = covariance / np.outer(spread, spread)
        np.fill_diagonal(model.correlation, 1)
        model.weight = 1 / np.maximum(model.correlation, 0).sum(1)
    return model


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        sums = np.fromiter((self.weights[r].sum() for r in rows), float, len(rows))
        return _sigmoid(sums + self.bias)


def train_classifier(voted: DataFrame, model: LabelModel, size: int, rounds: int = ROUNDS) -> Classifier:
    """Logistic regression of the posterior labels of all of ``voted`` (features, votes, label or null) on
    sets of features: each task takes its own steps over its rows; then each weight becomes
    the average of the tasks', by how often they met its feature."""
    spark = voted.sparkSession
    classifier = Classifier(np.zeros(size), math.log(model.prior / (1 - model.prior)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((classifier, model))

        def each(sent=sent):
            start, model = sent.value
            w = np.append(start.weights, start.bias)
            history, met = np.full(size + 1, 1e-4), np.zeros(size + 1)
            draw = np.random.default_rng(3)

            def turn(batch: pa.RecordBatch):
                rows = [np.append(np.frombuffer(x, np.int16), size) for x in batch.column("features").to_pylist()]
                target = posteriors(model, batch)
                for k in range(LOCAL_PASSES):
                    order = draw.permutation(len(rows))
                    for at in range(0, len(order), MINIBATCH):
                        some = order[at : at + MINIBATCH]
                        lengths = [len(rows[i]) for i in some]
                        columns = np.concatenate([rows[i] for i in some])
                        owner = np.repeat(np.arange(len(some)), lengths)
                        error = _sigmoid(np.bincount(owner, w[columns], len(some))) - target[some]
                        gradient = np.bincount(columns, error[owner], size + 1) / len(some)
                        gradient[:-1] += PENALTY * w[:-1]
                        history[:] += gradient**2
                        w[:] -= RATE * gradient / np.sqrt(history)
                        if not k:
                            met[:] += np.bincount(columns, minlength=size + 1)
                return None

            def finish():
                place = np.flatnonzero(met)
                return {"place": place, "weight": w[place] * met[place], "met": met[place]} if len(place) else None

            turn.finish = finish
            return turn

        trained = map_batches(voted, "place int, weight double, met double", each)
        means = trained.groupBy("place").agg((F.sum("weight") / F.sum("met")).alias("mean")).toPandas()
        w = np.append(classifier.weights, classifier.bias)
        w[means["place"]] = means["mean"]
        classifier = Classifier(w[:-1], float(w[-1]))
    return classifier


def as_votes(masks) -> np.ndarray:
    return (np.asarray(masks, np.int64)[:, None] & (1 << np.arange(len(VOTERS)))) > 0


def posteriors(model: LabelModel, batch: pa.RecordBatch) -> np.ndarray:
    """Probability of being toxic of each row (votes, label or null) by the label model."""
    labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
    gold = np.where(np.isnan(labels), 0.0, np.where(labels > 0, model.gold_odds(1), model.gold_odds(0)))
    return _sigmoid(model.log_odds(as_votes(batch.column("votes").to_numpy())) + gold)


def score(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, score, vote_posterior of every row of ``docs`` (doc_id, text), by the whole text.

    ``labels`` (doc_id, label 0/1) are all that is learnt from; where they hold one class
    only, the fixed voters decide alone. A null or empty text has no votes and no features.
    Repeated rows are scored each; of several labels of a document the largest counts; rows
    without id or label teach nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    labels = materialise(_label_sample(labels, bound), "toxic_labels")
    known_rows = F.broadcast(labels)  # about ``bound`` rows at most
    sample = materialise(docs.select("doc_id", "text").join(known_rows, "doc_id"), "toxic_sample")
    vocabulary = mine(sample)
    sent = spark.sparkContext.broadcast(vocabulary)  # at most FEATURES + MINED_PATTERNS terms

    def read():
        vocabulary = sent.value

        def turn(batch: pa.RecordBatch):
            found = [vocabulary.read(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "features": [np.array(f, np.int16).tobytes() for f, _ in found], "votes": [m for _, m in found]}

        return turn

    voted = map_batches(docs.select("doc_id", "text"), "doc_id long, features binary, votes int", read)
    voted = materialise(voted.join(known_rows, "doc_id", "left"), "toxic_votes")
    release(sample)
    # at most 2 ** voters patterns reach the driver, each for no label or one of two
    seen = voted.groupBy("votes", (F.col("label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    masks = sorted(set(seen["votes"]))
    place = {m: i for i, m in enumerate(masks)}
    counts, known = np.zeros(len(masks)), np.zeros((len(masks), 2))
    for mask, toxic, n in zip(seen["votes"], seen["toxic"], seen["n"], strict=True):
        counts[place[mask]] += n
        if toxic is not None and toxic == toxic:
            known[place[mask], int(toxic)] += n
    model = fit_label_model(as_votes(masks), counts, known)
    learnt = bool(vocabulary.features)
    classifier = train_classifier(voted.select("features", "votes", "label"), model, len(vocabulary.features)) if learnt else None
    shared = spark.sparkContext.broadcast((classifier, model))

    def judge():
        classifier, model = shared.value

        def turn(batch: pa.RecordBatch):
            posterior = _sigmoid(model.log_odds(as_votes(batch.column("votes").to_numpy())))
            scores = classifier.scores([np.frombuffer(x, np.int16) for x in batch.column("features").to_pylist()]) if learnt else posterior
            return {"doc_id": batch.column("doc_id"), "score": scores, "vote_posterior": posterior}

        return turn

    return map_batches(voted.select("doc_id", "features", "votes"), "doc_id long, score double, vote_posterior double", judge)


def score_held_out(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Learn from four of five folds (by crc32 of the id), score every document."""
    known = labels.where(fold_of("doc_id", FOLDS) != 0).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, known, bound).select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "vote_posterior",
    )
