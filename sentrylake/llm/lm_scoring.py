"""Language-model scores by masked pseudo-likelihood.

A small network reads the words on both sides of a position and predicts the one in the
middle; the sum of these log-probabilities over all positions scores a document. The
output is a softmax in two levels, both learnt from the context: the word's class, then the
word among those of its class. The classes are learnt too: words that stand beside the same words
share one. Words beyond the most frequent share an output with those of the same ending, some thousands
of such outputs in all, predicted like words, and each has the share of its own count in it. Words are
counted over all documents, and all documents train the network: many tasks at once, each in numpy on
its own partition; after each round their weights are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .columns import map_batches
from .scratch import materialise

#: Words that the network predicts and reads one by one, at most.
NETWORK_WORDS = 57_344
#: Outputs, at most, that all other words share by their endings of so many characters.
#: Ids of both, and one for the places before and after a document, have 16 bits.
SHARED, ENDING = 8191, 3
#: Classes: one for each of the most frequent words, some for all others.
SINGLE, KNOWN = 64, 192
#: Words looked at on either side, and units of the network.
SIDE, HIDDEN = 2, 16
#: Words on either side that tell which class a word belongs to, and numbers that stand for each of them.
AROUND, SIGNS = 8, 16
#: Each document trains in one of the rounds; the length of an Adagrad step.
ROUNDS, RATE = 2, 0.3
#: Tokens that a task of a round trains on at least, if fewer tasks keep all cores busy: each hands on a whole network.
TOKENS_A_TASK = 4_000_000
#: Distinct words a task counts before it passes them on.
COUNTER_SIZE = 300_000
#: Positions in one step of scoring and of training, and tokens shuffled among each other in training.
STEP, MINIBATCH, MIXED = 65_536, 8192, 65_536
#: Rows whose outputs are computed at a time: what they take fits a core's cache.
BLOCK = 512

_words = re.compile(r"\w+").findall
_OFFSETS = np.array([k for k in range(-SIDE, SIDE + 1) if k])
#: Logits above this would overflow when their exponentials are summed.
_HIGHEST = 80.0


def tokens_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def ending(word: str) -> int:
    return zlib.crc32(word[-ENDING:].encode("utf-8", "surrogatepass")) % SHARED


@dataclass
class Lexicon:
    """Ids of words, the most frequent first, then of the outputs that the rare ones share.

    A rare word's log-probability within its output is log n - log N, from its own count and that of
    all rare words there. ``rare_within`` is -log N of each; :func:`own_counts` gives log n.
    """

    codes: dict[str, int]
    counts: np.ndarray  # of each id
    shared: np.ndarray  # id of the output of each hash of endings

    def __post_init__(self):
        self.rare_within = -np.log(np.maximum(self.counts[len(self.codes) :], 1))

    def encode(self, documents: list[list[str]]) -> tuple[list[np.ndarray], list[float], list[str]]:
        """Of each document its ids, the log-probability of its rare words within their outputs but for
        log n, and these words with a space between them."""
        known = self.codes.get
        flat = [w for d in documents for w in d]
        ids = np.fromiter((known(w, -1) for w in flat), np.int64, len(flat))
        missing = np.flatnonzero(ids < 0)
        ids[missing] = self.shared[np.fromiter((ending(flat[i]) for i in missing), np.int64, len(missing))]
        inside = np.zeros(len(flat) + 1)
        inside[missing + 1] = self.rare_within[ids[missing] - len(self.codes)]
        sums = np.cumsum(inside)
        ids = ids.astype(np.uint16)
        ends = np.cumsum([0] + [len(d) for d in documents])
        cut = np.searchsorted(missing, ends)
        return (
            [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)],
            [float(sums[b] - sums[a]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
            [" ".join(flat[i] for i in missing[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)],
        )


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts of ``docs``."""

    def each():
        def turn(batch: pa.RecordBatch):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(tokens_of(text))
                if len(counts) >= COUNTER_SIZE:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts = Counter()
            yield {"word": list(counts), "n": list(counts.values())}

        return turn

    return map_batches(docs.select("text"), "word string, n long", each).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, words: int = NETWORK_WORDS) -> Lexicon:
    """From corpus counts (word, n): words of at least the least count that no more than ``words`` of them have.

    A histogram of counts (1 % wide beyond 92, exact below) finds that count, so no words are sorted
    in one task; these words and a row for each shared output reach the driver.
    """
    width = F.floor(F.log2("n") * 64)
    least, total = None, 0
    for r in sorted(counts.groupBy(width.alias("width")).count().collect(), reverse=True):
        total += r["count"]
        if total > words:
            break
        least = r["width"]
    frequent = F.lit(False) if least is None else width >= least
    own = sorted(counts.where(frequent).collect(), key=lambda r: (-r["n"], r["word"]))
    kind = F.crc32(F.substring("word", -ENDING, ENDING).cast("binary")) % SHARED
    rare = {r["kind"]: r["n"] for r in counts.where(~frequent).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}
    kinds = sorted(rare) or [0]
    shared = np.full(SHARED, len(own), np.int64)
    shared[kinds] = len(own) + np.arange(len(kinds))
    return Lexicon({r["word"]: k for k, r in enumerate(own)}, np.array([*(r["n"] for r in own), *(rare.get(k, 0) for k in kinds)]), shared)


def _exponentials(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of ``h`` times ``weights``, each row up to a factor, and the logarithm of that factor."""
    logits = h @ weights.T
    less = np.zeros(len(h), np.float32)
    # no value of the layer is beyond 1; rows are added up only where the largest weight leaves it open
    largest = max(weights.max(initial=0.0), -weights.min(initial=0.0))
    if largest * weights.shape[1] > _HIGHEST and np.abs(weights).sum(1).max(initial=0.0) > _HIGHEST:
        less = logits.max(1)
        logits -= less[:, None]
    np.exp(logits, out=logits)
    return logits, less


def _log_softmax(h: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the share of the ``chosen`` row of ``weights``, for each row of ``h``."""
    out = np.einsum("ij,ij->i", h, np.take(weights, chosen, axis=0))
    for i in range(0, len(h), BLOCK):
        powers, less = _exponentials(h[i : i + BLOCK], weights)
        out[i : i + BLOCK] -= less + np.log(powers @ np.ones(len(weights), np.float32))
    return out


def _gradients(h: np.ndarray, weights: np.ndarray, chosen: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Of the summed -log share of the ``chosen`` rows: that of ``weights``; that of ``h`` is added to ``back``."""
    wide = np.concatenate([weights, np.ones((len(weights), 1), np.float32)], axis=1)
    out = np.zeros_like(weights)
    for i in range(0, len(h), BLOCK):
        here = slice(i, i + BLOCK)
        powers, _ = _exponentials(h[here], weights)
        product = powers @ wide  # the last column is the sum of each row
        total = product[:, -1]
        back[here] += product[:, :-1] / total[:, None]
        powers[np.arange(len(powers)), chosen[here]] -= total
        out += powers.T @ (h[here] / total[:, None])
    back -= np.take(weights, chosen, axis=0)
    return out


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of ``values`` of each."""
    order = np.argsort(keys, kind="stable")  # a radix sort: the keys have 16 bits
    found = keys[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[first], np.add.reduceat(np.take(values, order, axis=0), first)


def _split(ids: np.ndarray, signs: np.ndarray, weight: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    """``ids`` in so many parts of about equal weight, none empty: halved along the axis on which they differ most."""
    if parts == 1:
        yield ids
        return
    own = signs[ids]
    own = own - own.mean(0)
    along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
    ids = ids[np.argsort(along, kind="stable")]
    upto = np.cumsum(weight[ids])
    left = parts // 2
    at = int(np.clip(np.searchsorted(upto, upto[-1] * left / parts), left, len(ids) - (parts - left)))
    yield from _split(ids[:at], signs, weight, left)
    yield from _split(ids[at:], signs, weight, parts - left)


def classes(counts: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First number of each class, with the end of the last, and the number of each id: class by class.

    The most frequent ids have a class each. All others are split by ``signs`` (a row for each id) into parts
    that hold alike much of the ids and of the occurrences, so frequent words meet in small classes.
    """
    order = np.argsort(-counts, kind="stable")
    rest = order[SINGLE:]
    parts = [order[k : k + 1] for k in range(min(SINGLE, len(order)))]
    if len(rest):
        weight = counts / max(1, counts[rest].sum()) + 1 / len(rest)
        parts += _split(np.sort(rest), signs, weight, min(KNOWN, len(rest)))
    number = np.empty(len(order), np.uint16)
    number[np.concatenate([order[:0], *parts])] = np.arange(len(order))
    return np.cumsum([0] + [len(p) for p in parts]), number


@dataclass
class Network:
    """One hidden layer over the words beside a position; softmax over classes, then over a class' words."""

    first: np.ndarray  # first word of each class; ends with PAD
    inputs: np.ndarray  # (words + PAD) x hidden
    places: np.ndarray  # positions beside x hidden: factors of the inputs
    outputs: np.ndarray  # classes x (hidden + 1): weights and bias
    words: np.ndarray  # words x (hidden + 1)

    @staticmethod
    def start(first: np.ndarray, seed: int = 5) -> Network:
        draw = np.random.default_rng(seed)
        pad = int(first[-1])
        return Network(
            first,
            draw.normal(0, 0.1, (pad + 1, HIDDEN)).astype(np.float32),
            draw.normal(1, 0.1, (2 * SIDE, HIDDEN)).astype(np.float32),
            np.pad(draw.normal(0, 0.1, (len(first) - 1, HIDDEN)), ((0, 0), (0, 1))).astype(np.float32),
            np.pad(draw.normal(0, 0.1, (pad, HIDDEN)), ((0, 0), (0, 1))).astype(np.float32),
        )

    def __post_init__(self):
        self.pad = int(self.first[-1])
        self.class_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)).astype(np.uint8)

    def rows(self) -> np.ndarray:
        """All weights as a matrix of hidden + 1 columns, a row for each input, position, class and word."""
        wide = [np.pad(part, ((0, 0), (0, 1))) for part in (self.inputs, self.places)]
        return np.concatenate([*wide, self.outputs, self.words])

    def filled(self, rows: np.ndarray) -> Network:
        parts = np.split(rows.astype(np.float32), np.cumsum([len(self.inputs), len(self.places), len(self.outputs)]))
        return Network(self.first, parts[0][:, :HIDDEN].copy(), parts[1][:, :HIDDEN].copy(), parts[2].copy(), parts[3].copy())

    def hidden(self, beside: np.ndarray) -> np.ndarray:
        """The layer's values, and a last column of ones for the biases."""
        total = np.empty((len(beside), HIDDEN + 1), np.float32)
        sums = np.take(self.inputs, beside[:, 0], axis=0) * self.places[0]
        for k in range(1, 2 * SIDE):
            sums += np.take(self.inputs, beside[:, k], axis=0) * self.places[k]
        np.tanh(sums, out=total[:, :HIDDEN])
        total[:, HIDDEN] = 1
        return total

    def _classes(self, kinds: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """The words and the positions of each class of several words that the sorted ``kinds`` hold."""
        bounds = np.searchsorted(kinds, np.arange(len(self.first)))
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.first) > 1)):
            yield slice(int(self.first[c]), int(self.first[c + 1])), slice(int(bounds[c]), int(bounds[c + 1]))

    def log_probability(self, beside: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target, a word or a shared output."""
        order = np.argsort(self.class_of[target], kind="stable")
        h, target = self.hidden(beside[order]), target[order]
        kinds = self.class_of[target]
        found = _log_softmax(h, self.outputs, kinds)
        for words, at in self._classes(kinds):
            found[at] += _log_softmax(h[at], self.words[words], target[at] - words.start)
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, beside: np.ndarray, target: np.ndarray, history: Network, rate: float = RATE) -> None:
        """One Adagrad step on a batch of positions; each row of weights has a length of its own,
        and ``history`` holds the sums of squares in its first column."""

        def step(part: np.ndarray, seen: np.ndarray, at, gradient: np.ndarray) -> None:
            squares = seen[at, 0] + np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
            seen[at, 0] = squares
            gradient *= (rate / (np.sqrt(squares) + 1e-6))[:, None]
            part[at] -= gradient

        order = np.argsort(self.class_of[target], kind="stable")
        beside, target = beside[order], target[order]
        h, kinds = self.hidden(beside), self.class_of[target]
        n = np.float32(len(target))
        back = np.zeros_like(h)
        by_class = _gradients(h, self.outputs, kinds, back) / n
        for words, at in self._classes(kinds):
            step(self.words, history.words, words, _gradients(h[at], self.words[words], target[at] - words.start, back[at]) / n)
        step(self.outputs, history.outputs, slice(None), by_class)
        back = back[:, :HIDDEN] * ((1 - h[:, :HIDDEN] ** 2) / n)
        factors = np.stack([(back * np.take(self.inputs, beside[:, k], axis=0)).sum(0) for k in range(2 * SIDE)])
        keys, gradient = sums_by(beside.T.ravel(), np.concatenate([back * f for f in self.places]))
        step(self.inputs, history.inputs, keys, gradient)
        step(self.places, history.places, slice(None), factors)


def lines(documents: list[np.ndarray], pad: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """All documents in a line with ``pad`` before, between and after them, and where their words lie in it."""
    gap = np.full(side, pad, np.uint16)
    line = np.concatenate([gap, *(x for d in documents for x in (d, gap))]).astype(np.uint16)
    return line, np.flatnonzero(line != pad)


def beside(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return line[at[:, None] + _OFFSETS]


def _groups(documents: list[np.ndarray], tokens: int) -> Iterator[list[np.ndarray]]:
    """``documents`` in runs of about so many tokens."""
    held, size = [], 0
    for d in documents:
        held.append(d)
        size += len(d)
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def signatures(encoded: DataFrame, size: int) -> np.ndarray:
    """Directions in which the words around each of ``size`` ids lie, by random vectors that stand for the ids:
    sums over all documents of ``encoded`` (ids binary), less their mean over all positions."""

    def each():
        stands = np.vstack([np.random.default_rng(7).normal(0, 1, (size, SIGNS)), np.zeros((1, SIGNS))])
        total, met = np.zeros((size + 1, SIGNS)), np.zeros(size, np.int64)

        def turn(batch: pa.RecordBatch):
            for some in _groups([np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()], MIXED):
                line, at = lines(some, size, AROUND)
                for i in range(0, len(at), MINIBATCH):
                    begin, end = at[i], at[min(i + MINIBATCH, len(at)) - 1] + 1
                    piece = np.take(stands, line[begin - AROUND : end + AROUND], axis=0)
                    upto = np.zeros((len(piece) + 1, SIGNS))
                    np.cumsum(piece, axis=0, out=upto[1:])
                    near = upto[2 * AROUND + 1 :] - upto[: -2 * AROUND - 1]
                    near -= piece[AROUND:-AROUND]
                    keys, sums = sums_by(line[begin:end], near)
                    total[keys] += sums  # the row of the places between documents is not handed on
                met[:] += np.bincount(line[at], minlength=size)

        def finish():
            place = np.flatnonzero(met)
            if len(place):
                return {"place": place, "seen": met[place]} | {f"s{k}": total[place, k] for k in range(SIGNS)}

        turn.finish = finish
        return turn

    names = [f"s{k}" for k in range(SIGNS)]
    found = map_batches(encoded.select("ids"), "place int, seen long, " + ", ".join(f"{c} float" for c in names), each)
    sums = found.groupBy("place").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((size, SIGNS))
    if len(sums):
        seen = sums["seen"].to_numpy()
        means = sums[names].to_numpy() / seen[:, None] - sums[names].to_numpy().sum(0) / seen.sum()
        out[sums["place"]] = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return out


_COLUMNS = [f"w{k}" for k in range(HIDDEN + 1)]


def _tasks(encoded: DataFrame, rounds: int) -> DataFrame:
    """ids and row of ``encoded`` in as many partitions as it has tokens for, a core at least has one."""
    tokens = (encoded.agg(F.sum(F.length("ids"))).first()[0] or 0) // 2
    return encoded.select("row", "ids").coalesce(max(encoded.sparkSession.sparkContext.defaultParallelism, -(-tokens // (rounds * TOKENS_A_TASK))))


def train(encoded: DataFrame, first: np.ndarray, number: np.ndarray, rounds: int = ROUNDS) -> Network:
    """A network from ``encoded`` (row, ids binary), whose ids have a ``number`` each: each partition trains its own on
    the documents of a round; then each row of weights becomes their average, by how often they met it."""
    spark = encoded.sparkSession
    network = Network.start(first)
    encoded = _tasks(encoded, rounds)
    for turn_of in range(rounds):
        sent = spark.sparkContext.broadcast((network, number))

        def each(sent=sent):
            given, number = sent.value
            own = given.filled(given.rows())
            history = own.filled(np.full(own.rows().shape, 1e-4))
            met = np.zeros(own.pad + 1, np.int64)
            targets = np.zeros(own.pad, np.int64)

            def turn(batch: pa.RecordBatch):
                documents = [number[np.frombuffer(x, np.uint16)] for x in batch.column("ids").to_pylist()]
                for some in _groups(documents, MIXED):
                    line, at = lines(some, own.pad)
                    targets[:] += np.bincount(line[at], minlength=own.pad)
                    for offset in _OFFSETS:
                        met[:] += np.bincount(line[at + offset], minlength=own.pad + 1)
                    order = np.random.default_rng(len(at)).permutation(at)
                    for i in range(0, len(order), MINIBATCH):
                        own.train(beside(line, order[i : i + MINIBATCH]), line[order[i : i + MINIBATCH]], history)
                return None

            def finish():
                of_class = np.add.reduceat(targets, own.first[:-1]) if own.pad else targets
                always = np.full(2 * SIDE + len(own.outputs), targets.sum())
                seen = np.concatenate([met, always, of_class[own.class_of]])
                place = np.flatnonzero(seen)
                if len(place):
                    rows = own.rows()[place]
                    return {"place": place, "seen": seen[place]} | {c: rows[:, k] for k, c in enumerate(_COLUMNS)}

            turn.finish = finish
            return turn

        schema = "place int, seen long, " + ", ".join(f"{c} float" for c in _COLUMNS)
        trained = map_batches(encoded.where(F.pmod("row", F.lit(rounds)) == turn_of).select("ids"), schema, each)
        # as many rows as the network has, whatever the number of partitions
        means = trained.groupBy("place").agg(*[(F.sum(F.col(c) * F.col("seen")) / F.sum("seen")).alias(c) for c in _COLUMNS]).toPandas()
        if len(means):
            rows = network.rows()
            rows[means["place"]] = means[_COLUMNS]
            network = network.filled(rows)
    return network


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """The columns of ``docs`` other than text, row (unique), ids (binary, 16 bits a word),
    rare (the words whose counts are to be joined, with a space between them) and inside
    (log-probability of rare words within their outputs, without log n) of each row.

    ``row`` counts the rows of a partition: write the result before using it twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def each():
        words, at = sent.value, [TaskContext.get().partitionId() << 33]

        def turn(batch: pa.RecordBatch):
            ids, inside, rare = words.encode([tokens_of(t) for t in batch.column("text").to_pylist()])
            first = at[0]
            at[0] += len(ids)
            return {f.name: batch.column(f.name) for f in kept} | {
                "row": range(first, at[0]),
                "ids": [x.tobytes() for x in ids],
                "rare": rare,
                "inside": inside,
            }

        return turn

    added = _parse_datatype_string("row long, ids binary, rare string, inside double")
    return map_batches(docs, StructType([*kept, *added.fields]), each)


def own_counts(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """row, log_n: sum of log n over the words to be joined of each row that has any with n > 1, from
    the counts of all words. None of these words is frequent, so no key of the join is large."""
    rare = encoded.where(F.col("rare") != "").select("row", F.explode(F.split("rare", " ")).alias("word"))
    return rare.join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("log_n"))


def likelihoods(encoded: DataFrame, network: Network, number: np.ndarray) -> DataFrame:
    """row, doc_id, n_tokens, log_likelihood of every row of ``encoded``."""
    sent = encoded.sparkSession.sparkContext.broadcast((network, number))

    def each():
        network, number = sent.value

        def turn(batch: pa.RecordBatch):
            coded = [number[np.frombuffer(x, np.uint16)] for x in batch.column("ids").to_pylist()]
            sums: list[np.ndarray] = []
            for some in _groups(coded, MIXED):
                line, at = lines(some, network.pad)
                owner = np.repeat(np.arange(len(some)), [len(d) for d in some])
                own = np.zeros(len(some))
                for i in range(0, len(at), STEP):
                    found = network.log_probability(beside(line, at[i : i + STEP]), line[at[i : i + STEP]])
                    own += np.bincount(owner[i : i + STEP], found, len(some))
                sums.append(own)
            inside = batch.column("inside").to_numpy()
            return {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": [len(c) for c in coded],
                "log_likelihood": np.concatenate(sums) + inside if sums else inside,
            }

        return turn

    return map_batches(encoded.select("row", "doc_id", "ids", "inside"), "row long, doc_id long, n_tokens long, log_likelihood double", each)


def score(docs: DataFrame) -> DataFrame:
    """Count, train and score ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood, per_token.

    Null, empty and wordless texts have no tokens, likelihood 0 and a null ``per_token``.
    Repeated rows are scored each; other columns are ignored. All documents are counted,
    train the network and are scored, whatever their ids and however many they are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialise(count_words(docs), "lm_counts")
    words = lexicon(counts)
    encoded = materialise(encode(docs, words), "lm_encoded")
    first, number = classes(words.counts, signatures(encoded, len(words.counts)))
    network = train(encoded.select("row", "ids"), first, number)
    scored = (
        likelihoods(encoded, network, number)
        .join(own_counts(encoded, counts), "row", "left")
        .select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("log_n", F.lit(0.0))).alias("log_likelihood"))
    )
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
