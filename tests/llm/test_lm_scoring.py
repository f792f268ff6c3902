import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import lm_scoring
from sentrylake.llm.lm_scoring import HIDDEN, SIDE, Network, beside, classes, count_words, encode, lexicon, lines, own_counts, score, signatures, tokens_of, train
from sentrylake.llm.scratch import materialise


SINGLE, SEVERAL = 16, 12


def small_network(seed=3):
    return Network.start(np.cumsum([0] + [1] * SINGLE + [1 + k % 4 for k in range(SEVERAL)]), seed)


def plain(network, ids, k):
    """log-probability of every word of the network at position k: no numpy tricks."""
    line = [network.pad] * SIDE + list(ids) + [network.pad] * SIDE
    near = [line[k + SIDE + d] for d in (-2, -1, 1, 2)]
    h = [math.tanh(sum(float(network.inputs[x][u]) * float(network.places[j][u]) for j, x in enumerate(near))) for u in range(HIDDEN)] + [1.0]
    of = lambda row: sum(a * float(b) for a, b in zip(h, row, strict=True))
    by_class = [of(row) for row in network.outputs]
    total = math.log(sum(map(math.exp, by_class)))
    out = {}
    for c, (a, b) in enumerate(zip(network.first[:-1], network.first[1:], strict=True)):
        inside = [of(network.words[w]) for w in range(a, b)] if b - a > 1 else [0.0]
        norm = math.log(sum(map(math.exp, inside)))
        out |= {w: by_class[c] - total + x - norm for w, x in zip(range(a, b), inside, strict=True)}
    return out


def test_scores_equal_a_plain_loop():
    network = small_network()
    ids = np.array([3, 30, 30, 1, network.pad - 1, 31, 0], np.uint16)
    line, at = lines([ids[:4], ids[4:]], network.pad)
    fast = network.log_probability(beside(line, at), line[at])
    for part, found in ((ids[:4], fast[:4]), (ids[4:], fast[4:])):
        for k, word in enumerate(part):
            assert abs(plain(network, part, k)[word] - found[k]) < 1e-4


def test_words_tell_contexts_apart():
    """Two words of one class are predicted and read as words."""
    network = small_network()
    c = SINGLE + 3
    a, b = int(network.first[c]), int(network.first[c]) + 1
    score_of = lambda ids: network.log_probability(beside(*lines([np.array(ids, np.uint16)], network.pad)), np.array(ids)).sum()
    assert network.class_of[a] == network.class_of[b] and abs(score_of([5, a, 7, b]) - score_of([5, b, 7, a])) > 1e-4


def test_a_step_goes_down_the_numerical_gradient():
    network, before, history = small_network(), small_network(), small_network()
    for part in (history.inputs, history.places, history.outputs, history.words):
        part[:] = 1e-4
    draw = np.random.default_rng(1)
    near, target = draw.integers(0, network.pad + 1, (50, 4)).astype(np.uint16), draw.integers(0, network.pad, 50).astype(np.uint16)
    loss = lambda: -before.log_probability(near, target).astype(float).mean()
    network.train(near, target, history)
    for name in ("inputs", "places", "outputs", "words"):
        part, old = getattr(network, name), getattr(before, name)
        moved = sorted(set(np.argwhere(np.abs(part - old) > 1e-3)[:, 0]))
        for row in moved[:: max(1, len(moved) // 5)]:
            gradient = np.zeros(old.shape[1])
            for u in range(old.shape[1]):
                kept, ends = old[row, u], []
                for d in (1e-2, -1e-2):
                    old[row, u] = kept + d
                    ends.append(loss())
                old[row, u] = kept
                gradient[u] = (ends[0] - ends[1]) / 2e-2
            step = lm_scoring.RATE * gradient / (math.sqrt((gradient**2).mean() + 1e-4) + 1e-6)
            assert np.abs(part[row] - (old[row] - step)).max() < 1e-2


def test_classes_hold_words_of_like_neighbours():
    """Every id has one number, no class is empty, frequent ids stand alone, and ids with the same signs stay together."""
    draw = np.random.default_rng(2)
    for size in (0, 1, lm_scoring.SINGLE, lm_scoring.SINGLE + 1, 5000):
        kind = draw.integers(0, 2, size)
        signs = np.where(kind[:, None], 1.0, -1.0) * np.eye(lm_scoring.SIGNS)[0] + draw.normal(0, 0.05, (size, lm_scoring.SIGNS))
        counts = draw.zipf(1.5, size).clip(max=10**6)
        first, number = classes(counts, signs)
        assert sorted(number) == list(range(size)) and (np.diff(first) > 0).all() and first[-1] == size
        ids = np.argsort(number)
        mixed = sum(len(set(kind[ids[a:b]])) == 2 for a, b in zip(first[:-1], first[1:], strict=True))
        assert mixed <= 1 and len(first) <= lm_scoring.SINGLE + lm_scoring.KNOWN + 1


def test_signatures_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "AROUND", 2)
    documents = [[0, 1, 2, 3, 2], [3], [], [1, 1, 0]]
    rows = spark.createDataFrame([(bytearray(np.array(d, np.uint16).tobytes()),) for d in documents], "ids binary")
    stands = np.random.default_rng(7).normal(0, 1, (5, lm_scoring.SIGNS))
    sums, met = np.zeros_like(stands), np.zeros(5)
    for d in documents:
        for k, word in enumerate(d):
            met[word] += 1
            for j in range(max(0, k - 2), min(len(d), k + 3)):
                sums[word] += stands[d[j]] if j != k else 0
    wanted = sums[:4] / met[:4, None] - sums.sum(0) / met.sum()
    found = signatures(rows, 5)
    assert np.abs(found[:4] - wanted / np.linalg.norm(wanted, axis=1, keepdims=True)).max() < 1e-4 and not found[4].any()


def test_rows_of_small_weights_are_not_added_up(monkeypatch):
    """The bound on logits comes from the largest weight; only large weights are looked at row by row, and nothing overflows."""
    added = []
    absolute = np.abs
    monkeypatch.setattr(lm_scoring.np, "abs", lambda x: added.append(len(x)) or absolute(x))
    h = np.full((3, HIDDEN + 1), 0.9, np.float32)
    for scale, rows in ((0.5, []), (50.0, [4])):
        weights = np.linspace(-scale, scale, 4, dtype=np.float32)[:, None].repeat(HIDDEN + 1, 1)
        powers, less = lm_scoring._exponentials(h, weights)
        wanted = (h.astype(float) @ weights.T.astype(float))
        assert added == rows and np.allclose(np.log(powers[:, -1]) + less, wanted[:, -1], rtol=1e-4)


def test_frequent_words_are_chosen_by_their_counts(spark):
    """All words of the least count that fits, none of a count that does not; words in order of counts."""
    counts = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([9, 7, 7, 3, 3, 3, 1])], "word string, n long")
    for most, wanted in ((0, 0), (1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (7, 7), (99, 7)):
        words = lexicon(counts, most)
        assert list(words.codes) == [f"w{k}" for k in range(wanted)] and words.counts.sum() == 33
    assert len(lexicon(counts.limit(0)).codes) == 0


def test_whole_documents_equal_a_plain_loop(spark, monkeypatch):
    """score() against counts, classes and sums from plain dictionaries, the trained network given."""
    texts = ["one two three two one", "four Five five six", None, "two two seven", ""]
    monkeypatch.setattr(lm_scoring.lexicon, "__defaults__", (3,))
    networks = []
    monkeypatch.setattr(lm_scoring, "train", lambda encoded, first, number: networks.append((Network.start(first, 9), number)) or networks[-1][0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = score(docs).toPandas().set_index("doc_id")
    counts = Counter(w for t in texts for w in tokens_of(t))
    own = sorted(counts, key=lambda w: (-counts[w], w))[:3]
    totals = Counter()
    for w, n in counts.items():
        if w not in own:
            totals[lm_scoring.ending(w)] += n
    network, number = networks[0]
    id_of = lambda w: number[own.index(w) if w in own else 3 + sorted(totals).index(lm_scoring.ending(w))]
    for doc, text in enumerate(texts):
        tokens = tokens_of(text)
        ids = [id_of(w) for w in tokens]
        wanted = sum(plain(network, ids, k)[i] + (0 if w in own else math.log(counts[w] / totals[lm_scoring.ending(w)])) for k, (i, w) in enumerate(zip(ids, tokens, strict=True)))
        assert rows.n_tokens[doc] == len(tokens) and abs(rows.log_likelihood[doc] - wanted) < 1e-3


def test_trained_network_prefers_real_order(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away " * 4
    docs = spark.createDataFrame([(k, text) for k in range(400)], "doc_id long, text string")
    words = lexicon(count_words(docs))
    rows = materialise(encode(docs, words), "test")
    first, number = classes(words.counts, signatures(rows, len(words.counts)))
    network = train(rows, first, number)
    real = number[words.encode([tokens_of(text)])[0][0]]
    of = lambda ids: network.log_probability(beside(*lines([ids], network.pad)), ids).sum()
    assert of(real) > of(np.random.default_rng(0).permutation(real)) + 10


def test_every_document_trains_once(spark, monkeypatch):
    """Null ids, one id for all, a small and a larger table: the rounds share out all rows."""
    seen = []
    taught = lm_scoring.train

    def watched(encoded, first, number, rounds=lm_scoring.ROUNDS):
        parts = [encoded.where(F.pmod("row", F.lit(rounds)) == r).agg(F.sum(F.octet_length("ids"))).first()[0] or 0 for r in range(rounds)]
        seen.append(sum(parts) // 2)
        return taught(encoded, first, number, rounds)

    monkeypatch.setattr(lm_scoring, "train", watched)
    for n, doc in ((400, None), (319, 1), (5, 7)):
        score(spark.createDataFrame([(doc, "one two three")] * n, "doc_id long, text string")).collect()
        assert seen[-1] == 3 * n


def test_rare_words_keep_their_counts(spark):
    """Words beyond the network's, with one output: their scores differ as their counts do, and
    the probabilities of an output add up to one."""
    docs = spark.createDataFrame([(1, "a a a a a a a a a a xing xing xing xing ying ying"), (2, "zing"), (3, None), (3, "a ying")], "doc_id long, text string")
    counts = count_words(docs)
    words = lexicon(counts, 1)
    rows = materialise(encode(docs, words), "test")
    joined = {r["doc_id"]: r["inside"] + (r["log_n"] or 0) for r in rows.join(own_counts(rows, counts), "row", "left").collect() if r["ids"]}
    n = 4 + 3 + 1  # all rare words end in "ing"
    assert abs(joined[1] - (4 * np.log(4 / n) + 2 * np.log(3 / n))) < 1e-9
    assert abs(joined[2] - np.log(1 / n)) < 1e-9 and abs(joined[3] - np.log(3 / n)) < 1e-9


def test_odd_rows(odd_documents, no_documents):
    rows = score(odd_documents).toPandas()
    assert len(rows) == odd_documents.count()
    empty = rows[rows.doc_id.isin([4, 5, 6])]
    assert (empty.n_tokens == 0).all() and (empty.log_likelihood == 0).all() and empty.per_token.isna().all()
    assert (rows[rows.n_tokens > 0].log_likelihood < 0).all()
    assert score(no_documents).count() == 0


def test_many_small_partitions_do_not_hand_on_a_network_each(spark):
    frame = spark.createDataFrame([(k, bytes(200)) for k in range(300)], "row long, ids binary").repartition(60)
    dealt = lm_scoring._tasks(frame, 2)
    assert dealt.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.row for r in dealt.collect()) == list(range(300))
