import numpy as np

from sentrylake.llm import langid, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    truth = labels.toPandas()
    toxic = toxicity.score_held_out(docs, labels).toPandas().merge(truth, on="doc_id")
    good = quality.score_held_out(docs, labels).toPandas().merge(truth, on="doc_id")
    language = langid.identify_held_out(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (toxic.predicted == toxic.toxic)[toxic.held_out].mean() >= 0.93
    assert (good.predicted == good.quality)[good.held_out].mean() >= 0.95
    assert (language.lang_pred == language.lang)[language.held_out].mean() >= 0.98


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (10, None, None), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_held_out, quality.score_held_out):
        for docs, known in ((odd_documents, labels), (odd_documents, labels.limit(0)), (no_documents, labels)):
            rows = score(docs, known).toPandas()
            assert len(rows) == docs.count() and rows.score.between(0, 1).all() and not rows.predicted.isna().any()
    kept = quality.keep_good(odd_documents, labels.select("doc_id", labels.quality.alias("label")))
    assert kept.columns == odd_documents.columns
    told = langid.identify_held_out(odd_documents).toPandas()
    assert len(told) == odd_documents.count() and (told[told.doc_id.isin([4, 5, 6, 11])].lang_pred == "und").all()
    assert langid.identify_held_out(no_documents).count() == 0
    assert langid.keep_identified(odd_documents, None).count() == odd_documents.count()


def test_label_model_finds_accuracies_and_correlation():
    draw = np.random.default_rng(0)
    truth = draw.random(20000) < 0.2
    fires = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.3, 0.35]])
    votes = draw.random((20000, 4)) < np.where(truth[:, None], fires[:, 1], fires[:, 0])
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that only repeats the first
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    known = np.zeros((len(patterns), 2))
    for p, y in zip(place.ravel()[:500], truth[:500]):
        known[p, int(y)] += 1
    model = toxicity.fit_label_model(patterns, counts, known)
    assert abs(model.prior - 0.2) < 0.05 and model.fires[1, 0] > 0.5 > 0.1 > model.fires[0, 0]
    assert model.correlation[0, 4] > 0.9 and model.weight[0] < 0.6 < model.weight[1]


def test_pairs_teach_a_ranking():
    draw = np.random.default_rng(0)
    rows = draw.random((400, len(quality.STATISTICS))).astype(np.float32)
    good = rows[:, 3] < 0.5
    ranking = quality.learn(rows, good, pairs=5000)
    scores = ranking.scores(rows)
    assert scores[good].mean() > scores[~good].mean() + 1
    assert quality.learn(rows, np.ones(400, bool)) is None


def test_small_languages_are_drawn_whole(spark):
    rows = [(k, "the old house by the river was sold", "en") for k in range(2000)] + [(5000 + k, "zażółć gęślą jaźń wśród łąk", "pl") for k in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bound=20)
    assert langid.predict(["łąka wśród gęśli"], model)[0] == ["pl"]
    assert abs(model.log_prior[1] - np.log(4 / 2005)) < 1e-9
    assert langid.shares([2000, 3], 20) == [17 / 2000, 1.0] and langid.shares([5, 5], 20) == [1.0, 1.0]


def test_languages_equal_a_plain_loop(spark, monkeypatch):
    """Counts, log-probabilities and posteriors from plain dictionaries of n-grams, for texts that
    lie across slices; whatever is no letter is `und`, in planes of no letters too."""
    monkeypatch.setattr(langid, "PIECE", 64)
    taught = [("the cat, the hat", "en"), ("der Hut und die Katze 12", "de"), ("le chat et le chapeau", "fr"), ("", "fr")]
    docs = spark.createDataFrame([(k, t, la) for k, (t, la) in enumerate(taught)], "doc_id long, text string, lang string")
    model = langid.train(docs)

    def grams(text):
        clean = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        codes = [ord(c) for c in f" {clean} "] if clean else [32]
        for order in langid.ORDERS:
            for at in range(len(codes) - order + 1):
                mixed = 0
                for k in range(order):
                    mixed = (mixed ^ codes[at + k]) * int(langid._FACTORS[k]) % 2**32
                    mixed ^= mixed >> 15
                yield ((mixed + order) * int(langid._FACTORS[0]) % 2**32) >> 17

    counts = {la: np.full(langid.BUCKETS, 0.5) for la in ("de", "en", "fr")}
    for t, la in taught:
        for g in grams(t):
            counts[la][g] += 1
    prior = {"de": 2 / 7, "en": 2 / 7, "fr": 3 / 7}
    texts = ["the hut", "katze " * 100, "", None, "chat", "12 !", chr(0xF0000), chr(0xE0100), "a\0b", "\0", chr(0x2EBF0) + " chat", "x" * 300]
    languages, scores = langid.predict(texts, model)
    for text, found, score in zip(texts, languages, scores):
        if not text or not any(map(str.isalpha, text)):
            assert (found, score) == ("und", 0.0)
            continue
        odds = {la: np.log(prior[la]) + sum(np.log(c[g] / c.sum()) for g in grams(text)) for la, c in counts.items()}
        best = max(odds, key=odds.get)
        assert found == best and abs(score - 1 / sum(np.exp(x - odds[best]) for x in odds.values())) < 1e-3


def test_label_model_equals_plain_loops():
    """Two rounds of expectation maximisation by loops over documents."""
    draw = np.random.default_rng(3)
    truth = draw.random(400) < 0.3
    votes = draw.random((400, 3)) < np.where(truth[:, None], [0.8, 0.6, 0.5], [0.05, 0.1, 0.3])
    label = [int(t) if draw.random() < 0.2 else None for t in truth]
    patterns, place = np.unique(votes, axis=0, return_inverse=True)
    place = place.ravel()
    counts, known = np.bincount(place), np.zeros((len(patterns), 2))
    for p, y in zip(place, label):
        if y is not None:
            known[p, y] += 1
    found = toxicity.fit_label_model(patterns, counts, known, rounds=2)

    fires = np.array([[(sum(votes[i, v] for i in range(400) if label[i] == y) + 0.5) / (label.count(y) + 1) for v in range(3)] for y in (0, 1)])
    prior, weight, gold = label.count(1) / (label.count(0) + label.count(1)), np.ones(3), np.array([0.05, 0.95])
    for _ in range(2):
        p = []
        for i in range(400):
            odds = np.log(prior / (1 - prior))
            for v in range(3):
                a, b = (fires[1, v], fires[0, v]) if votes[i, v] else (1 - fires[1, v], 1 - fires[0, v])
                odds += weight[v] * np.log(a / b)
            if label[i] is not None:
                odds += np.log(gold[1] / gold[0]) if label[i] else np.log((1 - gold[1]) / (1 - gold[0]))
            p.append(1 / (1 + np.exp(-odds)))
        p = np.array(p)
        mass = np.array([1 - p, p])
        fires = np.array([[(sum(mass[y] * votes[:, v]) + 0.5) / (mass[y].sum() + 1) for v in range(3)] for y in (0, 1)])
        prior = mass[1].sum() / 400
        says = [[sum(mass[y][i] for i in range(400) if label[i] == s) for s in (0, 1)] for y in (0, 1)]
        gold = np.array([(says[y][1] + (0.05, 0.95)[y]) / (sum(says[y]) + 1) for y in (0, 1)])
        covariance = sum(mass[y][i] * np.outer(votes[i] - fires[y], votes[i] - fires[y]) for y in (0, 1) for i in range(400)) / 400
        spread = np.sqrt(np.diag(covariance))
        correlation = covariance / np.outer(spread, spread)
        np.fill_diagonal(correlation, 1)
        weight = 1 / np.maximum(correlation, 0).sum(1)
    assert np.allclose(found.fires, fires) and abs(found.prior - prior) < 1e-9 and np.allclose(found.gold, gold) and np.allclose(found.weight, weight)


def test_unlabelled_documents_train_the_classifier(spark):
    """A word that only unlabelled documents hold, always beside a voter's word, gets weight."""
    rows = [(k, "calm words of the day" if k % 2 else "you idiot and fool strangeword") for k in range(400)]
    docs = spark.createDataFrame([*rows, *((1000 + k, "you idiot unheard" if k % 2 else "calm unseen") for k in range(200)), (9000, "unheard"), (9001, "unseen"), (9002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(400)], "doc_id long, label int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert found[0] > 0.5 > found[1] and found[1001] > 0.5 > found[1000] and 0 <= found[9002] <= 1


def test_ranking_and_threshold_over_spark(spark):
    """The Bradley-Terry scores of a table equal those of plain numpy, and the cut lies in the widest gap near the share."""
    docs, labels = tables(spark)
    known = quality.training_labels(labels)
    table = quality.materialise(quality.measured(docs.select("doc_id", "text")), "test")
    ranking, cut = quality.fit(table, known)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    plain = {}
    for doc, t in text.items():
        row = quality.statistics(t)
        plain[doc] = sum(ranking.weights[f * (ranking.cuts.shape[1] + 1) + int((row[f] > ranking.cuts[f]).sum())] for f in range(len(row)))
    spread = {r["doc_id"]: r["raw"] for r in quality._raw(table, ranking).collect()}
    assert max(abs(plain[d] - spread[d]) for d in plain) < 1e-6
    share = 1 - np.mean([r["label"] for r in known.where("label is not null and doc_id is not null").collect()])
    below = np.mean([x < cut for x in plain.values()])
    assert abs(below - share) <= quality.SLACK + 0.01
    assert all((r["score"] >= 0.7) == (spread[r["doc_id"]] >= cut) or abs(spread[r["doc_id"]] - cut) < 1e-6 for r in quality.score(docs, known).collect())
