import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sentrylake.llm.divergence import _pairs_of_runs, audit, partial_runs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def by_hand(rows, least, top):
    """Every group against every kept term, in plain whole numbers."""
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        terms = TERM.findall(text.translate(LOWER))
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    kept = {lang: {t for t, n in documents[lang].items() if n >= least} for lang, _ in groups}
    whole = {lang: sum((counts[g] for g in groups if g[0] == lang), Counter()) for lang in kept}

    def shares(count, lang):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p, q = shares(counts[lang, source], lang), shares(whole[lang], lang)
        pairs = [(sum(abs(p[t] - o[t]) for t in p), other) for la, other in groups if la == lang and other != source for o in [shares(counts[lang, other], lang)]]
        terms = [(p[t] - q[t], t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def of(spark, rows):
    docs = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, count int, term string")
    return docs.repartition(5)


def made(seed, documents, sources, langs=("en", "de", None)):
    draw = random.Random(seed)
    words = ["und", "the", "Straße", "ÉCOLE", "école", "a1b", "x.y", "ПРИВЕТ", "漢字", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    rows = [(" ".join(draw.choice(words[: draw.randrange(3, len(words))]) for _ in range(draw.randrange(30))), draw.choice(langs), draw.choice(sources)) for _ in range(documents)]
    return [*rows, (None, "en", "s1"), ("", "en", "empty"), ("... 123 !", "xx", None), (None, None, None), ("the THE the", "fr", "only"), ("the " * 200_000, "en", "s1"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 5), (2, 1, 50), (3, 400, 5)])
def test_equals_whole_numbers_by_hand(spark, seed, least, top):
    rows = made(seed, 150, ["s1", "s1", "s1", "s2", "S2", "é", None, "", *(f"t{k}" for k in range(9))])
    assert sorted(tuple(r) for r in audit(of(spark, rows), least, top).collect()) == by_hand(rows, least, top)


def test_empty_table(spark):
    assert audit(of(spark, [])).count() == 0
    assert audit(of(spark, [("a b", "en", "s")] * 3), 2).count() == 0  # one source: no pairs, no share above its language's


def test_small_memory_gives_the_same(spark):
    """Partial sums that are handed on early, of terms and of pairs, add up to the same; a run may be cut anywhere."""
    rows = made(4, 200, [f"s{k}" for k in range(30)])
    docs = of(spark, rows)
    total = lambda df: sorted(tuple(r) for r in df.groupBy("lang", "term", "source").agg(F.sum("documents"), F.sum("occurrences")).collect())
    assert total(partial_runs(docs, 7)) == total(partial_runs(docs)) and partial_runs(docs, 7).count() > partial_runs(docs).count()
    draw = random.Random(1)
    shares = spark.createDataFrame([(la, f"t{k:03d}", f"s{s:02d}", draw.randrange(1, 10**9), 3 + s) for la in ("a", "b") for k in range(40) for s in range(30) if draw.random() < 0.7], "lang string, term string, source string, p long, p0 long")
    shares = shares.repartition(3, "lang", "term").sortWithinPartitions("lang", "term", "source")
    summed = lambda df: sorted(tuple(r) for r in df.groupBy("lang", F.least("a", "b"), F.greatest("a", "b")).agg(F.sum("value")).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert summed(_pairs_of_runs(shares, 20)) == summed(_pairs_of_runs(shares))
        assert sorted(tuple(r) for r in audit(docs, 3, 5).collect()) == by_hand(rows, 3, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counts_beyond_64_bits(spark):
    """Shares are taken of decimal numbers: ten to the ninth times a count does not overflow."""
    from sentrylake.llm.divergence import _share

    got = spark.range(1).select(_share(F.lit(5_000_000_000_000), F.lit(7_000_000_000_000), F.lit(3_000_000)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (5_000_000_000_000 + 5) // (7_000_000_000_000 + 15_000_000)
