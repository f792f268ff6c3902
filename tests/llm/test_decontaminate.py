import hashlib
import random
import re

from sentrylake.llm import decontaminate
from sentrylake.llm.decontaminate import drop_contaminated, find, report

from .conftest import prose


def words_of(text):
    """Words as the contract has them, A-Z lowered."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    words, hit, found = words_of(text), set(), []
    for item, body in items:
        own = words_of(body)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        places = [k for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in windows]
        if places:
            found.append(item)
            hit.update(p + j for p in places for j in range(n))
    return len(words), len(hit), sorted(found)


def test_equals_brute_force(spark):
    draw = random.Random(2)
    items = [(k, prose(100 + k, draw.choice([3, 9, 10, 11, 40]))) for k in range(20)] + [(20, "!!"), (21, None), (22, "Rare Word")]
    docs = []
    for k in range(60):
        words = prose(k, 120).split()
        if k % 2:
            own = draw.choice(items[:20])[1].upper().split()
            words[30:30] = own[: draw.randrange(1, len(own) + 1)]
        docs.append((k, ", ".join(words) + (" rare WORD" if k % 7 == 0 else "")))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {i: brute(t, items) for i, t in docs}
    for r in find(frame, benchmark).collect():
        assert (r["n_words"], sum(e - s for s, e in r["spans"]), r["item_ids"]) == expected[r["doc_id"]]
    clean = {r["doc_id"] for r in drop_contaminated(frame, benchmark).collect()}
    assert clean == {i for i, e in expected.items() if not e[1]}


def test_odd_rows_and_empty_tables(spark, odd_documents, no_documents):
    benchmark = spark.createDataFrame([(1, "one"), (1, "one"), (None, "x"), (2, None)], "item_id long, text string")
    rows = report(odd_documents, benchmark).toPandas()
    assert len(rows) == odd_documents.count()
    assert set(rows[rows.contaminated].doc_id) == {7, 8} and rows[rows.doc_id == 4].n_words.iloc[0] == 0
    assert report(no_documents, benchmark).count() == 0
    assert not report(odd_documents, benchmark.limit(0)).where("contaminated").count()
    assert drop_contaminated(odd_documents, benchmark).columns == odd_documents.columns


def test_several_passes_give_the_same(spark, monkeypatch):
    """A benchmark in parts: hits of one document from several parts, overlapping and beside each other; reports by the contract."""
    draw = random.Random(9)
    items = [(k, prose(500 + k, draw.choice([4, 10, 25]))) for k in range(30)] + [(30, None), (31, "É-É ß")]
    docs = []
    for k in range(40):
        words = prose(900 + k, 60).split()
        for _ in range(k % 4):
            own = draw.choice(items[:30])[1].split()
            words[20:20] = own
        docs.append((k, " ".join(words) + (" é É ß" if k % 5 == 0 else "")))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1]), (None, docs[2][1])]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(r)
    once = sorted(map(key, report(frame, benchmark).collect()), key=str)
    left = sorted(map(str, drop_contaminated(frame, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", 120)
    assert len(decontaminate._passes(benchmark, 10)) > 3
    assert sorted(map(key, report(frame, benchmark).collect()), key=str) == once and sorted(map(str, drop_contaminated(frame, benchmark).collect())) == left
    expected = []
    for doc, text in docs:
        n, hit, ids = brute(text, [(i, t or "") for i, t in items])
        expected.append((doc, n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0))
    assert once == sorted(expected, key=str)
