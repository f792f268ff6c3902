import random
import re

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import minhash
from sentrylake.llm.minhash import PARITY, keep_first, near_duplicates, parity

from .conftest import prose


def shingles(text):
    """The set as the contract has it, of words, not hashes."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_equals_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for base in range(6):
        words = prose(base, 80).split()
        for _ in range(12):
            own = list(words)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, f"w{k % 3} x y") for k in range(6)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(found.doc_id, found.component_id)) == brute(rows)


def test_odd_rows(odd_documents):
    found = near_duplicates(odd_documents).toPandas()
    assert len(found) == odd_documents.count()
    component = found.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").component_id
    assert component[2] == 1 and component[8] == 7 and component[5] == 5 and component[6] == 6
    assert found[found.doc_id.isna()].kept.all()
    kept = keep_first(odd_documents).toPandas()
    assert list(kept.columns) == odd_documents.columns
    assert sorted(kept.doc_id.dropna()) == sorted(set(found[found.kept].doc_id.dropna()))


def test_empty_table(no_documents):
    assert near_duplicates(no_documents).count() == 0


def test_parity_bounds_the_difference():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(draw.integers(-(2**62), 2**62, 300))
        b = np.unique(np.concatenate([a[: draw.integers(1, 300)], draw.integers(-(2**62), 2**62, 50)]))
        bits = sum(int(x).bit_count() for x in (parity(a) ^ parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and PARITY == 512


def long_rows():
    """Sets larger than any sketch, edited by chains of small steps, documents that share a hot passage, and words in other cases and spaces."""
    draw = random.Random(11)
    rows = []
    for base in range(4):
        words = prose(40 + base, 420).split()
        for _ in range(10):
            for _ in range(draw.randrange(1, 12)):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    passage = prose(99, 150)
    for k in range(40):
        rows.append((len(rows), f"{prose(200 + k, 30)} {passage} {prose(300 + k, draw.choice([5, 20, 60]))}"))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, rows[1][1].replace(" ", "\t\n")), (len(rows) + 2, "É é ñ Ñ a b c"), (len(rows) + 3, "É É ñ Ñ A b c"), (len(rows) + 4, "one\u00a0two three four five")]
    return rows


def test_large_sets_and_hot_passages(spark):
    rows = long_rows()
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert found.component_id.to_dict() == brute(rows) and found.n_shingles.to_dict() == {i: len(shingles(t)) for i, t in rows}


def test_further_rounds_and_shuffles_give_the_same(spark, monkeypatch):
    """One pivot a round, lists split into shares, and no broadcast of ids."""
    rows = long_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "PIVOTS", (1, 1))
    monkeypatch.setattr(minhash, "SHARE", 7)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_IDS", 3)
    wanted = brute(rows)
    assert near_duplicates(frame).toPandas().set_index("doc_id").component_id.to_dict() == wanted
    assert sorted(r["doc_id"] for r in keep_first(frame).collect()) == sorted(i for i, c in wanted.items() if i == c)


def test_sizes_on_both_sides_of_the_whole_sets(spark, monkeypatch):
    """Partners of which one is listed by all its values and the other by a sketch, or both in either way."""
    monkeypatch.setattr(minhash, "WHOLE", 160)
    draw = random.Random(3)
    rows = []
    for base in range(5):
        words = prose(60 + base, 240).split()
        for k in range(14):
            own = words[: 240 - 10 * k]
            for _ in range(draw.randrange(5)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(found.doc_id, found.component_id)) == brute(rows)


def test_entries_of_a_hot_list_do_not_come_back(spark, monkeypatch):
    """Documents that share most of their text but are not similar: exact sets list few of their values, and what no
    marked entry is left for is not looked at again."""
    passage = prose(77, 100)
    rows = [(k, f"{prose(500 + k, 22)} {passage} {prose(900 + k, 10)}") for k in range(300)]
    entries = []
    written = minhash.materialise

    def counted(frame, name):
        out = written(frame, name)
        if name == "placed":
            entries.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(found.doc_id, found.component_id)) == brute(rows)
    assert sum(entries[1:]) <= 2 * entries[0]


def test_rows_of_one_id(spark):
    """Different texts under one id: one of them stands for all, in every order of the rows."""
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, a), (4, a)]
    seen = set()
    for order in (rows, rows[::-1]):
        found = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).toPandas()
        assert len(found) == len(rows)
        seen.add(str(sorted(set(zip(found.doc_id, found.component_id)))))
        kept = keep_first(spark.createDataFrame(order, "doc_id long, text string")).toPandas()
        assert kept.doc_id.is_unique and 1 in set(kept.doc_id)
    assert len(seen) == 1


def test_noisy_copies_of_a_long_text_are_ruled_out_by_what_they_have_left(spark, monkeypatch):
    """Copies that each keep too little of one text to be similar to others: no entry of theirs may be compared again
    and again in lists of that text's values."""
    draw = random.Random(8)
    base = prose(31, 460).split()
    rows = [(0, " ".join(base)), (1, " ".join(base[:440]))]
    for k in range(2, 150):
        own = list(base)
        for at in draw.sample(range(460), 14 if k % 10 == 0 else 21):
            own[at] = f"edit{draw.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    looked_at = []
    written = minhash.materialise

    def counted(frame, name):
        out = written(frame, name)
        if name == "placed":
            each = out.groupBy("value").agg(F.count(F.lit(1)).alias("entries"), F.count_if("pivot").alias("pivots"))
            looked_at.append(each.agg(F.coalesce(F.sum(F.col("entries") * F.col("pivots")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    wanted = brute(rows)
    assert dict(zip(found.doc_id, found.component_id)) == wanted
    assert sum(i == c for i, c in wanted.items()) > 50  # most stay alone
    assert sum(looked_at[1:]) <= 20 * len(rows)


def test_what_sets_have_left_bounds_their_similarity(spark):
    rows = [(n, m, shared) for n in range(1, 30, 3) for m in range(1, 30, 4) for shared in range(min(n, m) + 1)]
    frame = spark.createDataFrame(rows, "n long, m long, shared int")
    judged = frame.select("*", minhash.may_share(F.col("n"), F.col("m"), F.col("shared"), 75).alias("may")).collect()
    assert all(r.may == (100 * r.shared >= 75 * (r.n + r.m - r.shared)) for r in judged)
