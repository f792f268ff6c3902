from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sentrylake.llm import packing
from sentrylake.llm.packing import Mixture, WordEncoder, deal, pack, sequences
from sentrylake.llm.queries import tokenizer_path


@pytest.mark.parametrize("text", ["Don't stop", "a<|endoftext|>b", "x\ty", "İx.", "naïve, ÉTÉ... 3.14", "é o", "ж1é²", "", "a\x1cb\xa0c", "_x_ y-z"])
def test_encoder_equals_the_tokenizer(text):
    own, whole = WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    found = own.encode(pa.array([None, text, "x " + text, text * 2]))
    for ids, wanted in zip(found, ("", text, "x " + text, text * 2), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == whole.encode(wanted, add_special_tokens=False).ids


def test_frequent_pieces_are_learnt_once_and_few_are_kept(monkeypatch):
    """A piece that every batch holds stays when the encoder forgets others; ids are the tokenizer's."""
    own, whole = WordEncoder(tokenizer_path(), remembered=40), Tokenizer.from_file(tokenizer_path())
    learnt, teach = Counter(), own._learn
    monkeypatch.setattr(own, "_learn", lambda missing: (learnt.update(missing), teach(missing)))
    for k in range(30):
        text = "common " + " ".join("word" + chr(97 + k % 26) * (1 + k // 26) + chr(97 + j) for j in range(10))
        assert np.frombuffer(own.encode(pa.array([text]))[0], own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert learnt["common"] == 1 and len(own.pieces) + len(own.older) <= 40 + 2 * 11


def test_deal_fills_rooms_and_keeps_the_mixture():
    served = deal(np.array([600, 300, 100]), [100] * 10, np.array([0.6, 0.3, 0.1]))
    assert (served.sum(1) == 100).all() and served.sum(0).tolist() == [600, 300, 100]
    assert abs(served - np.array([60, 30, 10])).max() <= 1


def test_every_token_lies_in_one_piece(odd_documents):
    rows = pack(odd_documents, tokenizer_path(), window=256).toPandas()
    whole = Tokenizer.from_file(tokenizer_path())
    texts = odd_documents.toPandas()
    assert rows[rows.start == 0].shape[0] == len(texts)
    for doc in (1, 9, 12):
        own = rows[rows.doc_id == doc].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == [*whole.encode(texts[texts.doc_id == doc].text.iloc[0], add_special_tokens=False).ids, 1]
        assert (own.start.to_numpy() == np.cumsum([0, *own.length[:-1]])).all()
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.offset.to_numpy() == np.cumsum([0, *group.length[:-1]])).all() and group.length.sum() <= 256
    sizes = rows.groupby("sequence_id").length.sum()
    assert (sizes[sizes.index < sizes.index.max()] == 256).all()


@pytest.mark.parametrize("sources", [200, 300, 3000])
def test_every_source_has_its_share_of_every_window(sources):
    """Equal sources have a queue each, however many: no full window departs from a share by two tokens."""
    mix = Mixture([700] * sources, None, 2048)
    taken = np.zeros((mix.windows, sources), int)
    places = []
    for queue in range(sources):
        for window, offset, n in mix.pieces(queue, 0, 700):
            taken[window, queue] += n
            places.append((window, offset, n))
    assert taken.sum(0).tolist() == [700] * sources and (taken.sum(1)[:-1] == 2048).all()
    assert abs(taken[:-1] - 2048 / sources).max() < 2
    end = 0
    for window, offset, n in sorted(places):
        assert window * 2048 + offset == end
        end += n


def test_more_sources_than_queues_keep_targets_shares_and_names(spark, monkeypatch):
    """Targets hold, a large source has its share of every window, names are true."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 256)
    big = [(k, "one two three four " * 8, "big") for k in range(300)]
    small = [(1000 + k, "five six seven eight " * 8, "queue 17" if k == 0 else f"s{k}") for k in range(600)]
    docs = spark.createDataFrame(big + small, "doc_id long, text string, source string").coalesce(2)
    rows = pack(docs, tokenizer_path(), window=256).toPandas()
    assert rows.groupby("doc_id").source.first().to_dict() == {d: s for d, _, s in big + small}
    full = rows[rows.sequence_id < rows.sequence_id.max()]
    share = full[full.source == "big"].groupby("sequence_id").length.sum() / 256
    assert share.size == full.sequence_id.nunique() and ((share - 1 / 3).abs() < 0.02).all()

    rows = pack(docs, tokenizer_path(), window=256, targets={"s1": 0.25, "big": 0.75}).toPandas()
    first = rows[rows.sequence_id == 0].groupby("source").length.sum()
    s1 = rows[rows.source == "s1"].length.sum()
    assert first["s1"] == min(s1, 64) and first["big"] == 256 - first["s1"]


def test_sequences_join_their_pieces(odd_documents):
    pieces = pack(odd_documents, tokenizer_path(), window=256)
    joined = sequences(pieces).toPandas()
    assert (joined.tokens.map(len) // 4).sum() == pieces.toPandas().length.sum()


def test_empty_table(no_documents):
    assert pack(no_documents, tokenizer_path()).count() == 0


def test_all_documents_equal_the_tokenizer(spark):
    """Every id of every document, its places without gaps, and the corpus' shares in every full window."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = Tokenizer.from_file(tokenizer_path())
    rows = pack(docs, tokenizer_path()).toPandas()
    texts = docs.select("doc_id", "text", "source").toPandas()
    wanted = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in zip(texts.doc_id, texts.text)}
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == wanted[doc]
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and (own.doc_tokens == len(wanted[doc])).all()
    assert set(rows.doc_id) == set(wanted)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
    sizes = rows.groupby("sequence_id").length.sum()
    assert (sizes.sort_index()[:-1] == 2048).all()
    share = rows.groupby("source").length.sum() / rows.length.sum()
    full = rows[rows.sequence_id < rows.sequence_id.max()].pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0) / 2048
    assert (full - share[full.columns]).abs().max().max() < 0.005
