"""Mixture-controlled packing of documents into fixed training windows.

Every source is a queue of tokens. Deficit round-robin decides how many tokens of
each queue a window of ``window`` tokens takes: a queue earns its share of the room,
whole tokens are served, and what it is owed (or has borrowed) is carried on. The
same rule deals out a tree: the corpus to large partitions of windows, those to
smaller ones, the smallest to single windows, with the deficits carried from child
to child at each level. A node of that tree follows from the queues' totals alone,
so any task can work out the windows of its own documents and no task needs to see
another's: packing shuffles no token.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import map_batches
from .scratch import materialise, release

#: Sources that have a queue each. With more of them, those with a target and those with a share of
#: 2 / MAX_QUEUES of the characters keep theirs; the tail shares half as many queues by hash.
MAX_QUEUES = 65_536
#: Children of a node of the dealing tree at most; with many queues so few that a node has about ``CELLS`` numbers.
FAN = 512
CELLS = 1 << 17
#: Nodes, and runs of single queues, that a task remembers.
NODES, RUNS = 64, 512
#: Up to this many (partition, queue) offsets are broadcast (24 bytes each).
MAX_BROADCAST_OFFSETS = 1_000_000
#: Pieces of text whose ids a Python worker remembers, some 200 bytes each, and the longest of them.
PIECE_CACHE = 320_000
LONGEST_REMEMBERED = 64
#: Pieces encoded in one call.
PIECES_A_CALL = 2048
#: Texts cut at a time, about so many characters.
CUT_CHARACTERS = 1 << 20
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Texts with these are cut at white space only: contractions, special tokens, other scripts.
_WHOLE = f"'|<\\||[^\\x00-\\x7f{_LATIN}]"
_MARKS = f"([^{_LATIN} \n]+)"
_LETTERS = re.compile(f"[{_LATIN}]+").fullmatch


class WordEncoder:
    """Token ids of whole texts by a public tokenizer that never joins across white space, nor a letter with
    anything but letters (contractions apart), ignores case and marks the last token of a word.

    Texts are cut at spaces and line feeds and, where it holds Latin letters only and neither apostrophes nor
    special tokens, between letters and all else. That is done in Arrow, a batch at a time; each distinct piece of
    a batch is looked up or encoded once, and the ids of all pieces are gathered in Arrow too. New runs of letters
    are encoded many in one text, where the ends of words tell them apart. Of what is remembered, the half that
    was met last stays when the other goes, so frequent pieces are not learnt again.
    """

    def __init__(self, path: str, remembered: int = PIECE_CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u4") if len(vocabulary) > 65536 else np.dtype("<u2")
        self.code = "I" if self.dtype.itemsize == 4 else "H"
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = remembered

    def _apart(self, some: list[str]) -> None:
        for piece, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            self.pieces[piece] = array(self.code, coded.ids).tobytes()

    def _learn(self, missing: list[str]) -> None:
        letters = [p for p in missing if _LETTERS(p)]
        for at in range(0, len(letters), PIECES_A_CALL):
            some = letters[at : at + PIECES_A_CALL]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(some):
                self._apart(some)
                continue
            data, start = ids.tobytes(), 0
            for piece, end in zip(some, ends.tolist(), strict=True):
                self.pieces[piece] = data[start:end]
                start = end
        others = [p for p in missing if not _LETTERS(p)]
        for at in range(0, len(others), PIECES_A_CALL):
            self._apart(others[at : at + PIECES_A_CALL])

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.pieces) > self.remembered // 2:
            self.pieces, self.older = {}, self.pieces
        missing = [p for p in pieces if p not in self.pieces]
        self.pieces.update((p, self.older[p]) for p in missing if p in self.older)
        missing = [p for p in missing if p not in self.pieces]
        self._learn(missing)
        found = list(map(self.pieces.__getitem__, pieces))
        for p in missing:  # what is long is not kept: the bound counts pieces
            if len(p) > LONGEST_REMEMBERED:
                del self.pieces[p]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``self.dtype``."""
        out: list[bytes] = []
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CUT_CHARACTERS)))
            out.extend(self._encode(texts[at:stop]))
            at = stop
        pa.default_memory_pool().release_unused()  # else a worker holds on to what its largest texts took
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        flat = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = pc.utf8_lower(pc.replace_substring_regex(flat, _MARKS, r" \1 "))
        whole = pc.match_substring_regex(flat, _WHOLE)
        if pc.any(whole).as_py():
            apart = pc.if_else(whole, flat, apart)
        lists = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        data = ids.buffers()[2]
        data = data.to_pybytes() if data else b""
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        at = ends[bounds].tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


#: Encoders of this Python worker: what one task has learnt serves the next.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(path: str, remembered: int) -> WordEncoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]


def own_queue(source: str) -> str:
    return "=" + source


def queue_of(docs: DataFrame, source: Column, targets: Iterable[str] = ()) -> Column:
    """Queue of each row of ``docs``: that of its source alone, or one shared by sources of the tail."""
    alone = F.concat(F.lit(own_queue("")), source)
    if docs.select(source).distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES:
        return alone
    sizes = materialise(docs.groupBy(source.alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("n")), "source_sizes")
    least = sizes.agg(F.sum("n")).first()[0] * 2 / MAX_QUEUES
    kept = sorted({r["source"] for r in sizes.where(F.col("n") >= least).collect()}.union(targets))
    release(sizes)
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(MAX_QUEUES // 2)).cast("string"))
    return F.when(source.isin(kept), alone).otherwise(shared)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1, remembered: int = PIECE_CACHE, targets: Iterable[str] = ()) -> DataFrame:
    """doc_id, source, queue, part, local_start, n_tokens, ids (binary) of every document.

    ``local_start`` counts the tokens of the same queue before the document in its input
    partition ``part``. A null text is an empty one, so it has only the end id; a null
    source is the source ''.
    """
    docs = docs.select("doc_id", "text", "source")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    queue = queue_of(docs, source, targets)

    def each():
        encoder, part, before = encoder_of(tokenizer_path, remembered), TaskContext.get().partitionId(), {}
        end = np.array([end_id], encoder.dtype).tobytes()

        def turn(batch: pa.RecordBatch):
            queues = batch.column("queue").to_pylist()
            ids = [x + end for x in encoder.encode(batch.column("text"))]
            n = [len(x) // encoder.dtype.itemsize for x in ids]
            starts = []
            for q, k in zip(queues, n, strict=True):
                starts.append(before.get(q, 0))
                before[q] = starts[-1] + k
            return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "queue": queues, "part": [part] * len(n), "local_start": starts, "n_tokens": n, "ids": ids}

        return turn

    return map_batches(
        docs.select("doc_id", "text", source.alias("source"), queue.alias("queue")),
        "doc_id long, source string, queue string, part int, local_start long, n_tokens long, ids binary",
        each,
    )


def deal(quota: np.ndarray, rooms: list[int], weights: np.ndarray) -> np.ndarray:
    """Deficit round-robin: tokens that each room (row) takes of each queue (column).

    All rooms are filled, all of ``quota`` is dealt: the rooms must hold its sum.
    Deficits carry from room to room; an empty queue earns nothing.
    """
    left, deficit = quota.astype(np.int64).copy(), np.zeros(len(quota))
    served = np.zeros((len(rooms), len(quota)), np.int64)
    for row, room in zip(served[:-1], rooms[:-1], strict=True):
        earn = True
        while room > 0:
            live = left > 0
            if earn:
                share = np.where(live, weights, 0.0)
                if share.sum() <= 0:
                    share = left.astype(float)
                deficit = np.where(live, deficit + share * (room / share.sum()), 0.0)
            take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
            if take.sum() > room:  # borrowers elsewhere: serve the largest debts first
                order = np.argsort(-deficit, kind="stable")
                upto = np.cumsum(take[order])
                take[order] = np.clip(take[order] - np.maximum(upto - room, 0), 0, None)
            earn = bool((take == left)[live].any())  # a queue ran dry: deal its part anew
            if not take.sum():  # only fractions are owed: one token each, largest debt first
                order = np.argsort(np.where(live, -deficit, np.inf), kind="stable")
                take[order[: min(room, int(live.sum()))]] = 1
                take = np.minimum(take, left)
                earn = False
            deficit -= take
            left -= take
            row += take
            room -= int(take.sum())
    served[-1] = left
    return served


class Mixture:
    """Which window and offset each token of each queue falls in, from the queues' totals."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int):
        self.window = window
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(weights if weights is not None else totals, float)
        self.tokens = int(self.totals.sum())
        self.windows = -(-self.tokens // window)
        self.fan = max(2, min(FAN, CELLS // max(1, len(totals))))
        self.levels = 1
        while self.fan**self.levels < self.windows:
            self.levels += 1
        self.nodes: OrderedDict[tuple[int, int], tuple] = OrderedDict()
        self.runs: dict[int, tuple] = {}

    def _node(self, level: int, index: int):
        """(start of each child in each queue, queues' tokens of each child, tokens of the queues before) of a node."""
        found = self.nodes.get((level, index))
        if found is None:
            if level == self.levels:
                quota, start, weights = self.totals, np.zeros_like(self.totals), self.weights
            else:
                starts, served, _ = self._node(level + 1, index // self.fan)
                quota, start = served[index % self.fan], starts[index % self.fan]
                weights = quota.astype(float)
            span = self.fan ** (level - 1) * self.window
            first = index * self.fan**level * self.window
            rooms = []
            for child in range(self.fan):
                at = first + child * span
                if at >= self.tokens:
                    break
                rooms.append(min(span, self.tokens - at))
            held = np.flatnonzero(quota)  # low in the tree a node has few of many queues
            served = np.zeros((len(rooms), len(quota)), np.int64)
            served[:, held] = deal(quota[held], rooms, weights[held])
            inside = np.cumsum(served, 1) - served if level == 1 else None
            found = (start + np.vstack([np.zeros_like(quota), np.cumsum(served, 0)[:-1]]), served, inside)
            self.nodes[level, index] = found
            if len(self.nodes) > NODES:
                self.nodes.popitem(last=False)
        else:
            self.nodes.move_to_end((level, index))
        return found

    def _runs(self, queue: int, start: int):
        """First window, starts, ends and offsets of ``queue`` in the windows of the node that holds ``start``."""
        found = self.runs.get(queue)
        if found is None or not found[1][0] <= start < found[2][-1]:
            index = 0
            for level in range(self.levels, 1, -1):
                starts, _, _ = self._node(level, index)
                index = index * self.fan + int(np.searchsorted(starts[:, queue], start, "right")) - 1
            starts, served, inside = self._node(1, index)
            own = starts[:, queue]
            found = (index * self.fan, own.tolist(), (own + served[:, queue]).tolist(), inside[:, queue].tolist())
            if len(self.runs) >= RUNS:
                self.runs.clear()
            self.runs[queue] = found
        return found

    def pieces(self, queue: int, start: int, length: int):
        """(sequence, offset in it, tokens) of the parts of a run of ``queue``."""
        end = start + length
        while start < end:
            first, starts, stops, inside = self._runs(queue, start)
            child = bisect_right(starts, start) - 1
            while start < end and child < len(starts):
                stop = stops[child]
                if stop > start:
                    take = min(stop, end) - start
                    yield first + child, inside[child] + start - starts[child], take
                    start += take
                if start >= stop:
                    child += 1


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    targets: dict[str, float] | None = None,
    end_id: int = 1,
    remembered: int = PIECE_CACHE,
) -> DataFrame:
    """Cut all documents into windows of at most ``window`` tokens, mixed by source.

    ``targets`` are token shares by source name; without them each source has its share
    of the corpus, so that all queues end together. A source without a target gets its
    share once those with one have run out. Each source has a queue of its own; only beyond ``MAX_QUEUES`` of them do those
    without a target and with less than 2 / ``MAX_QUEUES`` of the characters share queues, which hold their share together. Rows: doc_id, source, start,
    length, ids (little-endian uint32), doc_tokens, sequence_id, offset, padded_length (of
    the sequence: ``window``, or its own length where that is a power of two).

    Null texts and sources count as empty; a null doc_id stays null; repeated rows are
    packed as often as they occur; an empty table gives no rows; other columns are ignored.
    Only queue totals (a row a source, at most ``MAX_QUEUES`` and one per target) reach the driver and each task.
    """
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, tokenizer_path, end_id, remembered, targets or ()), "tokens")
    by_part = materialise(tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "token_offsets")
    totals = {r["queue"]: r["n"] for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return spark.createDataFrame([], "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length int")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if by_part.count() <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, ["queue", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")
    number = {q: i for i, q in enumerate(names)}
    counts = [totals[q] for q in names]
    shares = None
    if targets:
        wanted = {own_queue(source): float(share) for source, share in targets.items()}  # no source with a target shares a queue
        shares = [wanted.get(q, 0.0) for q in names]

    def each():
        mix = Mixture(counts, shares, window)
        last_length = mix.tokens - (mix.windows - 1) * window

        def turn(batch: pa.RecordBatch):
            columns = ("doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length")
            out: list[tuple] = []
            size = 0
            for doc, source, queue, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "at", "n_tokens", "ids")), strict=True):
                width = len(ids) // n
                wide = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
                done = 0
                for sequence, offset, take in mix.pieces(number[queue], at, n):
                    length = last_length if sequence == mix.windows - 1 else window
                    padded = length if length & (length - 1) == 0 else window
                    out.append((doc, source, done, take, wide[4 * done : 4 * (done + take)], n, sequence, offset, padded))
                    done += take
                size += len(wide)
                if size > 16 << 20:
                    yield dict(zip(columns, zip(*out), strict=True))
                    out, size = [], 0
            if out:
                yield dict(zip(columns, zip(*out), strict=True))

        return turn

    return map_batches(placed, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length int", each)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tokens (binary uint32, without padding), padded_length of each window.

    A window has at most ``window`` pieces, so a group is small at any corpus size.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda joined, x: F.concat(joined, x["ids"])).alias("tokens"),
        F.first("padded_length").alias("padded_length"),
    )
