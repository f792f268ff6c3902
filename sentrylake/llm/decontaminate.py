"""Benchmark decontamination by Wu-Manber search for many word windows at once.

The alphabet is words. For the windows of one length m, a shift table over blocks of two
words says how far the search may move on without missing a window's end; where it may
not move, the bucket of that suffix block holds the windows to compare directly.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keep_rows, map_batches

WINDOW = 10
#: Benchmark words that one search may hold in memory; a larger benchmark is searched for
#: in several passes over the documents.
WORDS_A_PASS = 250_000

#: Bytes that are part of a word once A-Z are lowered: digits, a-z and all of non-ASCII.
_TO_SPACE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, split at ASCII characters other than digits and letters."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split() if text else []


class Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.windows = length, windows
        self.block = min(2, length)
        self.most = length - self.block + 1
        #: block of words -> how far the search may move on when the block ends at its place
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: suffix block -> windows that end with it
        self.bucket: dict[tuple[bytes, ...], set[tuple[bytes, ...]]] = {}
        for window in windows:
            for end in range(self.block, length + 1):
                piece = window[end - self.block : end]
                self.shift[piece] = min(self.shift.get(piece, self.most), length - end)
            self.bucket.setdefault(window[-self.block :], set()).add(window)

    def occurrences(self, words: list[bytes]):
        """(start, window) of each occurrence in ``words``."""
        length, most, shift, block = self.length, self.most, self.shift.get, self.block
        at, n = length, len(words)  # at: the place just after the window that is looked at
        if block == 2:
            while at <= n:
                move = shift((words[at - 2], words[at - 1]), most)
                if move:
                    at += move
                    continue
                found = tuple(words[at - length : at])
                if found in self.bucket[found[-2:]]:
                    yield at - length, found
                at += 1
        else:
            for start, word in enumerate(words):
                if (word,) in self.windows:
                    yield start, (word,)


def build(items: list[tuple[int, str]], window: int = WINDOW) -> list[Search]:
    """A search per length of window: ``window`` words, and shorter whole items."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        length = min(window, len(words))
        for start in range(len(words) - length + 1):
            owners = by_length.setdefault(length, {}).setdefault(tuple(words[start : start + length]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return [Search(windows, length) for length, windows in sorted(by_length.items())]


#: The searches of the broadcast that a Python worker used last.
_BUILT: dict[str, list[Search]] = {}


def _searches(sent, key: str, window: int) -> list[Search]:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(sent.value, window)
    return _BUILT[key]


def _passes(benchmark: DataFrame, window: int) -> list[DataFrame]:
    """The benchmark in parts whose words one search can hold."""
    size = F.length("text") / 2  # a word takes a letter and a gap at least
    words = benchmark.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-int(words) // WORDS_A_PASS))
    if parts == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [benchmark.where(part == k) for k in range(parts)]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of benchmark windows per document: doc_id, n_words, spans, item_ids.

    ``spans`` are disjoint, ascending [start, end) runs of hit words; ``item_ids`` the items
    with a window in the document, ascending. ``docs`` has doc_id and text, ``benchmark`` item_id
    and text; other columns are ignored. Null or wordless texts have no words and no hits;
    items without words or id have no window. Repeated rows give a row each, repeated items
    count once per id. Of the benchmark, parts of a bounded number of words are broadcast.
    """
    sc = docs.sparkSession.sparkContext
    row = F.monotonically_increasing_id()
    docs = docs.select("doc_id", "text")
    benchmark = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    passes = _passes(benchmark, window)
    if len(passes) > 1:
        from .scratch import materialise

        docs = materialise(docs.select(row.alias("row"), "doc_id", "text"), "decontaminate_docs")
    else:
        docs = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    found = None
    for part in passes:
        sent = sc.broadcast([(r["item_id"], r["text"]) for r in part.collect()])

        def each(sent=sent, key=uuid.uuid4().hex):
            searches = _searches(sent, key, window)

            def turn(batch: pa.RecordBatch):
                n_words, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    runs: list[list[int]] = []
                    hit: set[int] = set()
                    starts = sorted((s, s + x.length, x.windows[w]) for x in searches for s, w in x.occurrences(words))
                    for start, end, owners in starts:
                        hit.update(owners)
                        if runs and start <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([start, end])
                    n_words.append(len(words))
                    spans.append(runs)
                    items.append(sorted(hit))
                return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": n_words, "spans": spans, "item_ids": items}

            return turn

        one = map_batches(docs, "row long, doc_id long, n_words long, spans array<array<long>>, item_ids array<long>", each)
        found = one if found is None else found.unionByName(one)
    if len(passes) > 1:
        merge = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))),
            F.expr("cast(array() as array<array<bigint>>)"),
            lambda runs, s: F.when(
                (F.size(runs) > 0) & (s[0] <= F.element_at(runs, -1)[1]),
                F.concat(
                    F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))),
                    F.array(F.array(F.element_at(runs, -1)[0], F.greatest(F.element_at(runs, -1)[1], s[1]))),
                ),
            ).otherwise(F.concat(runs, F.array(s))),
        )
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            merge.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    return found.select("doc_id", "n_words", "spans", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, their columns as they are.

    A pass per part of the benchmark filters the rows in place; texts are not shuffled.
    """
    sc = docs.sparkSession.sparkContext
    benchmark = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    for part in _passes(benchmark, window):
        sent = sc.broadcast([(r["item_id"], r["text"]) for r in part.collect()])

        def each(sent=sent, key=uuid.uuid4().hex):
            searches = _searches(sent, key, window)
            hit = lambda words: any(True for x in searches for _ in x.occurrences(words))
            return lambda batch: [not hit(words_of(t)) for t in batch.column("text").to_pylist()]

        docs = keep_rows(docs, each)
    return docs


def digest_of_ids(ids) -> str:
    """sha256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
