"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document is hashed to its set of shingles; equal sets collapse into one class.
2. A short sketch (the ``SHORT`` smallest hashes) of each class goes into inverted lists;
   a class stays in the race only if enough of its values occur in a second class.
3. Classes in the race list their rarest values, as many as it takes for two similar sets to
   meet in a list: sets of up to ``WHOLE`` members out of all their values, larger ones (and those whose
   partners may be larger) out of a long sketch (``LONG``). A passage that many documents share is
   frequent, so it comes last and is listed only where it makes up most of a document. Of two
   similar sets the smaller is also met by its first few values alone; these entries are marked, and a
   list is looked through only for pairs whose smaller set is marked there. An entry also tells how many values
   its set has from there on: two sets are looked at only where both have left what they must share,
   which the list of their first common value always grants.
4. Each list generates overlaps with a few pivots; parities of the sets rule pairs out, the
   union of two sketches estimates similarity and filters, the full sets confirm. Linked classes
   merge, and what is still outside the largest component of a list is compared in further
   rounds, a bounded number of pivots each, until every pair of a list lies in one component
   or has been looked at.

The thresholds on sketches are such that a pair at the wanted similarity is missed with
a probability of at most 1e-9; sets no larger than the sketch are treated exactly.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_batches
from .components import connected_components
from .scratch import materialise, materialise_by, release

SHINGLE = 5
PERCENT = 75
SHORT, LONG, FILTER = 32, 128, 64
#: Sets up to this size are listed by all their values, so that what they must share is known exactly.
WHOLE = 16_384
MISS = 1e-9
#: Buckets of the parities that rule pairs out before their sets are fetched.
PARITY = 512
#: Up to this many ids (8 bytes each) a set of documents is broadcast, beyond it shuffled.
MAX_BROADCAST_IDS = 2_000_000
#: Pivots of a list in each round, about; the last number holds for all further rounds.
PIVOTS = (2, 32, 512)
#: Entries of a list that one task compares with the pivots of a round, about.
SHARE = 20_000
#: Ways in which the first round draws a pivot, by the value of the list.
FIRST_PIVOTS = 6
#: Sets in a file of the table they are stored in, about, and the most files of it.
SETS_A_BUCKET, MOST_BUCKETS = 4_000, 50_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z are lowered.

    Words are runs of characters other than ASCII white space. Fewer words than ``size``
    make one shingle; none make an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashed[k : len(words) - width + 1 + k]) * _MIX[k % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[0]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def least_overlap(k: int, similarity: float, miss: float = MISS) -> int:
    """Fewest common values of two bottom-k sketches that a similar pair goes below with
    probability ``miss`` at most (a Chernoff bound on the binomial count)."""

    def tail(x: float) -> float:
        divergence = (x * math.log(x / similarity) if x > 0 else 0.0) + (1 - x) * math.log((1 - x) / (1 - similarity))
        return math.exp(-k * divergence)

    c = 0
    while c + 1 < similarity * k and tail(c / k) <= miss:
        c += 1
    return c


def needed(n: Column, k: int, percent: int) -> Column:
    """Values of a sketch of a set of ``n`` that must be shared for a partner to exist.

    A set whose partners all fit their sketch needs the exact share; others the bound.
    """
    exact = F.ceil(n * percent / 100)
    return F.when(n * 100 <= k * percent, exact).otherwise(F.lit(least_overlap(k, percent / 100)))


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` buckets of hashes whether a set has an odd number in it, as bits of longs.

    The parities of two sets differ in no more buckets than the sets differ in members.
    """
    bits = np.bincount((shingles.view(np.uint64) >> np.uint64(7)) % np.uint64(PARITY), minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def may_be_similar(n: Column, m: Column, differing: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` whose parities differ in so many buckets can be similar.

    Similar sets differ in at most ``most`` members. That bounds the buckets; where buckets
    are shared by many members, so does their expectation plus a margin that a similar pair passes with
    probability ``MISS`` at most.
    """
    most = (n + m) * float(100 - percent) / float(100 + percent)
    expected = PARITY / 2 * (1 - F.exp(most * (-2.0 / PARITY)))
    return differing <= F.least(most, expected + math.sqrt(-math.log(MISS) * PARITY / 2))


def shingled(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, mark (64 bits of the set), shingles (array<long>, ascending), brief (the first
    ``FILTER`` of them), parity (array<long>) of each document."""

    def each():
        def turn(batch: pa.RecordBatch):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "mark": [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets],
                "shingles": _list_array(sets),
                "brief": _list_array([x[:FILTER] for x in sets]),
                "parity": _list_array([parity(x) for x in sets]),
            }

        return turn

    return map_batches(docs.select("doc_id", "text"), "doc_id long, mark long, shingles array<long>, brief array<long>, parity array<long>", each)


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def summaries(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_1, set_2 (128 bits of the whole set), sketch of each document."""

    def each():
        def turn(batch: pa.RecordBatch):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": [len(s) for s in sets],
                "set_1": marks[:, 0],
                "set_2": marks[:, 1],
                "sketch": _list_array([s[:SHORT] for s in sets]),
            }

        return turn

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_shingles long, set_1 long, set_2 long, sketch array<long>", each)


def _shared(postings: DataFrame) -> DataFrame:
    """value, holders: the values that more than one of ``postings`` (doc_id, value) holds."""
    return postings.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")


def _in_race(classes: DataFrame, percent: int) -> DataFrame:
    postings = classes.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    hits = postings.join(_shared(postings), "value").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n_shingles").alias("n"))
    return hits.where(F.col("hits") >= needed(F.col("n"), SHORT, percent)).select("doc_id")


def _rarest(values: DataFrame, needed_of: Column, marked_of: Column) -> DataFrame:
    """value, doc_id, n, marked, rest: of the values of each set (doc_id, n, value) that others hold too, the
    rarest, so many that it holds fewer than ``needed_of`` besides; with ``marked_of`` in its place, the marked ones.
    ``rest`` counts a set's values from this one on, which comes at the same place in the order of all sets."""
    held = (
        values.join(_shared(values), "value")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("held"), F.first("n").alias("n"))
    )
    listed = F.slice("held", 1, F.greatest(F.size("held") - needed_of + 1, F.lit(0)).cast("int"))
    return held.select("doc_id", "n", F.size("held").alias("size"), (F.size("held") - marked_of).alias("last"), F.posexplode(listed).alias("at", "posting")).select(
        "posting.value", "doc_id", "n", (F.col("at") <= F.col("last")).alias("marked"), (F.col("size") - F.col("at")).alias("rest")
    )


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """value, doc_id, n, marked, rest: the inverted lists in which similar sets meet.

    Two sets of ``WHOLE`` members at most share percent % of the larger one, and 2 percent / (100 + percent)
    of the smaller one: a list holds as few values as that allows. Pairs with a larger set
    meet in lists of sketches, which carry the complement of the value and no ``rest``.
    """
    n = F.col("n")
    of = sets.select("doc_id", F.size("shingles").cast("long").alias("n"), "shingles")
    whole = of.where(n <= WHOLE).select("doc_id", "n", F.explode("shingles").alias("value"))
    sketched = of.where(n * 100 > WHOLE * percent).select("doc_id", "n", F.explode(F.slice("shingles", 1, LONG)).alias("value"))
    bound = F.lit(least_overlap(LONG, percent / 100))
    exact = _rarest(whole, F.ceil(n * percent / 100), F.ceil(n * (2 * percent) / (100 + percent)))
    return exact.unionByName(_rarest(sketched, bound, bound).withColumns({"value": F.bitwise_not("value"), "rest": F.lit(None).cast("int")}))


def may_share(n: Column, m: Column, rest: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` that share ``rest`` members at most can be similar; without ``rest``, true."""
    return F.coalesce(rest * (100 + percent) >= (n + m) * percent, F.lit(True))


def _has_partner(least: Column, percent: int) -> Column:
    """Whether an entry of a list can be of a similar pair there, of which the smaller set is marked and has ``least`` members or more."""
    return may_share(F.col("n"), F.least("n", least), F.col("rest"), percent)


def _first_pivots(lists: DataFrame, percent: int) -> DataFrame:
    """value, doc_id, n, marked, rest, component, pivot, shares, first, other of the lists with two holders or more,
    without entries that the smallest marked set leaves no partner: the smallest id and one drawn by hash are pivots, and stand beside every
    document of the list. The draw depends on the value, so near copies that share many lists meet several pivots."""
    heads = (
        lists.groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("holders"),
            F.min(F.when(F.col("marked"), F.col("n"))).alias("least"),
            F.min("doc_id").alias("first"),
            F.min_by("doc_id", F.xxhash64("doc_id", F.pmod("value", F.lit(FIRST_PIVOTS)))).alias("other"),
        )
        .where("holders > 1 and least is not null")
    )
    pivot = (F.col("doc_id") == F.col("first")) | (F.col("doc_id") == F.col("other"))
    return (
        lists.join(heads, "value")
        .where(_has_partner(F.col("least"), percent))
        .select("value", "doc_id", "n", "marked", "rest", F.col("doc_id").alias("component"), pivot.alias("pivot"), F.lit(1).alias("shares"), "first", "other")
    )


def _first_candidates(placed: DataFrame) -> DataFrame:
    """a, b: each document with the two pivots of each of its lists."""
    return (
        placed.select("doc_id", F.explode(F.array_distinct(F.array("first", "other"))).alias("pivot_id"))
        .where("doc_id <> pivot_id")
        .select(F.least("doc_id", "pivot_id").alias("a"), F.greatest("doc_id", "pivot_id").alias("b"))
        .distinct()
    )


def _next_pivots(lists: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """The same (without first and other) of the lists whose documents are not all of one component and that hold
    a marked one: about so many pivots as the turn has, drawn by hash from outside the list's largest component,
    the marked ones before all others. Components only grow, so a list left out here stays settled."""
    known = labels.select(F.col("node").alias("doc_id"), "component")
    least = lists.where("marked").groupBy("value").agg(F.min("n").alias("least"))
    lists = lists.join(least, "value").where(_has_partner(F.col("least"), percent))
    placed = lists.join(known, "doc_id", "left").select("value", "doc_id", "n", "marked", "rest", F.coalesce("component", "doc_id").alias("component"))
    open_lists = (
        placed.groupBy("value", "component")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if("marked").alias("smaller"))
        .groupBy("value")
        .agg(F.sum("members").alias("all"), F.sum("smaller").alias("smaller"), F.max(F.struct("members", "component", "smaller")).alias("largest"))
        .where(F.col("all") > F.col("largest.members"))
        .where("smaller > 0")
        .select(
            "value",
            F.col("largest.component").alias("largest"),
            (F.col("all") - F.col("largest.members")).alias("outside"),
            (F.col("smaller") - F.col("largest.smaller")).alias("marked_outside"),
            F.ceil(F.col("all") / SHARE).cast("int").alias("shares"),
        )
    )
    only_marked = F.col("marked_outside") > 0
    drawn_from = F.when(only_marked, F.col("marked_outside")).otherwise(F.col("outside"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.ceil(drawn_from / PIVOTS[min(turn, len(PIVOTS) - 1)])) == 0
    pivot = drawn & (F.col("component") != F.col("largest")) & (F.col("marked") | ~only_marked)
    return placed.join(open_lists, "value").select("value", "doc_id", "n", "marked", "rest", "component", pivot.alias("pivot"), "shares")


def _candidates(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: each pivot with the documents of its list that lie in other components, unless their marks, sizes,
    the values they have from there on or parities rule them out. A long list is split into shares, and its pivots go to each."""
    bits = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY // 64)]
    # a document's lists, a few hundred at most, meet its parities in one row
    by_document = placed.groupBy("doc_id").agg(F.collect_list(F.struct("value", "n", "marked", "rest", "component", "pivot", "shares")).alias("held"))
    with_bits = by_document.join(sets.select("doc_id", *bits), "doc_id")
    names = [f"p{k}" for k in range(PARITY // 64)]
    entries = with_bits.select("doc_id", *names, F.explode("held").alias("e")).select(
        "e.value", F.pmod(F.xxhash64("doc_id"), F.col("e.shares")).cast("int").alias("share"), "doc_id", "e.n", "e.marked", "e.rest", "e.component", *names
    )
    pivots = (
        with_bits.select("doc_id", *names, F.explode(F.filter("held", lambda e: e["pivot"])).alias("e"))
        .select(
            "e.value", F.explode(F.sequence(F.lit(0), F.col("e.shares") - 1)).alias("share"), F.col("doc_id").alias("pivot_id"), F.col("e.n").alias("pivot_n"),
            F.col("e.marked").alias("pivot_marked"), F.col("e.rest").alias("pivot_rest"), F.col("e.component").alias("pivot_component"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY // 64)],
        )
    )
    differing = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITY // 64)))
    smaller = F.struct("n", "doc_id") < F.struct("pivot_n", "pivot_id")
    return (
        entries.join(pivots, ["value", "share"])
        .where("component <> pivot_component")
        .where(F.when(smaller, F.col("marked")).otherwise(F.col("pivot_marked")))
        .where(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent)
        .where(may_share(F.col("n"), F.col("pivot_n"), F.least("rest", "pivot_rest"), percent))
        .where(may_be_similar(F.col("n"), F.col("pivot_n"), differing, percent))
        .select(F.least("doc_id", "pivot_id").alias("a"), F.greatest("doc_id", "pivot_id").alias("b"))
        .distinct()
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: ruled out by parities, estimated on sketches, confirmed in full.

    ``sets`` is stored by doc_id, so the joins move pairs to it.
    """

    def with_sets(frame: DataFrame, *names: str) -> DataFrame:
        for side in "ab":
            frame = frame.join(sets.select(F.col("doc_id").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in names]), side)
        return frame

    differing = F.aggregate(
        F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    n, m = F.col("a_n").cast("long"), F.col("b_n").cast("long")
    both = F.array_intersect("a_brief", "b_brief")
    union = F.slice(F.array_sort(F.array_union("a_brief", "b_brief")), 1, FILTER)
    overlap = F.size(F.array_intersect(union, both))
    estimated = (
        with_sets(pairs, "n", "parity", "brief")
        .where(may_be_similar(n, m, differing, percent))
        .where(F.when(F.size(union) < FILTER, overlap * 100 >= F.size(union) * percent).otherwise(overlap >= least_overlap(FILTER, percent / 100)))
    )
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return (
        with_sets(estimated.select("a", "b"), "shingles")
        .where(common.cast("long") * 100 >= (F.size("a_shingles") + F.size("b_shingles") - common).cast("long") * percent)
        .select("a", "b")
    )


def _components_of_classes(sets: DataFrame, percent: int) -> DataFrame | None:
    """node, component over all links between the sets of ``sets`` (doc_id, n, shingles, brief, parity)."""
    lists = materialise(_lists(sets, percent), "lists")
    edges: list[DataFrame] = []
    labels = None
    turn = 0
    while True:
        if turn:
            placed = _next_pivots(lists, labels if labels is not None else _no_labels(sets), turn, percent)
        else:
            placed = _first_pivots(lists, percent)
        placed = materialise(placed, "placed")
        release(lists)
        if not placed.limit(1).count():
            break
        pairs = _candidates(placed, sets, percent) if turn else _first_candidates(placed)
        found = materialise(_linked(pairs, sets, percent), "edges")
        lists = materialise(placed.where("not pivot").select("value", "doc_id", "n", "marked", "rest"), "lists")  # a pivot has met its whole list
        release(placed)
        if found.limit(1).count():
            edges.append(found)
            if labels is not None:
                release(labels)
            labels = connected_components(reduce(DataFrame.unionByName, edges))
        else:
            release(found)
        turn += 1
    release(placed, *edges)
    return labels


def _no_labels(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "node long, component long")


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast while they are at most ``MAX_BROADCAST_IDS``."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _components(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id, rows of each distinct id of ``docs``; only this table stays."""
    summary = materialise(summaries(docs, size), "summaries")
    # one set for each doc_id: that of the smallest hash
    own = F.min(F.struct("set_1", "set_2", "n_shingles"))
    ones = summary.where("doc_id is not null").groupBy("doc_id").agg(own.alias("own"), F.count(F.lit(1)).alias("rows"))
    ones = materialise(ones.select("doc_id", "own.*", "rows"), "documents")
    real = ones.where("n_shingles > 0")
    copies = real.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = materialise(real.join(copies, ["set_1", "set_2"]).select("doc_id", "first"), "copies")
    later = _small(copies.where("doc_id <> first").select("doc_id"))
    classes = summary.where("n_shingles > 0 and doc_id is not null").join(later, "doc_id", "left_anti")
    again = ones.where("rows > 1")
    repeated = again.limit(1).count() > 0
    if repeated:
        classes = classes.join(again.select("doc_id", "set_1", "set_2"), ["doc_id"], "left_anti").select(classes.columns).unionByName(
            classes.join(again.select("doc_id", "set_1", "set_2"), ["doc_id", "set_1", "set_2"], "left_semi").dropDuplicates(["doc_id"]).select(classes.columns)
        )
    race = materialise(_in_race(classes.select("doc_id", "n_shingles", "sketch"), percent), "in_race")
    release(summary)
    racing = race.count()
    sets = shingled(docs.select("doc_id", "text").join(_small(race), "doc_id", "left_semi"), size)
    if repeated:
        sets = sets.groupBy("doc_id").agg(F.min_by(F.struct("mark", "shingles", "brief", "parity"), "mark").alias("own")).select("doc_id", "own.*")
    buckets = min(MOST_BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-racing // SETS_A_BUCKET)))
    sets = materialise_by(sets.select("doc_id", F.size("shingles").alias("n"), "shingles", "brief", "parity"), "sets", "doc_id", buckets)
    labels = _components_of_classes(sets, percent)
    release(race, sets)
    found = ones.join(copies, "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
    if labels is not None:
        found = found.join(labels.select(F.col("node").alias("first"), "component"), "first", "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("long"))
    found = materialise(found.select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"), "rows"), "near_duplicates")
    release(ones, copies, *([] if labels is None else [labels]))
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * shared >= percent * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links. Null, empty and blank texts have
    an empty set and no link. Rows of one doc_id count as one document, whose text is that with the
    smallest hash of its set. A row without a doc_id is never linked: its component is null, it
    is kept and n_shingles is that of its text. Other columns are ignored.
    """
    found = _components(docs, percent, size)
    known = found.select("doc_id", "n_shingles", "component_id", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("one")).drop("one")
    nameless = summaries(docs.where("doc_id is null"), size).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(nameless).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, their columns as they are.

    Of rows that share a doc_id the one whose text has the smallest hash stays. Rows
    without a doc_id stay. Up to ``MAX_BROADCAST_IDS`` dropped ids are broadcast, more are joined by a shuffle.
    """
    found = _components(docs, percent, size)
    dropped = materialise(found.where("doc_id <> component_id").select("doc_id"), "dropped")
    again = materialise(found.where("doc_id = component_id and rows > 1").select("doc_id"), "repeated")
    release(found)
    left = docs.join(_small(dropped), "doc_id", "left_anti").select(docs.columns)
    if not again.limit(1).count():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(_small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row"))
    return left.join(_small(again), "doc_id", "left_anti").select(docs.columns).unionByName(once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
