"""How far the sources of a language lie apart in their words: a sorted stream of term runs.

1. Each task cuts its documents into terms and sums, for each language, term and source, the documents and occurrences it
   saw: a partial run, named by its first document. Frequent terms thus cross the shuffle once a task and source.
2. Partial runs are dealt by (lang, term) and sorted by (lang, term, source, document) within
   partitions; a run-length scan adds them up, and keeps the terms of enough documents of their language.
3. Kept runs get their shares p, exact whole numbers, from the totals of their source and language.
4. A second scan of the runs of a term emits, for the sources that have it, partial sums of pairs. What two sources differ
   by at a term that one of them lacks depends on that one's share alone and on the other's totals over
   terms, so it comes from a small table of a source's low shares: no run meets a source without the term.
   With p0 the share of a term that does not occur, and summed over terms,
   ``|p_a - p_b| = V |p0_a - p0_b| + one(a, b) + one(b, a) + both(a, b)``, where one(a, b) = sum over the terms of a of
   ``|p_a - p0_b| - |p0_a - p0_b|`` and both = sum over common terms of
   ``|p_a - p_b| - |p_a - p0_b| - |p0_a - p_b| + |p0_a - p0_b|``.

Defined cases: null text, lang and source are ''. Every row is a document, whatever its id: repeated rows count again.
Texts without terms make no term, but their source is a group. Ties of a value are ordered by the item's UTF-8. A
language of one source has no pairs, one without kept terms has pairs of value 0 and no terms. An empty table gives no
rows. Other columns do not matter. Sums are 64-bit for counts and decimal for shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import map_batches
from .scratch import materialise

#: Documents of a language that a kept term occurs in.
LEAST_DOCUMENTS = 30
#: Added to every count.
PRIOR = 5
#: What shares are parts of.
WHOLE = 1_000_000_000
#: Terms of a group that are reported.
TOP = 50
#: Sums a task holds before it hands them on.
HELD = 200_000
#: Entries of pairs worked on at a time.
PAIRS = 1 << 20
#: Tasks that pairs of a language are dealt over.
SALTS = 16
_BREAKS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def partial_runs(docs: DataFrame, most: int = HELD) -> DataFrame:
    """lang, term, source, document, documents, occurrences: what one task saw of a term in a source."""

    def count():
        held: dict[tuple[str, str], tuple[int | None, Counter, Counter]] = {}

        def flush() -> dict:
            out = {name: [] for name in ("lang", "term", "source", "document", "documents", "occurrences")}
            for (lang, source), (first, within, total) in held.items():
                out["term"] += [t.decode("utf-8", "replace") for t in total]
                out["occurrences"] += total.values()
                out["documents"] += map(within.__getitem__, total)
                for name, value in (("lang", lang), ("source", source), ("document", first)):
                    out[name] += [value] * len(total)
            held.clear()
            return out

        def turn(batch: pa.RecordBatch) -> Iterator[dict]:
            entries = sum(len(total) for _, _, total in held.values())
            ids, langs, sources = (batch.column(c).to_pylist() for c in ("document", "lang", "source"))
            for k, text in enumerate(batch.column("text")):
                terms = text.as_py().translate(_BREAKS).split()
                _, within, total = held.setdefault((langs[k], sources[k]), (ids[k], Counter(), Counter()))
                entries -= len(total)
                total.update(terms)
                within.update(set(terms))
                entries += len(total)
                if entries > most:
                    yield flush()
                    entries = 0

        turn.finish = flush
        return turn

    named = docs.select(
        F.col("doc_id").cast("string").alias("document"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    return map_batches(named, "lang string, term string, source string, document string, documents long, occurrences long", count)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
    for column in columns:
        encoded = column.dictionary_encode()
        codes = (encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded).indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted batches again, cut so that no run of (lang, term) is parted."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        starts = np.flatnonzero(_changes(table.column("lang"), table.column("term")))
        if starts[-1]:
            yield table.slice(0, starts[-1])
        rest = table.slice(starts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def kept_runs(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, count, in_lang, leads: occurrences of a kept term in a source and in all of its language;
    ``leads`` marks one row of each term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_term(batches):
            lang, term, source = (table.column(c) for c in ("lang", "term", "source"))
            rows = np.flatnonzero(_changes(lang, term, source))
            heads = _changes(lang, term)[rows]
            runs = np.flatnonzero(heads)
            documents, occurrences = (np.add.reduceat(table.column(c).to_numpy(), rows) for c in ("documents", "occurrences"))
            of_run = np.cumsum(heads) - 1
            kept = np.flatnonzero((np.add.reduceat(documents, runs) >= least)[of_run])
            in_lang = np.add.reduceat(occurrences, runs)[of_run]
            at = pa.array(rows[kept])
            yield from pa.table(
                [lang.take(at), term.take(at), source.take(at), occurrences[kept], in_lang[kept], heads[kept]],
                names=["lang", "term", "source", "count", "in_lang", "leads"],
            ).to_batches()

    order = ["lang", "term", "source", "document"]
    sorted_runs = partial_runs(docs).repartition("lang", "term").sortWithinPartitions(*order)
    return sorted_runs.mapInArrow(scan, "lang string, term string, source string, count long, in_lang long, leads boolean")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among ``total`` occurrences of ``terms`` kept terms."""
    number = F.lit(WHOLE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = total.cast("decimal(20,0)") + (terms * PRIOR).cast("decimal(20,0)")
    return F.call_function("div", number, F.when(below > 0, below)) + 1


def _groups(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """lang, source, total, in_source (kept terms that occur), lang_total, terms, p0, q0, highest (p0 of the language)
    of every group that occurs. Groups are joined with each other by language only to give the pairs asked for."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_source = runs.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_lang = runs.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_if("leads").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = every.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))
    p0 = _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    return found.withColumn("p0", p0).withColumn("highest", F.max("p0").over(Window.partitionBy("lang")))


def _pairs_of_runs(shares: DataFrame, most: int = PAIRS) -> DataFrame:
    """lang, a, b, value for a < b: ``both`` of the module's formula, partial sums of a task. ``shares``: lang, term, source, p, p0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, values = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(values[order], first)

        def emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            known = list(names)
            low, high = keys >> 32, keys & 0xFFFFFFFF
            return pa.RecordBatch.from_arrays(
                [pa.array([known[k][0] for k in low], pa.string()), pa.array([known[k][1] for k in low], pa.string()), pa.array([known[k][1] for k in high], pa.string()), pa.array(values)],
                names=["lang", "a", "b", "value"],
            )

        def blocks(size: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Pairs of the runs of ``size`` sources that begin at ``rows``: positions of both sides, at most ``most`` or a row's at a time."""
            many = max(1, most // (size * size))
            wide = max(1, most // size)
            for at in range(0, len(rows), many):
                begin = rows[at : at + many, None]
                for left in range(0, size - 1, wide):
                    i = np.repeat(np.arange(left, min(size - 1, left + wide)), size)
                    j = np.tile(np.arange(size), len(i) // size)
                    i, j = i[j > i], j[j > i]
                    yield (begin + i).ravel(), (begin + j).ravel()

        for table in _by_term(batches):
            lang, source, p, p0 = table.column("lang").to_pylist(), table.column("source").to_pylist(), table.column("p").to_numpy(), table.column("p0").to_numpy()
            number = np.array([names.setdefault(x, len(names)) for x in zip(lang, source)], np.int64)
            starts = np.flatnonzero(_changes(table.column("lang"), table.column("term")))
            sizes = np.diff(np.append(starts, len(number)))
            for size in np.unique(sizes[sizes > 1]):
                for i, j in blocks(int(size), starts[sizes == size]):
                    value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                    # numbers follow first sight, so a pair may stand either way round: one way is kept here
                    low, high = np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
                    held.append((low << 32 | high, value))
                    waiting += len(value)
                    if waiting > 2 * most:
                        held = [summed()]
                        waiting = len(held[0][0])
                        if waiting > most:
                            yield emit(*held[0])
                            held, waiting = [], 0
        if held:
            yield emit(*summed())

    return shares.mapInArrow(scan, "lang string, a string, b string, value long")


def _pair_part(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    # one(a, b): all of a's terms at once where p0 of b is the lower; above it the low shares of a count back
    low = (
        shares.groupBy("lang", "source", "p", "highest").agg(F.count("*").alias("times"))
        .groupBy("lang", "source").agg(
            F.sum(F.col("p").cast("decimal(38,0)") * F.col("times")).alias("sum_p"),
            F.sum("times").alias("in_source"),
            F.collect_list(F.when(F.col("p") < F.col("highest"), F.struct("p", "times"))).alias("low"),
        )
    )
    side = groups.select("lang", "source", "p0", "terms").join(low, ["lang", "source"], "left")
    a = side.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    b = side.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    back = F.aggregate(
        F.coalesce("low", F.array().cast("array<struct<p:bigint,times:bigint>>")),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, x: (acc + F.greatest(F.col("q0") - x["p"], F.lit(0)).cast("decimal(19,0)") * x["times"].cast("decimal(19,0)")).cast("decimal(38,0)"),
    )
    one = F.coalesce(F.col("sum_p"), F.lit(0).cast("decimal(38,0)")) - wide("q0") * F.coalesce("in_source", F.lit(0)) + 2 * back
    base = F.abs(F.col("p0") - F.col("q0"))
    sided = a.join(b, ["lang", "salt"]).where("source <> item").withColumn("one", F.coalesce(one - base * F.coalesce("in_source", F.lit(0)), F.lit(0)).cast("decimal(38,0)"))
    sides = sided.select("lang", "source", "item", F.explode(F.array(
        F.struct(F.col("source").alias("x"), F.col("item").alias("y"), (F.col("one") + F.coalesce(base * F.col("terms"), F.lit(0))).cast("decimal(38,0)").alias("value")),
        F.struct(F.col("item").alias("x"), F.col("source").alias("y"), F.col("one").alias("value")),
    )).alias("s")).select("lang", F.col("s.x").alias("source"), F.col("s.y").alias("item"), "s.value")
    order = ["lang", "term", "source"]
    both = _pairs_of_runs(shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions(*order))
    common = both.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s"))
    every = sides.unionByName(common.select("lang", F.col("s.x").alias("source"), F.col("s.y").alias("item"), F.col("value").cast("decimal(38,0)").alias("value")))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank for every group of a language and source.

    ``pair``: the distance of the source to each other one of its language over all kept terms. ``term``: the
    ``top`` kept terms that the source uses more than its language does.
    """
    runs = materialise(kept_runs(docs, least), "runs")
    groups = materialise(_groups(docs, runs), "groups")
    joined = runs.join(groups, ["lang", "source"])
    shares = joined.withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms"))).withColumn("q", _share(F.col("in_lang"), F.col("lang_total"), F.col("terms")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = _pair_part(groups, shares).withColumn("rank", F.row_number().over(ranked))
    named = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named("pair", pairs).unionByName(named("term", terms))


def duckdb_sql(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """DuckDB SQL for the rows of :func:`audit` over ``documents``: every group against every kept term."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda count, total: f"1 + {WHOLE}::HUGEINT * ({count} + {PRIOR}) // ({total} + {PRIOR} * v)"
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
            FROM documents
        ), words AS (SELECT row_id, lang, source, unnest(found) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= {least}),
        langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (SELECT DISTINCT lang, source FROM d),
        cells AS (
            SELECT g.lang, g.source, k.term, k.in_lang, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), shares AS (SELECT lang, source, term, n, {p("n", "total")} AS p, {p("in_lang", "lang_total")} AS q FROM cells JOIN langs USING (lang)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
                GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), every AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM every QUALIFY part = 'pair' OR rank <= {top}
    """
