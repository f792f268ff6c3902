"""Content detection: findings of a text as an ordered array of structs."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.literals import leading, starting
from ..functions.props import once, redacted

#: Matches of one detector that count.
MOST_MATCHES = 10
FINDING = "array<struct<pos:int,type:string,risk:string,count:int,samples:array<string>,category:string,label:string>>"


#: Detectors whose matches begin with one of the signs below, and with no word. Java tests a class of single characters sooner than one with ranges.
CODES = ("credit_card", "swift_bic", "iban", "phone_number", "azerbaijan_fin")
CODE_SIGNS = f"[{string.digits}{string.ascii_uppercase}+]"


def _starts() -> tuple[dict[str, tuple[str, ...]], str, list[str]]:
    """What matches of each detector begin with, where that can be told; a pattern whose first groups are all of these that
    a text holds (and empty ones); all of them.

    The pattern goes from word to word, so a beginning with a letter or digit is only looked for at the beginning of a word,
    where detectors with a boundary ask for it, and one with a sign anywhere.
    """
    patterns = {kind: pattern for kind, *_, pattern in (*fixed.DETECTORS, *fixed.CONTEXTS)}
    named = {kind: leading(pattern) for kind, pattern in patterns.items()} | {"email": ("@",), "credit_card": None}
    inside = lambda kind, s: not patterns[kind].startswith(r"\b") and (s[0].isalnum() or s[0] == "_")
    known = {kind: starts for kind, starts in named.items() if starts is not None and not any(inside(kind, s) for s in starts)}
    every = sorted({s for starts in known.values() for s in starts})
    of_words = string.ascii_letters + string.digits + "_"
    signs = "".join(re.escape(c) for c in sorted({s[0] for s in every} - set(of_words)))
    start, unit = f"(?i:{starting(every)})", f"(?:[{of_words}]++|[{signs}])"
    return known, f"(?:[^{of_words}{signs}]++|(?!{start}){unit})*+(?:(?=({start})){unit})?", every


def _codes() -> str:
    """A pattern that finds something where any of ``CODES`` does."""
    return f"(?={CODE_SIGNS})(?:{'|'.join(pattern for kind, *_, pattern in fixed.DETECTORS if kind in CODES)})"


def _finding(hit: Column) -> Column:
    """The finding of a hit (pos, found): what its detector says of it, and the matches."""
    kinds = [(kind, level, redact) for kind, level, _, redact, _ in fixed.DETECTORS] + [(kind, level, None) for kind, level, _ in fixed.CONTEXTS]
    none, place = F.lit(None).cast("string"), hit["pos"]  # only findings of personal data have a category and a label
    told = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in kinds]), place)
    context = place > len(fixed.DETECTORS)
    samples = F.when(context, F.array().cast("array<string>")).when(F.coalesce(told(2), F.lit(False)), F.transform(hit["found"], lambda v: redacted(v))).otherwise(hit["found"])
    return F.struct(place.alias("pos"), told(0).alias("type"), told(1).alias("risk"), F.size(hit["found"]).alias("count"), samples.alias("samples"), none.alias("category"), none.alias("label"))


def detect(content: Column | str) -> Column:
    """The findings of all detectors in their order, then the context findings.

    At most ``MOST_MATCHES`` matches count and are sampled; samples of sensitive types are redacted.
    Null and empty texts have no findings. A pattern is tried where its text holds what its matches begin with, which one
    search finds out for all patterns that begin with a word, and another for ``CODES``.
    """
    text = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    known, pattern_of_starts, every = _starts()
    none = F.array().cast("array<string>")

    def tried(seen: Column) -> Column:
        starts, coded = seen["starts"], seen["coded"]

        def where(kind: str, found: Column) -> Column:
            if kind in CODES:
                return F.when(coded, found).otherwise(none)
            if kind not in known:
                return found
            # the longest beginning at a place stands for those that it begins with
            own = [s for s in every if s.startswith(known[kind])]
            return F.when(F.arrays_overlap(starts, F.array(*map(F.lit, own))), found).otherwise(none)

        def first(kind: str) -> str:
            """A look at the next character alone, which rules most places out sooner than the pattern does."""
            if kind in CODES or kind == "email":
                return "" if kind == "email" else f"(?={CODE_SIGNS})"
            heads = sorted({x for s in known.get(kind, ()) for x in (s[0].lower(), s[0].upper())})
            return f"(?=[{''.join(map(re.escape, heads))}])" if heads else ""

        rows = []
        for pos, (kind, _, cased, _, pattern) in enumerate(fixed.DETECTORS, 1):
            found = F.slice(F.regexp_extract_all(text, F.lit(("" if cased else "(?i)") + first(kind) + pattern), F.lit(0)), 1, MOST_MATCHES)
            rows.append(F.struct(F.lit(pos).alias("pos"), where(kind, found).alias("found")))
        for pos, (kind, _, pattern) in enumerate(fixed.CONTEXTS, len(fixed.DETECTORS) + 1):
            told = F.when(text.rlike("(?i)" + first(kind) + pattern), F.array(F.lit(kind))).otherwise(none)
            rows.append(F.struct(F.lit(pos).alias("pos"), where(kind, told).alias("found")))
        return F.filter(F.array(*rows), lambda hit: F.size(hit["found"]) > 0)

    # functions of arrays, so that what is searched for is searched for once and then named
    held = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern_of_starts), F.lit(1)))
    starts = F.transform(held, lambda s: F.translate(s, string.ascii_uppercase, string.ascii_lowercase))  # F.lower is slow by the call
    seen = F.struct(starts.alias("starts"), text.rlike(_codes()).alias("coded"))
    return F.flatten(F.transform(F.array(seen), lambda s: F.transform(tried(s), _finding))).cast(FINDING)


def classify(records: DataFrame, keep_content: bool = False) -> DataFrame:
    """``records`` with their ``findings``; the content goes once it has been read."""
    found = once(records, findings=detect("content"))
    return found if keep_content else found.drop("content")


def long_form(classified: DataFrame) -> DataFrame:
    """doc_id, pos, type, risk, count, samples: a row per finding."""
    return classified.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.pos", "f.type", "f.risk", "f.count", "f.samples")
