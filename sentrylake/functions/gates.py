"""Which steps of the personal-data rules a text can concern, told by one automaton over all context words and the places where they stand.

A gate never says no to a step that finds something: it asks for what each finding needs, and where that cannot be told it lets the step pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import personal_rules as p
from .literals import leading

#: Steps are numbered ``SHIFT`` x rule + step; ``WHOLE`` in place of the step stands for the rule itself.
SHIFT, WHOLE = 16, 15
#: Characters behind the place where a match begins that its beginning may take.
TAIL = 128
#: What every match of a pattern begins with, in lower case and as Python has it; it may say more than the pattern, never less.
BEGINS = {
    p.DATE: r"\d{1,4}[-/.]\d", p.MONEY: r"(?:[$€£₼]|azn|usd|eur|gbp)?(?:\s*\d|\s{40})", p.FIN: r"[a-z0-9]{7}", p.NATIONAL_ID: r"(?:aze|or|aa)[ -]?\d{7}",
    p.PHONE: r"\+\d|0[\s().-]?\d", p.PASSPORT: r"[a-z][a-z0-9]{8}", p.PLATE: r"\d{2}[-\s]?[a-z]{2}", p.VIN: r"[a-z0-9]{17}", p.IPV4: r"\d{1,3}\.\d", p.MASKED_IPV4: r"\d{1,3}\.",
    p.IPV6: r"[0-9a-f]{0,4}:[0-9a-f]{0,4}:", p.HASHED_IP: r"[0-9a-f]{32}", p.UUID: r"[0-9a-f]{8}-", p.PUSH_TOKEN: r"[a-z0-9_-]{80}", p.MAC: r"[0-9a-f]{2}[:-][0-9a-f]{2}[:-]",
    p.MAC_DOTTED: r"[0-9a-f]{4}\.[0-9a-f]{4}\.", p.IMEI: r"\d{15}", p.IMEISV: r"\d{16}", p.MEID: r"[0-9a-f]{14}", p.ESN: r"[0-9a-f]{8}", p.IMSI: r"\d{14}", p.ICCID: r"89\d{17}",
    p.COORDINATES: r"-?\d", p.CPT: r"\d{5}", p.ICD: r"[a-z]\d[0-9a-z]", p.KARYOTYPE: r"\d{2},", p.DNA: r"[acgtn]{12}", p.ALIEN_NUMBER: r"a[- ]?\d{7}", p.I94: r"i[- ]?94", p.SEVIS: r"n\d{10}",
    p.CARD: r"\d[ -]?\d", p.MASKED_CARD: r"\*{4}|x{4}", p.CARD_EXPIRY: r"[01]\d(?:\s*/|\s{40})", p.IBAN: r"[a-z]{2}\d{2}[a-z0-9]{11}", p.BIC: r"[a-z]{6}[a-z0-9]{2}(?:[a-z0-9]{3})?(?![a-z0-9_])",
    p.CREDIT_SCORE: r"[3-9]\d\d", p.PERCENT: r"\d", p.COOKIE: r"[a-z0-9._~+/=-]{16}", p.RECOVERY_CODE: r"[a-z0-9]{4,8}[-\s][a-z0-9]{4}", p.PASSWORD_HASH: r"\$|[0-9a-f]{32}", p.VARIANT: r"[cgpm]\.[a-z0-9_>*?+-]",
    p.CHROMOSOME: r"chr(?:omosome)?\s{40}|(?:chr(?:omosome)?\s*)?(?:\d{1,2}|x|y|mt)[:qpg.-]",
}
#: The same where the step's check asks for more of the match.
CHECKED = {(p.FIN, "mixed"): r"(?=[a-z]{0,6}\d)[a-z0-9]{7}"}
#: Patterns whose matches have a digit among their first characters; MONEY and CARD_EXPIRY may have a long gap before or behind it.
DIGITS = (
    p.DATE, p.MONEY, p.NATIONAL_ID, p.PHONE, p.PLATE, p.IPV4, p.MASKED_IPV4, p.IMEI, p.IMEISV, p.IMSI, p.ICCID, p.COORDINATES, p.CPT, p.ICD, p.KARYOTYPE, p.ALIEN_NUMBER, p.I94, p.SEVIS, p.CARD,
    p.CARD_EXPIRY, p.IBAN, p.CREDIT_SCORE, p.PERCENT,
)
#: Words one of which stands somewhere in every match.
HOLDS = {p.ASSIGNMENT: p._SECRET_TRIGGERS, p.EMAIL: ("@",), p.NATIONAL_ID: ("aze", "or", "aa")}
#: What follows from where such a word begins.
FROM_HELD = {p.ASSIGNMENT: r"[a-z0-9_.-]+\s*[:=]", p.NATIONAL_ID: BEGINS[p.NATIONAL_ID], p.DATABASE_FIELDS: r"[a-z ]+\s*="}
#: Letters that patterns take for others where case does not count, and that keep their length in lower case.
FOLD = str.maketrans({"ı": "i", "ſ": "s"})


def _begin(step) -> tuple[str, str | tuple] | None:
    """How matches of a step begin: with one of some words, or with a pattern (``digit``: that has a digit, unless a long gap comes first); None where that is not told."""
    if told := CHECKED.get((step.pattern, step.check)):
        return "digit", told
    if step.pattern in BEGINS:
        return "digit" if step.pattern in DIGITS else "any", BEGINS[step.pattern]
    heads = leading(step.pattern)
    return ("words", heads) if heads else None


def _plan(rules: tuple[p.Rule, ...]) -> tuple[dict, list, list, dict]:
    """What each word leads to (rules; steps for values after it; groups of steps for places behind it; steps of matches that have it; beginnings that it is), each
    group's beginnings with their steps, the beginnings, and for each rule the steps that nothing is known about and all its steps."""
    words: dict[str, tuple[set, set, set, set, set]] = {}
    groups: dict[tuple, tuple[int, dict]] = {}
    begins: dict[tuple, int] = {}
    own: dict[int, tuple[list, list]] = {}
    of = lambda w: words.setdefault(w, (set(), set(), set(), set(), set()))
    folded = lambda w: w.lower().translate(FOLD)

    def number(begin) -> int:
        if begin is None:
            return -1
        at = begins.setdefault(begin, len(begins))
        if begin[0] == "words":
            for w in begin[1]:
                of(folded(w))[4].add(at)
        return at

    for n, rule in enumerate(rules):
        own[n] = ([], [SHIFT * n + k for k in range(len(rule.steps))])
        for w in filter(None, (*rule.words, *rule.triggers)):
            of(w.lower())[0].add(n)
        for at, step in zip(own[n][1], rule.steps, strict=True):
            if step.kind == "after":
                for w in filter(None, rule.words):
                    of(folded(w))[1].add(at)
            elif step.kind == "near" and step.window and not (step.in_value or step.anywhere or step.also):
                near = tuple(sorted({folded(w) for w in (step.words or rule.words) if w}))
                group, steps = groups.setdefault((near, step.window), (len(groups), {}))
                steps.setdefault(number(_begin(step)), []).append(at)
                for w in near:
                    of(w)[2].add((group, step.window))
            elif step.kind == "near" and (holds := HOLDS.get(step.pattern) or leading(step.pattern)):
                first = number(("any", FROM_HELD[step.pattern])) if step.pattern in FROM_HELD else -1
                for w in holds:
                    of(folded(w))[3].add((first, at))
            else:
                own[n][0].append(at)
    return words, [list(steps.items()) for _, steps in groups.values()], list(begins), own


def _worker(words: dict, groups: list, begins: list, own: dict):
    """The function of :func:`steps_in` on batches; it refers to nothing of this module, so that it travels whole."""
    whole, shift, tail, fold = WHOLE, SHIFT, TAIL, FOLD

    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re
        from bisect import bisect_left

        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, told in words.items():
            automaton.add_word(word, (len(word), *map(tuple, told)))
        automaton.make_automaton()
        starts = [None if kind == "words" else re.compile(told) for kind, told in begins]
        digital = [kind == "digit" for kind, _ in begins]
        digit, gap = re.compile(r"\d"), re.compile(r"\s{40}")
        joined_up = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")

        def steps(low: str, hits, folded: str, ruled: set | None) -> set:
            """The steps that pass; the rules of words are noted in ``ruled``, if given."""
            passed, places, marks, length = set(), {}, {}, len(low)
            for last, (size, led, after, near, has, heads) in hits:
                if led and ruled is not None:
                    ruled.update(led)
                end = last + 1
                if end > length:  # about the file
                    continue
                begin = end - size
                if after and (not begin or low[begin - 1] not in joined_up) and (end == length or low[end] not in joined_up):
                    passed.update(after)
                for group, window in near:
                    if begin + window >= end:
                        ranges = places.get(group)
                        if ranges is None:
                            places[group] = [[end, begin + window]]
                        elif ranges[-1][1] >= last:
                            ranges[-1][1] = max(ranges[-1][1], begin + window)
                        else:
                            ranges.append([end, begin + window])
                for which, at in has:
                    if at not in passed and (which < 0 or starts[which].match(folded, begin)):
                        passed.add(at)
                for which in heads:
                    marks.setdefault(which, []).append(begin)
            if not places:
                return passed
            spots = [m.start() for m in digit.finditer(folded)]
            gaps = gap.search(folded) is not None

            def begun(which: int, ranges: list) -> bool:
                if starts[which] is None:
                    at = sorted(marks.get(which, ()))
                    return any((k := bisect_left(at, low_end)) < len(at) and at[k] <= high for low_end, high in ranges)
                search, sparse = starts[which].search, digital[which] and not gaps
                for low_end, high in ranges:
                    if sparse and ((k := bisect_left(spots, low_end)) == len(spots) or spots[k] > high + tail):
                        continue
                    m = search(folded, low_end, high + 1 + tail)
                    if m and m.start() <= high:
                        return True
                return False

            for group, ranges in places.items():
                for which, ids in groups[group]:
                    if which < 0 or begun(which, ranges):
                        passed.update(ids)
            return passed

        def numbers(low: str, about: str, kelvin: bool) -> list[int]:
            ruled: set[int] = set()
            hits = automaton.iter(f"{low} {about}")
            folded = low.translate(fold) if "ı" in low or "ſ" in low else low
            odd = kelvin or "i̇" in low
            if odd or folded is not low:
                for _, told in hits:
                    ruled.update(told[1])
                passed = {at for n in ruled for at in own[n][1]} if odd else steps(low, automaton.iter(folded), folded, None)
            else:
                passed = steps(low, hits, folded, ruled)
            out = {at for at in passed if at // shift in ruled}.union(*(own[n][0] for n in ruled))
            return sorted(out | {at // shift * shift + whole for at in out})

        for batch in batches:
            yield pd.Series([numbers(*x) for x in zip(*batch, strict=True)])

    return found


def steps_in(lowered: Column, about: Column, kelvin: Column, rules: tuple[p.Rule, ...]) -> Column:
    """Numbers of the steps that can find something in a lower-cased text and what is known about its file, and of their rules.

    A rule counts where the text or its file holds one of its words or triggers. Of its steps, those count for which a word
    stands alone (values after words), or stands so near before what a match begins with (matches near words). ``kelvin``: the
    text has a Kelvin sign, which lower case makes a plain letter; such texts, and those with a dotted capital I, have all steps of their rules.
    """
    return F.pandas_udf(_worker(*_plan(rules)), "array<int>")(lowered, about, kelvin)
