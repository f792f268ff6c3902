"""Personal and confidential data in texts: each step of each rule an expression of its own, with its patterns as literals.

An automaton over all context words (a short function on Arrow batches) says which steps of which rules can
have anything in a text; only their expressions are evaluated there. A text is read where it lies: it is
neither copied for each step nor joined with anything, and Spark compiles each pattern once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce
from operator import and_, or_
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.gates import SHIFT, WHOLE, steps_in
from ..functions.literals import firsts, one_of
from ..functions.personal_rules import COORDINATES, DATE, FIN, IBAN, CARD, LATITUDE, LONGITUDE, RULES, URL, FACE_VECTOR, IMEI, JWT, MAC, MAC_DOTTED, Rule
from ..functions.props import once, redacted
from .findings import FINDING as ITEM

#: Samples and matched words of a finding.
MOST_SAMPLES = 10
#: Characters on either side of a match that can matter.
SIDE = 150
#: Terms of user-defined groups, all in all, that may be matched at once.
MOST_TERMS = 10_000
#: Seven signs with a digit among them.
MIXED_FIN = FIN.replace("[A-Za-z0-9]{7}", "(?=[A-Za-z]{0,6}[0-9])[A-Za-z0-9]{7}")
#: Expressions of rules, by application: all rules are some 200,000 calls of the driver's Java side, which are made once.
_BUILT: dict[tuple, Column] = {}


def _word_values(words: Iterable[str], longest: int) -> str:
    known = sorted({x for x in words if x}, key=len, reverse=True)
    # most places are ruled out by plain classes, which cost less than those that know Unicode
    quick, words = (rf"(?<![A-Za-z0-9_])(?={firsts(known)})", one_of(known, ignore_case=True)) if known else ("", "")
    return rf"{quick}(?iU)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])\s*(?:[:=,-]|\bis\b)?\s*([^\r\n;]{{1,{longest}}})"


def _settings(rule: Rule, step) -> SimpleNamespace:
    """What the expression of a step depends on, in one form for all kinds of steps."""
    get = lambda name, default=None: getattr(step, name, default) or default
    least, most = get("text", (None, None))
    short, long = getattr(step, "size", (0, 0))
    if step.kind == "near":
        # the text is led by SIDE line feeds, so that there are as many characters left of any match
        # of seven signs without a digit, which are most words of seven letters, nothing would be left
        p = "(?U)" + (MIXED_FIN if (step.pattern, step.check) == (FIN, "mixed") else step.pattern)
        # group 1 is a match with what stands on its left, so that one search gives both
        pattern = rf"(?=(?:{p}))(?<=(?=((?s:.{{{SIDE}}})(?:{p})))(?s:.{{{SIDE}}}))" + (rf"(?=((?s:.{{0,{SIDE}}})))" if get("around") else "") + rf"(?:{p})"
    else:
        pattern = _word_values(rule.words, step.longest) if step.kind == "after" else get("or_pattern")
    return SimpleNamespace(
        kind=step.kind, pattern=pattern, words=[x.lower() for x in (get("words") or rule.words)], window=getattr(step, "window", 0), in_value=getattr(step, "in_value", False),
        anywhere=getattr(step, "anywhere", False), also=get("also"), unless=[x.lower() for x in (get("unless") or get("not_after") or ())], unless_window=getattr(step, "unless_window", 0) or SIDE,
        unless_but=get("unless_but"), around=get("around"), sorted_by=list(get("sorted_by", ())), check=get("check", ""), form=get("form", ""), clip=getattr(step, "clip", 1000),
        cut=get("cut"), trim=getattr(step, "trim", ""), accept=get("accept"), accept_lower=get("accept_lower"), accept_word=get("accept_word"), accept_both=get("accept_both"),
        least=least, most=most, text_needs=get("text_needs"), short=short, long=long, needs=get("needs"), word_needs=get("word_needs"), word_skips=get("word_skips"),
        skips=get("skips"), skips_but=get("skips_but"), value_skips=get("value_skips"), inner=get("inner", ""), inner_first=getattr(step, "inner_first", False), extensions=list(get("extensions", ())),
    )


def rules_in(lowered: Column, rules: tuple[Rule, ...]) -> Column:
    """Numbers of the rules that a lower-cased text holds a word or trigger of."""
    led: dict[str, set[int]] = {}
    for n, rule in enumerate(rules):
        for word in (*rule.words, *rule.triggers):
            led.setdefault(word.lower(), set()).add(n)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, numbers in led.items():
            automaton.add_word(word, tuple(numbers))
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({n for _, numbers in automaton.iter(t) for n in numbers}) for t in texts])

    return found(lowered)


def _list(words: Iterable[str]) -> Column:
    """The words as an array; a literal once Spark has folded it."""
    return F.split(F.lit("\x00".join(words)), "\x00")


def _holds(text: Column, words: list[str]) -> Column:
    """Whether a whole text has one of the words in it."""
    return F.exists(_list(words), lambda w: text.contains(w)) if words else F.lit(False)


def _close(text: Column, words: list[str]) -> Column:
    """The same of a few characters about a match, as one pattern."""
    return text.rlike(one_of(words)) if words else F.lit(False)


def _found(pattern: str | None, text: Column, missing: bool) -> Column:
    """Whether a pattern is found; ``missing`` where there is none."""
    return F.lit(missing) if pattern is None else text.rlike(pattern)


def _any(*told: Column | bool) -> Column:
    """Whether any holds; what is False in any row is left out."""
    return reduce(or_, [t for t in told if t is not False], F.lit(False))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ok(value: Column, check: str, context: Callable[[], Column]) -> Column:
    """The check of a step, by its name; null without one."""

    def contact() -> Column:
        first = F.regexp_substr(value, F.lit("^[^,;|/-]*"))
        told = value.rlike(v.EMAIL) | value.rlike(v.PHONE) | v.valid_address(value) | F.exists(F.split(value, "[,;|/-]"), v.is_relation) | v.valid_name(F.btrim(first))
        return ~F.lower(value).isin("unknown", "null", "none", "test", "demo", "sample", "n/a", "na") & told

    def hardware() -> Column:
        return (value.rlike(v.whole(MAC)) | value.rlike(v.whole(MAC_DOTTED))) & v.valid_mac(value) | value.rlike(v.whole(IMEI)) & v.valid_imei(value)

    def face() -> Column:
        return v.looks_like_base64(value) | F.lower(value).rlike(v.any_of(("face", "facial", "biometric", "embedding", "vector", "template", "uz", "sifet"))) & value.rlike(FACE_VECTOR)

    def coordinates() -> Column:
        pair = F.split(value, ",")
        return v.valid_coordinates(F.btrim(pair[0]), F.btrim(pair[1]))

    checks = {
        "name": v.valid_name, "email": v.valid_email, "phone": v.valid_phone, "address": v.valid_address, "ip": v.valid_ip, "mac": v.valid_mac, "imei": v.valid_imei, "card": v.valid_card,
        "iban": v.valid_iban, "free_text": v.valid_free_text, "secret": v.valid_secret, "secret_no_jwt": lambda x: v.valid_secret(x) & ~x.rlike(v.whole(JWT)), "base64": v.looks_like_base64,
        "mixed": lambda x: x.rlike("(?U)[\\p{L}]") & x.rlike(r"(?U)\d"), "coordinates": lambda _: coordinates(), "hardware": lambda _: hardware(), "face": lambda _: face(), "contact": lambda _: contact(),
        "key_file": lambda x: context() & v.valid_secret(x) & F.lower(x).rlike(v.any_of(("key", "pfx", "p12", "jks", "keystore", "passphrase"))),
    }
    return checks[check](value) if check in checks else F.lit(None).cast("boolean")


def _formed(value: Column, form: str) -> Column:
    if form == "assigned":  # what an assignment gives
        return F.btrim(F.btrim(F.regexp_replace(value, r"\A[A-Za-z0-9_.-]*\s*[:=]\s*", "")), F.lit("'\""))
    if form == "query":  # what a query asks for
        return F.btrim(F.regexp_replace(value, r"\A[^:=]*[:=]\s*", ""), F.lit(" :=,-"))
    if form == "compact":
        return F.upper(F.regexp_replace(value, "[ -]", ""))
    if form == "strip":
        return F.btrim(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.upper(value) if form == "upper" else value


def _near_values(text: Column, s: SimpleNamespace, context: Callable[[], Column]) -> Column:
    led = F.concat(F.lit("\n" * SIDE), text)
    found = _all(led, s.pattern, 1)
    if s.around:
        found = F.arrays_zip(found.alias("both"), _all(led, s.pattern, 2).alias("right"))
    both_of = lambda m: m["both"] if s.around else m
    value_of = lambda m: F.substring(both_of(m), SIDE + 1, 1 << 30)

    def counts(m: Column) -> Column:
        left, value = F.lower(F.substring(both_of(m), 1, SIDE)), value_of(m)
        window = lambda size: F.substring(left, SIDE + 1 - size, size)
        told = []
        if s.window:
            told.append(_any(_close(window(s.window), s.words), s.in_value and _close(F.lower(value), s.words), s.anywhere and context(), bool(s.also) and _found(s.also, value, False)))
        if s.unless:
            told.append(~(_close(window(s.unless_window), s.unless) & ~_found(s.unless_but, window(140), False)))
        if s.around:
            told.append(_found(s.around, F.concat(left, F.lit(" "), F.lower(m["right"])), True))
        if s.form == "query":
            told.append(F.length(_formed(value, s.form)).between(2, 160))
        if s.check:
            told.append(F.coalesce(_ok(_formed(value, s.form) if s.form == "assigned" else value, s.check, context), F.lit(True)))
        return reduce(and_, told, F.lit(True))

    # a step is evaluated where its gate has seen how a match begins, so there is no plain search before this one
    kept = F.coalesce(F.transform(F.filter(found, counts), lambda m: F.substring(_formed(value_of(m), s.form), 1, s.clip)), F.array().cast("array<string>"))
    if not s.sorted_by:
        return kept
    return F.flatten(F.transform(_list(s.sorted_by), lambda w: F.filter(kept, lambda x: F.lower(x) == w)))


def _inner_values(value: Column, candidate: Column, kind: str) -> Column:
    """What is found inside a value that follows a context word."""
    none = F.array().cast("array<string>")
    first = lambda found: F.slice(found, 1, 1)
    if kind == "dates":
        return F.filter(_all(value, DATE), lambda d: v.valid_date(d, F.col("this_year")))
    if kind == "pair":
        pair = F.filter(first(_all(value, COORDINATES)), lambda p: v.valid_coordinates(F.btrim(F.split(p, ",")[0]), F.btrim(F.split(p, ",")[1])))
        lat, lng = F.regexp_extract(value, LATITUDE, 1), F.regexp_extract(value, LONGITUDE, 1)
        fields = F.when((lat != "") & (lng != "") & v.valid_coordinates(lat, lng), F.array(F.concat(lat, F.lit(", "), lng))).otherwise(none)
        return F.when(F.size(pair) > 0, pair).otherwise(fields)
    if kind == "url":
        return F.transform(first(_all(value, URL)), lambda u: F.substring(u, 1, 160))
    if kind == "card":
        return F.filter(first(_all(candidate, CARD)), lambda _: v.valid_card(candidate))
    if kind == "iban":
        return F.transform(F.filter(first(_all(candidate, IBAN)), v.valid_iban), lambda x: F.upper(x))
    if kind != "users":
        return none
    # parts up to the first user name; the last piece of a URL is one that does not end the search
    told = F.transform(
        F.split(value, r"[,;|\r\n]"),
        lambda p: F.when(p.rlike(URL), F.struct(F.lit(False).alias("ends"), F.element_at(F.split(F.rtrim(F.regexp_substr(p, F.lit(URL)), F.lit("/")), "/"), -1).alias("name")))
        .otherwise(F.struct(F.lit(True).alias("ends"), F.regexp_substr(F.btrim(p, F.lit(" :=,-")), F.lit(v.USERNAME)).alias("name"))),
    )
    named = F.filter(told, lambda t: F.coalesce(t["name"].isNotNull() & v.valid_username(t["name"]), F.lit(False)))
    end = F.array_position(F.transform(named, lambda t: t["ends"]), True)
    return F.transform(F.when(end > 0, F.slice(named, F.lit(1), end)).otherwise(named), lambda t: t["name"])


def _pairs(text: Column, pattern: str, most: int | None = None) -> Column:
    """Context words of a text and what follows each of them; with ``most`` only the first so many."""
    # the text is searched once; a match by itself, which begins at its word, parts into the same groups
    pairs = F.transform(
        _all(text, pattern), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("word"), F.btrim(F.regexp_extract(m, pattern, 2), F.lit(" \t:=-,")).alias("value"))
    )
    told = F.filter(pairs, lambda p: p["value"] != "")
    return told if most is None else F.slice(told, 1, most)


def _after_values(pairs: Column, lowered: Column, s: SimpleNamespace, context: Callable[[], Column]) -> Column:
    none = F.array().cast("array<string>")

    def cut(value: Column) -> Column:
        piece = value if s.cut is None else F.split(value, s.cut, 2)[0]
        if s.trim:
            return F.btrim(piece, F.lit(s.trim))
        return piece if s.cut is None else F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")

    def given(p: Column) -> Column:
        value, candidate, lower, word = p["value"], p["candidate"], p["lower"], F.lower(p["word"])
        both = F.concat(word, F.lit(" "), lower)
        barred = [
            bool(s.skips) and _found(s.skips, both, False) & ~_found(s.skips_but, both, False), bool(s.word_skips) and _found(s.word_skips, word, False),
            bool(s.value_skips) and (_found(s.value_skips, candidate, False) | _found(s.value_skips, lower, False)),
        ]
        if s.unless:
            at = F.call_function("locate", lower, lowered)
            start = F.greatest(at - 1 - SIDE, F.lit(0))
            barred.append((at > 0) & _close(F.substring(lowered, start + 1, at - 1 - start), s.unless))
        fits = F.length(candidate).between(s.short, s.long)
        if s.needs:
            fits = fits & _found(s.needs, both, True)
        if s.word_needs:
            fits = fits & _found(s.word_needs, word, True)
        if s.check == "birthplace":
            checked = v.valid_name(candidate) & F.lower(value).rlike(v.any_of(("city", "country", "place", "yer", "seher", "olke", "rayon")))
        else:
            checked = bool(s.check) and F.coalesce(_ok(candidate, s.check, context), F.lit(False))
        told = _any(
            s.least is not None and v.valid_text(candidate, s.least, s.most) & _found(s.text_needs, lower, True), bool(s.accept) and _found(s.accept, candidate, False),
            bool(s.accept_lower) and _found(s.accept_lower, lower, False), bool(s.accept_word) and _found(s.accept_word, word, False), bool(s.accept_both) and _found(s.accept_both, both, False), checked,
        )
        # what bars a value comes last: it may be looked for in the whole text, and few values get there
        own = F.when(fits & F.coalesce(told, F.lit(False)) & ~_any(*barred), F.array(F.substring(_formed(candidate, s.form), 1, s.clip))).otherwise(none)
        if not s.inner:
            return own
        inner = _inner_values(value, candidate, s.inner)
        return F.when(F.size(inner) > 0, inner).otherwise(F.concat(inner, own)) if s.inner_first else F.concat(inner, own)

    cuts = F.transform(pairs, lambda p: F.struct(p["word"].alias("word"), p["value"].alias("value"), cut(p["value"]).alias("candidate"), F.lower(cut(p["value"])).alias("lower")))
    return F.flatten(F.transform(cuts, given))


def _stands_alone(blob: Column, words: Column) -> Column:
    """The words that stand in a lower-cased text: on their own where they begin and end with a letter
    or digit, else anywhere; in order, ``MOST_SAMPLES`` at most."""

    def there(word: Column) -> Column:
        lower = F.lower(word)
        alone = F.rlike(blob, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), lower, F.lit(r"\E(?![A-Za-z0-9_])")))
        edged = lower.rlike(r"\A[\p{L}\p{N}](?s:.*[\p{L}\p{N}])?\z")
        return blob.contains(lower) & F.when(edged, alone).otherwise(True)

    return F.slice(F.array_distinct(F.filter(F.transform(words, v.squeezed), lambda w: (w != "") & there(w))), 1, MOST_SAMPLES)


def detect(
    records: DataFrame, rules: tuple[Rule, ...] = RULES, words: dict[str, tuple[str, ...]] | None = None, this_year: int | None = None, most_values: int | None = None
) -> DataFrame:
    """doc_id, pos, type, risk, description, count, samples, framework, category, tier, label, matched_keywords: a row per record of ``records`` (doc_id, name, path, extension,
    content) and rule that finds a value in it, ``pos`` by the order of the rules.

    ``words`` gives rules (by type) other context words; dates count up to ``this_year`` (without it, the clock's). At most ten distinct redacted values
    count. All values after context words are looked at, unless ``most_values`` gives a number for each text and list of words.
    Null and empty texts have findings by their path only. doc_id tells records apart; rows without
    one are left out. Only findings are shuffled, no texts.
    """
    rules = tuple(replace(r, words=words[r.type]) if words and r.type in words else r for r in rules)
    has = {f.lower() for f in records.columns}
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("") for c in ("path", "name", "extension", "content_status", "scan_error")]
    year = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    rows = records.where("doc_id is not null").select(
        "doc_id", F.coalesce("content", F.lit("")).alias("text"), *[c.alias(f"f{k}") for k, c in enumerate(named)], year.alias("this_year")
    ).withColumn("about", F.lower(F.concat_ws(" ", *[f"f{k}" for k in range(5)])))
    rows = once(rows, lowered=F.lower("text"))
    gated = rows.withColumn("gates", steps_in(F.col("lowered"), F.col("about"), F.col("text").contains("\u212a"), rules)).where("size(gates) > 0")
    text, lowered, about = F.col("text"), F.col("lowered"), F.col("about")
    name = F.coalesce(F.nullif("f1", F.lit("")), F.nullif(F.element_at(F.split("f0", r"[\\/]"), -1), F.lit("")), F.lit("artifact"))
    none = F.array().cast("array<string>")

    def seen(rule: Rule, step, pairs: dict[str, Column]) -> Column:
        s = _settings(rule, step)
        context = lambda: _holds(about, s.words) | _holds(lowered, s.words)
        if s.kind == "near":
            values = _near_values(text, s, context)
        elif s.kind == "after":
            values = _after_values(pairs[s.pattern], lowered, s, context)
        else:
            of_kind = _any(bool(s.extensions) and F.lower("f2").isin(*s.extensions), bool(s.pattern) and _found(s.pattern, text, False))
            values = F.when(context() & of_kind, F.array(name)).otherwise(none)
        return F.slice(F.array_distinct(F.transform(values, lambda x: redacted(x, squeeze=True))), 1, MOST_SAMPLES)

    def steps_of(number: int, rule: Rule) -> Column:
        # steps that look after the same words for as long share one search
        patterns = list(dict.fromkeys(_settings(rule, step).pattern for step in rule.steps if step.kind == "after"))

        passed = lambda k: F.array_contains("gates", SHIFT * number + k)

        def steps(pairs: dict[str, Column]) -> Column:
            return F.array(*[F.struct(F.lit(k).alias("step"), F.when(passed(k), seen(rule, step, pairs)).otherwise(none).alias("seen")) for k, step in enumerate(rule.steps)])

        def searched(p: str) -> Column:
            return F.when(_any(*[passed(k) for k, step in enumerate(rule.steps) if step.kind == "after" and _settings(rule, step).pattern == p]), _pairs(text, p, most_values))

        if patterns:
            every = F.transform(F.array(F.array(*map(searched, patterns))), lambda found: steps({p: found[k] for k, p in enumerate(patterns)}))[0]
        else:
            every = steps({})
        return F.when(passed(WHOLE), F.struct(F.lit(number).alias("rule"), F.filter(every, lambda x: F.size(x["seen"]) > 0).alias("steps")))

    spark = records.sparkSession
    key = (spark.sparkContext.applicationId, rules, most_values)
    if key not in _BUILT:
        # within a function of arrays, since so large an expression is beyond what Spark compiles
        _BUILT[key] = F.transform(F.array(F.lit(0)), lambda _: F.filter(F.array(*[steps_of(n, r) for n, r in enumerate(rules) if r.steps]), lambda x: F.size(x["steps"]) > 0))[0]
    every = _BUILT[key]
    found = gated.select("doc_id", F.lower(F.concat_ws(" ", "text", "f1", "f0", "f2")).alias("evidence"), F.explode(every).alias("x"))
    facts = F.broadcast(
        spark.createDataFrame(
            [(n, list(r.words), r.type, r.risk, r.description, r.category, r.tier, r.label) for n, r in enumerate(rules)],
            "rule int, own_words array<string>, type string, risk string, description string, category string, tier string, label string",
        )
    )
    marked = found.select("doc_id", "evidence", F.col("x.rule").alias("rule"), F.col("x.steps").alias("steps")).join(facts.select("rule", "own_words"), "rule")
    marked = once(marked, matched=_stands_alone(F.col("evidence"), F.col("own_words"))).select("doc_id", "rule", "steps", "matched")
    # rows of one record come together: a record may be repeated
    by_rule = marked.groupBy("doc_id", "rule").agg(F.array_sort(F.flatten(F.collect_list("steps"))).alias("steps"), F.first("matched").alias("matched_keywords"))
    samples = F.slice(F.array_distinct(F.flatten(F.transform("steps", lambda x: x["seen"]))), 1, MOST_SAMPLES)
    return by_rule.withColumn("samples", samples).join(facts.drop("own_words"), "rule").select(
        "doc_id", (F.col("rule") + 1).alias("pos"), "type", "risk", "description", F.size("samples").alias("count"), "samples",
        F.lit("gdpr").alias("framework"), "category", "tier", "label", "matched_keywords",
    )


def _group_rules(groups: DataFrame, rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """User-defined groups (type, terms; category, label, risk where a type is no rule's) as rules without steps.

    A library is a small table; more than ``MOST_TERMS`` terms are refused.
    """
    if (groups.agg(F.sum(F.size("terms"))).first()[0] or 0) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    known, out = {r.type: r for r in rules}, []
    order = [c for c in ("ord", "type") if c in groups.columns]
    for g in (r.asDict() for r in groups.orderBy(*order).collect()):
        kind = (g["type"] or "").strip()
        rule = known.get(kind)
        if not rule and not all(g.get(x) for x in ("category", "label", "risk")):
            continue
        given = lambda name, other: ((g.get(name) or "") or getattr(rule, name, "") or other).strip()  # noqa: B023, E731
        label = given("label", kind.replace("_", " ").title())
        risk = given("risk", "MEDIUM").upper()
        terms = tuple(t for t in (" ".join((x or "").split()) for x in g["terms"] or ()) if t)
        out.append(
            Rule(kind, label, rule.tier if rule else "custom", given("category", "custom"), risk if risk in ("LOW", "MEDIUM", "HIGH", "CRITICAL") else "MEDIUM",
                 rule.description if rule else f"Custom GDPR keyword group matched for {label}.", terms, ())
        )
    return tuple(out)


def custom_terms(records: DataFrame, groups: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, ord, type, terms: a row per record of ``records`` (doc_id, content; name, path, extension) and group
    of ``groups`` (type, terms) with terms that stand in its text, name, path or extension, ten at most.

    A term that begins and ends with a letter or digit stands alone: beside it is no ASCII letter, digit or
    underscore. Others may stand anywhere. Case and repeated spaces of terms do not matter.
    """
    own = _group_rules(groups, rules)
    spark = records.sparkSession
    has = {f.lower() for f in records.columns}
    evidence = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("") for c in ("content", "name", "path", "extension")]))
    rows = records.where("doc_id is not null").select("doc_id", evidence.alias("evidence"))
    terms = spark.createDataFrame([(n, r.type, list(r.words)) for n, r in enumerate(own)], "rule int, type string, own_words array<string>")
    found = rows.withColumn("rules", rules_in(F.col("evidence"), own)).select("doc_id", "evidence", F.explode("rules").alias("rule")).join(F.broadcast(terms), "rule")
    found = once(found, terms=_stands_alone(F.col("evidence"), F.col("own_words")))
    return found.where("size(terms) > 0").select("doc_id", F.col("rule").alias("ord"), "type", "terms")


def with_custom(found: DataFrame, records: DataFrame, groups: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of :func:`detect` and those of user-defined groups: terms of a known type join its
    finding, each one more sample; those of another type make findings after all rules'."""
    own = _group_rules(groups, rules)
    spark = records.sparkSession
    place = {r.type: n + 1 for n, r in enumerate(rules)}
    about = spark.createDataFrame(
        [(n, place.get(r.type, len(rules) + 1 + n), r.risk, r.description, r.category, r.tier, r.label) for n, r in enumerate(own)],
        "ord int, pos int, risk string, description string, category string, tier string, label string",
    )
    ordered = F.array_sort(F.collect_list(F.struct("ord", "terms")))
    custom = custom_terms(records, groups, rules).groupBy("doc_id", "type").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["terms"]))).alias("terms"), F.min("ord").alias("ord"))
    custom = custom.join(F.broadcast(about), "ord").select("doc_id", "type", "terms", *[F.col(c).alias(f"own_{c}") for c in about.columns if c != "ord"])
    none = F.array().cast("array<string>")
    joined = found.join(custom, ["doc_id", "type"], "full")
    new = F.array_except(F.coalesce("terms", none), F.coalesce("matched_keywords", none))
    fields = {c: F.coalesce(F.col(c), F.col(f"own_{c}")) for c in ("pos", "risk", "description", "category", "tier", "label")}
    return joined.select(
        "doc_id", fields["pos"].alias("pos"), "type", fields["risk"].alias("risk"), fields["description"].alias("description"),
        (F.coalesce("count", F.lit(0)) + F.size(new)).cast("int").alias("count"),
        F.concat(F.coalesce("samples", none), F.transform(new, lambda t: redacted(t, squeeze=True))).alias("samples"), F.lit("gdpr").alias("framework"),
        fields["category"].alias("category"), fields["tier"].alias("tier"), fields["label"].alias("label"), F.concat(F.coalesce("matched_keywords", none), new).alias("matched_keywords"),
    )


def into_findings(classified: DataFrame, found: DataFrame) -> DataFrame:
    """``classified`` with the rows of :func:`detect` behind the findings of each record, in their order; a record's
    score, categories and remediation then follow from both."""
    rows = found.select("doc_id", F.struct("pos", "type", "risk", "count", "samples", "category", "label").alias("f")).groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("more"))
    moved = F.transform("more", lambda f: F.struct((f["pos"] + 1000).alias("pos"), f["type"], f["risk"], f["count"], f["samples"], f["category"], f["label"]))
    return classified.join(rows, "doc_id", "left").withColumn("findings", F.concat("findings", F.coalesce(moved, F.array().cast(ITEM)))).drop("more")
