"""Which literal texts a pattern can begin with, as a cheap test before it is tried; patterns of many words."""

from __future__ import annotations

import re
from collections.abc import Iterable

_META = set("[(.^$|?*+{)")


def _run(text: str) -> str:
    """The literal characters that ``text`` must begin with."""
    out, at = "", 0
    while at < len(text):
        c, size = text[at], 1
        if c == "\\":
            c, size = text[at + 1 : at + 2], 2
            if not c or c.isalnum():  # a class or a boundary
                break
        elif c in _META:
            break
        if text[at + size : at + size + 1] in ("?", "*", "{"):  # it may be missing
            break
        out += c
        at += size
    return out


def leading(pattern: str, least: int = 2) -> tuple[str, ...] | None:
    """Lower-case texts one of which stands at the beginning of every match; None where that can't be told."""
    rest = pattern.removeprefix("(?i)").removeprefix(r"\b")
    before = re.match(r"(?:\\\W|[^\w\\\[(.^$|?*+{)])+(?=\()", rest)  # signs in front of a choice, such as a quote
    if before:
        rest = rest[before.end() :]
    if rest.startswith("("):
        depth, at, parts = 0, 0, [""]
        while at < len(rest):
            c = rest[at]
            if c == "\\":
                parts[-1] += rest[at : at + 2]
                at += 2
                continue
            if c == "[":
                end = rest.index("]", at + 2)
                parts[-1] += rest[at : end + 1]
                at = end + 1
                continue
            if c == "(":
                depth += 1
                if depth > 1:
                    parts[-1] += c
            elif c == ")":
                depth -= 1
                if not depth:
                    break
                parts[-1] += c
            elif c == "|" and depth == 1:
                parts.append("")
            else:
                parts[-1] += c
            at += 1
        if rest[at + 1 : at + 2] in ("?", "*", "{"):
            return None
        parts[0] = parts[0].removeprefix("?:")
        starts = [(_run(before[0]) if before else "") + _run(p.removeprefix(r"\b")) for p in parts]
    else:
        starts = [_run(rest)]
    if any(len(s) < least and (not s or s.isalnum()) or not s.isascii() for s in starts):  # a sign by itself is rare enough
        return None
    return tuple(dict.fromkeys(s.lower() for s in starts))


def folded(word: str) -> str:
    """The word with one character for all that Java takes for equal where case does not count."""
    fold = lambda c: "i" if c in "\u0130\u0131" else low if len(up := c.upper()) == 1 and len(low := up.lower()) == 1 else c.lower() if len(c.lower()) == 1 else c
    return "".join(map(fold, word))


def starting(words: Iterable[str], groups: int = 3) -> str:
    """A pattern for the longest of the words that stands at a place. Words that begin alike share a group, and a place is
    compared with the words of its own group only."""
    own = sorted(set(words))
    heads = sorted({w[0] for w in own})
    size = -(-len(heads) // groups) or 1
    parts = [heads[k : k + size] for k in range(0, len(heads), size)]
    quoted = [f"(?=[{''.join(map(re.escape, part))}]){_branches([w for w in own if w[0] in part])}" for part in parts]
    return f"(?:{'|'.join(quoted)})" if own else "(?!)"


def _branches(words: list[str]) -> str:
    """The words as a tree of their characters, longer ones first."""
    below: dict[str, list[str]] = {}
    for w in words:
        if w:
            below.setdefault(w[0], []).append(w[1:])
    parts = []
    for c, rests in below.items():
        quoted = re.escape(c)
        while len(rests) == 1 and rests[0]:
            quoted, rests = quoted + re.escape(rests[0]), [""]
        parts.append(quoted + _branches(rests))
    if not parts:
        return ""
    out = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return out + "?" * ("" in words)


def firsts(words: Iterable[str]) -> str:
    """A class that holds what any of the words begins with in either case; all that is not ASCII counts."""
    ascii_ones = sorted({x for w in words for x in (w[0].lower(), w[0].upper()) if x.isascii()})
    return "[" + "".join(re.escape(x) for x in ascii_ones) + r"[^\x00-\x7F]]"


def one_of(words: Iterable[str], ignore_case: bool = False) -> str:
    """A pattern for any of the words, of those that fit the longest that lets the rest match: they share their beginnings, so a place in a text costs
    a few steps and not one a word. With ``ignore_case`` words that only differ there are one."""
    own = list(dict.fromkeys(folded(w) if ignore_case else w for w in words if w))
    return f"(?={firsts(own)})(?:{_branches(own)})" if own else "(?!)"
