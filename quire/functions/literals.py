"""Literals that a pattern cannot match without, and the automaton that finds them all in one reading of a text."""

from __future__ import annotations

import re
from bisect import bisect_right

_BREAKS = set("dDwWsSbBAzZGhHvVRtnrfae")  # escapes that stand for a class, a place or a control character


def _closing(pattern: str, i: int, opens: str, closes: str) -> int:
    """The place after the bracket that closes the one at i; -1 if there is none."""
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":
                return -1
            i += 1
        elif c == "[" and opens != "[":
            i = _closing(pattern, i, "[", "]") - 1
            if i < 0:
                return -1
        elif c == opens:
            depth += 1
            if c == "[" and pattern[i + 1 : i + 2] in ("]", "^"):
                i += 1 + (pattern[i + 1 : i + 3] == "^]")
                if pattern[i] == "]":
                    return -1
        elif c == closes:
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def needed_literal(pattern: str) -> str:
    """The longest run of characters outside brackets that every match of the pattern holds as it stands; empty if none is
    sure: with alternatives or flags at the top, quoted parts, or escapes by number. What may be left out (`?`, `*`,
    `{`) is not in a run."""
    runs, run, i = [], "", 0

    def stop() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "([":
            if c == "(" and pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
                return ""
            stop()
            i = _closing(pattern, i, c, ")" if c == "(" else "]")
            if i < 0:
                return ""
            continue
        if c in "?*{":
            run = run[:-1]
            stop()
            i = pattern.find("}", i) if c == "{" else i
            if i < 0:
                return ""
        elif c in "+.^$":
            stop()
        elif c == "\\":
            after = pattern[i + 1 : i + 2]
            if after in ("p", "P"):
                stop()
                i = pattern.find("}", i) if pattern[i + 2 : i + 3] == "{" else i + 2
                if i < 0:
                    return ""
            elif after in _BREAKS:
                stop()
                i += 1
            elif not after or after.isalnum():
                return ""
            else:
                run += after
                i += 1
        else:
            run += c
        i += 1
    stop()
    return max(runs, key=len)


def alphabet(pattern: str) -> frozenset[str] | None:
    """The characters that a match of the pattern can consist of; None if that isn't sure. Sure are plain characters, groups,
    alternatives, quantifiers and classes of plain characters and ranges, none of which looks beyond the match."""
    letters: set[str] = set()
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c in "\\.^$" or c == "(" and pattern[i + 1 : i + 2] == "?":
            return None
        if c == "[":
            end = pattern.find("]", i)
            body = pattern[i + 1 : end]
            if end < 0 or not body or body[0] == "^" or any(x in body for x in "[\\&"):
                return None
            while body:
                if body[1:2] == "-" and len(body) > 2:
                    if not 0 <= ord(body[2]) - ord(body[0]) < 1000:
                        return None
                    letters |= set(map(chr, range(ord(body[0]), ord(body[2]) + 1)))
                    body = body[3:]
                else:
                    letters.add(body[0])
                    body = body[1:]
            i = end
        elif c == "{":
            i = pattern.find("}", i)
            if i < 0:
                return None
        elif c not in "()|?*+":
            letters.add(c)
        i += 1
    return frozenset(letters)


def excerpts(patterns: list[str]):
    """A function of a text: (place in `patterns`, excerpt) of the patterns whose literal the text holds. The excerpt has the
    same matches as the text: the runs of the pattern's alphabet that hold the literal, between characters that aren't in
    it. It is the text itself if the alphabet isn't sure or there is no literal."""
    import ahocorasick

    literals = [needed_literal(p) for p in patterns]
    letters = [alphabet(p) if literal else None for p, literal in zip(patterns, literals, strict=True)]
    between = {own: next((c for c in "\n\0\x01" if c not in own), None) for own in {*letters} - {None}}
    letters = [None if own is None or between[own] is None else own for own in letters]
    runs = {own: re.compile("[" + "".join(map(re.escape, sorted(own))) + "]+") for own in {*letters} - {None}}
    places: dict[str, list[int]] = {}
    for i, literal in enumerate(literals):
        places.setdefault(literal, []).append(i)
    always = places.pop("", [])
    found = ahocorasick.Automaton()
    for literal, own in places.items():
        found.add_word(literal, own)
    found.make_automaton()

    def held(text: str) -> list[tuple[int, str]]:
        out = [(i, text) for i in always]
        ends: dict[int, list[int]] = {}
        for end, own in found.iter(text) if places else ():
            for i in own:
                ends.setdefault(i, []).append(end)
        spans: dict[frozenset, tuple[list[int], list[str]]] = {}
        for i, at in ends.items():
            own = letters[i]
            if own is None:
                out.append((i, text))
                continue
            if own not in spans:
                every = list(runs[own].finditer(text))
                spans[own] = [m.start() for m in every], [m.group() for m in every]
            starts, parts = spans[own]
            out.append((i, between[own].join([parts[j] for j in dict.fromkeys(bisect_right(starts, end) - 1 for end in at)])))
        return out

    return held
