"""Searches in linear time for patterns that a backtracking engine would try again from every place."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from quillward.functions import rules
from quillward.functions.rules import pattern

LOST, WORD = (re.compile(pattern(p, "i", "py")) for p in rules.LOST)


def tamed(text: str) -> str:
    """The text with words that begin no statement made unlike it, at the same places."""
    return LOST.sub(lambda m: WORD.sub("UPDAT_", m[0]), text)


class Rule:
    """The hits of a phrase rule."""

    def __init__(self, k: int):
        find, test = rules.linear(k, "py")
        self.find, self.test = re.compile(find), re.compile(test) if test else None
        self.tame: Callable[[str], str] | None = tamed if k == rules.LOST_RULE else None

    def finditer(self, text: str) -> Iterator[re.Match]:
        for m in self.find.finditer(self.tame(text) if self.tame else text):
            if self.test is None or self.test.search(m[0]):
                yield m

    def sub(self, put: str, text: str) -> str:
        if self.test is None and self.tame is None:
            return self.find.sub(put, text)
        out, at = [], 0
        for m in self.finditer(text):
            out += [text[at : m.start()], put]
            at = m.end()
        return "".join(out) + text[at:]


def upto(text: str, end: str) -> str:
    """The text as far as the last end mark: what opens behind it is never closed."""
    return text[: text.rfind(end) + len(end)] if end in text else ""


RUN = re.compile(r"\s*\S*")


def opened(text: str, begin: re.Pattern, close: str, follow: str, whole: re.Pattern) -> Iterator[re.Match]:
    """Matches of a whole that runs from a begin over all but close to the first close, which follow stands behind.

    Where one fails, every begin before the same close fails, and the search goes on behind it. A whole that fails
    behind a follow fails in all of the run of letters there, so what is followed within that run is not tried."""
    at = dead = 0
    while True:
        m = begin.search(text, at)
        end = text.find(close, m.end()) if m else -1
        if end < 0:
            return
        behind = end + len(close) + len(follow)
        tried = text.startswith(follow, end + len(close)) and behind >= dead
        found = whole.match(text, m.start()) if tried else None
        if found:
            yield found
        elif tried and follow:
            dead = RUN.match(text, behind).end()
        at = max(found.end() if found else end + len(close), m.start() + 1)
