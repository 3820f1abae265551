"""Copied coverage by a suffix automaton over words."""

from __future__ import annotations

import re
from functools import lru_cache

_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class SuffixAutomaton:
    """Recognises every run of words of one text; ``next[state][word]`` is a state."""

    __slots__ = ("next", "link", "length", "end")

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for position, token in enumerate(tokens, 1):
            state = self._new(self.length[last] + 1, {}, 0, position)
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], self.end[q])
                    while p >= 0 and self.next[p].get(token) == q:
                        self.next[p][token] = clone
                        p = self.link[p]
                    self.link[q] = self.link[state] = clone
            last = state

    def _new(self, length: int, edges: dict[str, int], link: int, end: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.next) - 1


@lru_cache(maxsize=4096)
def automaton(question: str) -> tuple[SuffixAutomaton, int]:
    tokens = words(question)
    return SuffixAutomaton(tokens), len(tokens)


def coverage(question: str, response: str, run: int = 3) -> tuple[float, float, float]:
    """(share of the response's words inside runs of at least ``run`` words of the question,
    share of the question covered by them, how far into the question the last such run reaches)."""
    sam, n = automaton(question)
    tokens = words(response)
    if not tokens or not n:
        return 0.0, 0.0, 0.0
    state, matched = 0, 0
    covered, seen = bytearray(len(tokens)), bytearray(n + 1)
    reach = 0
    for i, token in enumerate(tokens):
        while state and token not in sam.next[state]:
            state = sam.link[state]
            matched = sam.length[state]
        if token in sam.next[state]:
            state = sam.next[state][token]
            matched += 1
        else:
            state, matched = 0, 0
        if matched >= run:
            covered[i - matched + 1 : i + 1] = b"\x01" * matched
            stop = sam.end[state]
            seen[stop - matched + 1 : stop + 1] = b"\x01" * matched
            reach = stop
    return sum(covered) / len(tokens), sum(seen) / n, reach / n
