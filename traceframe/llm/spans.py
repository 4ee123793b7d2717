"""Spans as text: ``kind:start:end`` by start, then kind as listed, comma-joined; code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


class Cover:
    """Stretches of a text that do not meet, in order; what joins or meets them is found by bisection."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meeting(self, a: int, b: int) -> range:
        """Places of the stretches that share a character with [a, b)."""
        return range(bisect_right(self.ends, a), bisect_left(self.starts, b))

    def add(self, a: int, b: int) -> bool:
        """Takes [a, b) in unless it meets a stretch."""
        if self.meeting(a, b):
            return False
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True
