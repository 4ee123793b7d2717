"""Public tokenizer files applied by pre-token, with a cache of what each pre-token becomes.

Merges never cross pre-tokens, so a text is split as the file splits it and each pre-token (where the file
allows, each word) is looked up; only unknown ones are encoded, by the library, in batches. Texts whose
characters lie beyond Latin letters, and texts with special strings, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import regex

#: Beyond ASCII, the fast split takes only the letters U+00C0 to U+00FF (two of these places are signs).
NOT_PLAIN = re.compile(rb"<\||[\xc2\xc4-\xff]|\xc3[\x97\xb7]")
#: From U+0250 on, as UTF-8: left to the library, since normal forms and letter classes are its own.
BEYOND_LATIN = re.compile(rb"<\||[\xca-\xff]|\xc9[\x90-\xff]")
#: Longer pre-tokens are encoded but not kept, so the cache is bounded in bytes too.
KEEP_BYTES = 64

# How the byte-level file splits a text before merges, over plain bytes and over Latin text.
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
TEXT_PLAIN = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+|" + CONTRACTION.encode() + rb"| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
TEXT_LATIN = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+|{CONTRACTION}| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pretokens:
    """What the library makes of each pre-token, converted; a bounded cache over a given table."""

    def __init__(self, path: str, plain, latin, lower: bool, convert, given: dict | None = None, limit: int = 400_000):
        self.library, self.limit, self.lower = load(path), limit, lower
        self.plain, self.latin, self.convert = plain, latin, convert
        self.given = given or {}
        self.known: dict = dict(self.given)

    def split(self, raw: bytes) -> list[bytes] | None:
        """The text's pre-tokens; None where the library has to see the text whole."""
        if not NOT_PLAIN.search(raw):
            # Lower-casing ASCII alone never changes what a lower-casing file makes of a text.
            return self.plain.findall(raw.lower() if self.lower else raw)
        if BEYOND_LATIN.search(raw):
            return None
        return [p.encode() for p in self.latin.findall((raw.lower() if self.lower else raw).decode())]

    def values(self, raw: list[bytes], combine) -> list:
        """For each text the combined values of its pre-tokens."""
        lists = [self.split(x) for x in raw]
        if len(self.known) > self.limit + len(self.given):
            # What was met first is what is met most; the later half goes.
            self.known = dict(islice(self.known.items(), self.limit // 2 + len(self.given)))
        known, missing = self.known, set()
        for pieces in lists:
            missing.update(filterfalse(known.__contains__, pieces or ()))
        long: dict = {}
        ordered = list(missing)
        for start in range(0, len(ordered), 4096):
            some = ordered[start : start + 4096]
            for piece, e in zip(some, self.library.encode_batch([p.decode() for p in some], add_special_tokens=False)):
                (known if len(piece) <= KEEP_BYTES else long)[piece] = self.convert(e.ids)
        # The few that are too long to keep stand in front of the kept ones for this call.
        table = ChainMap(long, known) if long else known
        whole = lambda x: self.convert(self.library.encode(x.decode(), add_special_tokens=False).ids)
        return [whole(x) if pieces is None else combine(map(table.__getitem__, pieces)) for x, pieces in zip(raw, lists)]


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit integers; for the file that lower-cases and drops white space.

    No pre-token crosses white space there, so texts are split into words and words are looked up, both by C code.
    Unknown words go to the library many at a time, as one text in which a control character, a token of its own, stands
    between them. Texts with letters beyond Latin go to the library whole.
    """

    MARK = "\x01"

    def __init__(self, path: str, limit: int = 800_000):
        self.library, self.limit, self.words = load(path), limit, {}
        self.mark = self.ids(self.MARK)
        self.apart = len(self.mark) == 1 and self.ids(f"a {self.MARK} b") == [*self.ids("a"), *self.mark, *self.ids("b")]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encoded(self, words: list[bytes], at_once: int = 2000) -> list[bytes]:
        """The ids of each word."""
        alone = {i for i, w in enumerate(words) if not self.apart or self.MARK.encode() in w}
        rest = [w for i, w in enumerate(words) if i not in alone] if alone else words
        between, out = f" {self.MARK} ", []
        for start in range(0, len(rest), at_once):
            some = rest[start : start + at_once]
            ids = np.array(self.ids(between.join([w.decode() for w in some])), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends)]
        if alone:
            others = iter(out)
            out = [np.array(self.ids(w.decode()), "<u4").tobytes() if i in alone else next(others) for i, w in enumerate(words)]
        return out

    def __call__(self, raw: list[bytes]) -> list[bytes]:
        whole = {i for i, x in enumerate(raw) if BEYOND_LATIN.search(x)}
        lists = [() if i in whole else x.lower().split() for i, x in enumerate(raw)]
        if len(self.words) > self.limit:
            # What was met first is what is met most; the later half goes.
            self.words = dict(islice(self.words.items(), self.limit // 2))
        missing = list(set().union(*lists).difference(self.words.keys()))
        made = self.encoded(missing)
        long = {w: ids for w, ids in zip(missing, made) if len(w) > KEEP_BYTES}
        self.words.update((w, ids) for w, ids in zip(missing, made) if len(w) <= KEEP_BYTES)
        # The few that are too long to keep stand in front of the kept ones for this call.
        table = ChainMap(long, self.words) if long else self.words
        return [np.array(self.ids(raw[i].decode()), "<u4").tobytes() if i in whole else b"".join(map(table.__getitem__, words)) for i, words in enumerate(lists)]


class TokenLengths:
    """Token counts of whole texts: a given table of frequent pre-tokens, then a cache, then the library."""

    def __init__(self, path: str, frequent: dict[bytes, int], limit: int = 400_000):
        self.pretokens = Pretokens(path, TEXT_PLAIN, TEXT_LATIN, False, len, frequent, limit)

    def __call__(self, raw: list[bytes]) -> list[int]:
        return self.pretokens.values(raw, sum)


@lru_cache(maxsize=2)
def worker_ids(path: str) -> WordIds:
    """The worker's own encoder: its cache serves all tasks that the worker runs."""
    return WordIds(path)


_LENGTHS: dict[tuple[str, int], TokenLengths] = {}


def worker_lengths(path: str, frequent: dict[bytes, int], limit: int) -> TokenLengths:
    """The worker's own counter, likewise."""
    if (path, limit) not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[path, limit] = TokenLengths(path, frequent, limit)
    return _LENGTHS[path, limit]
