"""Personal data, also where it is disguised, with spans in the source text.

Plain detectors run on the text itself. Then three transducers rewrite disguised stretches into
plain characters while an offset map keeps, for each character written, the source range it came from:

1. homoglyphs: wide, small and mathematical forms, Cyrillic and Greek letters that look like Latin ones and
   decimal digits of any script become ASCII; zero-width characters go;
2. spelled digits: runs of numbers with digit words in them ("five five 5") become digits, "plus" before them a sign;
   four numbers up to 255 with dots between, plain or worded, keep the dots;
3. disguised signs: in addresses and dotted numbers, each "at" and "dot" may be bracketed, worded or plain.

The detectors run on the rewritten text, and each span found is mapped back through the composed
offsets. Texts without any disguise are never rewritten.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import in_slices, texts
from traceframe.llm.spans import Cover, Span, digest, joined

KINDS = ("email", "ip", "card", "phone")

# The base patterns, each written so that no start is tried twice over the same run.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like Latin ones, source then Latin.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУавеѕіјкмнорстху", "ABESIJKMHOPCTXYabesijkmhopctxy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaiknopux"))
# Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Characters without width.
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def plain_forms() -> dict[str, str]:
    """Characters that stand for one ASCII character: font, wide and small forms, and decimal digits."""
    out = {}
    for c in map(chr, range(0x80, 0x20000)):
        form = unicodedata.decomposition(c).split()
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            out[c] = str(digit)
        elif len(form) == 2 and form[0] in ("<font>", "<wide>", "<small>") and "!" <= chr(int(form[1], 16)) <= "~":
            out[c] = chr(int(form[1], 16))
    return out


LOOKALIKE = plain_forms() | CYRILLIC | GREEK
TRANSLATION = str.maketrans(LOOKALIKE)
# A set: as a class of a pattern these characters are tried one range after another.
HOMOGLYPHS = frozenset(LOOKALIKE) | frozenset(ZERO_WIDTH)
NO_WIDTH = re.compile("[" + ZERO_WIDTH + "]+")
NUMBER = "(?:" + "|".join(DIGIT_WORDS) + ")"
ITEM = rf"(?:{NUMBER}|[0-9]++)(?![^\W_])"
SPELLED = re.compile(rf"(?<![^\W_])(?:\+|plus +)?{ITEM}(?:(?: ++dot ++| *+[\[({{<] *+dot *+[\])}}>] *+|[ .\-]{{1,2}}){ITEM})++", re.I | re.A)
SPELLED_PART = re.compile(rf"{NUMBER}|[0-9]+|\+|plus|dot|(?<![ .\-])\.(?![ .\-])", re.I | re.A)
WORD_DIGIT = re.compile(NUMBER, re.I | re.A)
BRACKETED = re.compile(r"[\[({<]\s*(at|dot)\s*[\])}>]\s*", re.I | re.A)
AT = re.compile(r"@|(?<! ) ++at +", re.I | re.A)
DOT_WORD = re.compile(r"(?<! ) ++dot +", re.I | re.A)
HOST_DOT = re.compile(r" +dot +|\.", re.I | re.A)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?: ++dot ++|\.)[A-Za-z0-9-]++)++", re.I | re.A)
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:(?: ++dot ++|\.)[0-9]++)++", re.I | re.A)
TLD = re.compile(r"[A-Za-z]{2}\Z")
# A cheap test that some transducer could have work to do.
HINT = re.compile(rf"[\[({{<]\s*(?:at|dot)\s*[\])}}>]| dot |(?<![^\W_]){NUMBER}[ .\-]{{1,2}}(?:{NUMBER}|[0-9])|[0-9][ .\-]{{1,2}}{NUMBER}(?![^\W_])", re.I | re.A)


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping: each '@' with the whole run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in LOCAL_SET:
                start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


Mapped = tuple[str, list[tuple[int, int]]]


def rewrite(mapped: Mapped, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Mapped:
    """Applies edits (start, end, written characters with their own ranges in the current text)."""
    text, ranges = mapped
    if not edits:
        return mapped
    parts, out, done = [], [], 0
    for start, end, written in edits:
        parts.append(text[done:start])
        out += ranges[done:start]
        for c, a, b in written:
            parts.append(c)
            out.append((ranges[a][0], ranges[b - 1][1]))
        done = end
    parts.append(text[done:])
    out += ranges[done:]
    return "".join(parts), out


def homoglyphs(mapped: Mapped) -> Mapped:
    text, ranges = mapped
    # One character for one, so the ranges stay; only what has no width is cut out.
    return rewrite((text.translate(TRANSLATION), ranges), [(*m.span(), []) for m in NO_WIDTH.finditer(text)])


def spelled_digits(mapped: Mapped) -> Mapped:
    """Every run is written, however short; the detectors decide what it means."""
    edits = []
    for m in SPELLED.finditer(mapped[0]):
        if not WORD_DIGIT.search(m.group()):
            continue
        written = []
        for p in SPELLED_PART.finditer(mapped[0], *m.span()):
            a, b = p.span()
            word = p.group().lower()
            plain = DIGIT_WORDS.get(word) or {"plus": "+", "dot": "."}.get(word)
            written += [(plain, a, b)] if plain else [(c, a + i, a + i + 1) for i, c in enumerate(word)]
        parts = "".join(c for c, _, _ in written).split(".")
        if not (len(parts) == 4 and all(part.isdigit() and small(part) for part in parts)):
            written = [w for w in written if w[0] != "."]
        edits.append((*m.span(), written))
    return rewrite(mapped, edits)


def local_part(text: str, end: int, limit: int, words: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Start of the local part that ends at ``end``, not before ``limit``, and the worded dots in it."""
    start, dots = end, []
    while True:
        a = b = dots[-1][0] if dots else end
        while a > limit and text[a - 1] in LOCAL_SET:
            a -= 1
        if a == b:
            return start, dots[:-1]
        start = a
        if words.get(a, -1) < limit:
            return start, dots
        dots.append((words[a], a))


def signs(mapped: Mapped) -> Mapped:
    """Bracketed signs everywhere, then worded ones in addresses and dotted numbers; a sign may be plain beside others."""
    edits, done = [], 0
    for m in BRACKETED.finditer(mapped[0]):
        a, b = m.span()
        # Looked for backwards: as a head of the pattern, each blank of a long run would be a start.
        while a > done and mapped[0][a - 1] in " \t\n\r\f\v":
            a -= 1
        edits.append((a, b, [("@" if m.group(1).lower() == "at" else ".", a, b)]))
        done = b
    mapped = text, ranges = rewrite(mapped, edits)
    words = {m.end(): m.start() for m in DOT_WORD.finditer(text)}
    found, limit = {}, 0
    for at in AT.finditer(text):
        if at.start() < limit:
            continue
        host, worded = HOST.match(text, at.end()), at.group() != "@"
        start, local = local_part(text, at.start(), limit, words)
        limit = at.end()
        if not host or start == at.start():
            continue
        end, dots = host.end(), [d.span() for d in HOST_DOT.finditer(text, at.end(), host.end())]
        # What a word joins to an address, or "at" to a name, has a last label that ends in letters.
        while dots and (worded or text[dots[-1][0]] == " ") and not TLD.search(text, dots[-1][1], end):
            end = dots.pop()[0]
        spelled = local + [d for d in dots if text[d[0]] == " "]
        # "at" alone is an ordinary word: it needs a disguised dot, worded or bracketed.
        bracketed = any(text[i] == "." and ranges[i][1] - ranges[i][0] > 1 for i in range(start, end))
        if dots and (spelled or bracketed or not worded):
            found |= {d: "." for d in spelled} | ({at.span(): "@"} if worded else {})
            limit = end
    for m in NUMBERS.finditer(text):
        found |= {d.span(): "." for d in DOT_WORD.finditer(text, *m.span())}
    return rewrite(mapped, [(a, b, [(c, a, b)]) for (a, b), c in sorted(found.items())])


def disguised_spans(text: str) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets."""
    if not HINT.search(text) and (text.isascii() or HOMOGLYPHS.isdisjoint(text)):
        return []
    mapped = signs(spelled_digits(homoglyphs((text, [(i, i + 1) for i in range(len(text))]))))
    if mapped[0] == text:
        return []
    return [(kind, mapped[1][a][0], mapped[1][b - 1][1]) for kind, a, b in plain_spans(mapped[0])]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the transducers add: over a base span of the same kind only if they say more than it."""
    base = plain_spans(text)
    hidden = disguised_spans(text)
    if not hidden:
        return base, []
    added: dict[Span, None] = {}
    # Base spans of one kind do not overlap, so those that a span meets are neighbours.
    own = {kind: Cover(s for s in base if s[0] == kind) for kind in KINDS}
    for kind, a, b in hidden:
        cover = own[kind]
        met = cover.meeting(a, b)
        inside = not met or (a <= cover.starts[met[0]] and cover.ends[met[-1]] <= b)
        if inside and not (len(met) == 1 and (cover.starts[met[0]], cover.ends[met[0]]) == (a, b)):
            added[kind, a, b] = None
    return base, list(added)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, n_disguised, for every row.

    A null or empty text has no spans. Rows with a null or repeated id keep a row each; other columns
    are not read; an empty table gives no rows. One scan and one map, no shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches):
        for batch in in_slices(batches):
            rows = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")}
            for text in batch.column(1).to_pylist():
                base, added = find_spans(text)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["n_disguised"].append(len(added))
                rows["base_sha256"].append(digest(base, KINDS))
                rows["spans"].append(joined(base + added, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()]], names=["doc_id", *rows]
            )

    return texts(docs, "doc_id").mapInArrow(
        find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    )


def masked(text: str) -> str:
    """The text with every span, base or disguised, replaced by its kind in brackets; spans that meet become one."""
    base, added = find_spans(text)
    out, done, end = [], 0, 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[done:a] if a > done else "", f"[{kind.upper()}]"]
        end = done = max(end, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """The same columns and rows with personal data masked in ``text`` (null stays null) and ``n_chars`` counted anew."""
    fields = docs.columns
    at = fields.index("text")

    def mask(batches):
        for batch in in_slices(batches):
            new = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in fields else out
