"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

A candidate is a maximal run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that touches no base
span and holds a letter and a digit. Its encoding is inferred from its characters (hex, base 32, base 62,
base 64). Where no encoding fits the run or a base span touches it, the candidates are its parts of 20 or
more characters: split at inner '=', then at '-' and '_', at '+' and '/', and at all four. Three tests of
"drawn evenly and independently from that alphabet" are made:

* chi-squared of the symbol counts against uniform, symbols pooled so that each cell expects 2 or more;
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* serial correlation at lag 1 of the symbols' ranks.

The smallest of the three p-values, times three, is the p-value of "this is random". Tokens that are
not random (paths, identifiers, repeated text) get small ones. They are told apart under control
of the false discovery rate, weighted by length: a long token's tests have more power, so its weight in the
Benjamini-Hochberg step is larger, with mean weight 1 over all candidates of the corpus. What
the step rejects is ordinary text, by which at most a share ``rate`` of rejections are expected to be
random; what it keeps is reported as kind ``random`` if the encoding makes it at least ``bits`` bits long; of parts
that overlap, the longest. The step needs only a histogram of (length, p) over all candidates, counted by Spark.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import in_slices, stored, texts
from traceframe.llm.spans import Cover, Span, digest, joined

KINDS = ("assign", "access", "hex", "random")

# The three base patterns. Letters of the keyword in either case, in ASCII only.
KEYWORD = "(?:" + "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
) + ")"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A maximal run fails or passes as a whole, so the minimum can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Parts of a run: around '=', which ends the last part as padding, and of one alphabet each.
FIELD = re.compile(r"[^=]+(?:=+\Z)?")
PARTS = tuple(re.compile(p) for p in (r"[^=_-]+=*", r"[^=+/]+=*", r"[A-Za-z0-9]+=*"))

BINS = 200
# Shortest length of each class; the last one is open.
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)


def base_spans(text: str) -> list[Span]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def symbols(token: str) -> tuple[str, np.ndarray, int] | None:
    """Inferred encoding, ranks of the characters in it, and its size."""
    body = token.rstrip("=")
    kinds = {"d": any(c.isdigit() for c in body), "l": any(c.islower() for c in body), "u": any(c.isupper() for c in body)}
    if not kinds["d"] or not (kinds["l"] or kinds["u"]):
        return None
    for name, alphabet in (
        ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ):
        at = {c: i for i, c in enumerate(alphabet)}
        if all(c in at for c in body):
            return name, np.array([at[c] for c in body]), len(alphabet)
    return None


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-12 * total:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 400):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return min(1.0, max(0.0, h * scale))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def p_uniform(ranks: np.ndarray, size: int) -> float:
    n = len(ranks)
    cells = max(2, min(size, n // 2))
    # Neighbouring symbols share a cell; a cell expects as many as it has symbols.
    cell = ranks * cells // size
    expected = np.bincount(np.arange(size) * cells // size, minlength=cells) * (n / size)
    counts = np.bincount(cell, minlength=cells)
    return upper_gamma((cells - 1) / 2, float(((counts - expected) ** 2 / expected).sum()) / 2)


def p_runs(ranks: np.ndarray, size: int) -> float:
    high = ranks * 2 >= size
    n1 = int(high.sum())
    n2 = len(high) - n1
    n = n1 + n2
    if not n1 or not n2:
        return 2.0 ** (1 - n)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def p_serial(ranks: np.ndarray) -> float:
    x = ranks - ranks.mean()
    square = float((x * x).sum())
    n = len(x)
    if not square:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / square
    return two_sided((r + 1 / n) * math.sqrt(n))


def battery(token: str) -> tuple[float, float] | None:
    """p-value of "random", and the token's size in bits; None where no encoding fits."""
    found = symbols(token)
    if found is None or len(found[1]) < 16:
        return None
    _, ranks, size = found
    p = min(p_uniform(ranks, size), p_runs(ranks, size), p_serial(ranks))
    return min(1.0, 3 * p), len(ranks) * math.log2(size)


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, float, float]]:
    """Start, end, p-value and bits of each run, or of its parts where the run as a whole cannot be tested."""
    out, base = [], Cover(spans)

    def tested(a: int, b: int) -> bool:
        found = None if base.meeting(a, b) else battery(text[a:b])
        if found:
            out.append((a, b, *found))
        return found is not None

    for m in CANDIDATE.finditer(text):
        if tested(*m.span()):
            continue
        for f in FIELD.finditer(m.group()):
            a, b = m.start() + f.start(), m.start() + f.end()
            if b - a < LENGTHS[0] or ((a, b) != m.span() and tested(a, b)):
                continue
            parts = {(a + p.start(), a + p.end()) for pattern in PARTS for p in pattern.finditer(f.group())}
            for x, y in sorted(parts - {(a, b)}):
                if y - x >= LENGTHS[0]:
                    tested(x, y)
    return out


def longest(spans: list[Span]) -> list[Span]:
    """Of spans that overlap, the longest, the first among equals; in order of their starts."""
    kept, end = [], 0
    # Parts of one run meet only each other: each group of spans that meet is settled on its own.
    group: list[Span] = []
    for span in [*sorted(spans, key=lambda s: s[1:]), None]:
        if group and (span is None or span[1] >= end):
            taken = Cover()
            chosen = [s for s in sorted(group, key=lambda s: (s[1] - s[2], s[1])) if taken.add(s[1], s[2])]
            kept += sorted(chosen, key=lambda s: s[1])
            group = []
        if span:
            end = max(end, span[2]) if group else span[2]
            group.append(span)
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans, and the candidates with their p-values."""
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64()), ("p", pa.float64()), ("cell", pa.int32())])

    def find(batches):
        for batch in in_slices(batches):
            base, more = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                more.append([
                    {"start": a, "end": b, "p": p, "bits": bits, "cell": length_class(b - a) * BINS + p_bin(p)}
                    for a, b, p, bits in candidates(text, spans)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(item)), pa.array(more, pa.list_(candidate))], names=["doc_id", "base", "candidates"]
            )

    schema = f"doc_id {kind}, base array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,bits:double,p:double,cell:int>>"
    return texts(docs, "doc_id").mapInArrow(find, schema)


def p_bin(p: float) -> int:
    """Logarithmic bins: the upper edge of bin b is 10^(-(BINS - 1 - b) / 10)."""
    return max(0, BINS - 1 - int(math.floor(-10 * math.log10(max(p, 1e-300)) + 1e-9)))


def length_class(length: int) -> int:
    return max(i for i, low in enumerate(LENGTHS) if length >= low)


def rejection_limit(histogram: dict[tuple[int, int], int], rate: float) -> dict[int, float]:
    """Largest p-value rejected, by length class: Benjamini-Hochberg on p / weight.

    The weight of a class grows as the square root of its shortest length and has mean 1 over all
    candidates. ``histogram`` counts candidates by (length class, bin of p).
    """
    total = sum(histogram.values())
    if not total:
        return {}
    raw = {i: math.sqrt(low) for i, low in enumerate(LENGTHS)}
    mean = sum(raw[c] * n for (c, _), n in histogram.items()) / total
    weight = {c: w / mean for c, w in raw.items()}
    edges = sorted((10 ** (-(BINS - 1 - b) / 10) / weight[c], n) for (c, b), n in histogram.items())
    limit, seen = 0.0, 0
    for edge, n in edges:
        seen += n
        if edge <= rate * seen / total:
            limit = edge
    return {c: limit * w for c, w in weight.items()}


def secret_spans(docs: DataFrame, rate: float = 0.05, bits: float = 96.0) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, n_random, for every row.

    A null or empty text has no spans (digest of the empty text). Rows with a null or repeated id keep
    a row each. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = stored(scan(docs), "secrets")
    cells = found.select(F.explode("candidates.cell").alias("cell")).groupBy("cell").count()
    # At most len(LENGTHS) * BINS rows.
    histogram = {divmod(r["cell"], BINS): r["count"] for r in cells.collect()}
    limits = rejection_limit(histogram, rate)

    def finish(batches):
        for batch in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
            for base, tested in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                extra = longest([
                    ("random", c["start"], c["end"]) for c in tested
                    if c["bits"] >= bits and c["p"] > limits[length_class(c["end"] - c["start"])]
                ])
                for k in KINDS[:3]:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in spans))
                rows["n_random"].append(len(extra))
                rows["base_sha256"].append(digest(spans, KINDS))
                rows["spans"].append(joined(spans + extra, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()]], names=["doc_id", *rows]
            )

    return found.mapInArrow(finish, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
