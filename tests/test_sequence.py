import random

import pytest

from traceframe.operators import sequence


def brute(seq, max_period=8):
    """Blocks by the definition, on a list."""
    out, i, n = [], 0, len(seq)
    while i < n:
        for p in range(1, max_period + 1):
            if i + 2 * p <= n and seq[i : i + p] == seq[i + p : i + 2 * p]:
                r = 2
                while seq[i : i + p] == seq[i + r * p : i + (r + 1) * p]:
                    r += 1
                out.append(("loop", i, p * r, r, tuple(seq[i : i + p])))
                i += p * r
                break
        else:
            if out and out[-1][0] == "straight":
                k, s, ops, r, b = out[-1]
                out[-1] = (k, s, ops + 1, r, (*b, seq[i]))
            else:
                out.append(("straight", i, 1, 1, (seq[i],)))
            i += 1
    return out


def rolled(spark, sequences, **kw):
    rows = [(k, i, x) for k, seq in sequences.items() for i, x in enumerate(seq)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, x STRING").repartition(3)
    pieces = sequence.roll_loops(df, ["k"], ["i"], "x", **kw).collect()
    out = {k: {} for k in sequences}
    for r in sorted(pieces, key=lambda r: (r.k, r.piece_start)):
        old = out[r.k].get(r.block_start)
        body = tuple(r.body)
        out[r.k][r.block_start] = (
            (r.kind, r.block_start, r.ops, r.repeat, body) if old is None
            else (old[0], old[1], old[2] + r.ops, old[3], old[4] + body)
        )
    return {k: [v[s] for s in sorted(v)] for k, v in out.items()}


VECTORS = {
    "five": list("aaaaa"), "abc4": list("abc" * 4), "mixed": list("xaaayz"), "straight": list("ab"), "one": ["q"],
    "rounds": list("abc" * 6) + ["z"],
}


def test_vectors(spark):
    got = rolled(spark, VECTORS)
    assert got["five"] == [("loop", 0, 5, 5, ("a",))]
    assert got["abc4"] == [("loop", 0, 12, 4, ("a", "b", "c"))]
    assert [b[0] for b in got["mixed"]] == ["straight", "loop", "straight"]
    assert got["straight"] == [("straight", 0, 2, 1, ("a", "b"))]
    assert got == {k: brute(v) for k, v in VECTORS.items()}


@pytest.mark.parametrize("chunk,max_period,fan", [(16, 8, 2), (17, 8, 3), (33, 8, 256), (8, 4, 2), (65_536, 8, 256), (6, 3, 5), (2, 1, 2)])
def test_chunks_do_not_matter(spark, chunk, max_period, fan):
    rng = random.Random(chunk)
    cases = {}
    for c in range(30):
        seq = []
        while len(seq) < rng.randrange(1, 220):
            body = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
            seq += body * rng.choice([1, 1, 2, 3, 5, 30])
        cases[f"c{c}"] = seq
    assert rolled(spark, cases, chunk=chunk, max_period=max_period, fan=fan) == {k: brute(v, max_period) for k, v in cases.items()}


def test_monotonic(spark):
    df = spark.createDataFrame([("s", 0, 1), ("s", 1, 3), ("s", 2, 3), ("s", 3, 2), ("r", 4, 0)], "k STRING, i BIGINT, v BIGINT")
    assert sorted(r.i for r in sequence.non_monotonic(df, ["k"], ["i"], "v").collect()) == [2, 3, 4]


def test_one_long_key_is_composed_from_stretches(spark):
    """A straight stretch, a loop over many chunks and period changes: entries in the middle of stretches."""
    rng = random.Random(5)
    seq = [str(i) for i in range(70)] + ["a", "b", "c"] * 150 + [rng.choice("xyz") for _ in range(300)] + ["q"] * 200 + [str(i) for i in range(90)]
    for period in range(1, 9):
        assert rolled(spark, {"k": seq, "other": ["u"] * 9}, chunk=16, max_period=period, fan=4) == {"k": brute(seq, period), "other": brute(["u"] * 9, period)}


def test_null_key(spark):
    rows = [(None, i, "ab"[i % 2]) for i in range(40)] + [("s", i, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, x STRING")
    got = sequence.blocks(sequence.roll_loops(df, ["k"], ["i"], "x", max_period=2, chunk=4, fan=2), ["k"]).collect()
    assert {(r.k, r.block_start, r.kind, r.ops, r.repeat) for r in got} == {(None, 0, "loop", 40, 20), ("s", 0, "loop", 20, 20)}
