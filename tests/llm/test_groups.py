"""Near-duplicate groups, components and search against brute force."""

import collections
import math
import random

import numpy as np
import pytest

from traceframe.llm import near_dedup, topk_search
from traceframe.llm.components import components
from traceframe.llm.decontaminate import words_of

CLASH = "doc_id long, text string, node string, band int"


def brute_groups(rows, width, percent):
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return collections.Counter((d, len(s), None if d is None else find(d), d is None or d == find(d)) for d, s in sets)


def copies(rng, n):
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width, percent, block", [(3, 85, 8), (5, 80, 8), (3, 85, 768)])
def test_groups_equal_brute_force(spark, width, percent, block):
    rng = random.Random(width * block)
    rows = copies(rng, 60) + copies(rng, 10)[:10]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, rows[0][1]), (None, "alone"), (906, rows[3][1].upper()), (3, rows[3][1]), (906, "another text of this id here")]
    rows += [(907, "another text of this id here"), (908, "é one"), (909, "É one")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], CLASH)
    got = near_dedup.near_groups(docs, width, percent, block=block).cache()
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_groups(rows, width, percent)
    kept = near_dedup.keep_one(docs, got).collect()
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(named) == sorted({k[0] for k in brute_groups(rows, width, percent) if k[3] and k[0] is not None})
    assert sum(r.doc_id is None for r in kept) == 2


def test_groups_of_an_empty_table(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], CLASH)).collect() == []


def test_minmax_estimates_similarity_without_bias():
    rng = np.random.default_rng(1)
    signer = near_dedup.MinMax(64, 4, 9)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = values[:2000], values[1000:]
    (la, ha), (lb, hb) = signer.ends(a), signer.ends(b)
    assert abs(np.concatenate([la == lb, ha == hb]).mean() - 1 / 3) < 0.1
    assert signer.count == 128


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_search(rows, queries, k):
    docs = [(d, collections.Counter(words_of(t))) for d, t in rows if d is not None]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    out = []
    for q, text in queries:
        scored = []
        for d, c in docs:
            s = sum(
                m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) * n / total))
                for w, m in collections.Counter(words_of(text)).items() if w in c
            )
            if s:
                scored.append((-round(s, 6), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, "t1 t2"), (300, None), (301, rows[4][1]), (5, rows[5][1])]
    queries = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(900, "t1 t1 nothing"), (901, "unseen"), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(tuple(r) for r in topk_search.top_documents(docs, asked, k=5).collect())
    want = sorted(brute_search(rows, queries, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    assert topk_search.top_documents(docs.limit(0), asked).collect() == []


def test_blocks_are_pruned_and_shards_agree():
    builder = topk_search.ShardBuilder()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 200, 30).astype(np.uint64) for _ in range(2000)]
    for i, t in enumerate(texts):
        builder.add(i, t)
    names = [f.name for f in topk_search.INDEX]
    shard = topk_search.Shard(dict(zip(names, builder.row())), 30.0, 1.2, 0.75)
    terms, weights = np.array([3, 50, 77], dtype=np.uint64), np.array([1.0, 2.0, 0.5])
    want = sorted(
        ((round(sum(w * (c := int((t == x).sum())) * 2.2 / (c + 1.2) for x, w in zip(terms, weights)), 6), i) for i, t in enumerate(texts)), key=lambda x: (-x[0], x[1])
    )[:10]
    got = shard.search(terms, weights, 10)
    assert [i for _, i in got] == [i for _, i in want]


def test_rows_that_repeat_an_id_keep_their_texts(spark):
    one = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "x"), (1, one, "x"), (1, other, "x"), (1, None, "x"), (2, one, "x"), (3, other + " more", "x"), (None, one, "x"), (None, one, "x"), (4, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash_doc_id_text string").repartition(3)
    kept = near_dedup.keep_one(docs, near_dedup.near_groups(docs))
    assert kept.columns == docs.columns
    want = [(1, one), (1, other), (1, None), (None, one), (None, one), (4, ""), (5, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in want)


def _zipf_shard():
    builder, rng, texts = topk_search.ShardBuilder(), np.random.default_rng(5), []
    for i in range(600):
        own = np.minimum(rng.zipf(1.3, int(rng.choice([0, 1, 5, 60, 300]))), 3000).astype(np.uint64)
        texts.append(texts[-1] if i % 9 == 8 else own * np.uint64(0x9E3779B97F4A7C15))
        builder.add(1000 - i, texts[-1])
    row = dict(zip([f.name for f in topk_search.INDEX], builder.row()))
    queries = []
    for t in texts[::4]:
        terms, counts = np.unique(np.append(t, np.uint64(77)), return_counts=True)
        queries.append((b"", terms, counts * rng.uniform(0.001, 8, len(terms))))
    return row, queries


@pytest.mark.parametrize(("frequent", "postings"), [(32, 1 << 21), (4, 100), (10**9, 100)])
def test_queries_searched_together_get_what_each_gets_alone(monkeypatch, frequent, postings):
    monkeypatch.setattr(topk_search, "FREQUENT", frequent)
    monkeypatch.setattr(topk_search, "POSTINGS", postings)
    row, queries = _zipf_shard()
    shard = topk_search.Shard(row, 120.0, 1.2, 0.75)
    best = [shard.search(t, w, 10) for _, t, w in queries]
    for share in (0.0, 0.5, 1.0):
        floors = [share * b[9][0] if len(b) > 9 else 0.0 for b in best]
        want = [shard.search(t, w, 10, f) for (_, t, w), f in zip(queries, floors)]
        assert list(shard.search_many(queries, floors, 10)) == want


def test_postings_of_frequent_terms_are_not_gone_through_for_each_query(monkeypatch):
    """op5: a batch adds them by one product; the rarer terms' postings and those of the candidates are far fewer."""
    row, queries = _zipf_shard()
    shard, gone, went = topk_search.Shard(row, 120.0, 1.2, 0.75), [], topk_search.spread
    alone = sum(len(shard.search(t, w, 1)) for _, t, w in queries)
    assert len(shard.frequent[2]) and len(shard.forward[0]) == 601
    monkeypatch.setattr(topk_search, "spread", lambda start, size: gone.append(int(np.sum(size))) or went(start, size))
    assert sum(len(b) for b in shard.search_many(queries, [0.0] * len(queries), 1)) == alone
    assert sum(gone) < shard.scored / 2
