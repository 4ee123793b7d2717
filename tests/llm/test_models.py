"""Language ID, quality and the whole pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traceframe.llm import language_id, quality
from traceframe.llm.common import fold, stored, table
from traceframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORDS = {"aa": ["bala", "tomo", "rixi", "zora", "lamu"], "bb": ["stok", "grend", "wurst", "knap", "drisk"], "cc": ["éclat", "çava", "œuvre", "naïf", "déjà"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, 30), lang, "s", 0) for i in range(200) for lang in WORDS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return language_id.fit(docs)


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_languages_and_mixtures(spark, languages):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, 12), lang) for i, lang in enumerate(WORDS)]
    rows += [(10, sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 10), None), (11, None, None), (12, "", "aa"), (13, "12 34 !?", "aa"), (None, "stok grend", "bb"), (0, "zora", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in language_id.identify(docs, languages).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert [by[i][0][1] for i in range(3)] == list(WORDS) and len(got) == len(rows)
    shares = dict(x.split(":") for x in by[10][0][3].split(","))
    assert by[10][0][1] == "aa" and abs(float(shares["aa"]) - 0.75) < 0.1 and set(shares) == {"aa", "bb"}
    assert all(by[i][0][1:3] == ("und", 0.0) for i in (11, 12, 13)) and by[None][0][1] == "bb"
    kept = language_id.annotate(docs, languages).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.lang) for r in kept) == sorted([(0, "aa"), (1, "bb"), (2, "cc"), (10, "aa"), (-1, "bb"), (0, "aa")])


def test_a_long_text_is_read_in_parts(languages):
    rng = random.Random(6)
    text = sentence(rng, "cc", 30_000)
    assert "".join(language_id.parts(text, 1000)) == text and max(map(len, language_id.parts("x" * 2500, 1000))) == 1000
    letters = language_id.letter_table()
    whole = languages.words([text], letters)[0]
    pieces = np.concatenate([languages.words([p], letters)[0] for p in language_id.parts(text, 5000)])
    assert np.array_equal(whole, pieces)


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    likelihood = np.exp(rng.normal(size=(60, 3)))
    values = [language_id.mixture(likelihood, [0, 1, 2], r)[1] for r in range(1, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None
    docs = spark.createDataFrame([(1, "words", "aa")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(docs, None).collect()] == ["und"]
    assert language_id.identify(empty, None).collect() == []


def test_quality_learns_hashed_ngrams(spark):
    rng = random.Random(4)
    good = [(i, sentence(rng, "aa", 40), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "***" for w in sentence(rng, "aa", 40).split()), 0) for i in range(75)]
    bad += [(2000 + i, " ".join([f"u{i}"] * 40), 0) for i in range(75)]
    train = spark.createDataFrame(good + bad + [(9, None, 1), (8, "x", None)], "doc_id long, text string, label int")
    weights = quality.train(train, shards=3)
    tests = [(1, sentence(rng, "aa", 20), "c"), (2, "bala*** tomo*** rixi*** zora***", "c"), (3, "qq qq qq qq qq qq qq", "c"), (None, None, "c"), (5, "", "c")]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(tests, "doc_id long, text string, score string"), weights).collect()}
    assert (got[1].predicted, got[2].predicted, got[3].predicted) == (1, 0, 0)
    assert got[None].score == got[5].score and all(0 <= r.score <= 1 for r in got.values())
    assert not quality.train(train.limit(0)).any()


def test_ftrl_step_by_hand():
    model = quality.Ftrl(alpha=0.5, beta=1.0, l1=0.0, l2=0.1)
    at, x = np.array([7]), np.array([2.0])
    model.learn(at, x, 1)
    g = (0.5 - 1) * 2.0
    assert math.isclose(model.z[7], g) and math.isclose(model.n[7], g * g)
    assert math.isclose(float(model.weights(at)[0]), -g / ((1 + abs(g)) / 0.5 + 0.1))


@pytest.mark.parametrize("name, held, label, least", [("op7_language_id", "lang", "lang_pred", 0.97), ("op3_quality", "quality", "predicted", 0.9)])
def test_held_out_accuracy(spark, name, held, label, least):
    base = "/root/testdata/sf0.01"
    source = table(spark, base, "documents" if held == "lang" else "labels").select("doc_id", held)
    got = QUERIES[name](spark, base).where("held_out").join(source, "doc_id")
    assert got.agg(F.avg((F.col(label) == F.col(held)).cast("int"))).first()[0] >= least


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "?? 12", "en", "s", 5), (None, "Only a text without any id here.", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts[1] == counts[0] - 2 and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids and None in ids
    assert not docs.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count()


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_letters_of_all_planes_count():
    letters = language_id.letter_table()
    assert not any(chr(c).isalpha() for c in range(language_id.LETTERS, 0x110000))
    text = "aéЖ中\U00020000\U00030001"
    grams, first, _ = language_id.words_of([text, "12 \U000e0041 \U0001f600"], letters)
    assert len(grams) == len(text) and len(first) == 1
