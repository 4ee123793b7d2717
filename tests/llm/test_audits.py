"""Certified rules, the filter audit and the alignment of tokenizers, against brute force."""

import hashlib
import itertools
import json
import random
from collections import Counter, defaultdict
from math import comb

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceframe.llm import filter_audit, risk_rules, token_align

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- rules with certified cutoffs


def measured(text):
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            inside.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_measures_equal_a_plain_count():
    rng = random.Random(4)
    cases = ["", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x " * 50, "é ü ñ b\x1cc", "a\n a\na\n\r\na\r\n", "a a a a", "<>|&%$*# #"]
    cases += ["".join(rng.choice("ab \n\té#|") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    for text in cases:
        assert risk_rules.measure(text.encode()) == measured(text), text
    long = " ".join(str(i % 99_991) for i in range(1_500_000)).encode()
    assert risk_rules.measure(long)[0] == 1_500_000 and risk_rules.measure(long)[5] == 1_500_000


def test_binomial_tail_is_exact():
    for n, k, p in itertools.product((1, 7, 100, 400), (0, 1, 5, 30), (0.02, 0.3, 0.9)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
        assert risk_rules.binomial_tail(n, k, p) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert 0.4 < risk_rules.binomial_tail(5_000_000, 100_000, 0.02) < 0.6


def test_levels_are_certified_in_order():
    assert risk_rules.certified([0, 0, 0], 0.02, 0.05) == 0
    assert risk_rules.certified([0, 0, 100], 0.02, 0.05) == 0  # 0.98 ** 100 is over 0.05
    assert risk_rules.certified([0, 0, 200], 0.02, 0.05) == 2
    assert risk_rules.certified([0, 50, 0, 950], 0.02, 0.05) == 1


def good_text(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(60))


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        text = good_text(rng) + (" #|" * 20 if bad else "")
        rows.append((i, text, "aa" if i < 1400 else "bb", "x"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(5000, None, "aa", "x"), (5001, "", None, "x"), (None, good_text(rng), "aa", "x"), (1, good_text(rng), "aa", "x"), (5002, "one two", "cc", "x"), (5003, good_text(rng) + " ###" * 30, "cc", "x")]
    labels += [(None, 1, 0), (7, 0, 0), (7000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_bad_documents_go_and_good_ones_stay_within_the_risk(rated):
    docs, labels = rated
    out = risk_rules.quality_verdicts(docs, labels).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    big = [r for r in out if r.doc_id is not None and r.doc_id < 1400]
    assert not any(r.kept for r in big if r.doc_id % 5 == 0 and r.doc_id != 0) and sum(not r.kept for r in big if r.doc_id % 5) <= 0.02 * len(big)
    # 100 rows of "bb" certify nothing, "cc" has no labels: their bad rows stay.
    assert all(r.kept for r in out if r.doc_id is not None and 1400 <= r.doc_id < 1500) and by[5003].kept and by[5003].rejecting_level is None
    assert by[5000].base_failed and by[5001].base_failed and by[5001].stratum == "" and by[5002].base_failed and not by[5002].kept


def test_proposed_cutoffs_equal_a_plain_quantile(spark, rated):
    docs, labels = rated
    good = risk_rules.good_documents(risk_rules.measures(docs, F.col("lang")), labels)
    rows = good.where("proposes").select("stratum", *[v.alias(k) for k, v in risk_rules.rules().items()]).collect()
    assert all(r["symbols"] == 0 for r in rows)
    for got in risk_rules.proposals(good).collect():
        for rule in risk_rules.rules():
            values = [r[rule] for r in rows if r.stratum == got.stratum]
            want = [min(v for v in values if sum(x > v for x in values) <= level * len(values)) for level in risk_rules.LEVELS]
            assert got[rule] == want


def test_rules_without_documents_or_labels(spark, rated):
    docs, labels = rated
    assert risk_rules.quality_verdicts(docs.limit(0), labels).count() == 0
    some = docs.where("doc_id < 20")
    assert all(r.kept for r in risk_rules.quality_verdicts(some, labels.limit(0)).collect())


# --- the filter audit


def audit_by_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    kinds = defaultdict(list)
    for i, text, lang in rows:
        w, text = words_of(text or ""), text or ""
        fails = set("A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)))
        fails |= set("D" * any(c in "#$%&*|" for c in text) + "E" * (i is not None and i > least[text]))
        kinds[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, docs in kinds.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), (part, f)])
    return sorted((*r[:-1], shapley[r[-1]]) for r in out)


def audited(spark, folder, rows, labels, files, **options):
    folder.mkdir()
    names = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string()}
    for k in range(files):
        part = rows[k::files]
        data = {c: pa.array([r[i] for r in part], t) for i, (c, t) in enumerate(names.items())} | {"part": pa.array(["p"] * len(part)), "mask": pa.array([1] * len(part))}
        pq.write_table(pa.table(data), folder / f"f{k:03}.parquet")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.filter_audit(spark, str(folder), table, **options).collect())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["aa", "bb", "C", "dd", "e#"]) + str(rng.randint(0, k)) for _ in range(n)) for n in (3, 90, 120) for k in (3, 9, 900) for _ in range(3)]
    texts += [None, "", "A", "ÄÖÜ#", "x " * 30_000]
    ids = list(range(200)) + [5, 5, 6, None, None]
    rng.shuffle(ids)
    rows = [(i, rng.choice(texts), rng.choice(["aa", "bb", None])) for i in ids]
    # Copies of one text whose smallest id comes last, in steps.
    rows += [(1000 - k, "same text", "aa") for k in range(40)] + [(961, "same text", "bb")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 1001, 2)] + [(None, 1, 1)]
    return rows, labels


def test_audit_equals_brute_force_whatever_the_files(spark, tmp_path):
    rows, labels = audit_rows(1)
    want = audit_by_force(rows, labels)
    assert audited(spark, tmp_path / "a", rows, labels, 6, batches=6, texts=7) == want
    backwards = list(reversed(rows))
    assert audited(spark, tmp_path / "b", backwards, labels, 3, batches=2) == want


def test_smaller_ids_retract(spark, tmp_path):
    rows = [(9, "t", "aa"), (8, "t", "bb"), (8, "t", "bb"), (7, "t", "aa"), (7, "t", "aa")]
    assert audited(spark, tmp_path / "c", rows, [(7, 1, 0)], 5, batches=5) == audit_by_force(rows, [(7, 1, 0)])


def test_audit_of_an_empty_table(spark, tmp_path):
    assert audited(spark, tmp_path / "d", [], [(1, 1, 1)], 1) == []


def test_tasks_sum_equal_rows():
    schema = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("at_least", pa.int64()), ("rows", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"key": [b"a"] * 5 + [b"b"], "least": [3, 2, 2, 9, 4, 2], "at_least": [1] * 6, "rows": [1] * 6}, schema=schema)
    got = pa.Table.from_batches(list(filter_audit.summed([batch] * 3, ["key"], filter_audit.smallest_ids)))
    assert sorted(map(tuple, (r.values() for r in got.to_pylist()))) == [(b"a", 2, 6, 15), (b"b", 2, 3, 3)]


# --- alignment of two tokenizers


@pytest.fixture(scope="module")
def libraries():
    byte_file, piece_file = token_align.default_tokenizers()
    library = Tokenizer.from_file(byte_file)
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=piece_file)


def ends_of(tokens):
    return list(itertools.accumulate(map(len, tokens)))


def aligned_by_force(text, libraries):
    """(ids of A, ids of B) of every group; None without tokens."""
    a, b = libraries
    wanted = (" " + text).encode() if text else b""
    ids = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
    pieces = [b.id_to_piece(i) for i in ids[1]]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces)]
    back = token_align.byte_alphabet()
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]]
    if not text or b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
        return None
    ends = ends_of(bytes_a), ends_of(bytes_b)
    groups, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for side in (0, 1):
            start = at[side]
            while at[side] < len(ends[side]) and ends[side][at[side]] <= end:
                at[side] += 1
            group.append(ids[side][start : at[side]])
        groups.append(group)
    return groups


def links_by_force(texts, libraries):
    found = [aligned_by_force(t, libraries) or [] for t in texts]
    pairs = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(p for one in pairs for p in one)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, one in zip(found, pairs):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(one.values()),
                    sum(n for p, n in one.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in one.items()), sha))
    return out


def odd_texts():
    rng = random.Random(11)
    letters = ["a", "b", " ", "  ", "the", "ing", "é", "中", "▁", "\t", "\n", " ", "<|endoftext|>", "<s>", "<0x41>", "😀", "7", ".", "'s", "​", "ﬁ", "İ", "tion"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return texts + [None, "", " ", "  ", "\n", "a ", " a", "a  b", "�", "same text", "same text", "x" * 5000, "word " * 3000, "Zusammenhanǵ " * 50]


@pytest.mark.parametrize("frequent, limit", [(1 << 16, 4_000_000), (20, 50), (0, 4_000_000)])
def test_links_equal_brute_force(spark, libraries, frequent, limit):
    texts = odd_texts()
    rows = [(i % 290, t, 1, "x") for i, t in enumerate(texts)] + [(None, "the end", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string").repartition(5)
    got = token_align.token_links(docs, *token_align.default_tokenizers(), frequent=frequent, limit=limit).collect()
    want = links_by_force([r[1] for r in rows], libraries)
    key = lambda r: json.dumps(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)


def test_links_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.token_links(docs, *token_align.default_tokenizers()).collect() == []


def test_parts_are_what_the_libraries_make_of_whole_texts(libraries):
    byte_file, piece_file = token_align.default_tokenizers()
    texts = [t for t in odd_texts() if t]
    raw = [b" " + t.encode() for t in texts]
    assert token_align.byte_level(byte_file)(raw).to_pylist() == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert token_align.piece_level(piece_file)(raw).to_pylist() == libraries[1].encode(texts)
