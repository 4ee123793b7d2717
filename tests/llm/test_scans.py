"""Secrets, personal data and decontamination against plain brute force."""

import hashlib
import random
import re
import string

import pytest

from traceframe.llm import decontaminate, pii, secrets
from traceframe.llm.spans import Cover

ODD = [(None, None, "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "no letters? 42 \x00 é\U0001f600", None, None)]
CLASH = "doc_id long, text string, spans string, item_id int"


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return out


def brute_pii(text):
    def luhn(d):
        t = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


PARTS = [
    "password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef0123", "4111 1111 1111 1111", "4111-1111-1111-1111",
    "@", "a.b", ".com", "x@y.z", "1.2.3.4", "300.1.1.1", "+1 (555) 555-0100", "+", "(", "5", "-", ".", "é", "ſecret", "K", "\n", "word", "0", "٣",
]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_brute_force(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS) for _ in range(120))
    assert sorted(secrets.base_spans(text)) == sorted(brute_secrets(text))
    assert sorted(pii.plain_spans(text)) == sorted(brute_pii(text))


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "a@" * 50_000, "1." * 50_000, "token" * 40_000, "1 " * 100_000):
        pii.find_spans(text)
        secrets.base_spans(text)


def test_randomness_tells_keys_from_names():
    rng = random.Random(5)
    symbols = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(symbols) for _ in range(40)) for _ in range(300)]
    plain = [f"section_{i}_of_the_report_section_{i}_of_the_report"[:44] for i in range(100)] + ["abcabc123123" * 5, "AAAAAAAAAAAAAAAAAAAA1111111111"]
    p_keys = [secrets.battery(k)[0] for k in keys]
    p_plain = [secrets.battery(k)[0] for k in plain if secrets.battery(k)]
    assert sum(p < 0.01 for p in p_keys) < 12
    assert all(p < 1e-3 for p in p_plain)


def test_rejection_limit_is_benjamini_hochberg_for_one_length():
    bins = [secrets.p_bin(p) for p in (1e-12, 1e-9, 0.004, 0.2, 0.5, 0.9)]
    counts = {(4, b): bins.count(b) for b in bins}
    limit = secrets.rejection_limit(counts, 0.05)[4]
    assert 0.004 <= limit < 0.2
    assert secrets.rejection_limit({}, 0.05) == {}


def test_secret_rows(spark):
    rng = random.Random(9)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [*ODD, (7, f"see {key} and token = 'abcdef1'", "x", 1), (8, "path section_1_section_1_section_1_section_1", "x", 1)]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, CLASH)).collect()}
    assert len(got) == 5
    assert got[7].spans.startswith("random:4:44,assign:49:") and (got[7].n_assign, got[7].n_random) == (1, 1)
    base = got[7].spans.split(",")[1]
    assert got[7].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[8].spans == got[1].spans == got[None].spans == ""
    assert secrets.secret_spans(spark.createDataFrame([], CLASH)).collect() == []


def test_keys_in_longer_runs_and_long_runs_are_found(spark):
    rng = random.Random(11)

    def key(n, signs=""):
        return "".join(rng.choice(string.ascii_letters + string.digits + signs) for _ in range(n))

    cases = [(f"{name}={(k := key(40))}", k) for name in ("SESSION_KEY", "sig", "auth", "a_very_long_name_of_a_setting_1")]
    cases += [(f"x=1=sig={(k := key(40))}==", k), (f"={(k := key(40))}", k), (f"/srv_a/{(k := key(40))}", k), (f"my-app/{(k := key(40))}", k)]
    cases += [(f"section_one-section_two-{(k := key(40))}/the/rest/of/the/path/to/it", k)]
    cases += [((k := key(n, signs)), k) for n in (512, 513, 2000, 20_000) for signs in ("", "+/", "-_")]
    cases += [(f"-----{(k := key(1600, '+/'))}==-----END", k), (f"blob={(k := key(1600, '-_'))}", k)]
    cases += [(f"{(k := key(40))}/sha=0123456789abcdef0123456789abcdef", k)]
    rows = [(i, f"see {text} here", "x", 1) for i, (text, _) in enumerate(cases)]
    plain = ["section_1=of_the_report/section_1_of_the_report-section_1", "1-a/" * 300, "a1=" * 300]
    rows += [(1000 + i, text, "x", 1) for i, text in enumerate(plain)]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, CLASH)).collect()}
    for i, (_, k) in enumerate(cases):
        at = rows[i][1].index(k)
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("random:")]
        assert any(a <= at and at + len(k) <= b for a, b in spans), (rows[i][1][:80], got[i].spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and got[i].n_random == len(spans)
    assert all(got[1000 + i].n_random == 0 for i in range(len(plain)))


@pytest.mark.parametrize("text, kind, source", [
    ("write john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("write john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("mail ｊｏｈｎ＠example.com ok", "email", "ｊｏｈｎ＠example.com"),
    ("mail jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
    ("call +one five five five five five five zero one zero zero today", "phone", "+one five five five five five five zero one zero zero"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises_map_back(text, kind, source):
    base, added = pii.find_spans(text)
    assert (kind, source) in [(k, text[a:b]) for k, a, b in added]
    assert not any(k == kind and text[a:b] == source for k, a, b in base)
    assert source not in pii.masked(text) and f"[{kind.upper()}]" in pii.masked(text)


@pytest.mark.parametrize("at", ["@", " at ", " (at) ", "[at]", " AT "])
@pytest.mark.parametrize("dots", [(a, b, c) for a in (".", " dot ", "[dot]") for b in (".", " dot ", " [dot] ") for c in (".", " dot ", "(dot)")])
def test_mixed_signs_of_addresses(at, dots):
    source = f"john{dots[0]}doe{at}example{dots[1]}co{dots[2]}uk"
    text = f"write {source}, please; and we look at home"
    base, added = pii.find_spans(text)
    hidden = at.strip().lower() != "at" or any(d != "." for d in dots)
    assert (("email", source) in [(k, text[a:b]) for k, a, b in base + added]) == hidden
    assert (pii.masked(text) == "write [EMAIL], please; and we look at home") == hidden


@pytest.mark.parametrize("source", [
    "john (at) example dot com", "john at example [dot] com", "john[at]example dot co dot uk", "john@example dot com", "john dot doe@example.com",
    "192 dot 168 dot 0 dot 1", "192.168 dot 0[dot]1", "192 [dot] 168.0 dot 1", "10  DOT  0.0.1", "+1 dot 555 dot 555 dot 0100",
])
def test_mixed_signs_map_back(source):
    kind = "phone" if source[0] == "+" else "ip" if source[0].isdigit() else "email"
    text = f"see {source} now"
    assert (kind, 4, 4 + len(source)) in pii.find_spans(text)[1]
    assert pii.masked(text).startswith(f"see [{kind.upper()}]") and pii.masked(text).endswith("] now")


@pytest.mark.parametrize("text, kind, source", [
    ("host eight dot eight dot eight dot eight up", "ip", "eight dot eight dot eight dot eight"),
    ("host 192 dot 168 dot one dot one up", "ip", "192 dot 168 dot one dot one"),
    ("host 192.168.1.one up", "ip", "192.168.1.one"),
    ("host one nine two [dot] one six eight.zero.one up", "ip", "one nine two [dot] one six eight.zero.one"),
    ("ring plus four four two zero seven nine four six zero nine five eight now", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("ring +44 two zero seven nine four six 0958 now", "phone", "+44 two zero seven nine four six 0958"),
    ("mail \U0001d423\U0001d428\U0001d421\U0001d427@example.com ok", "email", "\U0001d423\U0001d428\U0001d421\U0001d427@example.com"),
    ("mail john@exam\u200bple.com ok", "email", "john@exam\u200bple.com"),
    ("host \u0661\u0669\u0662.\u0661\u0666\u0668.\u0660.\u0661 up", "ip", "\u0661\u0669\u0662.\u0661\u0666\u0668.\u0660.\u0661"),
    ("mail john\ufe6bexample\ufe52com ok", "email", "john\ufe6bexample\ufe52com"),
])
def test_short_runs_signs_and_scripts_map_back(text, kind, source):
    base, added = pii.find_spans(text)
    assert (kind, source) in [(k, text[a:b]) for k, a, b in added]


def test_many_hits_take_near_linear_time():
    import time

    def took(n):
        start = time.perf_counter()
        base, added = pii.find_spans("mail a.b@example.com or a.b at example dot com, or one dot two dot three dot four; " * n)
        assert len(base) == n and len(added) == 2 * n
        return time.perf_counter() - start

    def scanned(n):
        rng = random.Random(n)
        text = "".join(f"token = abcdef{i} and {''.join(rng.choices(string.ascii_letters + string.digits, k=38))}a1 " for i in range(n))
        start = time.perf_counter()
        spans = secrets.base_spans(text)
        assert len(spans) == n and len(secrets.candidates(text, spans)) >= n
        return time.perf_counter() - start

    for run in (took, scanned):
        run(50)
        assert run(4000) < 20 * run(1000) + 0.5


@pytest.mark.parametrize("seed", range(20))
def test_cover_equals_brute_force(seed):
    rng = random.Random(seed)
    spans = [("x", a, a + rng.randint(1, 6)) for a in (rng.randrange(100) for _ in range(12))]
    cover, taken, kept = Cover(spans), Cover(), []
    for _ in range(60):
        a = rng.randrange(105)
        b = a + rng.randint(1, 8)
        assert bool(cover.meeting(a, b)) == any(a < y and x < b for _, x, y in spans)
        free = not any(a < y and x < b for x, y in kept)
        assert taken.add(a, b) == free
        kept += [(a, b)] * free


def test_signs_in_prose_and_in_long_runs():
    for text in ("look at example.com now", "the score is 3 dot 4 at home", "we met at 5 dot 7", "a dot b dot c", "at dot", "version 1 dot 2 dot 3", "one. two. three. four", "one plus two three is six", "one two three four five six seven"):
        assert pii.find_spans(text) == ([], []), text
    for text in ("a dot " * 40_000, "a at " * 40_000, "at dot " * 40_000, "a at b dot at" + " dot at" * 30_000 + ".1", "1 dot " * 40_000, "a dot b" + " " * 100_000 + "at", "one " * 40_000, "one dot " * 40_000, ("one" + " " * 1000) * 100, "1 one" * 20_000, "plus " * 40_000):
        pii.find_spans(text)


def test_ordinary_prose_is_left_alone():
    for text in ("we met at home and dot it", "one two three", "look at the house. com is", "Τὸ κείμενο είναι ελληνικό", "это просто текст"):
        assert pii.find_spans(text) == ([], []) and pii.masked(text) == text


def test_personal_rows(spark):
    rows = [*ODD, (7, "a b@c.de x 10.0.0.1", "x", 1)]
    docs = spark.createDataFrame(rows, CLASH)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[7].spans == "email:2:8,ip:11:19" and got[None].n_email == 0
    assert pii.personal_data(spark.createDataFrame([], CLASH)).collect() == []
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[7].text == "a [EMAIL] x [IP]" and clean[None].text is None and pii.redact(docs).columns == docs.columns


def brute_contained(docs, items, threshold=0.8, width=5):
    def words(t):
        return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(width, len(w))
        own = grams(w, n)
        for doc, t in docs:
            shared = len(own & grams(words(t), n))
            if shared >= threshold * len(own) - 1e-9:
                out.add((doc, item, len(own), shared))
    return out


@pytest.mark.parametrize("block", [40, 4_000_000])
def test_containment_equals_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(30, ""), (31, None), (None, "w1 w2"), (7, "w3")]
    docs = [(None, items[3][1]), (1, None), (2, ""), (3, "w1 W2")]
    for i in range(4, 60):
        passage = items[rng.randrange(30)][1].split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = "edited"
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        at = rng.randint(0, len(words))
        docs.append((i, " ".join([*words[:at], *passage, *words[at:]])))
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], CLASH)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.contained_items(frame, bench, block=block).collect()}
    assert got == brute_contained(docs, items)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, bench, block=block).collect()}
    held = {g[0] for g in brute_contained(docs, [(99 if i is None else i, t) for i, t in items])}
    assert kept == {d for d, _ in docs} - held and held > {g[0] for g in got}
    assert decontaminate.contained_items(frame, bench.limit(0)).collect() == []


def test_containment_in_very_long_texts_and_of_common_sketches(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    shared = " ".join(rng.choices(words, k=20))
    # Many items that differ in their last words have sketch values in common.
    items = [(i, f"{shared} {' '.join(rng.choices(words, k=3))}") for i in range(200)]
    long = " ".join(rng.choices(words, k=60_000))
    docs = [(0, f"{long} {items[7][1]} {long}"), (1, shared), (2, long), (2, items[9][1]), (2, items[9][1])]
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], CLASH)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.contained_items(frame, bench).collect())

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, want = {i: grams(t) for i, t in items}, []
    for d, t in docs:
        own = grams(t)
        want += [(d, i, len(s), len(s & own)) for i, s in sets.items() if len(s & own) >= 0.8 * len(s) - 1e-9]
    assert got == sorted(want) and len(got) > 200
