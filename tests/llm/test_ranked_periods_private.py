"""Lexical search, periodic runs and personal data against brute force, with all awkward cases."""

import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import lexical, periods, private
from tideglass.llm.registry import planted

#: Columns with names that the operators use inside, with a dot, and of map type.
CLASH = "_row string, row string, item string, id string, term string, spans string, runs string, `a.b` string, m map<string,int>, _packed string, value string"
EXTRA = (*["x"] * 8, {"k": 1}, "x", "x")


def with_extras(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{names}, {CLASH}")


# -- lexical search


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked_by_hand(docs, items, k):
    split = [(i, terms_of(t)) for i, t in docs]
    n = sum(bool(ts) for _, ts in split)
    total = sum(len(ts) for _, ts in split)
    df = {}
    for _, ts in split:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, ts in split:
            score = 0
            for t in terms_of(text):
                if tf := ts.count(t):
                    m = 25 + (75 * len(ts) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search_case(seed):
    rng = random.Random(seed)
    word = lambda: f"W{int(1 / (rng.random() + 0.004))}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, None), (300, ""), (301, "!? \n"), (302, "Éa éA ÉA"), (303, " ".join(word() for _ in range(20_000)))]
    items = [(i, docs[rng.randrange(150)][1] + " " + word()) for i in range(12)]
    items += [(3, "w1 w2 w2"), (None, "W5"), (50, None), (51, ""), (52, "notthere"), (53, "éA"), (54, "w1 " * 300)]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 10, 1024), (2, 3, 16)])
def test_search(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", 5)
    docs, items = search_case(seed)
    got = lexical.rank(with_extras(spark, docs), with_extras(spark, items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items, k)


def test_search_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_TERMS", 200)
    docs, items = search_case(4)
    trace = []
    got = lexical.rank(with_extras(spark, docs), with_extras(spark, items, "item_id long, text string"), 4, trace=trace)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items, 4)
    assert len(trace) > 3


def test_items_with_many_copies_are_proven_by_high_tiers(spark):
    """Short documents that repeat an item have impacts that others can't reach: the first tiers suffice, and the result is that of all postings."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    docs = [(i, " ".join([rng.choice(common), *(f"x{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200)))])) for i in range(1500)]
    docs += [(2000 + i, " ".join(common)) for i in range(12)]
    items = [(1, " ".join(common)), (2, " ".join(f"x{i}" for i in range(40)))]
    trace = []
    got = lexical.rank(with_extras(spark, docs), with_extras(spark, items, "item_id long, text string"), trace=trace)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items, 10)
    assert sum(trace[:2]) >= 1


def test_search_without_rows(spark):
    docs, items = with_extras(spark, [(1, "a b")]), with_extras(spark, [(1, "a")], "item_id long, text string")
    none = docs.limit(0)
    assert lexical.rank(none, items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(with_extras(spark, [(1, None), (2, "")]), items).collect() == []
    text = spark.createDataFrame([("k1", "a b"), ("k2", "a")], "doc_id string, text string")
    assert [r.doc_id for r in lexical.rank(text, items).orderBy("rank").collect()] == ["k2", "k1"]
    more = text.unionByName(spark.createDataFrame([("k3", "c"), ("k4", "d")], text.schema))
    assert [r.doc_id for r in lexical.rank(more, items).orderBy("rank").collect()] == ["k2", "k1"]


def test_impacts_beyond_64_bits():
    import numpy as np

    n, total = 10**12, 10**14
    got = lexical._impacts(np.array([3]), np.array([10**8]), n, total)
    assert got.tolist() == [(10**9 * 3) // (3000 + 8 * (25 + 75 * 10**8 * n // total))]


# -- periodic runs


def runs_by_hand(ws, least):
    found = {}
    for p in range(1, len(ws) // 2 + 1):
        i = 0
        while i + p < len(ws):
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_hand(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_rows():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a " * 11), (6, "a " * 12), (None, "b c " * 30), (7, "b c " * 30), (7, "b c " * 30), (8, "é ü\t" * 9)]
    for i in range(60):
        n, k = rng.randrange(1, 120), rng.choice([1, 2, 3, 40])
        ws = [f"w{rng.randrange(k)}" for _ in range(n)]
        if i % 2:
            a, p = rng.randrange(n), rng.randrange(1, 30)
            ws = [ws[j] if j < a else ws[min(n - 1, a + (j - a) % p)] for j in range(n)]
        rows.append((100 + i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("least", [2, 12, 15])
def test_periodic_runs(spark, least):
    rows = periodic_rows()
    got = periods.collapse(with_extras(spark, rows), least)
    assert got.columns == ["doc_id", *[c for c in with_extras(spark, []).columns if c not in ("doc_id", "text", "runs")], "n_words", "runs", "collapsed"]
    ours = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    want = []
    for i, t in rows:
        ws = (t or "").split()
        runs = runs_by_hand(ws, least)
        want.append((i, len(ws), runs, collapsed_by_hand(ws, runs)))
    assert ours == sorted(want, key=repr)
    assert periods.collapse(with_extras(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", max_size=60), min_size=1, max_size=4), st.integers(2, 14))
def test_periodic_runs_of_few_letters(texts, least):
    for t, (n, own, kept) in zip(texts, periods._texts(texts, least), strict=True):
        ws = t.split()
        want = runs_by_hand(ws, least)
        assert (n, own, kept.decode()) == (len(ws), want, collapsed_by_hand(ws, want))


def test_extensions():
    import numpy as np

    rng = random.Random(2)
    for size in (1, 2, 17, 200):
        codes = np.array([rng.randrange(2) for _ in range(size)])
        ext = periods.Extensions(codes)
        pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b][:4000]
        want = []
        for a, b in pairs:
            n = 0
            while max(a, b) + n < size and codes[a + n] == codes[b + n]:
                n += 1
            want.append(n)
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in range(2))
        assert ext.of(a, b).tolist() == want


def test_long_periodic_texts():
    """Two million bytes: all the same, a long period, and one with a run at its end only."""
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    for ws, want in ((["a"] * 400_000, [(0, 400_000, 1)]), (text[:50_000] * 3, [(0, 150_000, 50_000)]), (text + text[-7:] * 2, [(99_993, 21, 7)])):
        ((n, own, _),) = periods._texts([" ".join(ws)], 12)
        assert (n, own) == (len(ws), want)


def test_planted_words(spark):
    """The rule of the query: from word a on, the words of each tenth document repeat p words."""
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 40))) for i in range(300)] + [(None, "a b"), (10**12, None), (1011, "")]
    got = {r.doc_id: r.text for r in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
        assert (got[i] or "").split() == ws


# -- personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for n, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("a0125.@-_ +()éb%4", max_size=60), st.text("0123 -+", max_size=60), st.text("a.@_", max_size=40)))
def test_base_spans(text):
    assert private.base_spans(text) == base_by_hand(text)
    for kind, start, end, base, _, _ in private.occurrences(text):
        assert 0 <= start < end <= len(text)
        assert base or not any(s < end and start < e for _, s, e in base_by_hand(text))


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "+1", "1 ", "a@", "(1", "a.b@c", ":", "1:", "at ", " dot a"])
def test_time_of_long_texts(piece):
    began = time.time()
    private.occurrences(piece * (400_000 // len(piece)))
    assert time.time() - began < 30


def card(rng, sound):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    for last in "0123456789":
        if private._luhn(body + last) == sound:
            return body + last


def personal_rows():
    """Two contexts that announce identifiers, most in known forms and some in others; numbers of the same shape in plain text; unlike contexts for unknown ones."""
    rng = random.Random(6)
    # (words without digits, as digits beside a number can make a card number of both)
    noise = lambda: " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(6))
    rows, unseen = [], {}
    for i in range(40):
        rows.append((i, f"{noise()} call us at +49 30 {rng.randrange(10**6, 10**7)} {noise()}\nWrite to: user{i}@host.example.com\n{noise()}"))
    for i in range(6):
        number, mail = f"030-{rng.randrange(10**6, 10**7)}", f"person{i} (at) inner (dot) example"
        rows.append((100 + i, f"{noise()} call us at {number} {noise()}\nWrite to: {mail}\n{noise()}"))
        unseen[100 + i] = {("phone", number), ("email", mail)}
        # the same number without a context, and a number of the same shape that no context announces
        rows.append((200 + i, f"{noise()} {number} {noise()}"))
        unseen[200 + i] = {("phone", number)}
        rows.append((300 + i, f"{noise()} order {rng.randrange(10**9, 10**10)} {noise()}"))
        # beside a common word, most numbers aren't cards: no pattern
        rows.append((400 + i, f"the number {card(rng, i < 3)} of {noise()}"))
        rows.append((500 + i, f"the number {rng.randrange(10**11, 10**12)} of {noise()}"))
    rows += [(600, None), (601, ""), (602, "+1 (555) 555-5657"), (None, "a@b.cc"), (602, "+1 (555) 555-5657")]
    return rows, unseen


def test_contexts_discover_unseen_identifiers(spark):
    rows, unseen = personal_rows()
    got = private.find(with_extras(spark, rows))
    texts = {i: t for i, t in rows}
    base, more = [], {}
    for r in got.collect():
        base.append((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]))
        for s in r.spans:
            if not s.base:
                more.setdefault(r.doc_id, set()).add((s.kind, texts[r.doc_id][s.start : s.end]))
    assert sorted(base, key=repr) == sorted(((i, base_by_hand(t)) for i, t in rows), key=repr)
    assert more == unseen


def test_no_rounds_and_no_rows(spark):
    rows, _ = personal_rows()
    got = private.find(with_extras(spark, rows), rounds=0)
    assert all(s.base for r in got.collect() for s in r.spans)
    assert private.find(with_extras(spark, [])).collect() == []


def known_by_hand(spans, rounds):
    known = {(k, v) for k, v, base, _ in spans if base}
    seeds = set(known)
    for _ in range(rounds):
        in_pattern = {}
        for k, v, _, ps in spans:
            for p in ps:
                in_pattern.setdefault((k, p), set()).add((k, v))
        left = {}
        for vs in in_pattern.values():
            yes = len(vs & known)
            if yes >= private.SUPPORT and yes / (len(vs) + private.PRIOR) >= private.SURE:
                for v in vs - known:
                    left[v] = left.get(v, 1.0) * (1 - yes / (len(vs) + private.PRIOR))
        new = {v for v, rest in left.items() if 1 - rest >= private.ACCEPT}
        if not new:
            break
        known |= new
    return known - seeds


def test_scores_are_those_of_plain_sets(spark):
    rng = random.Random(12)
    spans = [(rng.choice(["card", "phone"]), v, v % 5 != 0, [rng.randrange(6) + 10 * (v % 3) for _ in range(rng.randrange(1, 4))]) for v in (rng.randrange(120) for _ in range(600))]
    found = private.known_values(spark.createDataFrame(spans, "kind string, value long, base boolean, patterns array<long>"))
    assert {tuple(r) for r in found.collect()} == known_by_hand(spans, private.ROUNDS)
