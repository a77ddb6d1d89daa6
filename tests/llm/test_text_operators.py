"""The text operators against brute force, on small tables with all awkward cases."""

import random
from fractions import Fraction

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideglass.llm import automaton, decontaminate, jaccard, language, substrings, tokens
from tideglass.llm.components import components

#: Columns that could clash with names that the operators use inside.
KIND = "doc_id long, text string, node string, key string, id string, n string, root string, runs string, value string, _k string, _links string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 10) for i, t in rows], KIND)


def words(n, rng, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def awkward(seed, copies=3):
    """Null, empty, blank, short, long and repeated texts, shared passages, near copies, a text that repeats within itself, a null id."""
    rng = random.Random(seed)
    passage = " ".join(words(60, rng))
    base = words(200, rng)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "éü " * 80), (6, " ".join(words(3000, rng, 10**6))), (None, " ".join(base[:120])), (None, None)]
    for i in range(copies):
        rows.append((10 + i, " ".join(words(30, rng, 10**6)) + "\n" + passage + "  " + " ".join(words(30, rng, 10**6))))
        near = list(base)
        near[rng.randrange(200)] = f"edit{i}"
        rows.append((20 + i, " ".join(near)))
        rows.append((30, " ".join(base)))
    rows.append((40, passage[:-1]))
    return rows


def cut_by_hand(rows, size):
    seen = {}
    split = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    for ws in split:
        for s in range(len(ws) - size + 1):
            seen[tuple(ws[s : s + size])] = seen.get(tuple(ws[s : s + size]), 0) + 1
    out = []
    for (i, _), ws in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(ws) - size + 1):
            if seen[tuple(ws[s : s + size])] > 1:
                gone |= set(range(s, s + size))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "size", "gram"), [(1, 35, 6), (2, 12, 3), (3, 7, 7)])
def test_substrings(spark, seed, size, gram):
    rows = awkward(seed)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(table(spark, rows), size, gram).collect()]
    assert sorted(got, key=repr) == cut_by_hand(rows, size)


def test_substrings_of_few_words(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng.randrange(60), rng, 3))) for i in range(30)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(table(spark, rows), 8, 3).collect()]
    assert sorted(got, key=repr) == cut_by_hand(rows, 8)
    assert substrings.dedup(table(spark, [])).count() == 0


class Worker:
    """Stands for a table whose Arrow function is called here."""

    def select(self, *names):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_substrings_memory_of_a_worker():
    """A batch of 8 MB is worked on in parts: what is held at once doesn't grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(words(300, rng, 10**6)) for _ in range(4000)]
    assert sum(map(len, texts)) > 8_000_000
    n, none = len(texts), pa.array([None] * len(texts), pa.list_(pa.int64()))
    columns = {"id": pa.array(range(n), pa.int64()), "check": pa.array([0] * n, pa.int32()), "text": pa.array(texts)}
    marked = {"given": columns["id"], "text": columns["text"], "runs": none, "starts": none}
    for f, batch in ((substrings._runs(Worker(), 35, 6), columns), (substrings._strip(Worker(), 35, "long"), marked)):
        batch = pa.RecordBatch.from_pydict(batch)
        tracemalloc.start()
        rows = sum(out.num_rows for out in f(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= n
        assert peak < 48_000_000


def test_substrings_runs_are_shuffled_once(spark, tmp_path):
    """The texts are read for the counts of the anchors, for the runs and for the texts themselves, and no more often."""
    table(spark, awkward(1)).write.parquet(str(tmp_path / "rows"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        plan = substrings.dedup(spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in had.items():
            spark.conf.set(name, value)
    assert plan.count("FileScan") == 3


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_repetitive_words_do_not_collide(spark):
    """The two words of 1,024 letters whose polynomials modulo 2**64 are equal for every odd base, and such words in a row."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    text = lambda w: " ".join([*(f"x{i}" for i in range(17)), w, *(f"y{i}" for i in range(17))])
    rows = [(1, text(one)), (2, text(two)), (3, text(one[:-1] + "c")), (4, text(one * 3)), (5, text(two * 3))]
    assert [r.n_removed for r in substrings.dedup(table(spark, rows)).collect()] == [0] * 5
    rows = [(i, " ".join(thue_morse(64 * 2, "p ", "q ").split())) for i in (1, 2)] + [(3, " ".join(thue_morse(64, "q ", "p ").split()))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == cut_by_hand(rows, 35)


def test_word_hashes():
    import numpy as np
    import pyarrow as pa

    from tideglass.llm.words import Words

    each = ["", "a", "ab", "a" * 7, "a" * 8, "a" * 9, "b" * 16, "b" * 17, "c" * 5000, "c" * 4999 + "d", "é", "日本"]
    alone = [Words(pa.array([w], pa.large_string())) for w in each if w]
    together = Words(pa.array([" ".join(each)], pa.large_string()))
    for kind in ("hash", "other"):
        assert np.concatenate([getattr(w, kind) for w in alone]).tolist() == getattr(together, kind).tolist()
        assert len(set(getattr(together, kind).tolist())) == len(each) - 1
    assert not set(together.hash.tolist()) & set(together.other.tolist())


def links_by_hand(rows):
    sets = []
    for _, t in rows:
        ws = (t or "").split()
        sets.append({tuple(ws[s : s + 5]) for s in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    n = len(rows)
    linked = [[a != b and bool(sets[a]) and bool(sets[b]) and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5) for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if linked[a][b]:
                    root[a] = root[b] = min(root[a], root[b])
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if root[b] == root[a] and rows[b][0] is not None] if sets[a] else [rows[a][0]]
        out.append((rows[a][0], min((i for i in ids if i is not None), default=None), sum(linked[a])))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "block"), [(1024, 256), (3, 4)])
def test_jaccard(spark, limit, block):
    rng = random.Random(4)
    base = words(80, rng)
    rows = awkward(5, 4)
    for i in range(12):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(80)] = f"e{rng.randrange(9)}"
        rows.append((100 + i, " ".join(near)))
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(table(spark, rows), limit=limit, block=block).collect()]
    assert sorted(got, key=repr) == links_by_hand(rows)


def test_jaccard_splits_a_bucket_of_unlike_texts(spark):
    """Texts that share a passage but are no near copies fall into one bucket and must be split; pairs among them must be found."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, passage + " " + " ".join(words(60, rng, 10**6))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)]
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(table(spark, rows), limit=8, block=16).collect()]
    assert sorted(got, key=repr) == links_by_hand(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "only one"), (3, "only one")]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(table(spark, rows)).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (3, 3, 1)]


def test_sorted_batches_are_cut_between_values():
    import pyarrow as pa

    rng = random.Random(1)
    values = sorted(rng.randrange(30) for _ in range(500)) + [99] * 300 + sorted(rng.randrange(100, 140) for _ in range(200))
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 37]), pa.array(range(i, min(i + 37, 1000)))], ["k", "i"]) for i in range(0, 1000, 37)]
    tables = list(jaccard._grouped(iter(batches), "k", 50))
    assert [x for t in tables for x in t.column("i").to_pylist()] == list(range(1000)) and len(tables) > 3
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not a & b for n, a in enumerate(seen) for b in seen[n + 1 :])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(15)] + [(None, 3), (7, 7)]
    root = {x: x for e in edges for x in e if None not in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng.randrange(20, 60), rng, 5000))) for i in range(12)]
    filler = lambda n: " ".join(words(n, rng, 5000))

    def edited(text):
        ws = text.split()
        for j in range(3, len(ws), 6):
            ws[j] = "changed"
        del ws[8]
        return " ".join(ws).upper()

    rows = [(100 + i, filler(50) + " " + t + "! " + filler(50)) for i, t in items[:6]] + [(200 + i, filler(30) + "\n" + edited(t) + ", " + filler(30)) for i, t in items]
    rows += [(300 + i, filler(200)) for i in range(20)] + [(1, None), (2, ""), (3, filler(2)), (100, rows[0][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, filler(30)), (52, "too short")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leak_pairs(table(spark, rows), bench).collect())
    assert got == sorted([(100 + i, i) for i, _ in items[:6]] + [(200 + i, i) for i, _ in items] + [(100, 0)])
    assert decontaminate.leak_pairs(table(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.leak_pairs(table(spark, []), bench).count() == 0


@pytest.mark.parametrize("exact", [1, 30])
def test_decontamination_of_hot_items(spark, exact):
    """How often an item leaks must not decide whether its edited copies are found."""
    rng = random.Random(3)
    item = words(50, rng, 5000)
    edited = [f"c{j}" if j % 6 == 3 else w for j, w in enumerate(item) if j != 8]
    around = lambda ws: " ".join(words(40, rng, 10**6) + ws + words(40, rng, 10**6))
    rows = [(i, around(item)) for i in range(exact)] + [(1000 + i, around(edited)) for i in range(200)] + [(2000 + i, around(item[5:9])) for i in range(200)]
    got = decontaminate.leak_pairs(table(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [*range(exact), *range(1000, 1200)]


def test_decontamination_finds_all_that_scores_enough(spark):
    """Every item aligned with every text: copies with words replaced, put in and left out as densely as the score allows, and texts of common words."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    items = [(i, words(rng.choice([1, 2, 3, 4, 5, 7, 10, 15, 30, 45, 60]), rng, 60 if i % 2 else 4000)) for i in range(24)]
    rows = []

    def spoilt(ws):
        rate, out = rng.choice([0, 0.1, 0.2, 0.3, 0.4]), []
        for w in ws:
            kind = rng.random() if rng.random() < rate else 1
            out += [f"new{rng.randrange(9)}"] if kind < 0.4 else [w, f"in{rng.randrange(9)}"] if kind < 0.7 else [] if kind < 0.9 else [w]
        return out

    for n, (_, ws) in enumerate(items):
        third = [f"r{j}" if j % 3 == 2 else w for j, w in enumerate(ws)]
        spaced = [x for w in ws for x in (w, "and")][:-1]
        for copy in (ws, third, spaced, *(spoilt(ws) for _ in range(8))):
            rows.append((len(rows), " ".join(words(rng.randrange(40), rng, 60) + copy + words(rng.randrange(40), rng, 60))))
    rows += [(10_000, " ".join(words(3000, rng, 60))), (10_001, " ".join(items[7][1] * 200)), (10_002, " ".join(words(5, rng, 60) * 400))]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    known = decontaminate.Items([i for i, _ in items], [" ".join(ws) for _, ws in items])
    want = set()
    for i, t in rows:
        text = decontaminate._words(pa.array([t])).hash
        score = decontaminate.align(known.words, [text] * len(items))
        want |= {(i, int(known.ids[k])) for k in np.flatnonzero(score >= known.need - 1e-4)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_pairs(table(spark, rows), bench).collect()}
    assert got == want and len(want) > 150


def test_decontamination_of_short_items_parts_and_other_scripts(spark):
    rng = random.Random(5)
    item = {n: [f"i{n}x{j}" for j in range(n)] for n in (1, 2, 4, 7, 9, 12, 60, 150)}
    changed = lambda ws, *at: ["other" if j in at else w for j, w in enumerate(ws)]
    japanese = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。"
    copies = [(n, ws) for n, ws in item.items()] + [(9, changed(item[9], 4)), (12, changed(item[12], 3, 6, 9)), (150, item[150][40:110]), (60, item[60][20:45])]
    copies += [(500, ["書いた" + japanese + "と"]), (500, [japanese.replace("。", "、").replace("猫", "犬")])]
    around = lambda ws: " ".join(words(40, rng, 10**6) + ws + words(40, rng, 10**6))
    rows = [(i, around(ws)) for i, (_, ws) in enumerate(copies)]
    rows += [(100, around(item[150][:12])), (101, around(item[7][:3])), (102, around(item[4][:3])), (103, around(item[2][:1])), (104, around(["猫である。今日は天気がとても良い。"]))]
    bench = spark.createDataFrame([*((n, " ".join(ws)) for n, ws in item.items()), (500, japanese), (501, ""), (502, "... !")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leak_pairs(table(spark, rows), bench).collect())
    assert got == [(i, n) for i, (n, _) in enumerate(copies)]


def test_alignment_is_smith_waterman():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else decontaminate.MISMATCH), h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
        got = decontaminate.align([np.array(a, np.uint64) + 5, np.zeros(1, np.uint64) + 9], [np.array(b, np.uint64) + 5, np.zeros(3, np.uint64) + 7])
        assert abs(got[0] - max(map(max, h))) < 1e-4 and got[1] == 0


TEXTS = [
    None, "", " ", "a  b\n\n c", "don't I'LL we'RE", "<|endoftext|>x<|endoftext|><|startoftext|> y", "É̀é ﬁ ΑΣ ΣΑΣ İI ß ẞ", "\u0085a b​c\x1ch\x1fi᠎j", "٣٤５ ⅷ ²³", "日本語 テスト ｶﾞ", "😀👨‍👩‍👧 ok", "a" * 5000, "!!! ### $$$a", "\x00\x01 \t\r x",
    "ŉs'S 'T", " x  y   ", "ȩ́a", "﻿bom", "한국어 각", "plain words, again plain words",
]


@pytest.mark.parametrize("known", [tokens.KNOWN, 3, 0])
def test_token_counts(spark, known):
    """With all, few and none of the counts inside the tasks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokens._library(path)
    rows = [*enumerate(TEXTS), *((100 + i % 2, TEXTS[-1]) for i in range(5)), (None, "a b"), (None, None), (200, " ".join(words(2000, random.Random(1), 10**6)))]
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 12) for i, t in rows]
    got = [tuple(r) for r in tokens.count_tokens(table(spark, rows), path, 12, known=known).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokens.count_tokens(table(spark, []), path, 12, known=known).count() == 0


def test_pieces_are_counted_once_for_each_pre_token(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "one two one") for i in range(7)]
    got = tokens.pre_token_pieces(table(spark, rows).repartition(3), path).collect()
    assert sorted((r.token, r.n) for r in got) == [(" one", 7), (" two", 7), ("one", 7)]


def test_codec_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokens._library(path)
    rows = [*enumerate(TEXTS), *((100 + i, TEXTS[-1]) for i in range(3))]
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    got = sorted(tuple(r) for r in tokens.encode_decode(table(spark, rows), path, full=True).collect())
    assert got == sorted(want)
    assert tokens.encode_decode(table(spark, []), path).count() == 0
    assert "plain" in tokens.frequent_words(table(spark, rows), path, 5) and len(tokens.frequent_words(table(spark, rows), path, 3)) <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=6), max_size=40), st.lists(st.text("abcé", max_size=7), max_size=10))
def test_transducer(tmp_path_factory, known, others):
    keys = sorted({w.encode() for w in known})
    outputs = [[i, *range(i % 3)] for i in range(len(keys))]
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(automaton.build(keys, outputs))
    table_of = dict(zip(keys, outputs, strict=True))
    asked = [*keys, *(w.encode() for w in others)]
    assert automaton.Lexicon(str(path)).look_up(asked) == [table_of.get(w) for w in asked]


def test_transducer_shares_endings():
    import struct

    words_ = sorted(f"{p}{s}".encode() for p in "abcdefgh" for s in ("tion", "ting", "ted"))
    n_edges = struct.unpack("<q", automaton.build(words_, [[0]] * len(words_))[8:16])[0]
    assert n_edges < 8 + 12


def test_very_long_texts(spark):
    """A million characters in one text and in one word."""
    rng = random.Random(2)
    item = words(30, rng, 10**6)
    long = " ".join(words(60_000, rng, 10**6) + item + words(60_000, rng, 10**6))
    rows = [(1, long), (2, long + " x"), (3, "a" * 1_000_000), (4, " ".join(item[:3] * 40_000))]
    got = decontaminate.leak_pairs(table(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert sorted((r.doc_id, r.n_links) for r in jaccard.near_duplicates(table(spark, rows)).collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    removed = {r.doc_id: r.n_removed for r in substrings.dedup(table(spark, rows)).collect()}
    assert removed == {1: 120_030, 2: 120_030, 3: 0, 4: 120_000}


def test_columns_stay(spark):
    rows = table(spark, [(1, "a b c d e f"), (2, None)])
    clash = rows.withColumn("__node", F.lit("n")).withColumn("__class", F.lit("c")).withColumn("__links", F.lit("l"))
    assert jaccard.near_duplicates(clash).select("__node", "__class", "__links").distinct().collect() == [("n", "c", "l")]
    assert set(KIND.split()[::2]) <= set(jaccard.near_duplicates(rows).columns)
    assert decontaminate.with_leaks(rows, spark.createDataFrame([(1, "a b")], "item_id long, text string")).select(F.size("leaks")).count() == 2


@pytest.mark.parametrize("key", ["id", "runs", "check", "starts", "given", "_p", "_coded"])
def test_keys_named_like_columns_inside(spark, key):
    rows = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(2)] + [(9, "a b")]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], f"`{key}` long, text string, lang string, `a.b` string")
    got = substrings.dedup(df, key=key)
    assert got.columns[0] == key
    assert sorted((r[0], r.n_removed) for r in got.collect()) == [(0, 40), (1, 40), (9, 0)]
    assert tokens.encode_decode(df, public_tokenizers.path("word_bpe_49k.json"), key=key).columns[0] == key
    assert sorted(r[0] for r in language.identify(df, F.lit(False), key=key).collect()) == [0, 1, 9]


def similar_pairs(share, n, rng, name="p"):
    """Pairs of texts whose sets of shingles have about that similarity: an edit of one word changes up to five of them."""
    rows = []
    for i in range(n):
        base = [f"{name}{i}x{j}" for j in range(120)]
        near = list(base)
        edits = 0
        while True:
            a, b = ({tuple(x[s : s + 5]) for s in range(116)} for x in (base, near))
            if len(a & b) / len(a | b) <= share:
                break
            near[rng.randrange(120)] = f"e{edits}"
            edits += 1
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    return rows


@pytest.mark.parametrize("threshold", [(1, 2), (11, 20), (3, 5), (9, 10)])
def test_jaccard_at_other_thresholds(spark, threshold):
    """Pairs just above and just below the threshold; small buckets, so that large ones are split too."""
    rng, t = random.Random(17), threshold[0] / threshold[1]
    rows = similar_pairs(min(1, t + 0.06), 60, rng) + [(1000 + i, x) for i, x in similar_pairs(t - 0.02, 40, rng, "q")]
    shingled = {i: {tuple(x.split()[s : s + 5]) for s in range(len(x.split()) - 4)} for i, x in rows}
    near = lambda i, j: Fraction(len(shingled[i] & shingled[j]), len(shingled[i] | shingled[j])) >= Fraction(*threshold)
    want = {i: int(near(i, i + (1 if i % 2 == 0 else -1))) for i, _ in rows}
    for limit in (1024, 8):
        got = jaccard.near_duplicates(table(spark, rows), threshold=threshold, limit=limit)
        found = {r.doc_id: r.n_links for r in got.collect() if r.doc_id < 1000}
        assert found == {i: n for i, n in want.items() if i < 1000}
    with pytest.raises(ValueError):
        jaccard.near_duplicates(table(spark, rows), threshold=(1, 10))


def test_items_with_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    items = [("x1", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("7", "nothing of that kind stands anywhere in these"), (None, "alpha")]
    got = decontaminate.leak_pairs(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, "x1")]
    structs = spark.createDataFrame([((1, "a"), items[0][1])], "item_id struct<n:int,s:string>, text string")
    assert [tuple(r.item_id) for r in decontaminate.leak_pairs(docs, structs).collect()] == [(1, "a")]
