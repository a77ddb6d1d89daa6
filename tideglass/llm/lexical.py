"""Ranked lexical search over a tiered index (operator 11).

Each item of a query set is matched with all documents; a document's score is the sum, over the item's terms, of a term's weight times the impact of the term in the document,
all in integers.

The index has a row for each BLOCK documents, with the postings of the terms that the items ask for: of every document, as index and answer must be whole. Its postings lie in tiers, each a
group of columns, so that a search that needs the first tier reads that alone: the first has the SHARES[0] of a term's postings with the highest impacts (all postings of a rare
term), and so on; the last has the rest. For each term and tier the largest impact below is kept, the residual bound.

A search over the first tiers gives each item a k-th score that can only rise. If the residual bounds of the item's terms together stay below it, then a document
that none of these tiers named can't be among the best k, and of the others only those whose score and residual bounds reach it are scored in full: the item is proven. Items without that proof fall through
to the next tier by themselves; after the last tier nothing is left below, so that every result is exact.

Documents are never dealt out by term: a block's postings are summed where they lie, a task keeps the best k for each item, and only those are shuffled. Items are searched in
groups of GROUP_TERMS terms, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.words import LOWER, NOT_ALNUM, Words, chunks, signed
from tideglass.session import cut, fresh, quoted, shared_folder

#: Documents of an index row; shares of a term's postings in the tiers before the last; terms whose postings all lie in the first tier, as a share of the documents.
BLOCK, SHARES, RARE = 1024, (1 / 16, 1 / 4), 1 / 500
#: Terms (with repeats) of a group of items that is searched at once, items that a task sums up together, and steps of impact that tiers are told apart by.
GROUP_TERMS, ITEMS, LEVELS = 500_000, 512, 1000
#: Impacts are below UNIT / 1000.
UNIT = 1_000_000_000
POSTINGS = "term array<int>, place array<int>, {}"
COUNTED = "ids {}, sizes array<long>, term array<int>, place array<int>, tf array<long>"
BEST = "item int, score long, {}"


class Weights(NamedTuple):
    """What a search has to know of its items and their terms."""

    #: Of each term: its weight; the impact from which a posting lies in each tier (falling, 0 for the last); the largest impact below each tier.
    weight: np.ndarray
    floor: np.ndarray
    below: np.ndarray
    #: The items that have a term, as rows of a sparse matrix: where a term's begin, the item, how often it has the term.
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray
    n_items: int


def _terms(df: DataFrame, text: str, row: str) -> DataFrame:
    """row, one, two: the two hashes of each term of each text, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column(1)):
                words = Words(part, NOT_ALNUM, LOWER)
                at = pa.array(words.first, pa.int32())
                arrays = [batch.column(0).slice(lo, len(part)), *(pa.ListArray.from_arrays(at, pa.array(signed(h))) for h in (words.hash, words.other))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "one", "two"])

    return df.select(F.col(row).alias("row"), F.col(text)).mapInArrow(work, "row long, one array<long>, two array<long>")


def _counted(docs: DataFrame, one: np.ndarray, two: np.ndarray, kind: str) -> DataFrame:
    """The postings of the terms asked for (by their hashes, sorted by the first), in rows of BLOCK documents, with all documents' ids and numbers of terms."""
    asked = docs.sparkSession.sparkContext.broadcast((one, two))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = asked.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                keys, tfs, sizes = [], [], []
                for lo, part in chunks(block.column(1)):
                    words = Words(part, NOT_ALNUM, LOWER)
                    sizes.append(np.diff(words.first))
                    place = np.minimum(np.searchsorted(one, words.hash), max(0, len(one) - 1))
                    known = np.flatnonzero((one[place] == words.hash) & (two[place] == words.other)) if len(one) else np.zeros(0, np.int64)
                    key, tf = np.unique((words.text_of_word()[known] + lo) * max(1, len(one)) + place[known], return_counts=True)
                    keys.append(key)
                    tfs.append(tf)
                key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                lists = np.concatenate(sizes) if sizes else key, (key % max(1, len(one))).astype(np.int32), (key // max(1, len(one))).astype(np.int32), np.concatenate(tfs) if tfs else key
                ids = block.column(0)
                lists = [ids, *(pa.array(x) for x in lists)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["ids", "sizes", "term", "place", "tf"])

    return docs.mapInArrow(work, COUNTED.format(kind))


def _impacts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """(UNIT * tf) div (1000 * tf + 8 * m), with m = 25 + (75 * size * n) div total."""
    if 75 * int(size.max(initial=0)) * n >= 2**63:
        m = np.array([min(2**58, 25 + 75 * int(s) * n // total) for s in size], np.int64)
    else:
        m = 25 + 75 * size * n // max(1, total)
    return UNIT * tf // (1000 * tf + 8 * m)


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def _levels(counted: DataFrame, n: int, total: int) -> DataFrame:
    """term, level, n, top: how many postings of each term have impacts of a level, and the largest of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, term, place, tf = _lists(batch, i, "sizes", "term", "place", "tf")
                impact = _impacts(tf, size[place], n, total)
                key = term.astype(np.int64) * (LEVELS + 1) + impact * LEVELS * 1000 // UNIT
                order = np.lexsort((impact, key))
                last = np.flatnonzero(np.append(key[order[1:]] != key[order[:-1]], True)) if len(key) else order
                count = np.diff(np.append(-1, last))
                at = order[last]
                yield pa.RecordBatch.from_arrays([pa.array(term[at]), pa.array((key[at] % (LEVELS + 1)).astype(np.int32)), pa.array(count), pa.array(impact[at])], ["term", "level", "n", "top"])

    each = counted.select("sizes", "term", "place", "tf").mapInArrow(work, "term int, level int, n long, top long")
    return each.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _tiers(levels: DataFrame, n: int) -> list:
    """Of each term: df, and for each tier before the last the impact from which its postings lie in it, and the largest below; one row a term."""
    down = Window.partitionBy("term").orderBy(F.desc("level"))
    ranked = levels.withColumn("upto", F.sum("n").over(down)).withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    out = [F.first("df").alias("df")]
    for i, share in enumerate(SHARES):
        # a term's highest level is in the first tier, however many postings it has
        within = (F.col("upto") <= F.greatest(F.ceil(F.col("df") * share), F.lit(math.ceil(n * RARE)))) | (F.col("upto") == F.col("n"))
        out.append(F.min(F.when(within, F.col("level"))).alias(f"level{i}"))
        out.append(F.coalesce(F.max(F.when(~within, F.col("top"))), F.lit(0)).alias(f"below{i}"))
    return ranked.groupBy("term").agg(*out).collect()


def _tiered(counted: DataFrame, n: int, total: int, floor: np.ndarray, kind: str) -> DataFrame:
    """The index: of each block the ids, and of each tier the terms, places and impacts of its postings."""
    tiers = floor.shape[1]
    given = counted.sparkSession.sparkContext.broadcast(floor)
    names = [f"{x}{i}" for i in range(tiers) for x in ("term", "place", "impact")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = given.value
        for batch in batches:
            for i in range(batch.num_rows):
                size, term, place, tf = _lists(batch, i, "sizes", "term", "place", "tf")
                impact = _impacts(tf, size[place], n, total)
                level = impact * LEVELS * 1000 // UNIT
                tier = (level[:, None] < floor[term]).sum(1)
                arrays = [batch.column("ids").slice(i, 1)]
                for t in range(tiers):
                    mine = tier == t
                    for x in (term[mine], place[mine], impact[mine]):
                        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)))
                yield pa.RecordBatch.from_arrays(arrays, ["ids", *names])

    shape = ", ".join(f"term{i} array<int>, place{i} array<int>, impact{i} array<long>" for i in range(tiers))
    return counted.mapInArrow(work, f"ids {kind}, {shape}")


def _sums(term: np.ndarray, place: np.ndarray, value: np.ndarray, w: Weights, column: np.ndarray, items: int, docs: int) -> np.ndarray:
    """(items, docs): over the postings of the items' terms, weight times how often the item has the term times value. column: of each item its row here, or -1."""
    count = w.begin[term + 1] - w.begin[term]
    each = np.repeat(np.arange(len(term)), count)
    of = np.repeat(w.begin[term], count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    row = column[w.item[of]]
    use = row >= 0
    each, of, row = each[use], of[use], row[use]
    worth = w.weight[term[each]] * w.times[of] * value[each]
    key = row * docs + place[each]
    if float(np.abs(worth).astype(np.float64).sum()) < 2.0**53:  # then sums of doubles are exact
        return np.bincount(key, weights=worth, minlength=items * docs).astype(np.int64).reshape(items, docs)
    out = np.zeros(items * docs, np.int64)
    np.add.at(out, key, worth)
    return out.reshape(items, docs)


class Best:
    """The best k documents so far of each item: score falling, then id rising."""

    def __init__(self, k: int):
        self.k, self.had = k, {}

    def take(self, items: np.ndarray, score: np.ndarray, ids: pa.Array, open_: np.ndarray) -> None:
        """score: (items, docs); open_ says which of them count."""
        k = self.k
        for i, item in enumerate(items.tolist()):
            at = np.flatnonzero(open_[i])
            had = self.had.get(item)
            if had is not None and len(had) == k:
                at = at[score[i, at] >= had[-1][0]]
            if not len(at):
                continue
            if len(at) > k:
                least = np.partition(score[i, at], len(at) - k)[len(at) - k]
                at = at[score[i, at] >= least]
            new = zip(score[i, at].tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
            self.had[item] = sorted([*(had or []), *new], key=_order)[:k]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = [(item, s, d) for item, found in self.had.items() for s, d in found]
        for lo in range(0, len(rows), 10_000):
            item, score, ids = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, kind)], ["item", "score", "id"])


def _order(found: tuple) -> tuple:
    """Null ids come last among equal scores."""
    return -found[0], found[1] is None, found[1]


def _search(index: DataFrame, w: Weights, live: np.ndarray, least: np.ndarray, tiers: int, full: bool, k: int, kind: str) -> DataFrame:
    """item, score, id: the best k of each task for the items that are live.

    Scores are those of the first ``tiers`` tiers, which is what a document's score is at least. With ``full`` they are the whole scores of those documents which these tiers name and
    whose whole score may reach ``least``.
    """
    every = w.floor.shape[1]
    read = every if full else tiers
    given = index.sparkSession.sparkContext.broadcast((w, live, least))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, live, least = given.value
        best, of_ids = Best(k), None
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                of_ids, docs = ids.type, len(ids)
                postings = [_lists(batch, i, f"term{t}", f"place{t}", f"impact{t}") for t in range(read)]
                term, place, impact = (np.concatenate([p[x] for p in postings[:tiers]]) for x in range(3))
                for lo in range(0, len(live), ITEMS):
                    items = live[lo : lo + ITEMS]
                    column = np.full(w.n_items, -1)
                    column[items] = np.arange(len(items))
                    score = _sums(term, place, impact, w, column, len(items), docs)
                    open_ = score > 0
                    if full and tiers < every:
                        rest = w.below[:, tiers - 1]
                        named = _sums(term, place, rest[term], w, column, len(items), docs)
                        open_ &= score + _bounds(w, rest)[items][:, None] - named >= least[items][:, None]
                        further = [np.concatenate([p[x] for p in postings[tiers:]]) for x in range(3)]
                        wanted = open_.any(axis=0)[further[1]]
                        score = score + _sums(*(x[wanted] for x in further), w, column, len(items), docs)
                    best.take(items, score, ids, open_)
        if of_ids is not None:
            yield from best.rows(of_ids)

    columns = ["ids", *(f"{x}{t}" for t in range(read) for x in ("term", "place", "impact"))]
    return index.select(*columns).mapInArrow(work, BEST.format(f"id {kind}"))


def _bounds(w: Weights, below: np.ndarray) -> np.ndarray:
    """Of each item, what all its terms together can be worth by ``below``, at most."""
    term = np.repeat(np.arange(len(w.weight)), np.diff(w.begin))
    out = np.zeros(w.n_items, np.int64)
    np.add.at(out, w.item, w.weight[term] * w.times * below[term])
    return out


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", trace: list | None = None) -> DataFrame:
    """item_key, rank from 1, key, score: the k documents of each item with the highest scores above 0, ties by key.

    Terms are the runs of ASCII letters and digits and of all characters beyond ASCII, with A to Z lowered. Null and empty texts have none: such items find nothing, such documents are found by nobody and don't count
    among the documents. Rows of docs are documents of their own and rows of items are items of their own, also where ids are null or repeated; equal scores are in ascending order of key, null last. An empty table on
    either side gives no rows. Columns of either table may have any names. ``docs`` is read once for each group of items and once for all; ``trace`` gets the number of items proven after each tier of each group.
    """
    spark = docs.sparkSession
    (row,) = fresh(items, "_row")
    numbered = cut(items.select(F.col(quoted(item_key)).alias("item"), F.col(quoted(item_text)).alias("text")).withColumn(row, F.monotonically_increasing_id()))
    terms = cut(_terms(numbered, "text", row).filter(F.size("one") > 0))
    total = terms.agg(F.coalesce(F.sum(F.size("one")), F.lit(0)).alias("n")).first().n
    groups = max(1, math.ceil(total / GROUP_TERMS))
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    parts = []
    for g in range(groups if total else 0):
        some = terms.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g) if groups > 1 else terms
        parts += _group(slim, some.collect(), k, kind, trace)
    if not parts:
        parts = [spark.createDataFrame([], f"row long, rank int, score long, id {kind}")]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    named = found.join(numbered.select(F.col(row).alias("row"), "item"), "row")
    out_key = key if key.lower() not in {item_key.lower(), "rank", "score"} else fresh(items, f"found_{key}")[0]
    return named.select(F.col("item").alias(item_key), "rank", F.col("id").alias(out_key), "score")


def _group(docs: DataFrame, rows: list, k: int, kind: str, trace: list | None) -> list[DataFrame]:
    """The results of a group of items, given by their terms' hashes: row, rank, score, id."""
    if not rows:
        return []
    spark = docs.sparkSession
    one, two = (np.concatenate([np.array(r[c], np.int64) for r in rows]).view(np.uint64) for c in ("one", "two"))
    of = np.repeat(np.arange(len(rows)), [len(r.one) for r in rows])
    # two terms with the same first hash would hide one another
    known, term = np.unique(np.stack([one, two], 1), axis=0, return_inverse=True)
    if len(np.unique(known[:, 0])) < len(known):
        raise ValueError("two terms have the same hash of 64 bits")
    pair, times = np.unique(term.ravel().astype(np.int64) * len(rows) + of, return_counts=True)
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    _counted(docs, known[:, 0].copy(), known[:, 1].copy(), f"array<{kind}>").write.parquet(f"{folder}-counted")
    counted = spark.read.parquet(f"{folder}-counted")
    sums = counted.agg(F.sum(F.size(F.filter("sizes", lambda s: s > 0))).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s)).alias("terms")).first()
    n, total = sums.n or 0, sums.terms or 0
    if not n:
        return []
    tiers = len(SHARES) + 1
    weight = np.full(len(known), math.floor(1000 * math.log(2 * n + 2)), np.int64)
    floor, below = np.zeros((len(known), tiers), np.int64), np.zeros((len(known), tiers), np.int64)
    for r in _tiers(_levels(counted, n, total), n):
        weight[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
        for i in range(len(SHARES)):
            floor[r.term, i], below[r.term, i] = r[f"level{i}"], r[f"below{i}"]
    w = Weights(weight, floor, below, np.searchsorted(pair // len(rows), np.arange(len(known) + 1)), pair % len(rows), times, len(rows))
    _tiered(counted, n, total, floor, f"array<{kind}>").write.parquet(f"{folder}-tiers")
    index = spark.read.parquet(f"{folder}-tiers")
    live, least, out = np.arange(len(rows)), np.zeros(len(rows), np.int64), []
    for t in range(1, tiers + 1):
        found = cut(_kept(_search(index, w, live, least, t, False, k, kind), k))
        if t == tiers:
            out.append(found)
            proven = live
        else:
            for r in found.filter(F.col("rank") == k).select("item", "score").collect():
                least[r.item] = max(least[r.item], r.score)
            proven = live[_bounds(w, below[:, t - 1])[live] < least[live]]
            if len(proven):
                out.append(cut(_kept(_search(index, w, proven, least, t, True, k, kind), k)))
        if trace is not None:
            trace.append(len(proven))
        live = np.setdiff1d(live, proven)
        if not len(live):
            break
    _drop(spark, f"{folder}-counted", f"{folder}-tiers")
    numbers = spark.createDataFrame([(i, r.row) for i, r in enumerate(rows)], "item int, row long")
    return [x.join(numbers, "item").select("row", "rank", "score", "id") for x in out]


def _drop(spark, *folders: str) -> None:
    """Away with tables that nothing reads any more."""
    sc = spark.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
