"""N-gram Jaccard join by chosen paths (operator 3).

Texts are sets of shingles of SHINGLE words. Copies are taken together first: everything below is
about distinct texts. A text's set is embedded as COORDINATES minimum hashes (more for low thresholds), each of which two sets share with the probability of
their Jaccard similarity.

Chosen path: a run draws a coordinate and splits all texts by its values; how many there are follows from the threshold (``Paths``), 12 for 0.8. A bucket
of LIMIT texts or fewer is compared by brute force. A larger one draws further coordinates, 2 for 0.8, by a hash
of its path, and splits its texts by the values of each; and so on. If a sample of its texts is alike on average, it would not separate, and if the
tree is DEPTH levels deep neither: then the bucket is compared in blocks. A pair at the threshold t goes on into a common bucket with the
probability ONWARD at least, while unlike texts thin out; after d levels the runs miss it with (1 - t * ONWARD ** d) ** runs, which is for 0.8
4e-9 without a large bucket and below 1e-6 with two levels of them.

Brute force in a bucket compares sketches of one byte for each coordinate, with a margin of six standard deviations, and
only tells which texts may be linked, as one edge for each text. The components of these edges are small groups that hold all links.
Last, the sets themselves are brought together by component, once, and each pair is decided exactly there; a large component is worked on in
pairs of blocks. What comes out is counts and one edge for each text, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideglass.llm.components import components
from tideglass.llm.words import Spans, Words, chunks, grams, mix
from tideglass.session import cut, fresh

SHINGLE, THRESHOLD = 5, (4, 5)
#: Runs are repeated until a pair at the threshold is in a common bucket of one of them with this probability at least; a pair at the threshold goes on from a bucket that is split with this one.
RECALL, ONWARD = 1 - 1e-8, 0.96
#: Coordinates at least and at most, and levels of splits.
COORDINATES, MOST_COORDINATES, DEPTH = 64, 256, 6
#: Texts of a bucket that are compared at once.
LIMIT = 4096
#: Texts of a large bucket that are sampled to see how alike they are.
SAMPLE = 64
#: Texts and shingles of a block in the exact comparison; a component of n texts is read n / BLOCK_TEXTS times there.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 2_000_000
#: Keys of large buckets that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 100_000

U = np.uint64
FACTORS = np.random.default_rng(5).integers(0, 2**63, MOST_COORDINATES, dtype=U) * U(2) + U(1)


class Paths(NamedTuple):
    """What follows from a threshold."""

    #: Runs, coordinates in all, and those that a split draws.
    runs: int
    coordinates: int
    branches: int
    #: The average similarity from which a bucket doesn't get split; the share of equal sketch bytes from which two texts may be linked, six standard deviations below the threshold.
    alike: float
    maybe: float

    @classmethod
    def of(cls, threshold: tuple[int, int]) -> Paths:
        t = threshold[0] / threshold[1]
        if not 0.2 <= t <= 1:
            raise ValueError("the threshold must be from 0.2 to 1; below that most of a corpus would meet in one bucket")
        missed = log(max(1e-9, 1 - t))
        runs = ceil(log(1 - RECALL) / missed - 1e-9)
        coordinates = min(MOST_COORDINATES, max(COORDINATES, 2 * runs))
        return cls(runs, coordinates, ceil(log(1 - ONWARD) / missed - 1e-9), 0.375 * t, t - 6 * sqrt(t * (1 - t) / coordinates))


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the place of each text's first, with the end; a text of fewer words is one shingle, of none has none."""
    spans, count = Spans(words.hash), np.diff(words.first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.append(0, np.cumsum(many))
    lo = np.repeat(words.first[:-1] - at[:-1], many) + np.arange(at[-1])
    hi = np.minimum(lo + n, np.repeat(words.first[1:], many))
    return spans.of(lo, hi), at


def minima(hashes: np.ndarray, at: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """(n, texts) minimum hashes, mixed; of texts without shingles they mean nothing."""
    out = np.zeros((n, len(at) - 1), U)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for j in range(n):
            out[j, some] = mix(np.minimum.reduceat(hashes * FACTORS[j], at[some]))
    return out


def _identity(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _texts(df: DataFrame, text: str, key: str, paths: Paths) -> DataFrame:
    """Distinct texts that have words: node, copies, first key, and coordinates, whole for the first draw and in two bytes and one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                hashes, at = shingles(Words(part))
                some = np.flatnonzero(np.diff(at))
                m = minima(hashes, at, paths.coordinates)[:, some].T
                draws = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * paths.runs, pa.int32()), pa.array(m[:, : paths.runs].ravel().view(np.int64)))
                two = pa.array([r.tobytes() for r in (m & U(0xFFFF)).astype(np.uint16)], pa.binary())
                one = pa.array([r.tobytes() for r in (m & U(0xFF)).astype(np.uint8)], pa.binary())
                rows = pa.array(lo + some)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("key").take(rows), draws, two, one], ["node", "key", "draws", "two", "one"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(text).isNotNull()).select(_identity(F.col(text)).alias("node"), F.col(key).alias("key"), F.col(text).alias("text"))
    sketches = rows.mapInArrow(sketch, f"node binary, key {kind}, draws array<long>, two binary, one binary")
    return sketches.groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("first"), *(F.first(c).alias(c) for c in ("draws", "two", "one")))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component in a graph of n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _grouped(batches: Iterator[pa.RecordBatch], column: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by a column, cut between its values into tables of at least ``rows`` rows where there are as many."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        values = whole.column(column).to_numpy()
        end = int(np.count_nonzero(values != values[-1]))  # they are sorted: the last value's rows are the last
        if end:
            yield whole.slice(0, end)
            held = whole.slice(end).to_batches()
            n = whole.num_rows - end
        else:
            held = whole.to_batches()
            rows = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _maybe_linked(rows: DataFrame, paths: Paths) -> DataFrame:
    """Edges a, b between texts of a bucket whose sketches agree; rows are key, node, one. One edge for each text at most."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "key"):
            key = table.column("key").to_numpy()
            nodes = table.column("node").combine_chunks()
            sketch = np.frombuffer(b"".join(table.column("one").to_pylist()), np.uint8).reshape(len(key), paths.coordinates)
            a, b = [], []
            live, d = np.arange(len(key)), 1
            while len(live):
                live = live[live + d < len(key)]
                live = live[key[live] == key[live + d]]
                for lo in range(0, len(live), 20_000):
                    some = live[lo : lo + 20_000]
                    like = some[(sketch[some] == sketch[some + d]).sum(1) >= paths.maybe * paths.coordinates]
                    a.append(like)
                    b.append(like + d)
                d += 1
            root = local_roots(len(key), np.concatenate([*a, np.zeros(0, int)]), np.concatenate([*b, np.zeros(0, int)]))
            moved = np.flatnonzero(root != np.arange(len(key)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], ["a", "b"])

    return rows.select("key", "node", "one").repartition("key").sortWithinPartitions("key").mapInArrow(link, "a binary, b binary")


def _of(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def _alike(coordinates: int) -> object:
    """A function of a column of samples: the mean share of equal bytes of the pairs of some sketches."""

    @F.arrow_udf(DoubleType())
    def alike(samples: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in samples:
            out = []
            for sample in batch.to_pylist():
                m = np.frombuffer(b"".join(sample), np.uint8).reshape(-1, coordinates)
                n = len(m)
                equal = sum(int((np.bincount(m[:, j]) ** 2).sum()) for j in range(coordinates)) - n * coordinates
                out.append(equal / (n * (n - 1) * coordinates) if n > 1 else 1.0)
            yield pa.array(out, pa.float64())

    return alike


def candidate_edges(texts: DataFrame, paths: Paths, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Edges between texts that may be linked, as far as their components go."""
    found = []
    rows = texts.select("node", "two", "one", F.posexplode("draws").alias("c", "value")).select(F.xxhash64("c", "value").alias("key"), "node", "two", "one")
    for level in range(depth + 1):
        large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
        n_large = large.count()
        if not n_large:
            found.append(_maybe_linked(rows, paths))
            break
        found.append(_maybe_linked(rows.join(_of(large.select("key"), n_large), "key", "left_anti"), paths))
        held = cut(rows.join(_of(large, n_large), "key"))
        drawn = held.filter(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1_000_000)) < F.ceil(F.lit(1e6 * SAMPLE) / F.col("n")))
        alike = cut(drawn.groupBy("key").agg(F.collect_list("one").alias("sample")).select("key", _alike(paths.coordinates)("sample").alias("alike")))
        loose_keys = alike.filter(F.col("alike") < paths.alike).select("key") if level < depth else alike.select("key").limit(0)
        dense = held.join(_of(loose_keys, n_large), "key", "left_anti")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dense = dense.withColumn("blocks", F.ceil(F.col("n") / limit).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found.append(_maybe_linked(dense.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "one"), paths))
        if level == depth:
            break
        loose = held.join(_of(loose_keys, n_large), "key", "left_semi")
        coordinate = lambda j: paths.runs + F.pmod(F.xxhash64("key", F.lit(j)), F.lit(paths.coordinates - paths.runs))
        parts = F.array(*[F.xxhash64("key", coordinate(j), F.substring("two", (2 * coordinate(j) + 1).cast("int"), F.lit(2))) for j in range(paths.branches)])
        rows = loose.withColumn("_key", F.explode(F.array_distinct(parts))).select(F.col("_key").alias("key"), "node", "two", "one")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of sets with at least the threshold; one must be in ``left`` and the other in ``right``."""
    size = np.array([len(s) for s in sets])
    token, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(which, minlength=len(token))
    column = np.cumsum(often > 1) - 1
    keep = often[which] > 1
    row, which = row[keep], column[which[keep]]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    wide = max(64, 2_000_000 // len(sets))
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, wide):
        a, b = np.searchsorted(which, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[a:b], which[a:b] - lo] = 1
        shared += m @ m.T
    p, q = threshold
    linked = q * shared >= p * (size[:, None] + size[None] - shared)
    linked &= (left[:, None] & right[None]) | (right[:, None] & left[None])
    a, b = np.nonzero(np.triu(linked, 1))
    return a, b


def _decide(groups: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """node, links (rows that it is linked with in other texts), root of each text in each group; a group is a pair of blocks of a component."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "gid", 1):
            gid = table.column("gid").to_numpy()
            sets = [np.asarray(s) for s in table.column("shingles").combine_chunks().to_numpy(zero_copy_only=False)]
            copies, left, right = (table.column(c).to_numpy() for c in ("copies", "left", "right"))
            links, root = np.zeros(len(gid), np.int64), np.arange(len(gid))
            edge = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(gid)), strict=True):
                if hi - lo < 2:
                    continue
                a, b = exact_links(sets[lo:hi], left[lo:hi], right[lo:hi], threshold)
                links[lo:hi] = np.bincount(a, copies[lo:hi][b], hi - lo) + np.bincount(b, copies[lo:hi][a], hi - lo)
                root[lo:hi] = lo + local_roots(hi - lo, a, b)
            nodes = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes, pa.array(links), nodes.take(pa.array(root)), table.column("blocks").combine_chunks()], ["node", "links", "root", "blocks"])

    return groups.repartition("gid").sortWithinPartitions("gid").mapInArrow(decide, "node binary, links long, root binary, blocks int")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: tuple[int, int] = THRESHOLD, limit: int = LIMIT, block: int = BLOCK_TEXTS, head: str | None = None) -> DataFrame:
    """All columns of df with class_id and n_links.

    Two rows are linked if their texts are the same or the Jaccard similarity of their shingle sets is at least the threshold. n_links is the number of
    other rows that a row is linked with; class_id is the smallest key among the rows that links join together. Texts without words (null, empty, white space) are linked
    with nothing and are classes of their own, as their key says. Repeated rows are copies of one another. ``df`` is read more than once and must
    give the same rows each time. Columns of df with the names of the results are replaced. ``head`` names a further column: whether a row's text is the one that
    stands for its class (of those with the smallest key that with the smallest identity), null for texts without words.
    """
    paths = Paths.of(threshold)
    texts = cut(_texts(df, text, key, paths))
    found = components(candidate_edges(texts, paths, limit))
    sized = found.join(texts.select("node", "copies", "first"), "node")
    shape = found.join(texts.select("node"), "node").groupBy("root").agg(F.count("*").alias("texts"))
    groups = sized.join(shape, "root")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                hashes, at = shingles(Words(part))
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                ends = np.append(0, np.cumsum([len(s) for s in sets]))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, len(part)) for c in ("node", "root", "copies", "texts")] + [column], ["node", "root", "copies", "texts", "shingles"])

    bodies = df.filter(F.col(text).isNotNull()).select(_identity(F.col(text)).alias("node"), F.col(key).alias("first"), F.col(text).alias("text"))
    with_text = bodies.join(groups.withColumnRenamed("first", "_first"), (bodies["node"] == groups["node"]) & bodies["first"].eqNullSafe(F.col("_first"))).select(bodies["node"], "root", "copies", "texts", "text")
    sets = with_text.mapInArrow(to_sets, "node binary, root binary, copies long, texts long, shingles array<long>")
    sets = cut(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("root", "copies", "texts", "shingles"))))
    size = sets.groupBy("root").agg(F.sum(F.size("shingles")).alias("_all"))
    sets = sets.join(size, "root").withColumn("blocks", F.ceil(F.greatest(F.col("texts") / block, F.col("_all") / BLOCK_SHINGLES)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pairs = sets.select("node", "copies", "shingles", "blocks", F.xxhash64("root", low, high).alias("gid"), (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"))
    decided = cut(_decide(pairs, threshold))
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    roots = decided.filter("blocks = 1").select("node", "root")
    if decided.filter("blocks > 1").limit(1).count():
        roots = roots.unionByName(components(decided.filter("blocks > 1").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = roots.join(links, "node").join(texts.select("node", "first"), "node")
    best = [F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node"))["node"].alias("__head")] if head else []
    classes = rooted.groupBy("root").agg(F.min("first").alias("class"), *best)
    heads = ["__head"] if head else []
    linked = rooted.join(classes, "root").select("node", "links", "class", *heads)
    per_text = texts.select("node", "copies", "first").join(linked, "node", "left").select(
        F.col("node").alias("__node"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.coalesce("class", "first").alias("__class"), *((F.coalesce("__head", "node") == F.col("node")).alias(h) for h in heads)
    )
    # helper names that no column of df has
    node, *mine = fresh(df, "__node", "__class", "__links", "__head")
    per_text = per_text.toDF(*({"__node": node, "__class": mine[0], "__links": mine[1], "__head": mine[2]}[c] for c in per_text.columns))
    joined = df.withColumn(node, _identity(F.col(text))).join(per_text, node, "left")
    joined = joined.withColumn(head, F.col(mine[2])) if head else joined
    return joined.withColumns({"class_id": F.coalesce(mine[0], F.col(key)), "n_links": F.coalesce(mine[1], F.lit(0)).cast("long")}).drop(node, *mine)
