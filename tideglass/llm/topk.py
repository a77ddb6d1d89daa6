"""Exact top-k search by inner product with a pivot table (operator 7).

A search for the largest inner product is made a search for the smallest distance:
every row gets one more component, sqrt(M - |x|^2), with M the largest squared norm,
and a query gets 0 there. Then |q - x|^2 = |q|^2 + M - 2<q, x>.

The pivot table keeps each row's distances to PIVOTS rows. What they allow for together is more than what the best of them allows alone:
the distances to the pivots fix where a row lies in the space that the pivots span, and how far it is from it; so no row x is nearer to q than
the distance of their places there, and the difference of how far both are from it. This is the largest lower bound that the distances
allow. For a block of queries and rows it is one product of matrices. Rows are evaluated in the order of their bounds, and a search is over when no bound can still reach its
k-th best score. A bounded sample of rows gives every search a k-th score to begin with. Scores are integers.

Rows and queries are dealt as a grid: a cell has one block of queries and one share of the rows. The queries go through shuffles only, not
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.session import cut

#: Rows that pivots are chosen of and that first thresholds come from; pivots at most; rows and pairs that are worked on at once.
PIVOT_SAMPLE, PIVOTS, ROWS, PAIRS = 2048, 56, 4096, 2_000_000
#: Queries of a block, and rows of a cell from which there are more cells than partitions.
QUERY_BLOCK, CELL_ROWS = 8192, 500_000
LONG = 2**63

RESULT = "query_id long, rank int, vec_id long, score long"
FOUND = "block int, place int, id long, score long"


def quantised(df: DataFrame, vec: str, scale: int) -> Column:
    """floor(scale * x) of each component; NULL for vectors that are null, empty or hold null, NaN or infinity."""
    x = F.col(vec)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & (F.size(x) > 0) & sound, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))))


class Pivots:
    """Rows that span much of the space, and how distances to them become places in it."""

    def __init__(self, sample: np.ndarray, most: float, n: int = PIVOTS):
        self.most = most
        lifted = np.hstack([sample, _lift(sample, most)[:, None]])
        rest = lifted - lifted[:1] if len(lifted) else lifted
        chosen, basis = [0] if len(lifted) else [], []
        # each further pivot is the row that is farthest from the span of those before it
        while len(chosen) < min(n, len(lifted)):
            far = (rest * rest).sum(1)
            i = int(far.argmax())
            if far[i] <= 1e-9 * max(1.0, most):
                break
            basis.append(rest[i] / np.sqrt(far[i]))
            rest = rest - np.outer(rest @ basis[-1], basis[-1])
            chosen.append(i)
        self.rows = lifted[chosen]
        #: From <x - p0, pi - p0> to the places along the basis.
        self.turn = np.linalg.inv((self.rows[1:] - self.rows[:1]) @ np.array(basis).T) if basis else np.zeros((0, 0))
        self.size = ((self.rows - self.rows[:1]) ** 2).sum(1)

    def distances(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """From rows lifted by ``lift`` to the pivots."""
        p = self.rows
        d2 = ((x * x).sum(1) + lift * lift)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p[:, :-1].T + lift[:, None] * p[:, -1][None])
        return np.sqrt(np.maximum(d2, 0))

    def places(self, d: np.ndarray) -> np.ndarray:
        """(rows, pivots): places in the pivots' span, and last the distance from it, all from the distances to the pivots."""
        d2 = d * d
        along = (d2[:, :1] + self.size[None, 1:] - d2[:, 1:]) / 2 @ self.turn.T
        return np.hstack([along, np.sqrt(np.maximum(d2[:, :1] - (along * along).sum(1)[:, None], 0))])


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs; the ends of the 64-bit range where they would go beyond it."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, q.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", q, rows)
    full = (q.astype(object) * rows.astype(object)).sum(1)
    return np.array([max(-LONG, min(LONG - 1, int(v))) for v in full], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Search:
    """The k best rows so far for each query of a block."""

    def __init__(self, asked: np.ndarray, pivots: Pivots, sample: np.ndarray, k: int):
        self.asked, self.pivots, self.k = asked, pivots, k
        q = asked.astype(np.float64)
        self.norm = (q * q).sum(1)
        self.at = pivots.places(pivots.distances(q, np.zeros(len(q))))
        #: What rounding may take off a bound.
        self.slack = 1e-6 * (self.norm + pivots.most) + 1.0
        self.score = np.full((len(q), k), -LONG, np.int64)
        self.near = np.full((len(q), k), LONG - 1, np.int64)
        # no worse than the k-th best row of the sample
        self.least = np.full(len(q), -np.inf)
        if len(sample) >= k:
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ sample.T
                self.least[lo : lo + 512] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k] - self.slack[lo : lo + 512]
        self.evaluated = self.seen = 0

    def rows(self, ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> None:
        at = self.pivots.places(d)
        far = (at * at).sum(1)
        step = max(1, PAIRS // max(1, len(ids)))
        for lo in range(0, len(self.asked), step):
            mine = slice(lo, lo + step)
            bound = (self.at[mine] * self.at[mine]).sum(1)[:, None] + far[None] - 2 * self.at[mine] @ at.T
            most = (self.norm[mine, None] + self.pivots.most - bound) / 2 + self.slack[mine, None]
            self.seen += most.size
            # the most promising first, so that the others meet the best thresholds
            first = np.argpartition(-most, min(self.k, most.shape[1]) - 1, axis=1)[:, : self.k]
            rows, cols = np.repeat(np.arange(len(most)), first.shape[1]), first.ravel()
            good = most[rows, cols] >= self.least[mine][rows]
            self._take(lo, rows[good], cols[good], ids, x)
            most[rows, cols] = -np.inf
            rows, cols = np.nonzero((most >= self.least[mine, None]) & (most > -np.inf))
            if len(rows) > 4 * self.k * len(most):
                # many are left: by their bounds, an eighth at a time, with thresholds that rise meanwhile
                order = np.argsort(-most[rows, cols], kind="stable")
                rows, cols = rows[order], cols[order]
            for part in np.array_split(np.arange(len(rows)), max(1, min(8, len(rows) // 1024))):
                r, c = rows[part], cols[part]
                good = most[r, c] >= self.least[mine][r]
                self._take(lo, r[good], c[good], ids, x)

    def _take(self, lo: int, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Evaluate pairs of a query (from ``lo`` on) and a row, and keep the best of them."""
        if not len(rows):
            return
        self.evaluated += len(rows)
        score = np.concatenate([_exact(self.asked[lo + rows[a : a + 100_000]], x[cols[a : a + 100_000]]) for a in range(0, len(rows), 100_000)])
        there = np.unique(rows)
        kept = np.arange(self.k)
        query = np.concatenate([np.repeat(there, self.k), rows])
        score = np.concatenate([self.score[lo + there].ravel(), score])
        near = np.concatenate([self.near[lo + there].ravel(), ids[cols]])
        order = np.lexsort((near, ~score, query))  # ~s falls as s rises, without overflow
        begin = np.searchsorted(query[order], there)
        best = order[(begin[:, None] + kept[None]).ravel()]
        self.score[lo + there] = score[best].reshape(-1, self.k)
        self.near[lo + there] = near[best].reshape(-1, self.k)
        full = self.near[lo + there, -1] != LONG - 1
        some = lo + there[full]
        self.least[some] = np.maximum(self.least[some], self.score[some, -1])


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best rows for each query row: query_id, rank from 1, vec_id, score.

    Rows whose id is null take no part, nor vectors that are null, empty or hold null or
    non-finite components. Vectors meet only vectors of their own length. Candidates are all rows but the query's own: rows that repeat its id or all of it are
    candidates, and queries of their own, whose results come each for themselves. Ties go to the smaller id. A query with
    fewer than k candidates gets them all; an empty table gives no rows. ``df`` is read more than once and must give the same rows each time.
    """
    found, asked = _found(df, id_col, vec_col, is_query, k, scale, FOUND)
    if found is None:
        return df.sparkSession.createDataFrame([], RESULT)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    # the query's own row is among the candidates like any other: one row with its id and score is taken away, the last of them
    best = best.join(asked.select("block", "place", F.col("id").alias("query_id"), "own", "copies"), ["block", "place"])
    self_row = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    own = F.max(F.when(self_row, F.col("n"))).over(Window.partitionBy("block", "place"))
    best = best.withColumn("_own", own).filter(F.col("_own").isNull() | (F.col("n") != F.col("_own")))
    best = best.withColumn("rank", (F.col("n") - F.when(F.col("n") > F.col("_own"), 1).otherwise(0)).cast("int")).filter(F.col("rank") <= k)
    each = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def evaluated_share(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10, scale: int = 1024) -> float:
    """What share of the pairs of a query and a row the bounds leave to be evaluated."""
    found, _ = _found(df, id_col, vec_col, is_query, k, scale, "evaluated long, seen long")
    if found is None:
        return 0.0
    r = found.agg(F.sum("evaluated").alias("e"), F.sum("seen").alias("s")).first()
    return r.e / r.s if r.s else 0.0


def _found(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, scale: int, shape: str) -> tuple[DataFrame | None, DataFrame | None]:
    """What each cell finds, and the queries: block, place in it, id, own score, copies."""
    rows = (
        df.select(F.col(id_col).cast("long").alias("id"), quantised(df, vec_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .filter("id IS NOT NULL AND v IS NOT NULL")
        .withColumn("dim", F.size("v"))
    )
    parts, queries, before = [], [], 0
    for dim, n, n_queries, most in _shapes(rows):
        same = rows.filter(F.col("dim") == dim)
        sample = np.array([r.v for r in same.orderBy(F.xxhash64("id", "v"), "id", "v").select("v").limit(PIVOT_SAMPLE).collect()], np.float64).reshape(-1, dim)
        pivots = Pivots(sample, most)
        blocks = max(1, ceil(n_queries / QUERY_BLOCK))
        asked = same.filter("q").groupBy("id", "v").agg(F.count("*").alias("copies"))
        asked = asked.withColumn("block", (F.lit(before) + F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).cast("int"))
        place = (F.row_number().over(Window.partitionBy("block").orderBy("id", "v")) - 1).cast("int")
        own = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
        own = F.least(own, F.lit(LONG - 1).cast("decimal(38,0)")).cast("long")
        asked = cut(asked.withColumn("place", place).withColumn("own", own))
        parts.append(_search(_index(same, pivots), asked, pivots, sample, n, before, blocks, k + 1, shape))
        queries.append(asked)
        before += blocks
    if not parts:
        return None, None
    found, asked = parts[0], queries[0]
    for more, others in zip(parts[1:], queries[1:], strict=True):
        found, asked = found.unionByName(more), asked.unionByName(others)
    return found, asked


def _shapes(rows: DataFrame) -> list[tuple[int, int, int, float]]:
    """(length, rows, queries, largest squared norm) of each length that has queries; one row for each length."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    got = rows.groupBy("dim").agg(F.count("*").alias("all"), F.sum(F.col("q").cast("long")).alias("n"), F.max(norm).alias("most"))
    return [(r.dim, r["all"], r.n, r.most) for r in got.filter("n > 0").orderBy("dim").collect()]


def _index(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The pivot table: each row with its distances to the pivots."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = _matrix(part.column("v")).astype(np.float64)
                d = pivots.distances(x, _lift(x, pivots.most))
                at = pa.array(np.arange(0, d.size + 1, max(1, d.shape[1])), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(at, pa.array(d.ravel()))], ["id", "v", "d"])

    return rows.select("id", "v").mapInArrow(build, "id long, v array<long>, d array<double>")


def _search(index: DataFrame, asked: DataFrame, pivots: Pivots, sample: np.ndarray, n: int, before: int, blocks: int, k: int, shape: str) -> DataFrame:
    """The best k of each cell's rows for each query of its block, or how many pairs it evaluated."""
    spark = index.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, ceil(n / CELL_ROWS), min(ceil(wide / blocks), ceil(n / ROWS)))
    kept = spark.sparkContext.broadcast((pivots, sample))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample = kept.value
        cell, queries, state, block = None, [], None, 0

        def ready() -> Search | None:
            return Search(_matrix(pa.chunked_array(queries).combine_chunks()), pivots, sample, k) if queries else None

        def result(state: Search | None) -> Iterator[pa.RecordBatch]:
            if state is None:
                return
            if shape != FOUND:
                yield pa.RecordBatch.from_arrays([pa.array([state.evaluated]), pa.array([state.seen])], ["evaluated", "seen"])
                return
            for lo in range(0, len(state.asked), 1000):
                score, near = state.score[lo : lo + 1000], state.near[lo : lo + 1000]
                row, at = np.nonzero(near != LONG - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block, np.int32)), pa.array((lo + row).astype(np.int32)), pa.array(near[row, at]), pa.array(score[row, at])], ["block", "place", "id", "score"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
            for lo, hi in zip(edges, [*edges[1:], len(cells)], strict=True):
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    yield from result(state)
                    cell, queries, state = cells[lo], [], None
                    block = before + int(cell % blocks)
                n_queries = int(np.count_nonzero(part.column("place").to_numpy() >= 0))
                if n_queries:
                    queries.append(part.column("v").slice(0, n_queries))
                if n_queries < part.num_rows:
                    state = state or ready()
                    for at in range(n_queries, part.num_rows, ROWS if state else part.num_rows):
                        some = part.slice(at, ROWS)
                        if state:
                            state.rows(some.column("id").to_numpy(), _matrix(some.column("v")), _matrix(some.column("d")))
        yield from result(state)

    share = F.pmod(F.monotonically_increasing_id(), F.lit(shares))
    rows = index.withColumn("share", share).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select((F.col("share") * blocks + F.col("block")).cast("int").alias("cell"), F.lit(-1).alias("place"), "id", "v", "d")
    given = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    given = given.select((F.col("share") * blocks + F.col("block") - before).cast("int").alias("cell"), "place", "id", "v", F.array().cast("array<double>").alias("d"))
    dealt = rows.unionByName(given).repartition(max(1, min(shares * blocks, max(wide, shares))), "cell")
    # queries come first in their cell, in the order of their places
    first = F.when(F.col("place") < 0, F.lit(2**31 - 1)).otherwise(F.col("place"))
    return dealt.sortWithinPartitions("cell", first).mapInArrow(search, shape)
