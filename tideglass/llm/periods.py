"""Periodic run detection on a harmonic grid (operator 12).

A run is a stretch of words in which words ``period`` apart are equal, that spans two periods and MIN_LENGTH words at least, and that no neighbouring word extends. For each
period p the places jp and (j+1)p form a grid: a run of period p holds two neighbours of it. How far the words after such a pair agree, and those before it,
are longest common extensions; p and both together are the run.

Extensions come from a suffix array of the words, one of the reversed words, their arrays of common prefixes, and range minima over them. The texts of a batch share one
array: each text's words have codes of their own, so that no extension leaves its text. Two checks come first and lose nothing: a text in which no half of MIN_LENGTH words stands twice holds no run, and a pair of the grid whose words differ extends to nothing.

All is done within the row, with memory in proportion to a batch of texts or one long text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tideglass.llm.words import chunks, mix
from tideglass.session import fresh, quoted

#: Words of a run at least, by default.
MIN_LENGTH = 12
#: Bytes of text that share a suffix array, pairs of the grid that are looked at together, and the cells of a block of range minima (as a shift).
BATCH, PAIRS, SHIFT = 1_000_000, 1 << 20, 4
FAR = np.iinfo(np.int64).max


class Minima:
    """Smallest values of ranges: within blocks from running minima, across blocks from a table of powers of two over the blocks' minima."""

    def __init__(self, values: np.ndarray):
        width = 1 << SHIFT
        self.values = np.full(-(-max(1, len(values)) // width) * width, FAR)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, width)
        self.up = np.minimum.accumulate(blocks, axis=1).ravel()
        self.down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        level = blocks.min(axis=1)
        self.levels = [level]
        while 1 << len(self.levels) <= len(level):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            further = last.copy()
            further[:-step] = np.minimum(last[:-step], last[step:])
            self.levels.append(further)
        self.table = np.array(self.levels)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the values lo..hi, both ends included."""
        first, last = lo >> SHIFT, hi >> SHIFT
        out = np.minimum(self.down[lo], self.up[hi])
        near = np.flatnonzero(first == last)
        if len(near):
            a, b = lo[near], hi[near]
            least = self.values[a]
            for i in range(1, 1 << SHIFT):
                least = np.minimum(least, np.where(a + i <= b, self.values[np.minimum(a + i, b)], FAR))
            out[near] = least
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, n = first[wide] + 1, (last - first)[wide] - 1
            k = np.frexp(n.astype(np.float64))[1] - 1
            out[wide] = np.minimum(out[wide], np.minimum(self.table[k, a], self.table[k, a + n - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of the suffixes of a sequence of codes.

    The suffix array comes by doubling: what is sorted by h codes is sorted by 2h through the places h further on. Where two neighbours part, their common prefix is h and that of the places
    h further on, which have parted before.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        parted = np.ones(n, bool)
        parted[1:] = codes[order[1:]] != codes[order[:-1]]
        common = np.where(parted, 0, FAR)
        rank = np.empty(n, np.int64)
        place = np.empty(n + 1, np.int64)
        h = 1
        while True:
            rank[order] = np.cumsum(parted) - 1
            place[order] = np.arange(n)
            alone = parted & np.append(parted[1:], True)
            if alone.all():
                break
            left = np.flatnonzero(~alone)
            at = order[left]
            then = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + then
            new = np.argsort(key, kind="stable")
            order[left], key = at[new], key[new]
            # (neighbours in left are neighbours in the array unless a group begins, which has parted already)
            apart = np.flatnonzero(key[1:] != key[:-1]) + 1
            apart = apart[~parted[left[apart]]]
            where = left[apart]
            a, b = order[where - 1] + h, order[where] + h
            common[where] = h + self._before(Minima(common), place, a, b, n)
            parted[where] = True
            h *= 2
        self.n, self.place = n, place
        self.minima = Minima(common)

    @staticmethod
    def _before(minima: Minima, place: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        both = np.flatnonzero((a < n) & (b < n))
        one, two = place[a[both]], place[b[both]]
        out[both] = minima.of(np.minimum(one, two) + 1, np.maximum(one, two))
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a and from b on are equal; a and b differ, the end of the sequence extends to nothing."""
        return self._before(self.minima, self.place, a, b, self.n)


def runs_of(codes: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of each run, by start and period. ``first`` has where each text begins, and the end; texts have no code in common."""
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    most = size // 2
    if not most.sum():
        return none, none, none
    forward, backward = Extensions(codes), Extensions(codes[::-1].copy())
    n = len(codes)
    base = np.repeat(first[:-1], most)
    period = np.arange(len(base)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (np.repeat(size, most) - 1) // period
    end = np.cumsum(pairs)
    begin = end - pairs
    found = []
    for lo in range(0, int(end[-1]), PAIRS):
        hi = min(lo + PAIRS, int(end[-1]))
        some = slice(int(np.searchsorted(end, lo, "right")), int(np.searchsorted(begin, hi, "left")))
        from_, to = np.maximum(begin[some], lo), np.minimum(end[some], hi)
        count = to - from_
        j = np.arange(hi - lo) - np.repeat(np.cumsum(count) - count, count) + np.repeat(from_ - begin[some], count)
        p = np.repeat(period[some], count)
        a = np.repeat(base[some], count) + j * p
        same = codes[a] == codes[a + p]
        a, p = a[same], p[same]
        before = backward.of(n - a, n - a - p)
        length = p + forward.of(a, a + p) + before
        is_run = (length >= 2 * p) & (length >= least)
        found.append(_smallest(a[is_run] - before[is_run], length[is_run], p[is_run]))
    # a stretch is found for each multiple of its period, too
    start, length, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _smallest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def may_repeat(codes: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Of each text: whether as many words in a row as a run of ``least`` words repeats (half of it) stand in it twice."""
    gram = max(1, least - least // 2)
    if len(codes) < gram:
        return np.zeros(len(first) - 1, bool)
    h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(codes) - gram + 1, np.uint64)
    for i in range(gram):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(codes) - gram + 1 + i]
    order = np.argsort(total, kind="stable")
    twice = total[order[1:]] == total[order[:-1]]
    out = np.zeros(len(first) - 1, bool)
    # (texts share no code, so that equal grams are of one text; where unlike ones fall together, a text is looked at for nothing)
    out[np.searchsorted(first, order[1:][twice], "right") - 1] = True
    return out


def _texts(texts: list[str | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text: how many words it has, its runs, and its words without the repeats."""
    words = [(t or "").encode().split() for t in texts]
    size = np.array([len(w) for w in words])
    codes, last = np.empty(int(size.sum()), np.int64), 0
    first = np.append(0, np.cumsum(size))
    for w, at in zip(words, first[:-1].tolist(), strict=True):
        known: dict[bytes, int] = {}
        codes[at : at + len(w)] = [known.setdefault(x, len(known)) for x in w]
        codes[at : at + len(w)] += last
        last += len(known)
    asked = may_repeat(codes, first, least)
    part = np.repeat(asked, size)
    offset = np.append(0, np.cumsum(np.where(asked, size, 0)))
    start, length, period = runs_of(codes[part], np.append(0, np.cumsum(size[asked])), least)
    edge = np.searchsorted(start, offset)
    for i, w in enumerate(words):
        lo, hi = int(edge[i]), int(edge[i + 1])
        if not asked[i] or lo == hi:
            yield len(w), [], b" ".join(w)
            continue
        own = list(zip((start[lo:hi] - offset[i]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
        depth = np.zeros(len(w) + 1, np.int64)
        np.add.at(depth, [s + p for s, _, p in own], 1)
        np.add.at(depth, [s + n for s, n, _ in own], -1)
        yield len(w), own, b" ".join(compress(w, (np.cumsum(depth)[:-1] == 0).tolist()))


def collapse(df: DataFrame, least: int = MIN_LENGTH, text: str = "text", names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """All columns of df but the text, with the number of words, the runs (array of start, length, period, counted in words from 0, by start and period), and the words without repeats, joined by one space.

    Words are the runs of bytes other than space and 0x09 to 0x0D. A word is a repeat if a run holds it after that run's first period. Null and empty texts have no words, no runs and an empty result; texts of fewer
    than ``least`` words have no runs. Repeated rows come each for themselves, an empty table gives no rows, and columns of df may have any names (one that is named like a result is replaced). A long text is worked
    on whole, by one task.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    size, runs, rest = fresh(df, *(f"_{x}" for x in names))
    body, packed = fresh(df, "_body", "_row")
    others = [c for c in df.columns if c != text and c not in names]
    rows = df.select(F.struct(*(F.col(quoted(c)) for c in others), F.lit(None).cast("int").alias(fresh(df, "_none")[0])).alias(packed), F.col(quoted(text)).alias(body))
    kind = rows.schema[packed].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column(1), BATCH):
                n, own, kept = zip(*_texts(part.to_pylist(), least), strict=True)
                at = pa.array(np.append(0, np.cumsum([len(x) for x in own])), pa.int32())
                flat = np.array([r for x in own for r in x], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
                arrays = [batch.column(0).slice(lo, len(part)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, each), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [packed, size, runs, rest])

    run = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
    schema = StructType([StructField(packed, kind), StructField(size, LongType()), StructField(runs, ArrayType(run)), StructField(rest, StringType())])
    done = rows.mapInArrow(work, schema)
    return done.select(*(F.col(packed)[c].alias(c) for c in others), *(F.col(a).alias(b) for a, b in zip((size, runs, rest), names, strict=True)))
