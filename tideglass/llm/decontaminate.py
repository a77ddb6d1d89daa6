"""Benchmark decontamination (operator 2).

Seeds are pairs of words: each word of a test item with the next one and with the one after that, as
they stand in a passage next to one another or with one word between. A copy that an alignment accepts surely
has many of them: between matching words it can't have two errors everywhere, as each error takes 0.4 off. With m matches and e errors a score of s = m - 0.4 e
leaves m - 1 - e / 2 such pairs at least, which is no less than 1.25 s - 0.25 m - 1. So of an item's pairs the commonest in the corpus needn't be seeds: up to half of
what any copy has are left out, and of the rest, the rare ones, a passage must hold the other half on diagonals as near to one another as a copy's can be. Nothing that scores
enough is lost so, however often the item leaks (but for copies under LONG alone that match one word in three).

A pass over the corpus joins passages to items through the seeds. Windows with too few words of the item are left out, which loses none either;
each other is scored by a Smith-Waterman alignment of words, which lets edited and paraphrased copies through.

Items are taken in blocks whose seeds fit a bound; a block is sent to all tasks, and
the corpus is read for each block. Nothing of the corpus comes to the driver but how often each seed occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tideglass.llm.words import NOT_ALNUM, Words, chunks, flat, mix

U = np.uint64
#: Words of items of a block. Items of fewer words than WHOLE match as whole copies only.
BLOCK_WORDS, WHOLE = 250_000, 5
#: Distances of the two words of a seed, in the item and in a passage.
STEPS = (1, 2)
#: Alignment: a match gives 1, another word MISMATCH, a word left out GAP.
MISMATCH, GAP = -0.4, -0.4
#: A pair is a copy from this score per word of the item, and this many words' worth, on; or from LONG words' worth on, whatever the item's length.
SIMILARITY, LEAST, LONG = 0.5, 8.0, 20.0
#: For items so short that they can't reach LEAST with a few edits: this score per word, and for the shortest this one up to that many words' worth. 
SHORT, SHORTEST, UP_TO = 0.65, 0.8, 5.6
#: Characters of scripts without spaces, each a word of its own and worth half a word; punctuation of these scripts.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\x{30FC}\x{FF70}]\p{M}*)"
MARKS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]+"
#: Pairs that are aligned together, and cells of a row of their alignments; words of passages that are counted together.
PAIRS, CELLS, COUNTED = 256, 1_000_000, 1_000_000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * U(0xD6E8FEB86659FD93))


class Items:
    """A block of test items: their words' hashes, and their seeds as a sorted table. ``often`` tells how often a seed occurs in the corpus."""

    def __init__(self, ids: list, texts: list[str]):
        words = _words(pa.array(texts, pa.large_string()))
        self.ids = list(ids)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.size = np.diff(words.first)
        of_word = words.text_of_word()
        # an item of one word is a seed of its own
        alone = np.flatnonzero(self.size[of_word] == 1) if len(of_word) else np.zeros(0, np.int64)
        gram, item, place = [mix(words.hash[alone])], [of_word[alone]], [np.zeros(len(alone), np.int64)]
        for step in STEPS:
            at = np.flatnonzero(of_word[:-step] == of_word[step:]) if len(of_word) > step else np.zeros(0, np.int64)
            gram.append(_pair(words.hash[at], words.hash[at + step]))
            item.append(of_word[at])
            place.append(at - words.first[of_word[at]])
        self.gram, self.item, self.place = np.concatenate(gram), np.concatenate(item), np.concatenate(place)
        #: The score from which a pair is a copy.
        worth = 1 + np.bincount(of_word[_unspaced(words)], minlength=len(self.ids)) / np.maximum(self.size, 1)
        least = np.minimum(LEAST * worth, np.maximum(SHORT * self.size, np.minimum(SHORTEST * self.size, UP_TO)))
        least = np.where(self.size < WHOLE, self.size, least)
        self.need = np.minimum(np.maximum(SIMILARITY * self.size, least), LONG * worth)
        #: Pairs that a copy has at least, and how far apart its diagonals may be: an error takes 0.4 off.
        self.sure = np.maximum(1, np.ceil(1.25 * self.need - 0.25 * self.size - 1 - 1e-9)).astype(np.int64)
        self.drift = np.floor(np.maximum(0, self.size - self.need) / -GAP + 1e-9).astype(np.int64)
        #: The words of each item, as a sorted table and by their upper bits.
        self.owned = np.unique(_owned(of_word, words.hash))
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.owned >> U(44)).astype(np.int64)] = True
        self._sorted()

    def _sorted(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.table = np.unique(self.gram)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.table >> U(42)).astype(np.int64)] = True

    def keep_rare(self, often: dict[int, int]) -> None:
        """Leave out each item's commonest seeds, up to half of what a copy surely has."""
        n = np.array([often.get(g, 0) for g in self.gram.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.place, -n, self.item))
        begin = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        rank = np.arange(len(order)) - begin[self.item[order]]
        kept = order[rank >= self.sure[self.item[order]] // 2]
        self.gram, self.item, self.place = self.gram[kept], self.item[kept], self.place[kept]
        self.sure = self.sure - self.sure // 2
        self._sorted()

    def common(self, item: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many of the words left..right-1 stand in the item, for each pair; no alignment scores more."""
        n = right - left
        pair = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + left[pair]
        key = _owned(item[pair], words[at])
        some = np.flatnonzero(self.likely[(key >> U(44)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.owned, key[some]), len(self.owned) - 1)
        return np.bincount(pair[some[self.owned[near] == key[some]]], minlength=len(n))

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' seeds that are in the table, and the seeds."""
        if not len(self.table) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, U)
        of_word, places, held = words.text_of_word(), [], []
        for step in (0, *STEPS) if (self.size == 1).any() else STEPS:
            gram = _pair(words.hash[:-step], words.hash[step:]) if step else mix(words.hash)
            at = np.flatnonzero(self.filter[(gram >> U(42)).astype(np.int64)])
            at = at[of_word[at] == of_word[at + step]]
            near = np.minimum(np.searchsorted(self.table, gram[at]), len(self.table) - 1)
            at = at[self.table[near] == gram[at]]
            places.append(at)
            held.append(gram[at])
        return np.concatenate(places), np.concatenate(held)


def _owned(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(words + (item.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))


def _words(texts: pa.Array) -> Words:
    texts = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    body, at = flat(texts)
    # (these scripts take three bytes a character or more)
    wide = np.unique(np.searchsorted(at, np.flatnonzero(body >= 0xE0), side="right") - 1)
    if len(wide):
        cut = pc.replace_substring_regex(pc.replace_substring_regex(texts.take(pa.array(wide)), UNSPACED, r" \1 "), MARKS, " ")
        mask = np.zeros(len(texts), bool)
        mask[wide] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), cut)
    return Words(texts, NOT_ALNUM)


def _unspaced(words: Words) -> np.ndarray:
    """Which words are characters of scripts without spaces."""
    text = words.body.tobytes()
    each = pa.array([text[a:b] for a, b in zip(words.start, words.end, strict=True)], pa.binary()).cast(pa.string())
    return pc.match_substring_regex(each, "^" + UNSPACED + "$").to_numpy(zero_copy_only=False).astype(bool)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The Smith-Waterman score of each pair of word-hash arrays, for all pairs at once."""
    rows, columns = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), U), np.ones((len(items), columns), U)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    h = np.zeros((len(items), columns + 1), np.float32)
    best = np.zeros(len(items), np.float32)
    slope = (np.arange(columns + 1) * -GAP).astype(np.float32)
    inside = np.array([len(x) for x in items])
    for i in range(rows):
        step = np.where(a[:, i, None] == b, np.float32(1), np.float32(MISMATCH))
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + step, h[:, 1:] + np.float32(GAP))
        np.maximum(new, 0, out=new)
        # words left out of the passage: the best cell to the left, less a gap for each word
        h = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(best, np.where(i < inside, h.max(1), 0), out=best)
    return best


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of up to ``most`` in all, one at least."""
    sums, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + most, side="right")) - 1)
        yield slice(lo, hi)
        lo = hi


def pairs_of(items: Items, words: Words) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, score, seeds) of the texts that hold a copy of an item."""
    at, gram = items.found(words)
    if not len(at):
        return
    lo, hi = np.searchsorted(items.gram, gram, "left"), np.searchsorted(items.gram, gram, "right")
    n = hi - lo
    at = np.repeat(at, n)
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, offset = items.item[entry], at - items.place[entry]
    text = np.searchsorted(words.first, at, side="right") - 1
    order = np.lexsort((offset, item, text))
    text, item, offset = text[order], item[order], offset[order]
    size, drift = items.size, items.drift
    # windows of diagonals with as many seeds as a copy surely has; those that overlap make one region
    line = (text * len(items.ids) + item) * (len(words) * 2 + int(drift.max()) + int(size.max()) + 2) + offset + int(size.max())
    end = np.searchsorted(line, line + drift[item], side="right")
    full = end - np.arange(len(line)) >= items.sure[item]
    reach = np.maximum.accumulate(np.where(full, end, 0))
    begin = np.flatnonzero(full & (np.append(0, reach[:-1]) <= np.arange(len(line))))
    if not len(begin):
        return
    end = np.maximum.reduceat(np.where(full, end, 0), begin)
    t, it, seeds = text[begin], item[begin], end - begin
    left = np.maximum(words.first[t], offset[begin] - drift[it])
    right = np.minimum(words.first[t + 1], offset[end - 1] + drift[it] + size[it])
    # a copy is no wider than its item and its drift: wide regions are looked at in windows that overlap by that
    wide = size[it] + drift[it]
    n = np.maximum(1, -(-(right - left) // wide) - 1)
    region = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = left[region] + step * wide[region]
    right = np.minimum(right[region], left + 2 * wide[region])
    t, it = t[region], it[region]
    enough = np.zeros(len(region), bool)
    for some in _parts(right - left, COUNTED):
        enough[some] = items.common(it[some], words.hash, left[some], right[some]) >= items.need[it[some]] - 1e-4
    kept = np.flatnonzero(enough)
    kept = kept[np.argsort(right[kept] - left[kept], kind="stable")]
    found: dict[tuple[int, int], float] = {}
    regions: dict[tuple[int, int], set[int]] = {}
    for part in _parts(np.maximum(right[kept] - left[kept], CELLS // PAIRS), CELLS):
        some = kept[part]
        score = align([items.words[i] for i in it[some]], [words.hash[x:y] for x, y in zip(left[some], right[some], strict=True)])
        for k in np.flatnonzero(score >= items.need[it[some]] - 1e-4):
            key = int(t[some[k]]), int(it[some[k]])
            found[key] = max(found.get(key, 0.0), float(score[k]))
            regions.setdefault(key, set()).add(int(region[some[k]]))
    for (t, i), score in sorted(found.items()):
        yield t, i, score, int(sum(seeds[r] for r in regions[t, i]))


def blocks(benchmark: DataFrame, text: str, key: str) -> Iterator[Items]:
    """The test items in blocks of bounded size; items that are null are left out."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("i"), F.col(text).alias("t")).distinct()
    for i, t in rows.toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += 1 + len(t) // 4
        if size > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leak_type(benchmark: DataFrame, item: str) -> ArrayType:
    """An array of item, with the type of the test items' ids, score, similarity and seeds."""
    fields = ("item", benchmark.schema[item].dataType), ("score", DoubleType()), ("similarity", DoubleType()), ("seeds", LongType())
    return ArrayType(StructType([StructField(n, t) for n, t in fields]))


def _how_often(df: DataFrame, items: Items, text: str) -> dict[int, int]:
    """How often each of the block's seeds occurs in all texts."""
    kept = df.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = kept.value
        n = np.zeros(len(items.table), np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                _, gram = items.found(_words(part))
                n += np.bincount(np.searchsorted(items.table, gram), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(items.table[some].view(np.int64)), pa.array(n[some])], ["gram", "n"])

    counts = df.filter(F.col(text).isNotNull()).select(F.col(text)).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.collect()}


def _finder(df: DataFrame, items: Items, text: str, kind: ArrayType) -> object:
    """A function of a text column: the leaks of a block's items in each text."""
    items.keep_rare(_how_often(df, items, text))
    kept = df.sparkSession.sparkContext.broadcast(items)

    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = kept.value
        for texts in batches:
            out: list[list[dict]] = []
            for _, part in chunks(texts):
                rows: list[list[dict]] = [[] for _ in range(len(part))]
                for t, i, score, seeds in pairs_of(items, _words(part)):
                    rows[t].append({"item": items.ids[i], "score": round(score, 4), "similarity": round(score / len(items.words[i]), 4), "seeds": seeds})
                out += rows
            yield pa.array(out, arrow)

    return find


def with_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", leaks: str = "leaks") -> DataFrame:
    """All columns of df and ``leaks``: an array of item, score, similarity and seeds for the test items that a row holds copies of.

    The score counts matching words less what MISMATCH and GAP take off; similarity is the score per word of
    the item. Both are those of the best copy in the row. Null and empty texts hold nothing, nor does any text where there are no test items; repeated rows are
    looked at each for themselves. Items whose id or text is null are left out; ids may be of any type. ``df`` is read more than once. Test items that share an id but not a text may come more than once in a row's array. A column named as ``leaks`` is replaced.
    """
    parts, kind = [], leak_type(benchmark, item)
    for items in blocks(benchmark, text, item):
        parts.append(_finder(df, items, text, kind)(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn(leaks, F.concat(*parts) if parts else F.array().cast(kind))


def leak_pairs(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """key, item, score, similarity, seeds: a row for each pair of a row of df and a test item that it holds a copy of.

    As in ``with_leaks``: null and empty texts and items without a text or an id give no rows, rows that are repeated give theirs each for themselves, and an empty table on either side gives none.
    """
    rows = with_leaks(df.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")), "text", "item", "leaks").filter(F.size("leaks") > 0)
    fields = [F.col(f"leak.{f}").alias(n) for f, n in (("item", item), ("score", "score"), ("similarity", "similarity"), ("seeds", "seeds"))]
    return rows.select("key", F.explode("leaks").alias("leak")).select(F.col("key").alias(key), *fields)
