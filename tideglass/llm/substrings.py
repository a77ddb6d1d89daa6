"""Substring dedup by seed and extend (operator 1).

A passage of MIN_WORDS words is a window; a window is repeated if its words also start anywhere else in the corpus.

Seed: of the n-grams (SEED words) in a window the one with the smallest hash is its anchor
(winnowing), so that equal windows have equal anchors at equal places. Neighbouring windows mostly share
their anchor; a run is such a stretch of windows, and its context is all of their words. Runs whose anchor stands
once in the corpus hold no repeats and go no further; that is most of the text.

Extend: runs that meet in an anchor are extended both ways by comparing contexts. Where two runs
have the same context, the repeat goes on to both ends of it and all their windows are
repeated. Only a run whose context is its own, at the edges of repeats, is
looked at window by window, against one run for each other context of its anchor. Windows next to one another that are repeated
together make up the maximal repeats; their words are removed.

No step brings the occurrences of an anchor together in one task or pairs them: anchors, contexts
and windows are counted with partial aggregation, and joined by keys that a skewed join can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.words import Spans, Words, chunks, grams, mix, signed, window_argmin
from tideglass.session import quoted

#: Words of a window by default, and of a seed.
MIN_WORDS, SEED = 35, 6
#: Bytes of text that a worker looks at together. Larger parts are no faster, and a worker keeps what its largest part took.
PART = 500_000
#: What is done with a run: all windows are repeated; its windows are asked for; it answers for others.
FULL, ASKS, ANSWERS = 0, 1, 2


def runs_of(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its text, first window (counted in the text's words), windows, anchor and context."""
    none = np.zeros(0, np.int64)
    if len(words) < size:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    spans = Spans(words.hash)
    gram = grams(spans, len(words), seed)
    anchor = window_argmin(gram, size - seed + 1)
    text = words.text_of_word()
    start = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = anchor[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    lo, place = start[first], at[first]
    # the anchor's place belongs to the context: the same words with another window in front are another context. Its words count by their second hashes, so
    # that with the anchor, which is of the first ones, equal contexts are equal in two independent hashes
    context = mix(Spans(words.other, "other").of(lo, lo + count + size - 1) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text[lo], lo - words.first[text[lo]], count, gram[place], context


def _runs(df: DataFrame, size: int, seed: int) -> DataFrame:
    """anchor and row of each run; row is context, id, check and run, and run is first window * 64 + windows.

    The row is one array, so that its columns aren't pruned: the runs are then worked out and shuffled once for all that is asked of them.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, checks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, part in chunks(batch.column(2), PART):
                text, first, count, anchor, context = runs_of(Words(part), size, seed)
                row = text + lo
                four = np.stack((signed(context), ids[row], checks[row], first * 64 + count), axis=1)
                packed = pa.ListArray.from_arrays(np.arange(0, four.size + 1, 4, np.int32), four.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), packed], ["anchor", "row"])

    return df.select("id", "check", "text").mapInArrow(emit, "anchor long, row array<long>")


def _windows(df: DataFrame, size: int) -> DataFrame:
    """(With the columns that ``_strip`` needs, so that the texts are shuffled once for both.) The windows of the runs that ask or answer: two hashes, a weight (2 for runs that occur twice), and whether and where the answer is wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, checks = batch.column("id").to_numpy(), batch.column("check").to_numpy()
            marks = batch.column("runs")
            for lo, part in chunks(batch.column("text"), PART):
                words = Words(part)
                some = marks.slice(lo, len(part))
                mark = some.flatten().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(part)), some.value_lengths().fill_null(0).to_numpy())
                use = (mark & 3) != FULL
                mark, text = mark[use], text[use]
                count = (mark >> 2) & 63
                begin = np.repeat(mark >> 8, count)
                begin = begin + np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
                text, asks = np.repeat(text, count), np.repeat((mark & 3) == ASKS, count)
                at = begin + words.first[text]
                one, two = Spans(words.hash).of(at, at + size), Spans(words.other, "other").of(at, at + size)
                arrays = signed(one), signed(two), np.where(asks, 1, 2), asks, ids[lo + text], checks[lo + text], begin
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["one", "two", "weight", "asks", "id", "check", "start"])

    return df.select("id", "check", "given", "text", "runs").mapInArrow(emit, "one long, two long, weight long, asks boolean, id long, check int, start long")


def _strip(df: DataFrame, size: int, kind: str) -> DataFrame:
    """given (the key), n_words, n_removed and kept text, from the runs and starts that are known to be repeated."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in chunks(batch.column("text"), PART):
                words = Words(part)
                n = len(part)
                size_of = np.diff(words.first)
                runs, starts = batch.column("runs").slice(lo, n), batch.column("starts").slice(lo, n)
                mark = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(n), runs.value_lengths().fill_null(0).to_numpy())
                run = text << 48 | mark >> 2
                full = ((mark & 3) == FULL) & ~np.isin(run, run[(mark & 3) == ASKS])
                single = starts.flatten().to_numpy(zero_copy_only=False)
                single_text = np.repeat(np.arange(n), starts.value_lengths().fill_null(0).to_numpy())
                begin = np.concatenate([words.first[text[full]] + (mark[full] >> 8), words.first[single_text] + single]).astype(np.int64)
                end = np.concatenate([words.first[text[full]] + (mark[full] >> 8) + ((mark[full] >> 2) & 63) - 1, words.first[single_text] + single]).astype(np.int64) + size
                depth = np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
                gone = np.cumsum(depth)[: len(words)] > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (size_of > 0) if n else np.zeros(0, int)
                kept = np.flatnonzero(~gone)
                length = words.end[kept] - words.start[kept] + 1
                to = np.cumsum(length) - length
                body = np.full(int(length.sum()) + 1, 32, np.uint8)
                within = np.arange(int((length - 1).sum())) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1)
                body[np.repeat(to, length - 1) + within] = words.body[np.repeat(words.start[kept], length - 1) + within]
                edge = np.searchsorted(kept, words.first)
                at = np.append(to, int(length.sum()))[edge]
                raw = body.tobytes()
                texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("given").slice(lo, n), pa.array(size_of.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], ["given", "n_words", "n_removed", "kept"])

    return df.select("given", "text", "runs", "starts").mapInArrow(strip, f"given {kind}, n_words long, n_removed long, kept string")


def dedup(df: DataFrame, size: int = MIN_WORDS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_removed, kept of each row: all words that lie in a repeated window are gone, the others joined by one space.

    Words are the runs of bytes other than space and 0x09 to 0x0D, unchanged. All occurrences of a repeat go, the first one too. Null and empty texts have no
    words and are kept as empty texts; texts shorter than a window keep all words. Repeated rows are repeats of one another. Windows may overlap their other occurrence. Rows
    without a key are told apart by their texts. The key may have any name but those of the other results. ``df`` is read more than once and must give the same rows each time.
    """
    if not 1 <= seed <= size or size - seed + 1 > 63:
        raise ValueError("a seed must fit into a window, with at most 63 places in it")
    given, body = F.col(quoted(key)), F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = df.select(given.alias("given"), F.coalesce(given.try_cast("long"), F.xxhash64(body)).alias("id"), F.hash(body).alias("check"), body.alias("text"))
    runs = _runs(rows, size, seed)
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    meeting = runs.join(anchors, "anchor")
    context = F.col("row")[0].alias("context")
    single = meeting.groupBy("anchor", context).agg(F.count("*").alias("n")).filter("n = 1")
    # dealt by another key, so that the few that are left come out of a stage of their own and its sorts needn't stay in memory for those of the next
    open_anchors = single.select("anchor").distinct().repartition(F.xxhash64("anchor"))
    picked = runs.join(open_anchors, "anchor").groupBy("anchor", context).agg(F.count("*").alias("n"), F.min("row").alias("row"))
    # every run that meets another is marked FULL, and the mark to ask overrules that: so the counts needn't be joined back
    marks = meeting.select("row", F.lit(FULL).alias("kind")).union(picked.select("row", F.when(F.col("n") == 1, ASKS).otherwise(ANSWERS)))
    # no part is null; saying so keeps a filter from one use of the runs away, which would have them shuffled once more for it
    part = lambda i: F.coalesce(F.col("row")[i], F.lit(0))
    marks = marks.select(part(1).alias("id"), part(2).cast("int").alias("check"), (part(3) * 4 + F.col("kind")).alias("mark"))
    of_row = marks.groupBy("id", "check").agg(F.collect_set("mark").alias("runs"))
    marked = rows.join(of_row, ["id", "check"], "left")
    windows = _windows(marked.filter(F.exists("runs", lambda m: m.bitwiseAND(F.lit(3)) != FULL)), size)
    repeated = windows.groupBy("one", "two").agg(F.sum("weight").alias("n")).filter("n > 1").select("one", "two")
    answered = windows.filter("asks").join(repeated, ["one", "two"], "left_semi")
    starts = answered.groupBy("id", "check").agg(F.collect_set("start").alias("starts"))
    return _strip(marked.join(starts, ["id", "check"], "left"), size, df.schema[key].dataType.simpleString()).withColumnRenamed("given", key)
