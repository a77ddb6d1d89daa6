"""Many keywords in many texts: an Aho-Corasick automaton over a table of keywords.

A text is read once for all keywords, in time that grows with its length and what is found, not with the number of keywords. The keywords come as a table; they are dealt to shards by a hash so that
a shard's words fit SHARD_BYTES, which is checked. A shard is sent to all tasks and becomes an automaton there; a table with several shards has an automaton for each,
and what they find is put together in the row. Texts are never shuffled or compared with single keywords.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords that are sent to all tasks at once, each with WORD_BYTES for its place in the automaton.
SHARD_BYTES, WORD_BYTES = 32_000_000, 64
HITS = "array<struct<word:string,start:int,n:int>>"
_KIND = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("n", pa.int32())]))


def _automaton(words: list[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _found(automaton: ahocorasick.Automaton | None, text: str | None) -> list[dict]:
    """word, start of its first place (code points from 0) and number of places of each keyword in a text, by first place and then word."""
    if automaton is None or not text:
        return []
    places: dict[str, list[int]] = {}
    for end, word in automaton.iter(text):
        had = places.setdefault(word, [end - len(word) + 1, 0])
        had[1] += 1
    return [{"word": w, "start": s, "n": n} for w, (s, n) in sorted(places.items(), key=lambda x: (x[1][0], x[0]))]


def _shards(keywords: DataFrame, word: str, fold: bool, most: int) -> Iterator[list[str]]:
    """The distinct keywords in shards of bounded size; one shard at a time comes through the driver."""
    own = F.lower(F.col(word)) if fold else F.col(word)
    words = keywords.select(own.alias("w")).filter("w IS NOT NULL AND w <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("w") + WORD_BYTES), F.lit(0)).alias("b")).first().b
    n = max(1, ceil(1.1 * size / most)) if size > most else 1
    for i in range(n):
        yield [r.w for r in (words if n == 1 else words.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i)).collect()]


def _finder(given: Broadcast) -> object:
    """A function of a text column: what a shard's words find."""

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(given.value)
        for texts in batches:
            yield pa.array([_found(automaton, t) for t in texts.to_pylist()], _KIND)

    return find


def with_hits(texts: DataFrame, keywords: DataFrame, text: Column | str = "text", hits: str = "hits", word: str = "word", fold: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of texts and ``hits``: the keywords that a text holds anywhere, also inside words and over one another: word, start of its first place, n places; by start and then word.

    With ``fold`` both sides are lower-cased. Null and empty texts hold nothing, null and empty keywords stand nowhere, repeated keywords count once. Rows of texts come each for themselves.
    """
    body = F.col(text) if isinstance(text, str) else text
    body = F.coalesce(F.lower(body) if fold else body, F.lit(""))
    sc = texts.sparkSession.sparkContext
    parts = [_finder(sc.broadcast(words))(body) for words in _shards(keywords, word, fold, shard_bytes)]
    found = parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0))
    return texts.withColumn(hits, found)


def first_rule(texts: DataFrame, rules: DataFrame, fields: list[tuple[float, Column]], key: str) -> DataFrame:
    """key, weight, kind: for each text the best rule of a table, with the weight of the best field that holds one of its keywords; the rule with the smallest place of equals. Texts that no rule fits aren't there.

    rules: place, kind, word (a row for each keyword); fields: weight and text of each, to be searched in this order. The table may have any number of rules, also many with the same word: of those only the best
    can ever count, whatever the field, so that each hit is joined to one rule. Texts are searched once.
    """
    ranked = rules.groupBy(F.lower("word").alias("word")).agg(F.max(F.struct((-F.col("place")).alias("place"), "kind")).alias("r"))
    whole = texts.select(key, *(F.coalesce(c, F.lit("")).alias(f"f{i}") for i, (_, c) in enumerate(fields)))
    for i in range(len(fields)):
        whole = with_hits(whole, ranked, f"f{i}", f"h{i}")

    def weighed(i: int, weight: float) -> Column:
        return F.transform(F.col(f"h{i}"), lambda h: F.struct(F.lit(float(weight)).alias("weight"), h["word"].alias("word")))

    tagged = [weighed(i, w) for i, (w, _) in enumerate(fields)]
    each = whole.select(key, F.explode(F.concat(*tagged)).alias("h")).select(key, "h.weight", "h.word")
    best = each.join(ranked, "word").groupBy(key).agg(F.max(F.struct("weight", "r.place", "r.kind")).alias("b"))
    return best.select(key, "b.weight", "b.kind")


def plain_hits(texts: list[str | None], words: list[str]) -> list[list[tuple[str, int, int]]]:
    """What ``with_hits`` finds, by looking for each word by itself; for tests and small inputs."""
    out = []
    for t in texts:
        t, row = (t or "").lower(), []
        for w in {w.lower() for w in words if w}:
            places = list(_places(t, w))
            if places:
                row.append((w, places[0], len(places)))
        out.append(sorted(row, key=lambda x: (x[1], x[0])))
    return out


def _places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)
