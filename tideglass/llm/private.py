"""Personal data by patterns and bootstrapped contexts (operator 13).

Base: e-mail addresses, IP addresses, card numbers and phone numbers by their forms, with checks (parts of addresses, check digits, numbers of digits). These are the seeds.

Bootstrapping: whatever looks like an identifier and is no base span, numbers of seven digits and more in other notations, addresses with a spelled-out "at", addresses of IP version 6, is a candidate. The words around a
seed or a candidate make lexical patterns (two words before; one before and one after; three before). Patterns and values form a graph: an edge says that the
value stands in the pattern somewhere. In each round Spark scores the patterns of a kind by the share of known values of that kind among all values of that shape in it, less PRIOR, keeps those with SUPPORT known values and a score of
SURE or more, then scores the values by all kept patterns that they stand in (one minus the product of what each leaves open). Values that reach ACCEPT become known
and are seeds of the next round. What stays unknown counts against a pattern in each round, so that words that stand beside any number induce nothing.

Texts are read once and never shuffled. The graph has an edge for each different pair of a pattern and a value, made with partial aggregation, so that a value that stands in a third of all rows is one edge for each of
its contexts; patterns that are kept are few and joined by Spark's own choice. Every occurrence of a known value is a span, in whatever context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tideglass.llm.words import chunks
from tideglass.session import cut, fresh, quoted

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; known values that a pattern needs; what is added to its values; the scores from which patterns and values count.
ROUNDS, SUPPORT, PRIOR, SURE, ACCEPT = 4, 5, 1.0, 0.6, 0.8
#: Characters on each side that patterns are made of, and rows to send to all tasks at most.
CONTEXT, BROADCAST_ROWS = 64, 100_000

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# (a match of these begins where a stretch of digits begins, as it is leftmost and each takes its digits whole)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Candidates: addresses with another "at" or without a dot in the host, colons between hexadecimal digits, numbers with marks between their digits.
_CANDIDATE = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,64}+(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,64}+)*+| at [A-Za-z0-9-]{1,64}+(?: dot [A-Za-z0-9-]{1,64}+)++))"
    r"|(?P<colons>(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"
    r"|(?P<number>(?<![A-Za-z0-9_])\(?[0-9](?:[ ()./-]{0,2}[0-9]){5,40}+(?![A-Za-z0-9_]))"
)
_WORD = re.compile(r"[^\s]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of an address, one after the other. What stands before an @ is walked back once, and never into the match before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        end = host.end() if host else max(end, at + 1)
        if host:
            out.append((begin, end))
        at = text.find("@", end)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    sound = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(sound, m.group().split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points, by start and then the order of KINDS."""
    found = [(kind, *span) for kind, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for span in (find(text) if text else ())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _hash(kind: str, value: str) -> int:
    return int.from_bytes(blake2b(f"{kind}\x00{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _shapes(m: re.Match) -> tuple[str, ...]:
    """The kinds that a candidate may be of."""
    if m.lastgroup == "mail":
        return ("email",)
    if m.lastgroup == "colons":
        return ("ip",) if m.group().count(":") == 7 or "::" in m.group() else ()
    n = len(_DIGIT.findall(m.group()))
    return tuple(k for k, fits in (("card", 12 <= n <= 19), ("phone", 7 <= n <= 15)) if fits)


def normal(kind: str, value: str) -> str:
    """What two writings of one value have in common."""
    if kind in ("card", "phone"):
        return _NOT_DIGIT.sub("", value)
    return re.sub(r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?", "@", re.sub(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?", ".", value.lower()))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a span stands in: words beside it on its line, digits as 0; ^ and $ are the ends of the line."""
    tidy = lambda words: [_DIGIT.sub("0", w.lower()) for w in words]
    before = text[max(0, start - CONTEXT) : start]
    whole = start <= CONTEXT or "\n" in before
    before = tidy(_WORD.findall(before.rpartition("\n")[2]))
    # (a word that the window cuts is none)
    before = ["^", *before] if whole else before[1:]
    after = text[end : end + CONTEXT].partition("\n")[0]
    after = [*tidy(_WORD.findall(after))[:1], "$"][0]
    out = []
    if len(before) >= 2:
        out.append(f"2 {' '.join(before[-2:])}")
    if len(before) >= 3:
        out.append(f"3 {' '.join(before[-3:])}")
    if before:
        out.append(f"b {before[-1]} {after}")
    return out


def occurrences(text: str | None) -> list[tuple[str, int, int, bool, int, list[int]]]:
    """kind, start, end, whether it is a base span, hash of the value, hashes of its patterns. A candidate comes once for each kind that it may be of."""
    if not text:
        return []
    base = base_spans(text)
    out = []
    taken = sorted((s, e) for _, s, e in base)
    for kind, start, end in base:
        out.append((kind, start, end, True, _hash(kind, normal(kind, text[start:end])), [_hash("", p) for p in contexts(text, start, end)]))
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        i = at
        while i < len(taken) and taken[i][0] < end and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        kinds = _shapes(m)
        if kinds:
            patterns = [_hash("", p) for p in contexts(text, start, end)]
            out += [(kind, start, end, False, _hash(kind, normal(kind, m.group())), patterns) for kind in kinds]
    return out


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType()), StructField("value", LongType()), StructField("patterns", ArrayType(LongType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scanned(df: DataFrame, text: str, packed: str, found: str) -> DataFrame:
    """The other columns as one, and the occurrences of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "value", "patterns")
        for batch in batches:
            for lo, part in chunks(batch.column(1)):
                each = [[dict(zip(names, o, strict=True)) for o in occurrences(t)] for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(each, _ARROW)], [packed, found])

    return df.mapInArrow(work, StructType([StructField(packed, df.schema[packed].dataType), StructField(found, ArrayType(SPAN))]))


def known_values(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """kind, value of what is known beyond the base spans, from kind, value, base and patterns of all occurrences; None if there is nothing.

    Patterns and values score one another in rounds, each over the whole graph. A round ends with the written table of what is known so far.
    """
    edges = cut(spans.select("kind", "value", "base", F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("kind", "pattern", "value").agg(F.max("base").alias("base")))
    known = None
    for _ in range(rounds):
        of = edges.withColumn("known", F.col("base"))
        if known is not None:
            mark = known.select("kind", "value", F.lit(True).alias("new"))
            of = edges.join(_small(mark), ["kind", "value"], "left").withColumn("known", F.col("base") | F.coalesce("new", F.lit(False))).drop("new")
        counts = of.groupBy("kind", "pattern").agg(F.count_if("known").alias("yes"), F.count("*").alias("all"))
        # (a pattern whose values are known one and all has nothing to add)
        good = counts.select("kind", "pattern", "yes", "all", (F.col("yes") / (F.col("all") + PRIOR)).alias("score"))
        good = cut(good.filter((F.col("yes") >= SUPPORT) & (F.col("score") >= SURE) & (F.col("yes") < F.col("all"))).select("kind", "pattern", "score"))
        open_ = of.filter(~F.col("known")).join(_small(good), ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        # a value may be of several kinds: the best one holds, in doubt the first by name
        new = cut(open_.filter(F.col("score") >= ACCEPT).select("kind", "value"))
        if new.isEmpty():
            break
        known = new if known is None else cut(known.unionByName(new))
    return known


def _small(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it is a table of BROADCAST_ROWS at most, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(df: DataFrame, text: str = "text", spans: str = "spans", rounds: int = ROUNDS) -> DataFrame:
    """All columns of df but the text, with ``spans``: an array of kind, start, end (code points, end exclusive) and base, by start and then kind as in KINDS.

    Base spans are found leftmost for each kind, kinds may overlap; spans that the contexts add overlap no base span, and where a value may be of two kinds it is a card
    before it is a phone. Null and empty texts have none; repeated rows come each for themselves with equal spans and count once in the graph; an empty table gives no rows; columns of df may have any names (one that
    is named like the result is replaced). Very long texts are scanned whole, in time that grows with their length.
    """
    packed, found, row, body, none = fresh(df, "_packed", "_found", "_row", "_body", "_none")
    others = [c for c in df.columns if c not in (text, spans)]
    slim = df.select(F.struct(*(F.col(quoted(c)) for c in others), F.lit(None).cast("int").alias(none)).alias(packed), F.col(quoted(text)).alias(body))
    scanned = cut(_scanned(slim, body, packed, found).withColumn(row, F.monotonically_increasing_id()))
    each = scanned.select(row, F.explode(found).alias("o")).select(row, "o.*")
    known = known_values(each, rounds)
    if known is None:
        kept = F.filter(F.col(found), lambda o: o["base"])
        return scanned.select(*(F.col(packed)[c].alias(c) for c in others), _ordered(kept).alias(spans))
    added = each.filter(~F.col("base")).join(_small(known), ["kind", "value"], "left_semi").groupBy(row).agg(F.collect_list(F.struct("kind", "start", "end", "base", "value", "patterns")).alias("more"))
    both = scanned.join(added, row, "left")
    return both.select(*(F.col(packed)[c].alias(c) for c in others), _ordered(F.concat(F.filter(F.col(found), lambda o: o["base"]), F.coalesce("more", F.array().cast(ArrayType(SPAN))))).alias(spans))


def _ordered(spans: Column) -> Column:
    """Sorted, and of spans with the same place that aren't base spans the first kind only."""
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.array_sort(F.transform(spans, lambda o: F.struct(o["start"].alias("start"), F.array_position(order, o["kind"]).alias("n"), o["end"].alias("end"), o["kind"].alias("kind"), o["base"].alias("base"))))
    first = F.filter(keyed, lambda o, i: o["base"] | (i == 0) | (F.get(keyed, i - 1)["start"] != o["start"]) | (F.get(keyed, i - 1)["end"] != o["end"]))
    return F.transform(first, lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end"), o["base"].alias("base")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, with commas between them."""
    return F.array_join(F.transform(spans, lambda o: F.concat_ws(":", o["kind"], o["start"].cast("string"), o["end"].cast("string"))), ",")
