"""Token counts and BPE encoding with the files of public tokenizers (operators 4 and 5).

Operator 4 counts the corpus's distinct pre-tokens, and the library counts the pieces of each of them once. That table is joined
to the pre-token frequencies of the documents: its most frequent part, of a bounded size, inside the task that reads a
document, the rest, a few percent of all words, by a shuffle on the pre-token. Sums of pieces come out; ids are never made into a column.

Operator 5 counts words over the whole corpus, compiles the most frequent into a minimal
acyclic transducer (``automaton``) that all workers of an executor map into memory, and merges the other words exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm import automaton
from tideglass.llm.words import chunks
from tideglass.session import cut, fresh, quoted, share

#: Distinct pre-tokens that a worker remembers before it forgets them all.
REMEMBERED = 300_000
#: Words in the transducer at most, and pre-tokens whose counts are sent to all tasks: the most frequent of the corpus, of up to LONGEST characters.
LEXICON, KNOWN, LONGEST = 50_000, 400_000, 64
#: White space as the tokenizers' patterns have it: the Unicode property White_Space.
WS = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BYTE_PATTERN = regex.compile(rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
WORD_PATTERN = regex.compile(rf"\p{{L}}+|'(?:s|t|re|ve|m|ll|d)|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
#: Characters of most texts: for these the standard library's patterns do, which are faster, and Python normalises as the tokenizers library does.
PLAIN = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC]


def _class(kind: str) -> str:
    """The plain characters of a Unicode category, for a character class."""
    return "".join(re.escape(chr(i)) for i in PLAIN if unicodedata.category(chr(i))[0] == kind)


_L, _N = _class("L"), _class("N")
PLAIN_BYTE = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{WS}{_L}{_N}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
PLAIN_WORD = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{WS}{_L}{_N}]+")
NOT_PLAIN = re.compile("[^" + "".join(re.escape(chr(i)) for i in PLAIN) + "]")


def byte_pre_tokens(text: str) -> list[str]:
    return (BYTE_PATTERN if NOT_PLAIN.search(text) else PLAIN_BYTE).findall(text)


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _specials(tok) -> tuple[dict[str, int], regex.Pattern | None]:
    """Special tokens that stand for themselves inside a text; the longest comes first."""
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    return added, regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None


class _Bags:
    """Texts to their pre-tokens and how often each stands there; special strings count apart."""

    def __init__(self, path: str):
        self.specials, self.special = _specials(_library(path))

    def of(self, text: str) -> tuple[Counter, int]:
        if not (self.special and any(s in text for s in self.specials)):
            return Counter(byte_pre_tokens(text)), 0
        bag: Counter = Counter()
        for between in self.special.split(text):
            bag.update(byte_pre_tokens(between))
        return bag, len(self.special.findall(text))


def _summed(bags: Iterator[list[str] | Counter], leave: set[str] | dict[str, int], name: str) -> Iterator[pa.RecordBatch]:
    """name, n: the bags added up, sent whenever there are REMEMBERED distinct ones."""
    bag: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = [w for w in bag if w not in leave]
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([bag[w] for w in some], pa.int64())], [name, "n"])

    for one in bags:
        bag.update(one)
        if len(bag) > REMEMBERED:
            yield from out()
            bag = Counter()
    yield from out()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            yield from (t for t in part.to_pylist() if t)


def pre_token_pieces(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """token, n, pieces: each distinct pre-token of the whole corpus once, how often it occurs, and how many pieces the library makes of it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = _Bags(path)
        yield from _summed((bags.of(t)[0] for t in _texts(batches)), set(), "token")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _library(path)
        for batch in batches:
            sizes = [len(e) for e in tok.encode_batch_fast(batch.column("token").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(sizes, pa.int32())], ["token", "n", "pieces"])

    counts = df.select(F.col(text)).mapInArrow(split, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(count, "token string, n long, pieces int")


def _most_frequent(counts: DataFrame, word: str, size: int) -> tuple[Column, Column]:
    """Conditions for the ``size`` most frequent words at most and for the others; ``counts`` (word, n) is read for a histogram, so that no task sends
    a list of candidates to the driver. Words with equal counts are in or out together; those that occur once are always out."""
    fits = (F.col("n") > 1) & (F.length(word) <= LONGEST)
    level = F.floor(F.log2("n") * 64).cast("int")
    room, least = size, None
    for r in counts.filter(fits).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    inside = F.lit(False) if least is None else fits & (level >= least)
    return inside, ~inside


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row.

    Null and empty texts have 0 of both; repeated rows count each for themselves; an empty table gives no rows. Special strings inside a text are one token each, no others are added.
    ``df`` is read twice and must give the same rows each time. ``path`` names a byte-level BPE file (.json) that is on every node.
    """
    table = cut(pre_token_pieces(df, path, text))
    inside, outside = _most_frequent(table, "token", known)
    sent = df.sparkSession.sparkContext.broadcast({r.token: r.pieces for r in table.filter(inside).select("token", "pieces").toLocalIterator()})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row one row with its size and the sum over the frequent pre-tokens, and one for each other pre-token in it."""
        bags, pieces, names = _Bags(path), sent.value, ["row", "token", "n", "known", "n_bytes", "key"]
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                rows, tokens, n, sums, sizes, keys = [], [], [], [], [], []
                for i, t in enumerate(part.to_pylist()):
                    bag, total = bags.of(t or "")
                    mine = len(rows)
                    rows.append(at)
                    for w, k in bag.items():
                        one = pieces.get(w)
                        if one is None:
                            rows.append(at)
                            tokens.append(w)
                            n.append(k)
                        else:
                            total += k * one
                    # (no pre-token holds a NUL and a digit, so that these meet nothing in the join and are spread over all tasks)
                    tokens.insert(mine, f"\0{at}")
                    n.insert(mine, 0)
                    sums += [total] + [0] * (len(rows) - mine - 1)
                    sizes += [len((t or "").encode())] + [None] * (len(rows) - mine - 1)
                    keys += [lo + i] + [None] * (len(rows) - mine - 1)
                    at += 1
                columns = pa.array(rows, pa.int64()), pa.array(tokens, pa.string()), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, batch.column("key").take(pa.array(keys, pa.int64()))], names)

    kind = df.schema[key].dataType.simpleString()
    each = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(frequencies, f"row long, token string, n long, known long, n_bytes long, key {kind}")
    joined = each.join(table.filter(outside).select("token", "pieces"), "token", "left")
    lost = (F.col("n") > 0) & F.col("pieces").isNull()
    pieces = F.when(lost, F.raise_error(F.lit("the table gave other rows when it was read again")).cast("long")).otherwise(F.col("n") * F.coalesce("pieces", F.lit(0)))
    sums = joined.groupBy("row").agg(F.max("n_bytes").alias("n_bytes"), (F.sum("known") + F.sum(pieces)).alias("n_tokens"), F.first("key", ignorenulls=True).alias("key"))
    return sums.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


# Operator 5

#: Lexicons that are with the executors of an application.
_sent: set[tuple[str, str]] = set()


class _Splitter:
    """Texts to pre-tokens of the word-level file: NFC, lower case, white space dropped."""

    def __init__(self, tok):
        self.tok = tok
        self.specials, self.special = _specials(tok)

    def words(self, text: str) -> list[str]:
        """Of a text without special strings."""
        if text.isascii():
            return PLAIN_WORD.findall(text.lower())
        if not NOT_PLAIN.search(text):
            return PLAIN_WORD.findall(unicodedata.normalize("NFC", text).lower())
        plain = self.tok.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(plain)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a special string comes as itself after a NUL."""
        if not any(s in text for s in self.specials):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self.words(text[at:])


def word_frequencies(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, n over the whole texts of all rows; each task sends a word once for each few megabytes at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _Splitter(_library(path))
        yield from _summed(map(splitter.split, _texts(batches)), {"\0" + s for s in splitter.specials}, "word")

    return df.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, path: str, size: int, text: str = "text") -> list[str]:
    """The most frequent words of the corpus, ``size`` at most; words that occur once are none of them."""
    counts = cut(word_frequencies(df, path, text).filter((F.col("n") > 1) & (F.length("word") <= LONGEST)))
    inside, _ = _most_frequent(counts, "word", size)
    return [r.word for r in counts.filter(inside).select("word").collect()]


def compile_lexicon(df: DataFrame, path: str, size: int = LEXICON, text: str = "text") -> str:
    """Compile the most frequent words with their ids and send the file to all executors; its name there."""
    top = frequent_words(df, path, size, text)
    tok = _library(path)
    words = sorted(w.encode() for w in top)
    encoded = tok.encode_batch([w.decode() for w in words], add_special_tokens=False) if words else []
    data = automaton.build(words, [e.ids for e in encoded])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, name) not in _sent:  # a name can be sent once, from one path
        share(df.sparkSession, name, data)
        _sent.add((sc.applicationId, name))
    return name


class _Encoder:
    """Pre-token to its ids and to its tokens, each as one string with spaces between."""

    def __init__(self, path: str, lexicon: str | None):
        self.tok = _library(path)
        self.splitter = _Splitter(self.tok)
        self.names = {i: s for s, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.lexicon = automaton.Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def put(self, word: str, ids: list[int]) -> None:
        self.ids[word] = " ".join(map(str, ids))
        self.tokens[word] = " ".join(map(self.names.__getitem__, ids))

    def learn(self, words: list[str]) -> None:
        """From the lexicon if it has them, else by merging."""
        found = self.lexicon.look_up([w.encode() for w in words]) if self.lexicon else [None] * len(words)
        merge = []
        for w, ids in zip(words, found, strict=True):
            if w[0] == "\0" and w[1:] in self.splitter.specials:
                self.put(w, [self.splitter.specials[w[1:]]])
            elif ids is not None:
                self.put(w, ids)
            else:
                merge.append(w)
        for w, e in zip(merge, self.tok.encode_batch_fast(merge, add_special_tokens=False), strict=True):
            self.put(w, e.ids)


def bpe_codec(path: str, lexicon: str | None, full: bool = False) -> object:
    """A function of a text column: struct of n_tokens, ids and decoded, or their SHA-256 unless ``full``.

    Null counts as empty. ids are decimal, with one space between; decoded is what decode(ids, skip_special_tokens=False) gives.
    """

    @F.arrow_udf("n_tokens long, ids string, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(path, lexicon)
        digest = (lambda s: s) if full else lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts in batches:
            n, ids, decoded = [], [], []
            for _, part in chunks(texts):
                split = [encoder.splitter.split(t) if t else [] for t in part.to_pylist()]
                if len(encoder.ids) > REMEMBERED:
                    encoder.ids.clear()
                    encoder.tokens.clear()
                new = set().union(*split).difference(encoder.ids)
                if new:
                    encoder.learn(list(new))
                for words in split:
                    i = " ".join(map(encoder.ids.__getitem__, words))
                    n.append(i.count(" ") + 1 if i else 0)
                    ids.append(digest(i))
                    decoded.append(digest(" ".join(map(encoder.tokens.__getitem__, words))))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids", "decoded"])

    return code


def encode_decode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", full: bool = False, keep: list[str] | None = None) -> DataFrame:
    """key, n_tokens and the ids and decoded text of each row (``full``) or their digests.

    Null and empty texts have no tokens and empty ids; repeated rows come each for themselves; an empty table gives no rows.
    """
    lexicon = compile_lexicon(df, path, text=text)
    names = ("ids", "decoded") if full else ("ids_sha256", "decoded_sha256")
    (held,) = fresh(df, "_coded")
    kept = [F.col(quoted(c)) for c in keep or [key]]
    coded = df.select(*kept, bpe_codec(path, lexicon, full)(F.coalesce(F.col(text), F.lit(""))).alias(held))
    return coded.select(*kept, *(F.col(held)[a].alias(b) for a, b in zip(("n_tokens", "ids", "decoded"), ("n_tokens", *names), strict=True)))
