"""Vectorised words, hashes and n-grams over Arrow string arrays.

Texts are looked at as one flat array of UTF-8 bytes. A word has two hashes of 64 bits, independent
of one another: its bytes go through a mixing step eight at a time, so that no two words collide for a structural
reason, as repetitive words do under polynomials modulo 2**64. Runs of words are polynomials over the words' hashes, taken
from prefix sums, so that an n-gram costs the same whatever its length; runs here are of at most a hundred words, too few for
such structure. Hashes depend on nothing but the bytes: equal words have equal hashes in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK = 2_000_000

#: Odd multipliers, so that they have inverses modulo 2**64.
BASES = {"word": 0xD6E8FEB86659FD93, "other": 0xC2B2AE3D27D4EB4F}
#: Start and factor of each of a word's two hashes; words from LONG_WORD bytes on are digested one by one.
SEEDS = ((U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD)), (U(0x2545F4914F6CDD1D), U(0xC4CEB9FE1A85EC53)))
LONG_WORD = 2048
#: Which bytes of eight belong to a word that has so many left.
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

#: [^\x20\x09-\x0D]+ as a table: True for the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of letters and digits; every byte of a non-ASCII character counts as a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A to Z as their small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    had = _powers.get(kind)
    if had is None or len(had[0]) < n:
        size = n if n > CHUNK else min(1 << (n - 1).bit_length(), CHUNK + 1)
        both = []
        for b in (BASES[kind], pow(BASES[kind], -1, 2**64)):
            steps = np.full(size, b, U)
            steps[0] = 1
            both.append(np.cumprod(steps))
        had = both[0], both[1]
        if size <= 4 * CHUNK:
            _powers[kind] = had
    return had[0][:n], had[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of up to ``most`` bytes each, one row at least."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large_string rows, and where each row begins, with the end; null is empty."""
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


class Words:
    """The words of some texts: where they begin and end, their hashes, and each text's first word."""

    def __init__(self, texts: pa.Array, between: np.ndarray = SPACE, fold: np.ndarray | None = None):
        body, at = flat(texts)
        if fold is not None:
            body = fold[body]
        self.body, self.at = body, at
        sep = between[body]
        first = np.ones(len(body), bool)
        first[1:] = sep[:-1]
        edge = at[(at > 0) & (at < len(body))]
        first[edge] = True
        last = np.ones(len(body), bool)
        last[:-1] = sep[1:]
        last[edge - 1] = True
        self.start = np.flatnonzero(first & ~sep)
        self.end = np.flatnonzero(last & ~sep) + 1
        self._eights = None
        self.hash = self._hashed(0)
        self._other = None
        self.first = np.searchsorted(self.start, at)

    @property
    def other(self) -> np.ndarray:
        """The words' second hashes."""
        if self._other is None:
            self._other = self._hashed(1)
        return self._other

    def _hashed(self, which: int) -> np.ndarray:
        seed, factor = SEEDS[which]
        size = self.end - self.start
        out = mix(seed ^ (size.astype(U) * factor))
        if self._eights is None:
            padded = np.zeros(len(self.body) + 8, np.uint8)
            padded[:-8] = self.body
            self._eights = np.ndarray((len(self.body) + 1,), np.uint64, padded, strides=(1,))
        live, step = np.flatnonzero(size < LONG_WORD), 0
        while len(live):
            left = size[live] - step
            block = self._eights[self.start[live] + step] & LOW_BYTES[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ block) * factor)
            step += 8
            live = live[left > 8]
        for i in np.flatnonzero(size >= LONG_WORD):
            digest = hashlib.blake2b(self.body[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        return out

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Spans:
    """Hashes of any run of words, from prefix sums."""

    def __init__(self, words: np.ndarray, kind: str = "word"):
        up, self.down = powers(kind, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the words lo..hi-1; runs of different lengths differ too."""
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U))


def grams(spans: Spans, n_words: int, n: int) -> np.ndarray:
    """The hash of the n words from each place on, also across texts; the caller drops those."""
    lo = np.arange(max(0, n_words - n + 1))
    return spans.of(lo, lo + n)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest of each ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, step = np.arange(len(values)), 1
    while step * 2 <= width:
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        step *= 2
    a, b = best[:n], best[width - step : width - step + n]
    return np.where(values[a] <= values[b], a, b)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
