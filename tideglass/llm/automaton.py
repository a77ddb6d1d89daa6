"""A minimal acyclic transducer from words to token ids, as one file to be mapped into memory.

Words that end alike share states. Each edge carries how many words leave its state
before it, so that the sum along a path numbers the words in their order; that number
gives the place of the word's ids. The edges are kept sorted by (state, byte).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TGLX0001"


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """Of distinct words in ascending order, the empty word left out, and their ids."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word, not yet shared
    last = b""

    def share(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = edges[state][byte]
            shape = (final[child], tuple(edges[child].items()))
            same = known.setdefault(shape, child)
            edges[state][byte] = same

    for word in words:
        if not word or (last and word <= last):
            raise ValueError("words must be distinct, not empty and in ascending order")
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        share(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    share(0)

    number: dict[int, int] = {}
    order = [0]
    for state in order:  # breadth first: only the states that are still reached
        if state not in number:
            number[state] = len(number)
            order.extend(edges[state].values())
    states = sorted(number, key=number.get)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        if todo := [c for c in edges[state].values() if c not in below]:
            stack += todo
        else:
            stack.pop()
            below[state] = final[state] + sum(below[c] for c in edges[state].values())
    keys, targets, before = [], [], []
    for state in states:
        n = int(final[state])
        for byte in sorted(edges[state]):
            child = edges[state][byte]
            keys.append(number[state] << 8 | byte)
            targets.append(number[child])
            before.append(n)
            n += below[child]
    at = np.cumsum([0, *(len(x) for x in outputs)])
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(before, np.int32), np.array([final[s] for s in states], np.int8),
        at.astype(np.int64), np.array([i for x in outputs for i in x], np.int32),
    ]
    blob = MAGIC + struct.pack("<6q", *(len(p) for p in parts))
    for p in parts:
        blob += b"\0" * (-len(blob) % 8) + p.tobytes()
    return blob


class Lexicon:
    """The file of ``build``, mapped; many words are looked up at once, byte after byte."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, mode="r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        sizes, at, parts = struct.unpack("<6q", bytes(raw[8:56])), 56, []
        for size, kind in zip(sizes, (np.int64, np.int32, np.int32, np.int8, np.int64, np.int32), strict=True):
            at += -at % 8
            parts.append(raw[at : at + size * np.dtype(kind).itemsize].view(kind))
            at += size * np.dtype(kind).itemsize
        self.keys, self.targets, self.before, self.final, self.at, self.ids = parts

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words that are not there."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        body = np.frombuffer(b"".join(words), np.uint8)
        state, number, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.flatnonzero(size > 0)
        dead = size == 0
        i = 0
        while len(live):
            key = state[live] << 8 | body[begin[live] + i]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            dead[live[~hit]] = True
            live, place = live[hit], place[hit]
            state[live] = self.targets[place]
            number[live] += self.before[place]
            i += 1
            live = live[size[live] > i]
        found = ~dead & (self.final[state] == 1)
        lo, hi = self.at[number * found], self.at[number * found + 1]
        return [self.ids[a:b].tolist() if ok else None for ok, a, b in zip(found.tolist(), lo.tolist(), hi.tolist(), strict=True)]
