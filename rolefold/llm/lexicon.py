"""A minimal acyclic transducer from words to id sequences, in one file that tasks memory-map.

States with equal futures are one state, so common endings are stored once. Each edge carries the number of words that
its earlier siblings lead to; the sum along a word's path is the word's number, and the number finds its ids. The file holds unsigned
32-bit numbers: a header (states, edges, words, ids), the key of each edge (256 * state + byte, ascending), the target of each edge, the words
skipped by each edge, the first id of each word, the ids; then the end mark of each state, a byte each.
"""

from __future__ import annotations

import mmap
import struct
from array import array

import numpy as np

LONGEST = 64     # bytes of a word in a lexicon at most


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes. Words come in sorted order, so a state is complete, and can be merged with an equal one, once a word leaves it."""
    ends: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    known: dict[tuple, int] = {}

    def settled(end: bool, out: list[tuple[int, int]]) -> int:
        key = (end, tuple(out))
        if key not in known:
            known[key] = len(ends)
            ends.append(end)
            edges.append(key[1])
        return known[key]

    words = sorted(entries)
    path: list[list] = [[False, []]]       # open states along the last word: end mark, settled edges
    last = b""
    for word in [*words, None]:
        shared = 0
        if word is not None:
            limit = min(len(last), len(word))
            while shared < limit and last[shared] == word[shared]:
                shared += 1
        for depth in range(len(path) - 1, shared, -1):
            end, out = path.pop()
            path[-1][1].append((last[depth - 1], settled(end, out)))
        if word is not None:
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
    root = settled(*path[0])
    words_from = [0] * len(ends)
    for state, out in enumerate(edges):    # targets are settled before the states that lead to them
        words_from[state] = ends[state] + sum(words_from[t] for _, t in out)
    # The root comes first, so that it needs no place in the header.
    number = {root: 0} | {s: s + (s < root) for s in range(len(ends)) if s != root}
    order = sorted(range(len(ends)), key=number.__getitem__)
    keys, target, skip = array("I"), array("I"), array("I")
    for state in order:
        before = int(ends[state])
        for byte, to in edges[state]:
            keys.append(256 * number[state] + byte)
            target.append(number[to])
            skip.append(before)
            before += words_from[to]
    starts, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        starts.append(len(ids))
    head = struct.pack("<4I", len(order), len(keys), len(words), len(ids))
    return head + b"".join(x.tobytes() for x in (keys, target, skip, starts, ids)) + bytes(ends[s] for s in order)


def byte_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, filled up with 0, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, sizes


class Lexicon:
    """A lexicon file mapped into memory; processes on one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids = struct.unpack_from("<4I", self._map)
        at, parts = 16, []
        for n in (edges, edges, edges, words + 1, ids):
            parts.append(np.frombuffer(self._map, "<u4", n, at))
            at += 4 * n
        self._keys, self._target, self._skip, self._starts, self._ids = parts
        self._ends = np.frombuffer(self._map, np.uint8, states, at)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 where the lexicon does not have one. All words walk through the automaton together, a byte a step."""
        out = np.full(len(words), -1)
        walking = np.array([k for k, w in enumerate(words) if len(w) <= LONGEST], np.int64)
        if not len(walking) or not len(self._keys):
            return out
        data, sizes = byte_matrix([words[k] for k in walking])
        state, number = np.zeros(len(walking), np.int64), np.zeros(len(walking), np.int64)
        alive = np.arange(len(walking))
        for step in range(data.shape[1] + 1):
            ended = sizes[alive] == step
            here = alive[ended]
            here = here[self._ends[state[here]] == 1]
            out[walking[here]] = number[here]
            alive = alive[~ended]
            if not len(alive):
                break
            key = state[alive] * 256 + data[alive, step]
            edge = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[edge] == key
            alive, edge = alive[known], edge[known]
            number[alive] += self._skip[edge]
            state[alive] = self._target[edge]
        return out

    def packed_ids(self, number: int) -> bytes:
        """The ids of a word's number, little-endian."""
        return self._ids[self._starts[number]:self._starts[number + 1]].tobytes()
