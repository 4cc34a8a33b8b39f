"""A minimal acyclic transducer from byte strings to lists of ids, in one flat file that is used where it lies.

Sorted words are added one after the other; as soon as no later word can pass a state it is exchanged for an equal one that is known
(equal: same finality, same arcs), so suffixes are shared and the automaton is minimal. An arc's output is the number of words that
leave its state before it; the outputs of a word's path add up to the word's rank, and the rank leads to its ids.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"VMAT"


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file for `words` (any order, distinct) with their ids."""
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
            sizes.append(node[0] + sum(sizes[t] for _, t in node[1]))
        return at

    path: list[list] = [[False, []]]
    last = b""
    for i in order:
        word = words[i]
        same = 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        for k in range(len(last), same, -1):
            path[k - 1][1].append((last[k - 1], settle(path.pop())))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1].append((last[k - 1], settle(path.pop())))
    root = settle(path.pop())

    n, finals = len(states), bytearray(final for final, _ in states)
    bits, base = np.zeros((n, 4), dtype=np.uint64), np.zeros((n, 4), dtype=np.int32)
    targets, outs = [], []
    for at, (final, arcs) in enumerate(states):
        gone = int(final)
        base[at] = len(targets)
        for label, target in arcs:  # labels ascend
            bits[at, label >> 6] |= np.uint64(1 << (label & 63))
            base[at, (label >> 6) + 1 :] += 1
            targets.append(target)
            outs.append(gone)
            gone += sizes[target]
    offsets = np.cumsum([0] + [len(ids[i]) for i in order])
    flat = [x for i in order for x in ids[i]]
    parts = [bits.tobytes(), *(np.asarray(x, dtype="<i4").tobytes() for x in (base, targets, outs, offsets, flat)), bytes(finals)]
    return MAGIC + struct.pack("<9i", root, *map(len, parts), 0) + b"".join(parts)


class Automaton:
    """Look-ups of many strings at once in a compiled file, given as a (memory-mapped) buffer; nothing of it is copied.

    A state's arcs are a bitmap of 256 labels; an arc's place is the state's base plus the number of smaller labels. All strings take a step
    at a time, in arrays.
    """

    def __init__(self, data: memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a transducer file")
        self.root, *sizes, _ = struct.unpack_from("<9i", data, 4)
        parts, at = [], 40
        for n, kind in zip(sizes, ("<u8", "<i4", "<i4", "<i4", "<i4", "<i4", "u1")):
            parts.append(np.frombuffer(data, dtype=kind, count=n // np.dtype(kind).itemsize, offset=at))
            at += n
        self.bits, self.base, self.targets, self.outs, self.offsets, self.ids, self.finals = parts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_states(self) -> int:
        return len(self.finals)

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have an arc with their label, and these arcs."""
        cell = (state << 2) + (label >> 6)
        word, bit = self.bits[cell], np.uint64(1) << (label & 63).astype(np.uint64)
        on = (word & bit) != 0
        return on, (self.base[cell] + np.bitwise_count(word & (bit - np.uint64(1))))[on]

    def ranks(self, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Rank of each string data[start : start + length] among the words; -1 for strings that are none."""
        out = np.full(len(starts), -1, dtype=np.int64)
        at, left = starts.astype(np.int64), lengths.astype(np.int64)
        row, state, rank = np.arange(len(starts)), np.full(len(starts), self.root, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        while len(row):
            done = left == 0
            if done.any():
                whole = done & (self.finals[state] == 1)
                out[row[whole]] = rank[whole]
                on = ~done
                row, at, left, state, rank = row[on], at[on], left[on], state[on], rank[on]
            on, arc = self.step(state, data[at])
            row, at, left, rank = row[on], at[on], left[on], rank[on]
            rank, state, at, left = rank + self.outs[arc], self.targets[arc].astype(np.int64), at + 1, left - 1
        return out

    def get(self, word: bytes) -> list[int] | None:
        """The ids of one word."""
        rank = int(self.ranks(np.zeros(1, dtype=np.int64), np.array([len(word)]), np.frombuffer(word, dtype=np.uint8))[0])
        return None if rank < 0 else self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
