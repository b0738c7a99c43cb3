"""A minimal acyclic transducer: words to ids through shared prefixes and shared suffixes.

Words are added in order; a state whose words are all known is replaced by an equal state seen before, so
the automaton is minimal at every step. An edge carries an output number, and the sum of the outputs along a
word is the word's place in sorted order, which addresses its ids. The whole is a few flat arrays in one file
that readers map into memory.
"""

from __future__ import annotations

import bisect
import mmap
import struct
from collections.abc import Sequence

MAGIC = b"FXLEX1\0\0"


class Builder:
    """Words must come sorted and distinct, as bytes."""

    def __init__(self) -> None:
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
        # The path of the word added last: final, the edges already frozen, and the label that leads on.
        self.path: list[list] = [[False, []]]
        self.last = b""

    def freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            final, edges = self.path.pop()
            state = (final, tuple(edges))
            if (at := self.known.get(state)) is None:
                at = self.known[state] = len(self.states)
                self.states.append(state)
            self.path[-1][1][-1] = (self.path[-1][1][-1][0], at)

    def add(self, word: bytes) -> None:
        if word <= self.last and (self.last or self.path[0][0]):
            raise ValueError("words must be sorted and distinct")
        same = 0
        for a, b in zip(word, self.last):
            if a != b:
                break
            same += 1
        self.freeze(same)
        for c in word[same:]:
            self.path[-1][1].append((c, -1))
            self.path.append([False, []])
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> int:
        self.freeze(0)
        self.states.append((self.path[0][0], tuple(self.path[0][1])))
        return len(self.states) - 1


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> bytes:
    """The file: header, first edge of each state, finality, then label, target and output of each edge, then where each word's ids begin, and the ids."""
    builder = Builder()
    order = sorted(words)
    for w in order:
        builder.add(w)
    root = builder.finish()
    below = [0] * len(builder.states)  # words that can be finished from a state
    first, final, labels, targets, outputs = [0], bytearray(), bytearray(), [], []
    for at, (ends, edges) in enumerate(builder.states):  # targets come before their sources
        total = int(ends)
        for c, to in edges:
            labels.append(c)
            targets.append(to)
            outputs.append(total)
            total += below[to]
        below[at] = total
        final.append(ends)
        first.append(len(labels))
    starts, ids = [0], []
    for w in order:
        ids += words[w]
        starts.append(len(ids))
    final += bytes(-len(final) % 4)
    edges_n = len(labels)
    labels += bytes(-len(labels) % 4)
    pack = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    return MAGIC + struct.pack("<6I", len(builder.states), edges_n, len(order), len(ids), root, 0) + pack(first) + bytes(final) + bytes(labels) + pack(targets) + pack(outputs) + pack(starts) + pack(ids)


class Lexicon:
    def __init__(self, buffer) -> None:
        view = memoryview(buffer)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        states, edges, self.words, ids, self.root, _ = struct.unpack_from("<6I", view, 8)
        at = 32

        def part(n: int, size: int) -> memoryview:
            nonlocal at
            out = view[at : at + n * size]
            at += n * size + (-(n * size) % 4)
            return out.cast("I") if size == 4 else out

        self.first, self.final, self.labels = part(states + 1, 4), part(states, 1), part(edges, 1)
        self.targets, self.outputs, self.starts, self.ids = part(edges, 4), part(edges, 4), part(self.words + 1, 4), part(ids, 4)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word; None if it isn't in the lexicon."""
        state, place, first, labels = self.root, 0, self.first, self.labels
        for c in word:
            end = first[state + 1]
            at = bisect.bisect_left(labels, c, first[state], end)
            if at == end or labels[at] != c:
                return None
            place += self.outputs[at]
            state = self.targets[at]
        if not self.final[state]:
            return None
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()
