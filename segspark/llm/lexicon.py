"""Minimal acyclic transducer: a word list with id outputs in one block of bytes.

States share suffixes (incremental construction over sorted words). Each arc carries how many words
sort before those that go through it, so a walk sums up to the word's rank, and the rank addresses
its ids. The block is plain little-endian arrays and can be memory-mapped.
"""

from __future__ import annotations

import mmap
import tempfile
from array import array
from collections.abc import Iterable

_MAGIC = 0x4D41541


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Entries of distinct words -> the block. Memory is that of the automaton and the ids."""
    items = sorted(entries)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []  # (final, ((label, state), ...)) by state number

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the unfinished states of the last word
    last = b""
    for word, _ in items:
        if word == last and word:
            raise ValueError("words must be distinct")
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    root = settle(path[0])
    # A state is made after those that it points to, so counts follow in one pass.
    below: list[int] = []
    for final, arcs in nodes:
        below.append(final + sum(below[t] for _, t in arcs))
    first, final_flags, targets, before, labels = array("I", [0]), bytearray(), array("I"), array("I"), bytearray()
    for final, arcs in nodes:
        count = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            before.append(count)
            count += below[target]
        first.append(len(labels))
        final_flags.append(final)
    offsets, ids = array("I", [0]), array("I")
    for _, out in items:
        ids.extend(out)
        offsets.append(len(ids))
    head = array("I", [_MAGIC, root, len(nodes), len(labels), len(items), len(ids)])
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    return b"".join([head.tobytes(), first.tobytes(), targets.tobytes(), before.tobytes(), offsets.tobytes(), ids.tobytes(), pad(final_flags), pad(labels)])


class Lexicon:
    """A compiled block, mapped from an unlinked file; `find` gives a word's ids as little-endian bytes."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        head = view[:24].cast("I")
        if head[0] != _MAGIC:
            raise ValueError("not a lexicon")
        self.root, states, arcs, words, ids = head[1:6]
        at = 24

        def cut(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.first, self.targets, self.before, self.offsets = cut(states + 1), cut(arcs), cut(arcs), cut(words + 1)
        self.ids = view[at : at + 4 * ids]
        at += 4 * ids
        self.final = view[at : at + states]
        self.labels = at + states + (-states % 4)

    def find(self, word: bytes) -> bytes | None:
        state, rank = self.root, 0
        first, targets, before, labels, find = self.first, self.targets, self.before, self.labels, self.map.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            rank += before[arc]
            state = targets[arc]
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.offsets[rank] : 4 * self.offsets[rank + 1]])
