"""A minimal acyclic transducer: words to their ids, in a file that is memory-mapped.

Words that are equal from some byte on share those states. Each move carries a number, and the numbers along a word's
path add up to the word's place among all words; the ids of each place stand in one array. Moves are sorted by state and
byte, so many words are looked up at once, a byte of each at a time.

File: eight little-endian 64-bit numbers (mark, version, moves, states, words, ids, first state, 0), then the arrays
``moves`` (8 bytes: state * 256 + byte), ``targets``, ``outputs`` (4), ``ends`` (4, words + 1), ``ids`` (4), ``final`` (1).
"""

from __future__ import annotations

import mmap

import numpy as np

MARK, VERSION = 0x4C584E31, 1


def automaton(words: list[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final, moves as (byte, state)) of the least automaton that takes exactly ``words`` (sorted, distinct), and the first state.

    States come after those they lead to. What a word has beyond the next one's common beginning can change no more,
    so it is closed from its end on: a state equal to an earlier one becomes that one.
    """
    known: dict[tuple, int] = {}
    open_: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    before = b""

    def close(depth: int) -> None:
        while len(open_) > depth + 1:
            final, moves = open_.pop()
            state = known.setdefault((final[0], tuple(moves)), len(known))
            open_[-1][1].append((before[len(open_) - 1], state))

    for word in words:
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        close(same)
        open_.extend(([False], []) for _ in range(len(word) - same))
        open_[-1][0][0] = True
        before = word
    close(0)
    first = known.setdefault((open_[0][0][0], tuple(open_[0][1])), len(known))
    return list(known), first


def compiled(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file of distinct words and their ids."""
    entries = sorted(entries)
    states, first = automaton([w for w, _ in entries])
    counts: list[int] = []  # words that can follow from a state
    moves, targets, outputs = [], [], []
    for state, (final, out) in enumerate(states):
        n = int(final)
        for byte, to in out:
            moves.append(state << 8 | byte)
            targets.append(to)
            outputs.append(n)
            n += counts[to]
        counts.append(n)
    ids = [i for _, x in entries for i in x]
    head = np.array([MARK, VERSION, len(moves), len(states), len(entries), len(ids), first, 0], "<i8")
    arrays = [np.array(moves, "<i8"), np.array(targets, "<u4"), np.array(outputs, "<u4"), np.cumsum([0, *(len(x) for _, x in entries)]).astype("<u4"), np.array(ids, "<u4"), np.array([f for f, _ in states], "u1")]
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """A compiled file, mapped: workers of one machine share its pages."""

    def __init__(self, data):
        head = np.frombuffer(data, "<i8", 8).tolist()
        if head[:2] != [MARK, VERSION]:
            raise ValueError("not a lexicon of this version")
        _, _, moves, states, words, ids, self.first, _ = head
        at = 64
        self.moves, self.targets, self.outputs, self.ends, self.ids, self.final = (
            np.frombuffer(data, kind, n, at + before) for kind, n, before in (("<i8", moves, 0), ("<u4", moves, 8 * moves), ("<u4", moves, 12 * moves), ("<u4", words + 1, 16 * moves), ("<u4", ids, 16 * moves + 4 * words + 4), ("u1", states, 16 * moves + 4 * (words + 1 + ids)))
        )

    @classmethod
    def map(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the lexicon's words, -1 where it is none of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts, data = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        state, place = np.full(len(words), self.first, np.int64), np.zeros(len(words), np.int64)
        alive, lost, depth = np.flatnonzero(size > 0), np.zeros(len(words), bool), 0
        while len(alive) and len(self.moves):
            key = state[alive] << 8 | data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            ok = self.moves[at] == key
            lost[alive[~ok]] = True
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            place[alive] += self.outputs[at]
            depth += 1
            alive = alive[size[alive] > depth]
        lost[alive] = True  # of a lexicon without moves
        return np.where(~lost & (self.final[state] == 1), place, -1)
