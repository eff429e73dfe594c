"""A multi-pattern automaton in arrays: which of many names occur in a text, by one pass over its characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: No pattern ends here, nor at any of its suffixes.
NONE = np.iinfo(np.int32).max
#: Characters of a text that are read as one piece.
PIECE = 4096


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Automaton:
    """Node i > 0 was reached from its parent by a letter, ``keys[i - 1]`` = parent x letters + letter; keys ascend, so a
    child is found by binary search. ``fail`` leads to the longest proper suffix that is a node; ``best`` is the least
    value of the patterns that end at a node or at one of these."""

    alphabet: np.ndarray
    keys: np.ndarray
    fail: np.ndarray
    best: np.ndarray
    longest: int

    @classmethod
    def of(cls, patterns: list[str], values: np.ndarray) -> Automaton:
        """Built level by level over all patterns at once. Empty patterns are not taken."""
        points = [points_of(p) for p in patterns]
        size = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        start = np.cumsum(size) - size
        alphabet = np.unique(flat)
        code = np.searchsorted(alphabet, flat) + 1
        letters = len(alphabet) + 1
        node, levels, keys, base = np.zeros(len(points), np.int64), [0, 1], [], 1
        for depth in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > depth)
            new, which = np.unique(node[on] * letters + code[start[on] + depth], return_inverse=True)
            node[on] = base + which
            keys.append(new)
            base += len(new)
            levels.append(base)
        out = cls(alphabet, np.concatenate(keys) if keys else np.zeros(0, np.int64), np.zeros(base, np.int32), np.full(base, NONE, np.int32),
                  int(size.max(initial=0)))
        np.minimum.at(out.best, node[size > 0], values[size > 0].astype(np.int32))
        for low, high in zip(levels[2:], levels[3:]):
            parent, letter = np.divmod(out.keys[low - 1:high - 1], letters)
            out.fail[low:high] = out.step(out.fail[parent], letter)
            out.best[low:high] = np.minimum(out.best[low:high], out.best[out.fail[low:high]])
        return out

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node a letter leads to, 0 where there is none."""
        wanted = node.astype(np.int64) * (len(self.alphabet) + 1) + letter
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at + 1, 0).astype(np.int32)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The longest node that ends with this letter, from the one before it."""
        node = np.array(node, np.int32)
        out = self.child(node, letter)
        todo = np.flatnonzero((out == 0) & (node > 0) & (letter > 0))
        while len(todo):
            node[todo] = self.fail[node[todo]]
            out[todo] = self.child(node[todo], letter[todo])
            todo = todo[(out[todo] == 0) & (node[todo] > 0)]
        return out

    def least(self, texts: list[str]) -> np.ndarray:
        """By text the least value of the patterns that occur in it, or NONE. All pieces go forward together; pieces of a
        long text overlap by one letter less than the longest pattern."""
        found = np.full(len(texts), NONE, np.int32)
        if not len(self.keys) or not texts:
            return found
        pieces, owner = [], []
        for i, text in enumerate(texts):
            points = points_of(text)
            for first in range(0, max(1, len(points)), PIECE):
                pieces.append(points[first:first + PIECE + self.longest - 1])
                owner.append(i)
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        size = np.array([len(pieces[i]) for i in order])
        letters = np.zeros((int(size[0]), len(pieces)), np.int64)
        for column, i in enumerate(order):
            at = np.minimum(np.searchsorted(self.alphabet, pieces[i]), len(self.alphabet) - 1)
            letters[:size[column], column] = np.where(self.alphabet[at] == pieces[i], at + 1, 0)
        active = len(pieces) - np.searchsorted(size[::-1], np.arange(len(letters)), "right")
        node, best = np.zeros(len(pieces), np.int32), np.full(len(pieces), NONE, np.int32)
        for t, n in enumerate(active):
            node[:n] = self.step(node[:n], letters[t, :n])
            np.minimum(best[:n], self.best[node[:n]], out=best[:n])
        np.minimum.at(found, np.array(owner)[order], best)
        return found
