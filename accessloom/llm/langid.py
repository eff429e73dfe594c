"""Language of a text by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
RESULT = "lang_pred string, score double"
_SPACE, _OTHER, _FIRST = 0, 1, 2
#: Letters, the most frequent ones, whose transitions stand in a dense table; those of all others are sorted arcs.
_DENSE = 46
_CELLS = 1 << 21


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _points(text: str) -> np.ndarray:
    return _lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _folded(points: np.ndarray) -> np.ndarray:
    """Without repeated non-letters: each run of them is one space, none at the ends."""
    letter = points != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = points[keep]
    return out[:-1] if len(out) and out[-1] == 0 else out


def suffix_automaton(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """The automaton of all substrings of ``codes``: how many states it has, and its arcs as rows of state, letter, state.

    State 0 is kept free, state 1 is the start. Built letter by letter with suffix links, in time linear in the text.
    """
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes.tolist():
        current = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = current
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[current] = copy
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        last = current
    n = sum(map(len, nxt))
    state = np.repeat(np.arange(len(nxt), dtype=np.int32), [len(arcs) for arcs in nxt])
    letter = np.fromiter((c for arcs in nxt for c in arcs), np.int32, n)
    to = np.fromiter((t for arcs in nxt for t in arcs.values()), np.int32, n)
    return len(nxt), np.stack([state, letter, to], axis=1)


class Model:
    """Automata of all languages in one table that also says where a phrase ends.

    Entry (state, letter) is the next state while the phrase goes on; where the phrase must end it is minus the state
    that the letter leads to from the start, so one lookup does a step of the parse. Each language has a state from which
    every letter starts a phrase: a parse begins there, and a letter the reference lacks leads there.

    Every letter of the references counts. The space and the most frequent letters have columns of the table; the arcs
    of all others are found by binary search among (state, letter), those from the start among them.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = {k: _folded(_points(samples[k])) for k in self.languages}
        every = np.concatenate([x[x != 0] for x in folded.values()] or [np.zeros(0, np.uint32)])
        self.alphabet, count = np.unique(every, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.code = (rank + _FIRST).astype(np.int32)
        self.width = _FIRST + min(_DENSE, len(count))
        self.letters = _FIRST + len(count)
        tables, keys, targets, self.starts, base = [np.zeros((1, self.width), np.int32)], [], [], [], 1
        for name in self.languages:
            states, arcs = suffix_automaton(self.codes(folded[name]))
            state, letter, to = arcs.T
            dense = letter < self.width
            root = np.full(self.width, base, np.int32)
            first = dense & (state == 1)
            root[letter[first]] = to[first] + base
            table = np.repeat(-root[None, :], states, axis=0)
            table[state[dense], letter[dense]] = to[dense] + base
            tables.append(table)
            keys.append((state[~dense].astype(np.int64) + base) * self.letters + letter[~dense])
            targets.append(to[~dense] + base)
            self.starts.append(base)
            base += states
        self.table = np.concatenate(tables).ravel()
        key, target = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, targets))
        order = np.argsort(key)
        self.arc_key, self.arc_to = key[order], target[order].astype(np.int32)
        self.bits = np.log2([max(2, len(folded[k])) for k in self.languages]) if self.languages else np.zeros(0)

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        if not len(self.alphabet):
            return np.where(points == 0, _SPACE, _OTHER)
        return np.where(points == 0, _SPACE, np.where(self.alphabet[at] == points, self.code[at], _OTHER))

    def _arc(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The state that a sparse arc leads to, 0 where there is none."""
        key = state.astype(np.int64) * self.letters + letter
        at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
        return np.where(self.arc_key[at] == key, self.arc_to[at], 0)

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states, negative where a phrase ends; rows are languages, columns pieces."""
        rare = letter >= self.width
        if not rare.any():
            return self.table[state * np.int32(self.width) + letter]
        to = self.table[state * np.int32(self.width) + np.where(rare, np.int32(_OTHER), letter)]
        begin = np.array(self.starts, np.int32)[:, None]
        on = self._arc(state[:, rare], letter[rare][None, :])
        root = self._arc(np.broadcast_to(begin + 1, on.shape), letter[rare][None, :])
        to[:, rare] = np.where(on > 0, on, -np.where(root > 0, root, begin))
        return to

    def _phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece in each language; all pieces go forward together, the longest first."""
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        longest = len(pieces[order[0]])
        codes = np.zeros((longest, len(pieces)), np.int32)
        lengths = np.array([len(pieces[i]) for i in order])
        for column, i in enumerate(order):
            codes[:lengths[column], column] = pieces[i]
        active = len(pieces) - np.searchsorted(lengths[::-1], np.arange(longest), "right")
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(pieces), 1)
        count = np.zeros(state.shape, np.int32)
        for t in range(longest):
            n = active[t]
            to = self._step(state[:, :n], codes[t, :n])
            count[:, :n] += to < 0
            state[:, :n] = np.abs(to)
        out = np.empty((len(pieces), len(self.languages)))
        out[order] = count.T
        return out

    def classify(self, texts: list[str | None], piece: int = 512) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        pieces, owner = [], []
        held = 0

        def settle():
            nonlocal pieces, owner, held
            if not pieces:
                return
            rows, inverse = np.unique(owner, return_inverse=True)
            phrases = np.zeros((len(rows), len(self.languages)))
            np.add.at(phrases, inverse, self._phrases(pieces))
            size = np.bincount(inverse, [len(p) for p in pieces])
            entropy = phrases * self.bits[None, :] / size[:, None]
            ranked = np.argsort(entropy, axis=1, kind="stable")
            at = np.arange(len(rows))
            best = entropy[at, ranked[:, 0]]
            second = entropy[at, ranked[:, 1]] if len(self.languages) > 1 else np.full(len(rows), np.inf)
            for i, r in enumerate(rows):
                names[r] = self.languages[ranked[i, 0]]
            with np.errstate(invalid="ignore"):
                scores[rows] = np.where(np.isinf(second), 1.0, second / (best + second))
            pieces, owner, held = [], [], 0

        for i, text in enumerate(texts):
            points = _points(text) if text else np.zeros(0, np.uint32)
            if not points.any():
                continue
            codes = self.codes(_folded(points))
            for a in range(0, len(codes), piece):
                pieces.append(codes[a:a + piece])
                owner.append(i)
            held += len(codes)
            if held >= _CELLS:
                settle()
        settle()
        return names, scores


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int, chars: int) -> dict[str, str]:
    """At most ``texts`` texts per language, the first by a hash of the id, each cut at ``chars`` code points.

    The ranking reads ids and languages only; texts are fetched for the chosen rows. The bound on what reaches the
    driver is languages x texts x chars.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ids = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h"))
    chosen = ids.withColumn("r", rank).where(F.col("r") <= texts).select("id").distinct()
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, chars).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").where("lang is not null and text is not null").groupBy("lang", "id").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r.lang, r.id)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: " ".join(v) for k, v in out.items()}


def train(
        labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = 48,
        chars: int = 800, states: int = 600_000) -> dict[str, str]:
    """The reference text of each language. With many languages each gets less, so all automata have at most about
    ``states`` states (twice the letters) and fit a worker's memory."""
    sample = training_sample(labelled, id_col, text_col, lang_col, texts, chars)
    share = states // 2 // max(1, len(sample))
    return {k: v[:share] for k, v in sample.items() if _points(v).any()}


def predict(text: Column, samples: dict[str, str]) -> Column:
    """A struct of lang_pred and score for a text column.

    Only letters, lower-cased, and single spaces between them count; the whole text is parsed, a text of over 512 of
    them in consecutive pieces whose phrases are added. A phrase is the longest match from its place in a language's
    automaton. The language with the lowest phrases x log2(reference length) / text length wins; ties go to the
    first by name. score is second / (best + second), at least 0.5, or 1 where only one language is known. A null text or one
    without letters, or any text where no language is known, is ``und`` with score 0.
    """
    @F.pandas_udf(RESULT)
    def parsed(batch: pd.Series) -> pd.DataFrame:
        model = _loaded(tuple(sorted(samples.items())))
        names, scores = model.classify(batch.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return parsed(text)


@lru_cache(maxsize=2)
def _loaded(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))
