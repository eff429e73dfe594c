"""Indel similarity: 100 * 2 * LCS / (|a| + |b|)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Pairs whose common subsequence is worked out at once.
_PAIRS = 4096


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by one dynamic-programming row per character of ``a``."""

    def next_row(previous: Column, ch: Column) -> Column:
        def extend(row: Column, j: Column) -> Column:
            diagonal = F.get(previous, j - 1) + F.when(F.substr(b, j, F.lit(1)) == ch, 1).otherwise(0)
            return F.concat(row, F.array(F.greatest(F.get(previous, j), F.get(row, j - 1), diagonal)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), extend)

    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    last = F.aggregate(_characters(a), zeros, next_row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(last, -1))


def ratio_from_distance(distance: Column, total_length: Column) -> Column:
    return (F.lit(1.0) - distance / total_length) * 100


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).otherwise(ratio_from_distance(total - 2 * lcs_length(a, b), total))


def maybe_at_least(a: Column, b: Column, threshold: int) -> Column:
    """False only where ``indel_ratio`` is surely below: the Levenshtein distance never exceeds the Indel distance."""
    allowed = F.floor((F.length(a) + F.length(b)) * (100 - threshold) / 100)
    return (F.abs(F.length(a) - F.length(b)) <= allowed) & (F.levenshtein(a, b) <= allowed)


def at_least(a: Column, b: Column, threshold: int) -> Column:
    """``indel_ratio >= threshold`` with cheap rejections first."""
    total = F.length(a) + F.length(b)
    verdict = F.when(a == b, True).when(maybe_at_least(a, b, threshold), 2 * lcs_length(a, b) * 100 >= total * threshold).otherwise(False)
    return F.when((a == "") | (b == ""), False).otherwise(verdict)


# ---- bit-parallel, for columns of pairs -----------------------------------------------------


def _points(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row per text, filled up, and how many each text has."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw], np.int64)
    out = np.full((len(raw), max(1, int(size.max(initial=0)))), fill, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint32)
    return out, size


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """The longest common subsequences of pairs, all pairs a character of ``right`` at a time.

    Bit i of a pair's words is 0 where the subsequence grows at character i of ``left``: a step takes the places that
    match the next character, adds them in and keeps what the carries leave, for 64 places of all pairs at once.
    """
    a, n = _points(left, 0xFFFFFFFF)
    b, _ = _points(right, 0xFFFFFFFE)
    words = -(-a.shape[1] // 64)
    a = np.pad(a, ((0, 0), (0, words * 64 - a.shape[1])), constant_values=0xFFFFFFFF)
    state = np.full((len(a), words), ~np.uint64(0))
    for t in range(b.shape[1]):
        match = np.packbits(a == b[:, t:t + 1], axis=1, bitorder="little").view("<u8")
        grow = state & match
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            some = state[:, w] + grow[:, w]
            total = some + carry
            carry = ((some < grow[:, w]) | (total < carry)).astype(np.uint64)
            state[:, w] = total | (state[:, w] & ~match[:, w])
    used = np.clip(n[:, None] - 64 * np.arange(words), 0, 64)
    mask = np.where(used == 64, ~np.uint64(0), (np.uint64(1) << used.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    return np.bitwise_count(~state & mask).sum(axis=1).astype(np.int64)


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], float)
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, (1.0 - (total - 2 * lcs_lengths(left, right)) / total) * 100, 100.0)


def with_ratio(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """The pairs whose ``indel_ratio`` of two text columns is at least ``threshold``, with it as column ratio."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double"

    def compare(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _PAIRS):
                rows = batch.slice(first, _PAIRS)
                ratio = indel_ratios(rows.column(a).to_pylist(), rows.column(b).to_pylist())
                near = ratio >= threshold - 1e-9
                if near.any():
                    kept = rows.filter(pa.array(near))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ratio[near])], names=[*kept.schema.names, "ratio"])

    return pairs.mapInArrow(compare, schema)
