"""N-gram Jaccard join by universe partition: hashed segments, pigeonhole, one-deletion neighbourhoods, exact checks.

Sets within one band of sizes that are similar enough differ in at most H shingles. Hashing deals the shingles of every
set to the same m segments; a segment matched exactly counts one unit, one matched up to one deletion counts two. With
more units than H, one segment must match. ``allocation`` chooses per band how many segments there are and how many of
them get one-deletion neighbourhoods, by the expected number of index entries, and leaves spare units: a set can
then do without its empty segments and without segments so common that listing their pairs would be quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from accessloom.llm import common
from accessloom.llm.common import mix
from accessloom.llm.components import components
from accessloom.session import PLAIN_SIZES, cut_lineage, released, under

#: A key that more different sets have is common: its pairs are not listed at once but found through some members.
COMMON = 8
#: Members of a common key that are compared with all its other members in one round.
HUBS = 4
#: Bits of a set's parity sketch: sets differ in at least as many shingles as their sketches in bits.
SKETCH = 512
#: A set with too many empty segments is dealt again with another hash, at most so often.
DEALS = 6
#: Entries that one of a single shared shingle counts for when segments are allocated, and shingles of a shared passage.
CROWDED, PASSAGE = 24, 50
#: Partners of one set that are compared in one stretch.
PER_STRETCH = 256
#: Sets of one component that are compared as one block, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_COLUMNS = 1 << 12
_FLUSH = 1 << 19
#: Entries that meet in one task; it holds about 17 bytes for each, and a few times that while it sorts them.
_PER_BUCKET = 2_000_000
_DELETED, _UPPER = 1, 2

SETS = "row_key long, doc_id long, n_shingles long, set_key long, sketch binary, n_entries long"
BLOBS = "bucket int, keys binary, sets binary, tags binary, schemes binary, lost binary"
CHECKED = "a long, b long, both long, n_a long, n_b long"
LINKS = "a long, b long, both long, n_a long, n_b long"
COUNTS = "set_key long, n long"
MET = "kind int, target int, a binary, b binary, c binary, d binary"


# ---- bands and allocation -------------------------------------------------------------------


def least_size(num: int, den: int) -> int:
    """The least size of a set that is similar enough to any other: one of s shingles to one of s + 1 at best."""
    return max(1, -(-num // max(1, den - num)))


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 48) -> list[int]:
    """Least sizes of the bands: a set's similar partners are in its own band or one beside it. No text has ``most`` words."""
    edges = [least_size(num, den)]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    return edges


def _poisson_tail(mean: float, bound: int) -> float:
    term = below = math.exp(-mean) if mean < 700 else 0.0
    for k in range(1, bound + 1):
        term *= mean / k
        below += term
    return max(0.0, 1 - below)


@lru_cache(maxsize=512)
def allocation(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, how many of them also match up to one deletion, spare units) of a band, at least cost.

    Cost is the expected number of entries per set, deals that must be repeated for empty segments included. An entry
    of a single shingle is as common as that shingle; where that is one of a passage that many texts share, it counts as
    CROWDED entries for the pairs it leads to. So short texts get fewer, fuller segments with one-deletion
    neighbourhoods, and long ones plain segments.
    """
    low, high = bands(num, den)[band], bands(num, den)[band + 1] - 1
    errors = (high + high * den // num) * (den - num) // (den + num)
    weight = CROWDED * min(1.0, 2 * PASSAGE / (low + high))
    best = None
    for deep in range(0, errors // 2 + 2, max(1, errors // 24)):
        for spare in range(-(-errors // 16), errors + 9, max(1, errors // 64)):
            m = errors + 1 + spare - deep
            if m < max(1, deep):
                continue
            load = low / m
            empty = math.exp(-load) if m > 1 else 0.0
            lost = (m - deep) * empty + deep * empty * (2 + load)
            again = _poisson_tail(lost, spare)
            if spare < lost + errors / 16 or again > 0.3:
                continue
            mean = (low + high) / 2 / m
            single, double = mean * math.exp(-mean), mean ** 2 / 2 * math.exp(-mean)
            cost = (m + deep * mean + weight * (m * single + deep * 2 * double)) / (1 - again)
            if best is None or cost < best[0]:
                best = (cost, m, deep, spare)
            break
    half = -(-(errors + 1) // 2)
    return best[1:] if best else (half, half, 0)


# ---- entries of a set -----------------------------------------------------------------------


def entries(tokens: np.ndarray, band: int, deal: int, m: int, deep: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys, tags and lost units of one set: per non-empty segment the hash of what it holds, per deep segment also
    those of what it holds without one. tags: whether one was deleted, and in bits 2 and 3 the units a key stands for."""
    salt = mix(np.uint64([band * DEALS + deal + 1]))[0]
    value = mix(tokens ^ salt)
    segment = ((value >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    value = mix(value + salt)
    count = np.bincount(segment, minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, value)
    marks = mix(np.arange(m, dtype=np.uint64) + salt)
    full = np.flatnonzero(count)
    keys, tags = [mix(total[full] ^ marks[full])], [np.where(full < deep, 8, 4).astype(np.uint8)]
    if deep:
        one = np.flatnonzero((segment < deep) & (count[segment] > 1))
        at = segment[one]
        keys.append(mix((total[at] - value[one]) ^ marks[at]))
        tags.append(np.full(len(one), 4 | _DELETED, np.uint8))
    shallow, deeper = count[deep:], count[:deep]
    lost = int((shallow == 0).sum() + 2 * (deeper == 0).sum() + (deeper == 1).sum())
    return np.concatenate(keys), np.concatenate(tags), lost


def set_entries(tokens: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Keys, tags, scheme and lost units of a set in the schemes of its own band and of the band below."""
    if len(tokens) < least_size(num, den):
        return
    own = int(np.searchsorted(bands(num, den), len(tokens), "right")) - 1
    for band in (own, own - 1) if own else (own,):
        m, deep, spare = allocation(band, num, den)
        upper = np.uint8(_UPPER if band < own else 0)
        for deal in range(DEALS):
            keys, tags, lost = entries(tokens, band, deal, m, deep)
            yield keys, tags | upper, band * (DEALS + 1) + deal, lost
            if lost <= spare:
                break
        else:
            yield mix(np.uint64([band + 1 << 40])), np.uint8([4]) | upper, band * (DEALS + 1) + DEALS, 0


def expected_entries(n: int, num: int, den: int) -> int:
    """About how many entries a set of n shingles has."""
    if n < least_size(num, den):
        return 0
    own = int(np.searchsorted(bands(num, den), n, "right")) - 1
    total = 0
    for band in (own, own - 1) if own else (own,):
        m, deep, _ = allocation(band, num, den)
        total += min(m, n) + int(deep * n / m)
    return total


def spare_units(scheme: np.ndarray, num: int, den: int) -> np.ndarray:
    """By scheme: lost units beyond which a set counts on common keys too; below 0 where nothing can be lost."""
    out = np.zeros(len(scheme), np.int64)
    for s in np.unique(scheme):
        band, deal = divmod(int(s), DEALS + 1)
        out[scheme == s] = -1 if deal == DEALS else allocation(band, num, den)[2]
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """For each bit, whether an odd number of shingles hash to it."""
    odd = np.bincount((mix(tokens + np.uint64(77)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(n: np.ndarray, bits: np.ndarray, m: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and sketches (rows of 64-bit words) leave it open that sets are similar; never false for those that are."""
    apart = np.bitwise_count(bits ^ other).sum(axis=-1)
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))


def set_key(tokens: np.ndarray) -> int:
    """Names a set by all its shingles."""
    if not len(tokens):
        return 0
    total = np.add.reduce(mix(tokens + np.uint64(0x51ED270B)), dtype=np.uint64)
    return int(mix(np.uint64([total ^ np.uint64(len(tokens))])).view(np.int64)[0])


# ---- tasks ----------------------------------------------------------------------------------


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _dealt(target: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """For each target its number and its part of each array as bytes."""
    order = np.argsort(target, kind="stable")
    target, arrays = target[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.diff(target)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(target)]):
        if b > a:
            yield int(target[a]), *(x[a:b].tobytes() for x in arrays)


def _pairs_unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new &= low != high
    return low[new], high[new]


def _pair_target(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return (mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) % np.uint64(n)).astype(np.int32)


def _measured(size: int, num: int, den: int):
    """Rows of SETS from batches of row_key, doc_id and text."""
    def measure(batches):
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for _, data, offsets in common.text_blocks(batch.column(2)):
                for tokens in common.shingle_sets(data, offsets, size):
                    sizes.append(len(tokens))
                    keys.append(set_key(tokens))
                    sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array([expected_entries(n, num, den) for n in sizes], pa.int64())],
                names=[c.split()[0] for c in SETS.split(", ")])
    return measure


def _indexed(size: int, num: int, den: int, buckets: int):
    """Entries of batches of texts, dealt to buckets by key; equal sets of one stretch are entered once."""
    def index(batches):
        held, seen, n = [], set(), 0

        def flush():
            keys = np.concatenate([h[0] for h in held])
            lengths = [len(h[0]) for h in held]
            sets = np.repeat(np.array([h[4] for h in held], np.int64), lengths)
            schemes = np.repeat(np.array([h[2] for h in held], np.uint16), lengths)
            lost = np.repeat(np.minimum([h[3] for h in held], 65535).astype(np.uint16), lengths)
            tags = np.concatenate([h[1] for h in held])
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            short = (keys >> np.uint64(32)).astype(np.uint32)
            return _batch(BLOBS, list(zip(*_dealt(bucket, short, sets, tags, schemes, lost))))

        for batch in batches:
            for _, data, offsets in common.text_blocks(batch.column(0)):
                for tokens in common.shingle_sets(data, offsets, size):
                    name = set_key(tokens)
                    if len(tokens) < least_size(num, den) or name in seen:
                        continue
                    seen.add(name)
                    for found in set_entries(tokens, num, den):
                        held.append((*found, name))
                        n += len(found[0])
                    if n >= _FLUSH:
                        yield flush()
                        held, n = [], 0
                        seen.clear()
        if held:
            yield flush()
    return index


def _columns(batches, kinds: list, first: int = 1) -> list[np.ndarray]:
    """The blobs of all batches, joined by column; the columns before ``first`` are not blobs."""
    parts = [[] for _ in kinds]
    for batch in batches:
        for k in range(len(kinds)):
            parts[k] += [np.frombuffer(x, kinds[k]) for x in batch.column(first + k).to_pylist()]
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, kinds)]


def _grouped_pairs(key: np.ndarray, sets: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that share a key that is not common, and which rows have a common one. Rows come sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(2, COMMON + 1):
        first = starts[sizes == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, _FLUSH // len(i))
        for a in range(0, len(first), step):
            rows = first[a:a + step, None] + np.arange(s)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            apart = (tags[x] & tags[y] & (_DELETED | _UPPER)) == 0
            p, q = _pairs_unique(sets[x[apart]], sets[y[apart]])
            left.append(p)
            right.append(q)
    a, b = _pairs_unique(np.concatenate(left), np.concatenate(right))
    return a, b, np.repeat(sizes > COMMON, sizes)


def _met(buckets: int):
    """Of one bucket: pairs of sets that share a key (kind 0), and entries with common keys (kind 1)."""
    def meet(batches):
        bucket, kept = 0, []
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column(0)[0].as_py()
                kept.append(batch)
        key, sets, tags, schemes, lost = _columns(kept, [np.uint32, np.int64, np.uint8, np.uint16, np.uint16])
        kept.clear()
        order = np.lexsort((tags & _DELETED, sets, key))
        key, sets, tags, schemes, lost = (x[order] for x in (key, sets, tags, schemes, lost))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
        key, sets, tags, schemes, lost = (x[new] for x in (key, sets, tags, schemes, lost))
        a, b, common_ = _grouped_pairs(key, sets, tags)
        rows = [(0, t, x, y, b"", b"") for t, x, y in _dealt(_pair_target(a, b, buckets), a, b)]
        if common_.any():
            full = (key[common_].astype(np.int64) << 24) | bucket
            s = sets[common_]
            target = _key_target(s, buckets)
            what = schemes[common_].astype(np.int64) << 32 | lost[common_].astype(np.int64) << 8 | (tags[common_] >> 2)
            rows += [(1, t, x, y, z, b"") for t, x, y, z in _dealt(target, s, full, what)]
        if rows:
            yield _batch(MET, list(zip(*rows)))
    return meet


def _split(batches) -> dict[int, list[pa.RecordBatch]]:
    """Batches by kind; a batch of several kinds is cut."""
    out: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        kinds = np.asarray(batch.column(0))
        for k in np.unique(kinds):
            out.setdefault(int(k), []).append(batch.filter(pa.array(kinds == k)))
    return out


def _found(names: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """The value of each asked name, or the entry of ``missing``."""
    if not len(names):
        return missing
    order = np.argsort(names)
    at = order[np.minimum(np.searchsorted(names, asked, sorter=order), len(names) - 1)]
    return np.where(names[at] == asked, values[at], missing)


def _key_target(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _uncovered(num: int, den: int, buckets: int):
    """By set: the common keys of sets that lose more units to them than they can spare, with the set's root (kind 2).
    Takes entries (kind 1) and roots so far (kind 3)."""
    def choose(batches):
        parts = _split(batches)
        sets, key, what = _columns(parts.get(1, []), [np.int64] * 3, 2)
        names, roots = _columns(parts.get(3, []), [np.int64] * 2, 2)
        scheme, lost, units = what >> 32, (what >> 8) & 0xFFFF, what & 0xFF
        order = np.lexsort((scheme, sets))
        sets, key, scheme, lost, units = (x[order] for x in (sets, key, scheme, lost, units))
        if not len(sets):
            return
        starts = np.flatnonzero(np.concatenate([[True], (sets[1:] != sets[:-1]) | (scheme[1:] != scheme[:-1])]))
        gone = np.add.reduceat(units, starts) + lost[starts]
        open_ = np.repeat(gone > spare_units(scheme[starts], num, den), np.diff(np.append(starts, len(sets))))
        key, sets = key[open_], sets[open_]
        root = _found(names, roots, sets, sets)
        rows = [(2, t, x, y, z, b"") for t, x, y, z in _dealt(_key_target(key, buckets), key, sets, root)]
        if rows:
            yield _batch(MET, list(zip(*rows)))
    return choose


def _groups(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Common keys whose members (set and root, by set) have more than one root."""
    key, sets, root = _columns(batches, [np.int64] * 3, 2)
    order = np.lexsort((sets, key))
    key, sets, root = key[order], sets[order], root[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
    key, sets, root = key[new], sets[new], root[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    for a, b in zip(starts, [*starts[1:], len(key)]):
        if (root[a:b] != root[a]).any():
            yield int(key[a]), sets[a:b], root[a:b]


def _through_hubs(hubs: int, buckets: int):
    """Of each key: pairs of the first member of each of some roots with all members of other roots (kind 0)."""
    def pair(batches):
        left, right = [], []
        for _, sets, root in _groups(batches):
            _, first = np.unique(root, return_index=True)
            for at in np.sort(first)[:hubs]:
                others = sets[root != root[at]]
                left.append(np.full(len(others), sets[at]))
                right.append(others)
        if left:
            p, q = _pairs_unique(np.concatenate(left), np.concatenate(right))
            yield _batch(MET, list(zip(*[(0, t, x, y, b"", b"") for t, x, y in _dealt(_pair_target(p, q, buckets), p, q)])))
    return pair


def _mixed(buckets: int):
    """Of keys whose members still have several roots: key and root by set (kind 4)."""
    def keep(batches):
        parts = [(np.full(len(sets), key), sets, root) for key, sets, root in _groups(batches)]
        if parts:
            key, sets, root = (np.concatenate(x) for x in zip(*parts))
            rows = [(4, t, x, y, z, b"") for t, x, y, z in _dealt(_key_target(sets, buckets), sets, key, root)]
            yield _batch(MET, list(zip(*rows)))
    return keep


def _sketched(buckets: int):
    """Adds to rows by set (kind 4) size and sketch (from kind 3): key, set, root, sketch with size, by key (kind 5)."""
    words = SKETCH // 64

    def add(batches):
        parts = _split(batches)
        sets, key, root = _columns(parts.get(4, []), [np.int64] * 3, 2)
        if not len(sets):
            return
        names, info = _columns(parts.get(3, []), [np.int64, np.int64], 2)[0], _columns(parts.get(3, []), [np.int64], 4)[0]
        info = info.reshape(-1, words + 1)
        at = _found(names, np.arange(len(names)), sets, np.full(len(sets), -1))
        rows = [(5, t, x, y, z, w) for t, x, y, z, w in _dealt(_key_target(key, buckets), key, sets, root, info[at])]
        yield _batch(MET, list(zip(*rows)))
    return add


def _crossed(num: int, den: int, buckets: int):
    """Of each key: all pairs of members of different roots whose sizes and sketches leave a link open (kind 0)."""
    words = SKETCH // 64

    def cross(batches):
        key, sets, root, info = _columns(batches, [np.int64] * 4, 2)
        info = info.reshape(-1, words + 1)
        order = np.lexsort((sets, key))
        key, sets, root, info = key[order], sets[order], root[order], info[order]
        n, bits = info[:, 0], info[:, 1:].view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(starts, [*starts[1:], len(key)]):
            for i in range(a, b - 1):
                rest = i + 1 + np.flatnonzero(root[i + 1:b] != root[i])
                rest = rest[may_link(n[i], bits[i], n[rest], bits[rest], num, den)]
                left.append(np.full(len(rest), sets[i]))
                right.append(sets[rest])
        p, q = _pairs_unique(np.concatenate(left), np.concatenate(right))
        rows = [(0, t, x, y, b"", b"") for t, x, y in _dealt(_pair_target(p, q, buckets), p, q)]
        if rows:
            yield _batch(MET, list(zip(*rows)))
    return cross


def _sieved(num: int, den: int):
    """Pairs (a, b, n_a, sketch_a, n_b, sketch_b) that sizes and sketches leave open."""
    def sieve(batches):
        for batch in batches:
            n, m = (np.asarray(batch.column(k)) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(n), -1) for k in (3, 5))
            yield batch.select([0, 1]).filter(pa.array(may_link(n, x, m, y, num, den)))
    return sieve


def _told(buckets: int):
    """Root, size and sketch of each set as blobs by set (kind 3)."""
    def tell(batches):
        for batch in batches:
            sets, root, n = (np.asarray(batch.column(k)).astype(np.int64) for k in range(3))
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(len(sets), -1)
            info = np.concatenate([n[:, None], bits], axis=1)
            rows = [(3, t, x, y, z, b"") for t, x, y, z in _dealt(_key_target(sets, buckets), sets, root, info)]
            if rows:
                yield _batch(MET, list(zip(*rows)))
    return tell


def _listed(batches):
    a, b = _columns(batches, [np.int64] * 2, 2)
    a, b = _pairs_unique(a, b)
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i:i + (1 << 16)]), pa.array(b[i:i + (1 << 16)])], names=["a", "b"])


def _compared(size: int):
    """Exact counts of pairs from rows of hub, salt, member, set_key and text, each hub's own row before its members.

    Holds the set of one hub and those of one block of texts."""
    def compare(batches):
        hub = own = None
        for batch in batches:
            hubs, members, keys = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for first, data, offsets in common.text_blocks(batch.column(4)):
                rows = []
                for at, tokens in enumerate(common.shingle_sets(data, offsets, size), first):
                    if not members[at]:
                        hub, own = hubs[at], tokens
                        continue
                    if hub != hubs[at]:
                        raise RuntimeError(f"set {hubs[at]} is missing before its partners")
                    place = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    rows.append((hub, keys[at], int((own[place] == tokens).sum()), len(own), len(tokens)))
                if rows:
                    yield _batch(CHECKED, list(zip(*rows)))
    return compare


def shared(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``own`` has in common with each of ``other``."""
    sides = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (own, other)]
    both = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    places = []
    for sets, tokens in zip((own, other), sides):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.minimum(np.searchsorted(both, tokens), max(0, len(both) - 1))
        kept = both[column] == tokens if len(both) else np.zeros(len(tokens), bool)
        order = np.argsort(column[kept], kind="stable")
        places.append((row[kept][order], column[kept][order]))
    out = np.zeros((len(own), len(other)))
    for first in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - first)
        parts = []
        for sets, (row, column) in zip((own, other), places):
            a, b = np.searchsorted(column, (first, first + width))
            part = np.zeros((len(sets), width), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _linked(size: int, num: int, den: int, counted: bool):
    """Of each pair of blocks (rows of pair, side, set_key, text, sorted by pair): its links, or links by set.

    A block that is paired with itself has rows of one side. Holds the sets of two blocks."""
    def compare(sides):
        names = [np.array([k for k, _ in side], np.int64) for side in sides]
        sets = [[x for _, x in side] for side in sides]
        alone = not sets[1]
        if alone:
            names[1], sets[1] = names[0], sets[0]
        n, m = (np.array([len(x) for x in side], np.int64) for side in sets)
        both = shared(*sets)
        right = both * den >= (n[:, None] + m[None, :] - both) * num
        if alone:
            right &= np.triu(np.ones(right.shape, bool), 1)
        if counted:
            if alone:
                rows = [(names[0], right.sum(axis=1) + right.sum(axis=0))]
            else:
                rows = [(names[0], right.sum(axis=1)), (names[1], right.sum(axis=0))]
            key, count = (np.concatenate(x) for x in zip(*rows))
            return _batch(COUNTS, [key[count > 0], count[count > 0]])
        i, j = np.nonzero(right)
        a, b = names[0][i], names[1][j]
        swap = a > b
        return _batch(LINKS, [np.where(swap, b, a), np.where(swap, a, b), both[i, j], np.where(swap, m[j], n[i]), np.where(swap, n[i], m[j])])

    def link(batches):
        pair, sides = None, ([], [])
        for batch in batches:
            pairs, side, keys = (batch.column(k).to_pylist() for k in range(3))
            for first, data, offsets in common.text_blocks(batch.column(3)):
                for at, tokens in enumerate(common.shingle_sets(data, offsets, size), first):
                    if pairs[at] != pair:
                        if sides[0]:
                            yield compare(sides)
                        pair, sides = pairs[at], ([], [])
                    sides[side[at]].append((keys[at], tokens))
        if sides[0]:
            yield compare(sides)
    return link


# ---- the join -------------------------------------------------------------------------------


class _Join:
    def __init__(self, docs, id_col, text_col, size, num, den):
        self.size, self.num, self.den = size, num, den
        self.docs = docs.select(
            common.row_key(id_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("string").alias("text"))
        self.sets = cut_lineage(self.docs.mapInArrow(_measured(size, num, den), SETS))
        total = self.sets.agg(F.sum("n_entries")).first()[0] or 0
        self.classes = cut_lineage(self.sets.where(F.col("n_shingles") >= least_size(num, den)).groupBy("set_key").agg(
            F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")))
        # As few as memory allows: the fewer there are, the more entries of one set stand together and are sent as one.
        self.buckets = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-total // _PER_BUCKET))

    def met(self) -> DataFrame:
        found = self.docs.select("text").mapInArrow(_indexed(self.size, self.num, self.den, self.buckets), BLOBS)
        return cut_lineage(found.repartitionById(self.buckets, F.col("bucket")).mapInArrow(_met(self.buckets), MET))

    def dealt(self, rows: DataFrame, task, schema: str = MET) -> DataFrame:
        return rows.repartitionById(self.buckets, F.col("target")).mapInArrow(task, schema)

    @released
    def pairs(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs (a, b), once each, that sizes and sketches leave open."""
        listed = cut_lineage(self.dealt(rows.where("kind = 0"), _listed, "a long, b long"))
        one = self.classes.select("set_key", "n_shingles", "sketch")
        both = listed.join(one.toDF("a", "n_a", "x"), "a").join(one.toDF("b", "n_b", "y"), "b").select("a", "b", "n_a", "x", "n_b", "y")
        return both.mapInArrow(_sieved(self.num, self.den), "a long, b long")

    def fetch(self, pairs: DataFrame, groups: DataFrame) -> None:
        """Stores one text of every set that is in a candidate pair or in a group, by a single scan of the documents."""
        def members(batches):
            (sets,) = _columns(batches, [np.int64], 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(sets))], names=["set_key"])

        named = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(groups.mapInArrow(members, "set_key long"))
        chosen = cut_lineage(self.sets.join(named.distinct(), "set_key", "left_semi").groupBy("set_key").agg(
            F.min("row_key").alias("row_key")))
        keys = common.membership(chosen, F.col("row_key"))
        texts = common.with_membership(self.docs, F.col("row_key"), keys, "open").where("open").select("row_key", "text")
        # Read until the join is done, so they outlive the step that stores them.
        self.texts = cut_lineage(texts.dropDuplicates(["row_key"]).join(chosen, "row_key").select("set_key", "text"), True)
        self.classes = cut_lineage(self.classes.join(self.texts.select("set_key"), "set_key", "left_semi"), True)

    @released
    def checked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with exact counts.

        Partners meet at their lesser set, whose text is sent once to each stretch of at most PER_STRETCH partners.
        """
        stretches = F.ceil(F.col("n") / PER_STRETCH).cast("int")
        hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", stretches.alias("n"))
        spread = F.pmod(F.xxhash64("b"), F.col("n")).cast("int")
        wanted = cut_lineage(pairs.join(hubs, "a").select(
            F.col("b").alias("set_key"), F.col("a").alias("hub"), spread.alias("salt"), F.lit(1).alias("member")).unionByName(hubs.select(
                F.col("a").alias("set_key"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"),
                F.lit(0).alias("member"))))
        keys = common.membership(wanted, F.col("set_key"))
        texts = common.with_membership(self.texts, F.col("set_key"), keys, "open").where("open")
        rows = wanted.join(texts, "set_key").select("hub", "salt", "member", "set_key", "text")
        placed = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
        return placed.mapInArrow(_compared(self.size), CHECKED)

    @released
    def settled(self, pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """(node, root) of all linked sets, from roots so far and candidate pairs.

        First every set is checked against the least of its partners, then one pair of every two components that
        candidates still connect; pairs that links have joined by then need no check.
        """
        roots, now = known, cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        for turn in range(3):
            roots = self.joined(roots, now)
            if turn == 2:
                break
            a, b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
            rest = pairs.join(now, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").select(
                "a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
            rest = cut_lineage(rest.where("x <> y").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
            if rest.isEmpty():
                break
            pairs = rest.select("a", "b")
            now = pairs if turn else cut_lineage(
                rest.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
        return roots

    @released
    def joined(self, known: DataFrame | None, pairs: DataFrame) -> DataFrame:
        union = F.col("n_a") + F.col("n_b") - F.col("both")
        links = self.checked(pairs).where(F.col("both") * self.den >= union * self.num).select("a", "b")
        return components(links if known is None else links.unionByName(known.toDF("a", "b")))

    @released
    def roots(self, rounds: int = 1) -> DataFrame:
        """(node, root) of every set that is linked with a lesser one.

        Pairs that share a key that is not common are all candidates. Sets that may have a partner through common keys
        only meet there in rounds: some members of each key against all members of other components. Keys whose
        members are of one component are done. In the last round all remaining pairs of different components are
        candidates, so that no link between components is lost.
        """
        met = self.met()
        common_ = met.where("kind = 1")
        groups = cut_lineage(self.dealt(common_, _uncovered(self.num, self.den, self.buckets)))
        pairs = self.pairs(met)
        self.fetch(pairs, groups)
        roots = self.settled(pairs, None)
        if groups.isEmpty():
            return roots
        for turn in range(rounds + 1):
            told = cut_lineage(self.classes.join(roots.toDF("set_key", "root"), "set_key", "left").select(
                "set_key", F.coalesce("root", "set_key"), "n_shingles", "sketch").mapInArrow(_told(self.buckets), MET))
            groups = self.dealt(common_.unionByName(told), _uncovered(self.num, self.den, self.buckets))
            if turn < rounds:
                pairs = self.pairs(cut_lineage(self.dealt(groups, _through_hubs(HUBS if turn else 1, self.buckets))))
            else:
                mixed = self.dealt(groups, _mixed(self.buckets)).unionByName(told)
                found = self.dealt(self.dealt(mixed, _sketched(self.buckets)), _crossed(self.num, self.den, self.buckets))
                pairs = cut_lineage(self.dealt(found, _listed, "a long, b long"))
            if not pairs.isEmpty():
                roots = self.settled(pairs, roots)
        return roots

    @released
    def linked(self, roots: DataFrame, counted: bool) -> DataFrame:
        """All links between different sets, or their number by set.

        A link joins sets of one component, so all pairs of a component's sets whose sizes allow it are counted exactly.
        A component is one block, or blocks by size band and hash; blocks of one band and the next make pairs.
        """
        edges = F.array(*[F.lit(e) for e in bands(self.num, self.den)])
        nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().toDF("set_key", "root")
        members = cut_lineage(nodes.join(self.classes.select("set_key", "n_shingles"), "set_key").withColumn(
            "band", F.size(F.filter(edges, lambda e: e <= F.col("n_shingles")))))
        parts = F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK), F.sum("total") / F.lit(BLOCK_SHINGLES))).cast("int")
        sizes = cut_lineage(members.groupBy("root", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")))
        small = sizes.groupBy("root").agg((parts <= 1).alias("small"))
        salts = sizes.groupBy("root", "band").agg(parts.alias("salts"))
        split = cut_lineage(salts.join(small, "root"))
        own = F.when(F.col("small"), 0).otherwise(F.col("band"))
        placed = members.join(split, ["root", "band"]).select(
            "set_key", "root", own.alias("band"), F.when(F.col("small"), 0).otherwise(F.pmod(F.xxhash64("set_key"), F.col("salts"))).cast("int").alias("salt"))
        blocks = split.select("root", own.alias("band"), F.explode(F.sequence(
            F.lit(0), F.when(F.col("small"), 0).otherwise(F.col("salts") - 1))).alias("salt")).distinct()
        x, y = blocks.toDF("root", "band", "salt"), blocks.toDF("root", "band_y", "salt_y")
        pairs = cut_lineage(x.join(y, "root").where("band_y = band and salt_y >= salt or band_y = band + 1").withColumn(
            "pair", F.monotonically_increasing_id()))
        left = pairs.select("root", "band", "salt", "pair", F.lit(0).alias("side"))
        right = pairs.where("band <> band_y or salt <> salt_y").select(
            "root", F.col("band_y").alias("band"), F.col("salt_y").alias("salt"), "pair", F.lit(1).alias("side"))
        wanted = placed.join(left.unionByName(right), ["root", "band", "salt"]).select("pair", "side", "set_key")
        rows = wanted.join(self.texts, "set_key").select("pair", "side", "set_key", "text")
        sorted_ = rows.repartition(self.buckets, "pair").sortWithinPartitions("pair", "side")
        return sorted_.mapInArrow(_linked(self.size, self.num, self.den, counted), COUNTS if counted else LINKS)


@under(PLAIN_SIZES)
@released
def jaccard_links(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All links between different sets, once each: a, b (names of the sets, a < b), both, n_a, n_b (shingles)."""
    join = _Join(docs, id_col, text_col, size, num, den)
    return join.linked(join.roots(), False)


@under(PLAIN_SIZES)
@released
def jaccard_components(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100,
        links: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id; with ``links`` also n_links, the number of other sets
    that the row's own set links with (equal sets, so also exact copies, count once). row_key names the row by id and text,
    class_key its component, also where that has no id.

    Words are runs of other characters than blank and 0x09-0x0D, with A-Z in lower case; a text's set holds its distinct
    runs of ``size`` words, or its whole sequence if it has fewer. Two rows link when den x intersection >= num x union;
    component_id is the least id reachable. Equal sets are one node, so copies cost one entry; all texts are read whole.

    A null or empty text, or one without words, has no shingles and its own id as component. Repeated rows get equal
    results. Rows without id link as others do but name no component; if a component has no id at all, its component_id
    is null. Other columns are ignored; an empty table gives no rows.
    """
    join = _Join(docs, id_col, text_col, size, num, den)
    roots = join.roots()
    sets = join.sets.withColumn("_set", F.when(F.col("n_shingles") > 0, F.col("set_key")).otherwise(F.col("row_key")))
    placed = cut_lineage(sets.join(roots.withColumnRenamed("node", "_set"), "_set", "left").select(
        "doc_id", "n_shingles", "_set", F.coalesce(F.col("root"), F.col("_set")).alias("root"), "row_key"))
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    more = []
    if links:
        counts = join.linked(roots, True).groupBy("set_key").agg(F.sum("n").alias("n_links"))
        placed = cut_lineage(placed.join(counts.withColumnRenamed("set_key", "_set"), "_set", "left"))
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    # A root without shingles is a row of its own, which no component can claim.
    return placed.join(least, "root", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), *more, "row_key",
        F.col("root").alias("class_key"))
