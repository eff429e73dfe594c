"""Concatenate and cut: documents laid end to end by prefix sums over partition totals, cut into fixed windows.

The first pass turns every text into ids once and stores them with their place in the stream of their partition. The totals
of the partitions, summed in order, shift these places to places in one global stream. The second pass is a narrow map:
a document's place says which windows it touches, and each window it touches gets a boundary record, its piece there.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from accessloom.session import cut_lineage

#: The file of a word-level byte-pair vocabulary; None takes the one the public package of vocabularies names.
VOCABULARY = None
VOCABULARY_FILE = "word_bpe_49k.json"
#: Parts of words whose ids a Python worker remembers at least (words: a quarter); bytes of text it takes at once; ids it hands on at once.
REMEMBERED, BYTES, IDS = 400_000, 1 << 23, 1 << 21

# Where the vocabulary's own pattern always cuts. Runs of letters, single digits and runs of other signs are
# pieces of their own; the apostrophe and the signs of special tokens are left out, as they may join what
# stands beside them, and so is the one letter whose lower case has a mark of its own.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"""!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"""
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_RUN, _SIMPLE = re.compile(f"[{_LETTERS}]+"), re.compile(f"([{_LETTERS}]+)[{_SIGNS}]?")
_MARK = "!"


class _Memory:
    """Remembers between ``least`` and twice as many latest answers."""

    def __init__(self, least: int):
        self.least, self.young, self.old = least, {}, {}

    def missing(self, keys: Collection[str]) -> set[str]:
        young, old = self.young, self.old
        if len(young) + len(keys) > self.least:
            self.young, self.old = young, old = {}, young
        out = set()
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.add(key)
        return out


class _Encoder:
    """Ids of texts, word by word.

    The vocabulary drops white space and none of its pieces spans any, so a text's ids are those of its words in turn, and
    a plain word's those of its parts; one that returns costs a look-up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words, self.parts = _Memory(REMEMBERED // 4), _Memory(REMEMBERED)

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        whole, ended, other = {}, {}, {}
        for w in self.words.missing(words):
            # Nearly all words are letters alone or with one sign behind them.
            if w.isascii() and w.isalpha():
                whole[w] = w.lower()
            elif simple := _SIMPLE.fullmatch(w):
                ended[w] = simple[1].lower() if w.isascii() else simple[1]
            else:
                other[w] = [p.lower() if p.isascii() else p for p in _PARTS.findall(w)] if _PLAIN.fullmatch(w) else [w]
        asked = {*whole.values(), *ended.values(), *{w[-1] for w, p in ended.items() if len(p) < len(w)}}
        for ps in other.values():
            asked.update(ps)
        self._learn(self.parts.missing(asked))
        get, known = self.parts.young.__getitem__, self.words.young
        known.update(zip(whole, map(get, whole.values())))
        known.update((w, get(p) if len(p) == len(w) else get(p) + get(w[-1])) for w, p in ended.items())
        known.update((w, b"".join(map(get, ps))) for w, ps in other.items())
        return list(map(known.__getitem__, words))

    def _learn(self, parts: Collection[str]) -> None:
        """The ids of parts not met before. Runs of letters are encoded as one text, each followed by a sign that none of
        them holds, whose id says where the next begins: a text of its own costs about twice as much."""
        young, code = self.parts.young, self.dtype.char
        runs = [p for p in parts if _RUN.fullmatch(p)] if self.mark is not None else []
        single = [p for p in parts if not _RUN.fullmatch(p)] if runs else list(parts)
        for at in range(0, len(runs), 4096):
            part = runs[at:at + 4096]
            text = f" {_MARK} ".join([*part, ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):
                single += part
                continue
            blob, width, first = ids.tobytes(), self.dtype.itemsize, 0
            for run, end in zip(part, ends.tolist()):
                young[run] = blob[first * width:end * width]
                first = end + 1
        for at in range(0, len(single), 4096):
            part = single[at:at + 4096]
            for text, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                young[text] = array(code, found.ids).tobytes()

    def encoded(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, as one array, and how many each has."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        bounds = np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        found = self.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        end = len(found)
        found.append(np.array([end_id], self.dtype).tobytes())
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.array([len(x) for x in found]) // self.dtype.itemsize
        first = np.cumsum(size) - size
        word = np.insert(np.asarray(coded.indices), bounds[1:] - bounds[0], end)
        length = size[word]
        before = np.cumsum(length) - length
        ids = flat[np.repeat(first[word] - before, length) + np.arange(length.sum())]
        ends = np.append(before, length.sum())[bounds[1:] - bounds[0] + np.arange(1, len(bounds))]
        return ids, np.diff(ends, prepend=0)


def _path(vocabulary: str | None) -> str:
    if vocabulary is not None:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_FILE)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str | None) -> _Encoder:
    return _Encoder(_path(vocabulary))


def _tokenised(vocabulary: str | None, end_id: int):
    """Rows (part, at, id, ids): the ids of each row's text and the end id, and how many ids its partition has before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            for first, last in stretches(lengths, BYTES):
                rows = batch.slice(first, last - first)
                ids, sizes = encoder.encoded(rows.column(1), end_id)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + bounds[:-1]), rows.column(0), pa.array(sizes), blobs.cast(pa.binary())],
                    names=["part", "at", "id", "n", "ids"])
                at += len(ids)
    return run


def stretches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most ``limit``, or of one larger row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + limit, "right")))
        yield first, last
        first = last


def cut(places: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The pieces that windows of ``length`` cut from documents at global places: (row, start, size, window, offset)."""
    first, last = places // length, (places + sizes - 1) // length
    count = last - first + 1
    row = np.repeat(np.arange(len(places)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    low = np.maximum(window * length, places[row])
    high = np.minimum((window + 1) * length, places[row] + sizes[row])
    return row, low - places[row], high - low, window, low - window * length


def pack(
        docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = VOCABULARY, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, four bytes each).

    All rows' ids, each text followed by the end id, make one stream in the order of partitions and of rows in them;
    sequence k is the stream from k x length on, so every sequence but the last is full and a piece ends only where its
    document or its sequence does. ``start`` counts the document's ids before the piece, ``offset`` those of the sequence.

    A null or empty text is the end id alone. Rows that repeat, tie or lack an id are packed as often as they occur;
    other columns are ignored; an empty table gives no rows. A text is held whole by its task; texts of any length are
    read to their end. The ids are stored once, so later passes need no second tokenising and no order of ``docs``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stored = cut_lineage(source.mapInArrow(
        _tokenised(vocabulary, end_id), f"part int, at long, id {kind}, n long, ids binary"))
    total, bases = 0, {}
    # One number per partition reaches the driver.
    for row in sorted(stored.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        bases[row.part] = total
        total += row.n
    shared = docs.sparkSession.sparkContext.broadcast(bases)

    def pieces(batches):
        for batch in batches:
            for first, last in stretches(np.asarray(batch.column(3)), IDS):
                yield from piece_rows(batch.slice(first, last - first))

    def piece_rows(batch):
        part, at, ids, sizes, found = (batch.column(k) for k in range(5))
        sizes = np.asarray(sizes)
        bytes_ = b"".join(found.to_pylist())
        stream = np.frombuffer(bytes_, f"<u{len(bytes_) // max(1, int(sizes.sum()))}").astype("<u4")
        places = np.array([shared.value[p] for p in part.to_pylist()], np.int64) + np.asarray(at)
        row, start, size, window, offset = cut(places, sizes, length)
        bounds = np.zeros(len(row) + 1, np.int32)
        np.cumsum(size * 4, out=bounds[1:])
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(stream)])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), *(pa.array(x) for x in (start, size, sizes[row], window, offset)), blobs],
            names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    out = stored.mapInArrow(
        pieces, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


def padded_length(n: int, length: int) -> int:
    """A sequence is padded to ``length``, but one that ends at a power of two is left as it is."""
    return n if n & (n - 1) == 0 else length


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Rows of sequence_id, n_tokens, boundaries (offsets where another document begins), ids, padded; from ``pack``."""
    def join(batches):
        at, parts, cuts = None, [], []

        def row():
            ids = b"".join(parts)
            n = len(ids) // 4
            ids += np.full(padded_length(n, length) - n, pad_id, "<u4").tobytes()
            return pa.RecordBatch.from_pydict(
                {"sequence_id": pa.array([at], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "boundaries": pa.array([cuts], pa.list_(pa.int64())),
                 "ids": pa.array([ids], pa.binary())})

        for batch in batches:
            for sequence, offset, start, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if sequence != at:
                    if parts:
                        yield row()
                    at, parts, cuts = sequence, [], []
                if sum(map(len, parts)) != offset * 4:
                    raise RuntimeError(f"sequence {sequence} has no piece before {offset}")
                parts.append(ids)
                if start == 0:
                    cuts.append(offset)
        if parts:
            yield row()

    placed = pieces.select("sequence_id", "offset", "start", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return placed.mapInArrow(join, "sequence_id long, n_tokens long, boundaries array<long>, ids binary")
