"""Token ids in training order: fixed-length sequences placed by a keyed permutation in fixed-stride shards."""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import common
from accessloom.llm.common import mix

#: A byte-pair vocabulary as lines of base64 and rank; its size is the id that ends each text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are cut into pieces before pairs are merged, as that vocabulary expects.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PLACED = "slot long, doc_ids array<long>, n_tokens int, tokens binary"
WRITTEN = "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, crc32 long, path string"


# ---- the permutation ------------------------------------------------------------------------


def permute(index: np.ndarray, size: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. size-1: a balanced Feistel network over the least even number of bits that holds
    them; numbers that land beyond the size walk on along their cycle until they are inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = [mix(np.uint64([key & (1 << 64) - 1]) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1))[0] for r in range(rounds)]

    def once(x):
        left, right = x >> shift, x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        return left << shift | right

    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


# ---- sequences of a partition ---------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def dtype_for(end_id: int) -> np.dtype:
    return np.dtype("<u2" if end_id < 1 << 16 else "<u4")


def packed(batches: Iterator[pa.RecordBatch], length: int, vocabulary: str) -> Iterator[tuple[np.ndarray, list[int | None], int]]:
    """Sequences of ``length`` ids from a partition's texts in their order: (ids, ids of their documents, ids before
    padding). Each text that is not empty is followed by the end id; only a partition's last sequence is padded, with it."""
    encoding, end = _encoding(vocabulary)
    dtype = dtype_for(end)
    buffer, filled, owners = np.full(length, end, dtype), 0, []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, text in zip(ids, batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            ids_ = array(dtype.char, encoding.encode_ordinary(text))
            ids_.append(end)
            tokens = np.frombuffer(ids_, dtype)
            at = 0
            while at < len(tokens):
                if not owners or owners[-1] != i:
                    owners.append(i)
                taken = min(length - filled, len(tokens) - at)
                buffer[filled:filled + taken] = tokens[at:at + taken]
                filled, at = filled + taken, at + taken
                if filled == length:
                    yield buffer, owners, length
                    buffer, filled, owners = np.full(length, end, dtype), 0, []
    if filled:
        yield buffer, owners, filled


def _counted(docs: DataFrame, length: int, vocabulary: str) -> dict[int, int]:
    """Sequences of each partition; one number per partition reaches the driver."""
    def count(batches):
        encoding, _ = _encoding(vocabulary)
        n = 0
        for batch in batches:
            for text in batch.column(1):
                text = text.as_py()
                n += len(encoding.encode_ordinary(text)) + 1 if text else 0
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": pa.array([-(-n // length)], pa.int64())})

    rows = docs.mapInArrow(count, "part long, n long").where("n > 0").collect()
    return {r.part: r.n for r in rows}


def place(
        docs: DataFrame, length: int = 1024, key: int = 20240229, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
        text_col: str = "text") -> tuple[DataFrame, int]:
    """All sequences with their global slots, and their number.

    A sequence's number is its place in its partition after the sequences of earlier partitions; the permutation makes
    it a slot. That takes two passes over the texts instead of a stored copy of the tokens. Both passes, and any task run
    again after a loss, must see the same partitions: ``docs`` has to be a plain scan of stored files.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = _counted(source, length, vocabulary)
    total, first, parts = 0, {}, sorted(counts)
    for p in parts:
        first[p] = total
        total += counts[p]
    starts = spark.sparkContext.broadcast((first, counts))

    def sequences(batches):
        part = TaskContext.get().partitionId()
        at, rows, n = starts.value[0].get(part, 0), [], 0

        def batch():
            slots = permute(np.arange(at - len(rows), at), total, key)
            owners, sizes, tokens = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(owners, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())],
                names=["slot", "doc_ids", "n_tokens", "tokens"])

        for tokens, owners, size in packed(batches, length, vocabulary):
            rows.append((owners, size, tokens.tobytes()))
            at, n = at + 1, n + 1
            if len(rows) == 512:
                yield batch()
                rows = []
        if rows:
            yield batch()
        if n != starts.value[1].get(part, 0):
            raise RuntimeError(f"partition {part} gave {n} sequences, counted before as {starts.value[1].get(part, 0)}")

    return source.mapInArrow(sequences, PLACED), total


# ---- shards ---------------------------------------------------------------------------------


def write(placed: DataFrame, total: int, folder: str, length: int, per_shard: int = 8192, id_bytes: int = 2) -> DataFrame:
    """Writes slots [k x per_shard, (k + 1) x per_shard) to shard k and returns a row per sequence; see WRITTEN.

    Slot s stands at byte (s mod per_shard) x length x id_bytes of its shard, so a reader can start anywhere without an
    index. One range partition makes one shard: it sorts its slots and writes them in one go under a passing name, then
    moves the file to its final one, so a task that runs again leaves the same bytes.
    """
    shards = max(1, -(-total // per_shard))
    stride = length * id_bytes

    def shard(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        out = name = None
        done = 0
        for batch in batches:
            rows = []
            for slot, owners, size, tokens in zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_ids", "n_tokens", "tokens"))):
                number, at = divmod(slot, per_shard)
                if out is None:
                    name, passing = f"shard-{number:08d}.bin", f"{root}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(passing, compression=None)
                if at != done:
                    raise RuntimeError(f"slot {slot} follows {done} slots of {name}")
                out.write(tokens)
                done += 1
                rows.append((slot, number, at * stride, size, owners, zlib.crc32(tokens), f"{folder}/{name}"))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.string()))],
                    names=[c.split()[0] for c in WRITTEN.split(", ")])
        if out is not None:
            out.close()
            fs.move(passing, f"{root}/{name}")

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    number = F.floor(F.col("slot") / per_shard).cast("int")
    return placed.repartitionById(shards, number).sortWithinPartitions("slot").mapInArrow(shard, WRITTEN)


def materialise(
        docs: DataFrame, folder: str | None = None, length: int = 1024, per_shard: int = 8192, key: int = 20240229,
        vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises whole texts, packs them into sequences, and writes them in training order; a row per sequence.

    Ids are little-endian, of two bytes where the vocabulary allows. Null and empty texts give no ids; rows that repeat
    are tokenised each; a null id stands as null in doc_ids; other columns are ignored; an empty table writes nothing and
    gives no rows.
    """
    folder = folder or common.new_folder(docs.sparkSession, "tokens")
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder
    placed, total = place(docs, length, key, vocabulary, id_col, text_col)
    return write(placed, total, folder, length, per_shard, dtype_for(_encoding(vocabulary)[1]).itemsize)


def read_slots(folder: str, first: int, last: int, length: int, per_shard: int, end_id: int) -> Iterator[np.ndarray]:
    """The sequences of slots first .. last-1, read in sequence; a run can resume at any slot."""
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    dtype = dtype_for(end_id)
    stride = length * dtype.itemsize
    while first < last:
        number, at = divmod(first, per_shard)
        n = min(per_shard - at, last - first)
        with fs.open_input_file(f"{root}/shard-{number:08d}.bin") as f:
            f.seek(at * stride)
            for _ in range(n):
                yield np.frombuffer(f.read(stride), dtype)
        first += n
