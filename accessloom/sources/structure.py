"""Records of large files that no single line holds: quoted fields with line breaks, elements of a JSON document.

Both readers scan a file in Spark's own splits and know at each block's start what state the bytes before it leave. A first
pass says of every block what it does to any state it may be entered in; these descriptions, a row each, are composed
file by file in order; a second pass then reads every block from its known state. Records inside a block leave it whole, the
pieces of those that cross blocks are joined by number. So a file of any size is read by as many tasks as it has blocks.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

FILE, BLOCK = "source_file", "block"
_ROWS = 4096


def _scan(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(source_file, block, value): the file cut at ``separator``, which the values lack, in its order within a block."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), "value")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """A task's rows by file block: the key of the block and its batches, which are to be read before the next block."""
    def runs():
        for batch in batches:
            if batch.num_rows:
                keys = list(zip(batch.column(FILE).to_pylist(), batch.column(BLOCK).to_pylist()))
                first = 0
                for at in range(1, len(keys) + 1):
                    if at == len(keys) or keys[at] != keys[first]:
                        yield keys[first], batch.slice(first, at - first)
                        first = at

    rest = runs()
    head = next(rest, None)
    while head is not None:
        key = head[0]

        def own():
            nonlocal head
            while head is not None and head[0] == key:
                batch, head = head[1], None
                yield batch
                head = next(rest, None)

        mine = own()
        yield key, mine
        for _ in mine:
            pass


def _resolved(scan: DataFrame, describe, described: str, fold, starts: str, emit, emitted: str) -> DataFrame:
    """Both passes: describe blocks, fold their descriptions per file into start states, emit records from known states.

    A start state is one small row per block of the input; they reach all tasks so that no line of the files moves.
    """
    described_ = scan.mapInArrow(describe, f"{FILE} string, {BLOCK} long, {described}")
    states = described_.groupBy(FILE).applyInPandas(fold, f"{FILE} string, {BLOCK} long, {starts}")
    return scan.join(F.broadcast(states), [FILE, BLOCK]).mapInArrow(emit, emitted)


# ---- delimited text -------------------------------------------------------------------------


def _physical(value: str) -> list[str]:
    """The lines of one value with their ends; a lone carriage return ends a line as well."""
    return re.findall("[^\r\n]*(?:\r\n|\r|\n)", value + "\n") if "\r" in value else [value + "\n"]


def _stays_open(line: str, quoted: bool) -> bool:
    """Whether a record is still inside quotes after this line, entered inside quotes or at a record's start."""
    reader = csv.reader(iter(('"' + line if quoted else line, "\n")))
    next(reader)
    return reader.line_num == 2


def _describe_lines(batches):
    """By block: its lines, and for either start (0 between records, 1 inside quotes) whether it ends inside quotes and
    at which of its lines the record that is then open began, -1 if before the block."""
    csv.field_size_limit(sys.maxsize)
    for (file, block), own in _blocks(batches):
        n, open_, began = 0, [False, True], [-1, -1]
        for batch in own:
            values = batch.column("value")
            plain = pc.invert(pc.match_substring_regex(values, '["\r]'))
            if pc.all(plain).as_py():
                n += len(values)
                continue
            for value, easy in zip(values.to_pylist(), plain.to_pylist()):
                if easy:
                    n += 1
                    continue
                for line in _physical(value):
                    for start in (0, 1):
                        was = open_[start]
                        open_[start] = _stays_open(line, was)
                        if open_[start] and not was:
                            began[start] = n
                    n += 1
        yield pa.RecordBatch.from_pydict({
            FILE: [file], BLOCK: [block], "n": [n], "open_0": [open_[0]], "open_1": [open_[1]], "began_0": [began[0]], "began_1": [began[1]]})


def _fold_lines(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of each block the lines before it, and the line at which the record open at its start began, or 0."""
    line, quoted, began, out = 0, False, 0, []
    for b in blocks.sort_values(BLOCK).itertuples():
        opened = b.began_1 if quoted else b.began_0
        ends = b.open_1 if quoted else b.open_0
        out.append((getattr(b, FILE), getattr(b, BLOCK), line, began if quoted else 0, opened if ends else -2))
        if ends and opened >= 0:
            began = line + opened + 1
        line, quoted = line + b.n, bool(ends)
    return pd.DataFrame(out, columns=[FILE, BLOCK, "before", "began", "last"])


_RECORD = f"{FILE} string, source_line long, {BLOCK} long, whole boolean, fields array<string>, raw string"


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string())
    names = (FILE, "source_line", BLOCK, "whole", "fields", "raw")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _emit_lines(batches):
    """Records with the line they begin at; a record that crosses blocks leaves its pieces, unparsed."""
    csv.field_size_limit(sys.maxsize)

    def of_block(file, block, own):
        first = next(own)
        before, began, last = (first.column(c)[0].as_py() for c in ("before", "began", "last"))
        lines = (line for batch in chain((first,), own) for value in batch.column("value").to_pylist() for line in _physical(value))
        at, held, quoted = 0, [], began > 0
        if quoted:  # the rest of a record that began in an earlier block
            for line in lines:
                at += 1
                held.append(line)
                quoted = _stays_open(line, True) if '"' in line else True
                if not quoted:
                    break
            yield file, began, block, False, None, "".join(held)
        if quoted:
            return
        held, read = [], at

        def whole():
            nonlocal read
            for line in lines:
                if read == last:
                    tail.append(line)
                    return
                read += 1
                held.append(line)
                yield line

        tail: list[str] = []
        for fields in csv.reader(whole()):
            yield file, before + at + 1, block, True, fields, "".join(held).rstrip("\r\n")
            at += len(held)
            held.clear()
        if tail:  # a record that ends in a later block, or at the end of the file inside quotes
            yield file, before + last + 1, block, False, None, "".join(chain(tail, lines))

    for (file, block), own in _blocks(batches):
        rows = []
        for row in of_block(file, block, own):
            rows.append(row)
            if len(rows) == _ROWS:
                yield _record_batch(rows)
                rows = []
        if rows:
            yield _record_batch(rows)


def _parse_pieces(batches):
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        rows = []
        for file, line, raw in zip(*(batch.column(c).to_pylist() for c in (FILE, "source_line", "raw"))):
            text = raw[:-1]  # the break after the record's last line
            rows.append((file, line, 0, True, next(csv.reader(_physical(text)), []), text.rstrip("\r\n")))
        if rows:
            yield _record_batch(rows)


def _joined(pieces: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The pieces of records that cross blocks, put together in the blocks' order."""
    ordered = F.sort_array(F.collect_list(F.struct(BLOCK, text)))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "").alias(text))


def delimited_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, fields, raw) of delimited files; a quoted field may hold line breaks.

    Fields are what Python's csv reader gives for the whole file. ``source_line`` is the physical line a record begins at,
    from 1; an empty line is a record without fields. A quote that is never closed ends with its file, after a line break.
    """
    records = _resolved(
        _scan(spark, path, "\n"), _describe_lines, "n long, open_0 boolean, open_1 boolean, began_0 long, began_1 long", _fold_lines,
        "before long, began long, last long", _emit_lines, _RECORD)
    crossing = _joined(records.where("NOT whole").select(FILE, "source_line", BLOCK, "raw"), [FILE, "source_line"], "raw")
    return records.where("whole").unionByName(crossing.mapInArrow(_parse_pieces, _RECORD)).select(FILE, "source_line", "fields", "raw")


# ---- JSON documents -------------------------------------------------------------------------

#: A document may be nested so deep.
DEEPEST = 64
_QUOTE, _ESCAPE, _COMMA, _OPEN_ARRAY, _OPEN_OBJECT = (ord(c) for c in '"\\,[{')
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


@lru_cache(maxsize=1)
def _marks() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes may be structure, and by how much each changes the depth."""
    structural, step = np.zeros(256, bool), np.zeros(256, np.int64)
    structural[[ord(c) for c in '"[]{},']] = True
    step[[ord("["), ord("{")]], step[[ord("]"), ord("}")]] = 1, -1
    return structural, step


class _Text:
    """The structural signs of a stretch of a document: where they are, and which are quotes that escapes do not hide."""

    def __init__(self, data: bytes):
        structural, self.step = _marks()
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(structural[raw])
        sign = raw[at]
        if b"\\" in data:
            hidden = np.zeros(len(at), bool)
            for k in np.flatnonzero((sign == _QUOTE) & (raw[at - 1] == _ESCAPE) & (at > 0)):
                first = at[k]
                while first and raw[first - 1] == _ESCAPE:
                    first -= 1
                hidden[k] = (at[k] - first) & 1
            at, sign = at[~hidden], sign[~hidden]
        quote = sign == _QUOTE
        quotes = np.cumsum(quote)
        self.at, self.sign, self.before = at[~quote], sign[~quote], quotes[~quote]
        self.quotes = int(quotes[-1]) if len(quotes) else 0

    def read(self, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, int]:
        """From a start inside or outside a string: places, signs, depth after each, and the state at the end."""
        real = (self.before + quoted) & 1 == 0
        at, sign = self.at[real], self.sign[real]
        after = depth + np.cumsum(self.step[sign])
        return at, sign, after, bool(quoted ^ (self.quotes & 1)), int(after[-1]) if len(after) else depth


def _stretches(own: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes]]:
    """Batches of a block with their text, the closing braces that the scan cut at put back."""
    for batch in own:
        yield batch, b"}".join(batch.column("value").cast(pa.binary()).to_pylist()) + b"}"


def _opened(data: bytes, at: int) -> str | None:
    """The member name before an opening bracket."""
    found = _NAME.search(data[max(0, at - 4096):at])
    return json.loads(b'"' + found[1] + b'"') if found else None


def _describe_json(level: int):
    """By block and start (outside or inside a string): the change of depth, and for each depth relative to the start what
    happens there to a container's elements: commas before the first container opens, arrays opened, the kind and
    name of the last container and the commas in it."""
    def merged(old, new):
        if old is None:
            return new
        commas, arrays, kind, name, inside = new
        if kind:
            return old[0] if old[2] else old[0] + commas, old[1] + arrays, kind, name, inside
        return (*old[:4], old[4] + commas) if old[2] else (old[0] + commas, *old[1:])

    def describe(batches):
        for (file, block), own in _blocks(batches):
            quoted, depth, seen = [False, True], [0, 0], ({}, {})
            for _, data in _stretches(own):
                text = _Text(data)
                for start in (0, 1):
                    at, sign, after, quoted[start], end = text.read(quoted[start], depth[start])
                    opens = (sign == _OPEN_ARRAY) | (sign == _OPEN_OBJECT)
                    told = opens | (sign == _COMMA)
                    near = told & (after <= level) & (after >= level - DEEPEST)
                    for r in np.unique(after[near]).tolist():
                        own_ = np.flatnonzero(near & (after == r))
                        kinds = sign[own_]
                        places = np.flatnonzero(kinds != _COMMA)
                        if len(places):
                            last = own_[places[-1]]
                            what = (int(places[0]), int((kinds == _OPEN_ARRAY).sum()), int(sign[last]), _opened(data, at[last]), len(kinds) - int(places[-1]) - 1)
                        else:
                            what = (len(kinds), 0, 0, None, 0)
                        seen[start][r] = merged(seen[start].get(r), what)
                    depth[start] = end
            told = json.dumps([[*r] for r in ([(quoted[s], depth[s], list(seen[s].items())) for s in (0, 1)])])
            yield pa.RecordBatch.from_pydict({FILE: [file], BLOCK: [block], "effects": [told]})
    return describe


def _fold_json(level: int):
    def fold(blocks: pd.DataFrame) -> pd.DataFrame:
        """Of each block: inside a string or not, depth, and of the container at ``level``: arrays so far, kind, name, element."""
        quoted, depth, arrays, kind, name, element, out = False, 0, 0, 0, None, 0, []
        for b in blocks.sort_values(BLOCK).itertuples():
            out.append((getattr(b, FILE), getattr(b, BLOCK), quoted, depth, arrays, kind, name, element))
            ends, change, seen = json.loads(b.effects)[int(quoted)]
            commas, opened, last, called, inside = dict((r, w) for r, w in seen).get(level - depth, (0, 0, 0, None, 0))
            if last:
                arrays, kind, name, element = arrays + opened, last, called, inside
            else:
                element += commas
            quoted, depth = ends, depth + change
            if not -1 <= depth <= DEEPEST:
                raise ValueError(f"{getattr(b, FILE)} is no JSON document, or nested deeper than {DEEPEST}")
        if quoted or depth > 0:
            raise ValueError(f"{out[0][0]} ends inside a value")
        return pd.DataFrame(out, columns=[FILE, BLOCK, "quoted", "depth", "arrays", "kind", "name", "element"])
    return fold


_ELEMENT = f"{FILE} string, name string, array long, position long, {BLOCK} long, whole boolean, value string"


def _emit_json(level: int):
    """Elements of the arrays at ``level``; one that crosses blocks leaves its pieces, under its array and position."""
    def batch_of(rows):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        names = [c.split()[0] for c in _ELEMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def of_block(file, block, own):
        state = None
        held, whole = [], False  # the element being read, and whether it began in this block
        for batch, data in _stretches(own):
            if state is None:
                state = [batch.column(c)[0].as_py() for c in ("quoted", "depth", "arrays", "kind", "name", "element")]
            quoted, depth, arrays, kind, name, element = state
            at, sign, after, quoted, depth = _Text(data).read(quoted, depth)
            left = 0
            bounds = ((sign == _OPEN_ARRAY) | (sign == _OPEN_OBJECT) | (sign == _COMMA)) & (after == level) | (after == level - 1) & (
                _marks()[1][sign] < 0)
            for place, mark in zip(at[bounds].tolist(), sign[bounds].tolist()):
                if mark == _OPEN_ARRAY or mark == _OPEN_OBJECT:
                    kind, element, whole, held = mark, 0, True, []
                    if mark == _OPEN_ARRAY:
                        arrays, name = arrays + 1, _opened(data, place)
                elif kind == _OPEN_ARRAY:
                    held.append(data[left:place])
                    yield file, name, arrays, element, block, whole, b"".join(held).decode()
                    element, whole, held = element + 1, True, []
                    if mark != _COMMA:
                        kind = 0
                elif mark != _COMMA:
                    kind = 0
                left = place + 1
            if kind == _OPEN_ARRAY:
                held.append(data[left:])
            state = [quoted, depth, arrays, kind, name, element]
        if state is not None and state[3] == _OPEN_ARRAY and held:
            yield file, state[4], state[2], state[5], block, False, b"".join(held).decode()

    def emit(batches):
        for (file, block), own in _blocks(batches):
            rows = []
            for row in of_block(file, block, own):
                rows.append(row)
                if len(rows) == _ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
    return emit


def json_elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """(source_file, name, array, position, value): the elements, as JSON text, of the arrays that are ``level`` deep.

    At level 1 the document is an array; at level 2 it is an object or array of arrays, and ``name`` is the member that
    holds the array. Arrays of a file count from 1, elements from 0. Documents are cut at closing braces, which Spark can do
    anywhere in a file, so a document of any size is read by many tasks. One that ends inside a value is an error.
    """
    elements = _resolved(
        _scan(spark, path, "}"), _describe_json(level), "effects string", _fold_json(level),
        "quoted boolean, depth long, arrays long, kind long, name string, element long", _emit_json(level), _ELEMENT)
    keys = [FILE, "array", "position"]
    crossing = _joined(elements.where("NOT whole").select(*keys, BLOCK, "value"), keys, "value").join(
        elements.where("NOT whole").groupBy(*keys).agg(F.max("name").alias("name")), keys)
    columns = [FILE, "name", "array", "position", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value")]
    return elements.where("whole").select(*columns).unionByName(crossing.select(*columns)).where("value <> ''")
