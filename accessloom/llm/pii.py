"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import bisect
import hashlib
import pickle
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import boosting
from accessloom.session import cut_lineage

# The kinds and their patterns. Digits and letters are ASCII.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates: written-out or spaced addresses, and any run of digits with separators.
_LOOSE_ADDRESS = re.compile(
    r"(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?|\x20at\x20)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\x20?\.\x20?|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,8}")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().:/-]{0,2}[0-9]){5,39}(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")
_HINTS = ("mail", "contact", "tel", "phone", "call", "fax", "mobil", "card", "visa", "iban", "account", "host", "addr", "ssn", "birth")
_WINDOW = 32
# Ways to write a confirmed span so that its base pattern misses it. Texts around one are cut to _AROUND code points.
_ADDRESS_FORMS = ((" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", " . "), (" (at) ", "."))
_AROUND = 160
# Last labels of domains that confirm a written-out address besides those of the base addresses.
_ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk"))
_PHONE_HINTS = ("tel", "phone", "call", "fax", "mobil", "contact")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Addresses from left to right: each starts as far left of its @ as its letters reach and the one before ended."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = _leftmost(text, m.start(), done)
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _leftmost(text: str, at: int, bound: int) -> int:
    while at > bound and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all matches that pass their kind's check, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span that could be personal data; spans of different kinds may overlap."""
    out = []
    for m in _LOOSE_ADDRESS.finditer(text):
        start = _leftmost(text, m.start(), max(0, m.start() - 64))
        if start < m.start():
            out.append((0, start, m.end()))
    if not _DIGIT.search(text):
        return out
    for m in _LOOSE_NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if m[0].count(".") == 3:
            out.append((1, *m.span()))
        if n >= 12:
            out.append((2, *m.span()))
        if 7 <= n <= 16:
            out.append((3, *m.span()))
    return out


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context of each span: what it is made of, how its digits group, what stands around it."""
    rows = []
    for kind, a, b in spans:
        s, before, after = text[a:b], text[max(0, a - _WINDOW):a], text[b:b + _WINDOW]
        digits, groups = _digits(s), re.findall("[0-9]+", s)
        low = before.lower()
        rows.append([
            kind, len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            s.count("."), s.count("-"), s.count(" "), s.count("@"), s.startswith("+"), "(" in s, s.count("/") + s.count(":"),
            bool(digits) and luhn(digits), max((min(int(g[:6]), 999) for g in groups), default=0),
            sum(c.isalpha() for c in s), "[" in s or " at " in s, before[-1:].isspace() or not before,
            after[:1].isspace() or not after, before.rstrip()[-1:] in (":", "=") and bool(before.strip()),
            sum(h in low for h in _HINTS), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
            "dot" in s, ". " in s])
    return np.array(rows, float).reshape(len(spans), 25)


@dataclass
class Detector:
    """Trees and, per kind, slope, offset and least probability; a kind without enough evidence has a bound of 1."""

    trees: boosting.Boosted | None
    slope: list[float]
    offset: list[float]
    least: list[float]

    def probabilities(self, text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
        if self.trees is None or not spans:
            return np.zeros(len(spans))
        x = features(text, spans)
        kind = x[:, 0].astype(int)
        z = np.array(self.slope)[kind] * self.trees.log_odds(x) + np.array(self.offset)[kind]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates beyond the base spans: likely enough for their kind, in falling order of likelihood, none
        overlapping a base span or one taken before."""
        spans = candidates(text)
        chances = self.probabilities(text, spans)
        taken = sorted((a, b) for _, a, b in base)
        out = []
        for p, (kind, a, b) in sorted(zip(chances.tolist(), spans), key=lambda r: (-r[0], r[1][1], r[1])):
            if p >= self.least[kind] and self.least[kind] < 1 and _free(taken, a, b):
                taken.insert(_place(taken, a), (a, b))
                out.append((kind, a, b))
        return sorted(out)


def _place(taken: list[tuple[int, int]], a: int) -> int:
    return bisect.bisect_left(taken, (a, 0))


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    k = _place(taken, a)
    # Base spans of different kinds may overlap, so a longer one can stand before its neighbour.
    return not any(x < b and a < y for x, y in taken[max(0, k - 4):k + 1])


def rewritten(kind: int, span: str, form: int) -> str | None:
    """A confirmed span in a form its base pattern misses; ``form`` picks one of several."""
    groups = re.findall("[0-9]+", span)
    if kind == 0:
        at, dot = _ADDRESS_FORMS[form % len(_ADDRESS_FORMS)]
        local, domain = span.rsplit("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return (". ", " .")[form % 2].join(groups)
    if kind == 2:
        digits = _digits(span)
        return (".", "/", "  ", "- ")[form % 4].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    rest = groups[1:] if sum(map(len, groups[1:])) >= 7 else groups
    out = (span[1:], "00" + span[1:], span[1 + len(groups[0]):].strip() if rest is not groups else span[1:],
           "-".join(rest), ".".join(rest), "/".join(rest), " ".join(groups))[form % 7]
    # A bare run of digits could be any number.
    return None if out.isdigit() else out


def _shape(span: str) -> str:
    return _DIGIT.sub("9", span)


def _ending(domain: str) -> str:
    return re.split(r"[^A-Za-z0-9-]+", domain.lower().rstrip(" )]"))[-1]


def _labelled(text: str, form: int) -> tuple[np.ndarray, list[int], list[str]]:
    """Features, labels and notes of the examples of a text; none is, or overlaps, a base match.

    1: a base span written in another form, in its place in the text; so is 4, a phone number, whose shape is the note.
    0: a candidate that is not of its kind, by checks that hold for every way to write it (Luhn and length, parts up to
    255), and what stands for another kind in a rewritten span. 2 (addresses) and 3 (phone numbers): to be decided by
    ``_resolved`` from the note. A candidate that those checks leave open is no example.
    """
    base, parts, labels, notes = base_spans(text), [], [], []

    def put(where: str, span: tuple[int, int, int], label: int, note: str = "") -> None:
        parts.append(features(where, [span])[0])
        labels.append(label)
        notes.append(note)

    taken = sorted((a, b) for _, a, b in base)
    longest = max((b - a for a, b in taken), default=0)
    starts = [a for a, _ in taken]
    for kind, a, b in candidates(text):
        near = taken[bisect.bisect_left(starts, a - longest):bisect.bisect_left(starts, b)]
        if any(y > a for _, y in near):
            continue
        s, digits = text[a:b], _digits(text[a:b])
        if kind == 0:
            put(text, (kind, a, b), 2, ("@" if "@" in s or "[" in s or "(" in s else "dot" if " dot " in s else "") + "|" + _ending(s))
        elif kind == 1 and any(int(p) > 255 for p in re.findall("[0-9]+", s)):
            put(text, (kind, a, b), 0)
        elif kind == 2:
            put(text, (kind, a, b), int(16 <= len(digits) <= 19 and luhn(digits)))
        elif kind == 3 and not any(h in text[max(0, a - _WINDOW):a].lower() for h in _PHONE_HINTS):
            put(text, (kind, a, b), 0 if s.isdigit() else 3, _shape(s))
    for k, (kind, a, b) in enumerate(base):
        new = rewritten(kind, text[a:b], form + k)
        if new is None:
            continue
        cut = text[max(0, a - _AROUND):a]
        where, x, y = cut + new + text[b:b + _AROUND], len(cut), len(cut) + len(new)
        if any(k2 == kind and p < y and x < q for k2, p, q in base_spans(where)):
            continue
        for other, p, q in candidates(where):
            if 2 * (min(q, y) - max(p, x)) > max(q - p, y - x):
                put(where, (other, p, q), (4 if kind == 3 else 1) if other == kind else 0, _shape(where[p:q]) if kind == 3 else "")
    for kind, a, b in base:
        if kind == 0:
            parts.append(np.zeros(25))
            labels.append(5)
            notes.append(_ending(text[a:b]))
    return np.array(parts, float).reshape(len(parts), 25), labels, notes


def _resolved(found: DataFrame) -> DataFrame:
    """(half, x, label 0 or 1) of the examples; those that stay open are left out.

    A written-out address is right if it has an @, a bracket or a written dot and the last label of its domain is one of
    the base addresses or a usual one, wrong if it has neither, else open. A number with the shape of a rewritten phone
    number is open, as it may well be one; one of another shape, or a bare run of digits, is not.
    """
    label, ending = F.col("label"), F.substring_index("note", "|", -1)
    endings = found.where(label == 5).select("note").distinct().select(F.col("note").alias("ending"), F.lit(True).alias("told"))
    addresses = found.where(label == 2).withColumn("ending", ending).join(endings, "ending", "left")
    known = F.coalesce("told", F.lit(False)) | F.col("ending").isin(*_ENDINGS)
    marked = ~F.startswith("note", F.lit("|"))
    addresses = addresses.withColumn("label", F.when(marked & known, 1).when(~marked & ~known, 0)).where("label is not null")
    numbers = found.where(label == 3).join(found.where(label == 4).select("note").distinct(), "note", "left_anti").withColumn("label", F.lit(0))
    rest = found.where(label.isin(0, 1, 4)).withColumn("label", F.when(label == 0, 0).otherwise(1))
    return reduce(DataFrame.unionByName, [df.select("half", "x", "label") for df in (addresses, numbers, rest)])


def _examples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(half, x, label, n): the distinct examples of all whole texts and how often each occurs."""
    def described(batches):
        parts = []
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"]):
                x, labels, notes = _labelled(t, int(i) // 2)
                parts += [(int(i) % 2, y, note, row) for y, note, row in zip(labels, notes, x.tolist())]
                if len(parts) > 5000:
                    yield pd.DataFrame(parts, columns=["half", "label", "note", "x"])
                    parts = []
        if parts:
            yield pd.DataFrame(parts, columns=["half", "label", "note", "x"])

    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.abs(F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))).alias("id"),
        F.col(text_col).alias("text"))
    found = cut_lineage(rows.mapInPandas(described, "half int, label int, note string, x array<double>"))
    return cut_lineage(_resolved(found).groupBy("half", "label", "x").agg(F.count(F.lit(1)).alias("n")))


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").combine_chunks() if isinstance(batch, pa.Table) else batch.column("x")
    return (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, 25) if len(x) else np.zeros((0, 25)),
            batch.column("label").to_numpy().astype(float), batch.column("n").to_numpy().astype(float))


def _grown(rows: DataFrame, edges: list[np.ndarray], share: float) -> boosting.Boosted:
    """The trees of rows that stay in their tasks: what a level of a tree needs are sums, of fixed size for each task."""
    def measured(model, *state):
        def summed(batches):
            total = 0
            for batch in batches:
                x, y, n = _columns(batch)
                if len(y):
                    total = total + boosting.slopes(model, model.binned(x), y, n, *state)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": pa.array([pickle.dumps(total)], pa.binary())})

        parts = sorted(rows.mapInArrow(summed, "part long, sums binary").collect(), key=lambda r: r.part)
        return sum(pickle.loads(r.sums) for r in parts)

    return boosting.grow(edges, share, measured)


def _spread(trees: boosting.Boosted, rows: DataFrame) -> np.ndarray:
    """(kind, log-odds, label, n) of all rows, log-odds to 1/1024, so that their number is bounded."""
    def judged(batches):
        for batch in batches:
            x, y, n = _columns(batch)
            z = np.round(np.clip(trees.log_odds(x), -35, 35) * 1024)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (x[:, 0], z, y, n)], names=["kind", "z", "y", "n"])

    found = rows.mapInArrow(judged, "kind long, z long, y long, n long").groupBy("kind", "z", "y").agg(F.sum("n").alias("n")).collect()
    return np.array(sorted((r.kind, r.z / 1024, r.y, r.n) for r in found), float).reshape(-1, 4)


def train(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, least: int = 20,
        in_memory: int = 100_000) -> Detector:
    """A detector from all whole texts.

    Candidates and features are made by tasks. Examples are spans that the base patterns miss, as only such can be added:
    each base span once in another form, and candidates that checks decide (see ``_labelled``). Equal examples are counted.
    Texts of odd ids train the trees, those of even ones calibrate: each kind gets a logistic fit of its own and the least
    probability at which the kept examples are right with the wanted ``precision``, if missed spans are as many as base
    spans; a kind with fewer than ``least`` right examples there adds nothing. Up to ``in_memory`` distinct examples are
    summed on the driver, more of them in tasks, with the same trees.
    """
    rows = _examples(docs, id_col, text_col)
    nothing = Detector(None, [1.0] * 4, [0.0] * 4, [1.0] * 4)
    odd, even = rows.where("half = 1"), rows.where("half = 0")
    size = {r.half: r for r in rows.groupBy("half").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("ones"), F.count(F.lit(1)).alias("distinct")).collect()}
    if len(size) < 2 or min(size[0].n, size[1].n) < least or not 0 < size[1].ones < size[1].n:
        return nothing
    values = odd.select("n", F.posexplode("x").alias("j", "v")).groupBy("j", "v").agg(F.sum("n").alias("n")).collect()
    edges = [boosting.edges_of(*np.array([(r.v, r.n) for r in values if r.j == j], float).T) for j in range(25)]
    if size[1].distinct <= in_memory:
        x, y, n = _columns(odd.orderBy("x", "label").toArrow())
        trees = boosting.fit(x, y, n, edges)
    else:
        trees = _grown(odd, edges, size[1].ones / size[1].n)
    spread, out = _spread(trees, even), Detector(trees, [1.0] * 4, [0.0] * 4, [1.0] * 4)
    for k in range(len(KINDS)):
        _, z, y, n = spread[spread[:, 0] == k].T
        if (y * n).sum() < least:
            continue
        out.slope[k], out.offset[k] = _logistic(z, y, n)
        at, group = np.unique(-z, return_inverse=True)
        p = 1 / (1 + np.exp(-(out.slope[k] * -at + out.offset[k])))
        named = np.cumsum(np.bincount(group, n))
        last = np.flatnonzero(np.cumsum(np.bincount(group, n * y)) / named >= precision)
        if len(last) and named[last[-1]] >= least:
            # Halfway down to the first candidate that would be too many.
            kept = p[last[-1]:last[-1] + 2]
            out.least[k] = max(0.5, float(kept.mean() if len(kept) == 2 else kept[0] / 2))
    return out


def _logistic(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        d, h = n * (p - y), n * p * (1 - p)
        g = np.array([(d * z).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        m = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
    return float(np.clip(a, 0.01, 10)), float(np.clip(b, -30, 30))


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(text: Column, detector: Detector) -> Column:
    """A struct of n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans (base and added ones).

    Spans are kind:start:end in code points, by kind and start. The whole text is read; a null text is an empty one and
    has no spans. Rows are independent, so repeated rows get equal results.
    """
    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string"
    names = [c.split()[0] for c in fields.split(", ")]

    @F.pandas_udf(fields)
    def found(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            t = t or ""
            base = base_spans(t)
            more = detector.added(t, base)
            counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
            rows.append((*counts, len(more), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(base + more)))
        return pd.DataFrame(rows, columns=names)

    return found(text)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first to start is shown."""
    @F.pandas_udf("string")
    def redacted(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, found):
            if not t or not s:
                out.append(t)
                continue
            parts, at = [], 0
            for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(","))):
                if a >= at:
                    parts += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return redacted(text, spans)
