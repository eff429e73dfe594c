"""Toxicity: a convolutional text classifier in numpy over hashed words, calibrated by language."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage

BUCKETS = 1 << 14
WIDTHS = (1, 2, 3)
_PAD = 2 * BUCKETS
_PREFIX = 5
FOLDS = 3
#: Texts, and their code points, from which one replica of a network learns.
REPLICA_TEXTS, REPLICA_CHARS = 1 << 14, 1 << 26


@dataclass
class Texts:
    """Texts as one run of tokens: for each a word row and a prefix row of the embedding; each text ends in padding."""

    word: np.ndarray
    prefix: np.ndarray
    start: np.ndarray
    size: np.ndarray


def encode(data: np.ndarray, offsets: np.ndarray) -> Texts:
    words = common.Words(data, offsets, common.letter_words(), prefix=_PREFIX)
    counts = np.diff(words.bounds)
    size = np.maximum(counts, 1)
    tail = max(WIDTHS) - 1
    start = np.concatenate([[0], np.cumsum(size + tail)])
    word, prefix = np.full(start[-1], _PAD, np.int32), np.full(start[-1], _PAD, np.int32)
    if len(words.hash):
        place = np.repeat(start[:-1] - words.bounds[:-1], counts) + np.arange(len(words.hash))
        word[place] = (words.hash & np.uint64(BUCKETS - 1)).astype(np.int32)
        prefix[place] = (words.prefix & np.uint64(BUCKETS - 1)).astype(np.int32) + BUCKETS
    return Texts(word, prefix, start[:-1], size)


@dataclass
class Network:
    """Word and prefix embeddings are added; filters of several widths, rectified and max-pooled over the whole text,
    meet in one logistic unit. A second table holds each language's log word frequencies, to choose the calibration."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    language: np.ndarray = field(default_factory=lambda: np.zeros((_PAD + 1, 1), np.float32))
    #: Per language: slope and threshold of the log-odds.
    slope: np.ndarray = field(default_factory=lambda: np.ones(1))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1))
    constant: float | None = None

    def convolve(self, t: Texts) -> list[np.ndarray]:
        """For each width the responses at each token; where a window would leave its text they are -inf."""
        x = self.embedding[t.word] + self.embedding[t.prefix]
        beyond = np.concatenate([t.start + t.size + i for i in range(max(WIDTHS) - 1)])
        out = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias):
            y = x @ w[0]
            for j in range(1, width):
                y[:-j] += x[j:] @ w[j]
            y += b
            y[beyond] = -np.inf
            out.append(y)
        return out

    def log_odds(self, t: Texts) -> np.ndarray:
        pooled = np.concatenate([np.maximum.reduceat(y, t.start, axis=0) for y in self.convolve(t)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def languages(self, t: Texts) -> np.ndarray:
        return np.argmax(np.add.reduceat(self.language[t.word] + self.language[t.prefix], t.start, axis=0), axis=1)

    def scores(self, t: Texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(t.start), self.constant)
        group = self.languages(t)
        z = np.clip(self.slope[group] * (self.log_odds(t) - self.threshold[group]), -35, 35)
        return 1 / (1 + np.exp(-z))


def _encode_all(texts: list[str | None]) -> list[Texts]:
    out = []
    for text in texts:
        raw = (text or "").encode()
        out.append(encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    return out


def _joined(parts: list[Texts]) -> Texts:
    size = np.concatenate([p.size for p in parts])
    start = np.concatenate([[0], np.cumsum(size + max(WIDTHS) - 1)])[:-1]
    return Texts(np.concatenate([p.word for p in parts]), np.concatenate([p.prefix for p in parts]), start, size)


class _Adagrad:
    def __init__(self, shape, rate):
        self.squares, self.rate = np.full(shape, 1e-6, np.float32), rate

    def step(self, values, gradient, at=slice(None)):
        self.squares[at] += gradient * gradient
        values[at] -= self.rate * gradient / np.sqrt(self.squares[at])


class Training:
    """A network while it learns; ``state`` is all that a task must know to go on with it."""

    def __init__(self, seed: int, share: float, size: int = 16, filters: int = 12):
        rng = self.rng = np.random.default_rng(seed)
        net = self.net = Network(
            rng.normal(0, 0.03, (_PAD + 1, size)).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(size * w), (w, size, filters)).astype(np.float32) for w in WIDTHS],
            [np.zeros(filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32),
            float(np.log(share / (1 - share))))
        net.embedding[_PAD] = 0
        self.rows, self.taps = _Adagrad(net.embedding.shape, 0.05), [_Adagrad(w.shape, 0.02) for w in net.filters]
        self.biases, self.unit, self.unit_bias = [_Adagrad(b.shape, 0.02) for b in net.bias], _Adagrad(net.out.shape, 0.02), _Adagrad((1,), 0.02)
        self.bias = np.array([net.out_bias], np.float32)

    def _arrays(self) -> list[np.ndarray]:
        pairs = [*zip(self.net.filters, self.taps), *zip(self.net.bias, self.biases), (self.net.out, self.unit), (self.bias, self.unit_bias)]
        return [x for values, steps in pairs for x in (values, steps.squares)]

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """A row per embedding row (with its mean squared gradient), and all else."""
        return np.column_stack([self.net.embedding, self.rows.squares.mean(1)]), np.concatenate([x.ravel() for x in self._arrays()])

    def load(self, embedding: np.ndarray, rest: np.ndarray) -> None:
        self.net.embedding[:] = embedding[:, :-1]
        self.rows.squares[:] = embedding[:, -1:]
        at = 0
        for x in self._arrays():
            x[...] = rest[at:at + x.size].reshape(x.shape)
            at += x.size

    def learn(self, texts: list[Texts], labels: np.ndarray, weights: np.ndarray, passes: int, batch: int = 32) -> None:
        net, rows, taps, biases, unit, unit_bias, bias = self.net, self.rows, self.taps, self.biases, self.unit, self.unit_bias, self.bias
        size, filters = net.embedding.shape[1], len(net.bias[0])
        for chosen in (c for _ in range(passes) for c in np.array_split(self.rng.permutation(len(texts)), max(1, len(texts) // batch))):
            t = _joined([texts[i] for i in chosen])
            at, pooled = [], []
            for y in net.convolve(t):
                best = np.stack([a + y[a:a + n].argmax(axis=0) for a, n in zip(t.start, t.size)])
                at.append(best)
                pooled.append(y[best, np.arange(y.shape[1])[None, :]])
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + bias, -30, 30)))
            delta = ((p - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            back = delta[:, None] * net.out[None, :] * (hidden > 0)
            unit.step(net.out, hidden.T @ delta + 1e-5 * net.out)
            unit_bias.step(bias, delta.sum(keepdims=True))
            touched, pushed = [], []
            for k, (width, best) in enumerate(zip(WIDTHS, at)):
                g = back[:, k * filters:(k + 1) * filters]
                biases[k].step(net.bias[k], g.sum(0))
                change = np.empty_like(net.filters[k])
                for j in range(width):
                    tokens = best + j
                    x = net.embedding[t.word[tokens]] + net.embedding[t.prefix[tokens]]
                    change[j] = np.einsum("bf,bfd->df", g, x)
                    to_x = g[:, :, None] * net.filters[k][j].T[None, :, :]
                    for source in (t.word, t.prefix):
                        touched.append(source[tokens].ravel())
                        pushed.append(to_x.reshape(-1, size))
                taps[k].step(net.filters[k], change)
            ids, where = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), size), np.float32)
            np.add.at(total, where, np.concatenate(pushed))
            real = ids != _PAD
            rows.step(net.embedding, total[real], ids[real])
        net.out_bias = float(bias[0])


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float = 1.0, weight: float = 1.0) -> float:
    """The slope of a logistic fit by Newton steps, drawn to ``prior``.

    Labels count as slightly less than certain, by their number, and the prior as ``weight`` squared units of slope, so
    that labels which a threshold separates do not drive the slope to infinity.
    """
    a, b = prior, 0.0
    known, missed = (w * y).sum(), (w * (1 - y)).sum()
    aim = np.where(y > 0, (known + 1) / (known + 2), 1 / (missed + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = w * (p - aim), w * p * (1 - p) + 1e-9
        gradient = np.array([(d * z).sum() + weight * (a - prior), d.sum()])
        hessian = np.array([[(h * z * z).sum() + weight, (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(np.clip(a, 0.05, 20)) if np.isfinite(a) else prior


def _best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The middle of the gap in log-odds at which weighted F1 is largest."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hits, named = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (named + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def calibrate(net: Network, group: np.ndarray, z: np.ndarray, labels: np.ndarray, n: np.ndarray, least: int = 15) -> None:
    """Sets slope and threshold per language from the log-odds of texts, n of each, by networks that have not seen them; a
    language with fewer than ``least`` of either label uses those of all, and the slopes of the others are drawn to that of all."""
    whole = (_platt(z, labels, n), _best_threshold(z, labels, n))
    net.slope, net.threshold = (np.full(net.language.shape[1], v) for v in whole)
    for k in range(net.language.shape[1]):
        own = group == k
        if min((n * labels)[own].sum(), (n * (1 - labels))[own].sum()) >= least:
            net.slope[k] = _platt(z[own], labels[own], n[own], whole[0], 10.0)
            net.threshold[k] = _best_threshold(z[own], labels[own], n[own])


def _encoded(batch: pa.RecordBatch | pa.Table) -> list[Texts]:
    return _encode_all(batch.column("text").to_pylist())


def _language_table(rows: DataFrame) -> np.ndarray:
    """Log frequencies of hashed words and prefixes by language, over all texts."""
    def counted(batches):
        for batch in batches:
            words: dict = {}
            for t, name in zip(_encoded(batch), batch.column("lang").to_pylist()):
                words.setdefault(name, []).extend((t.word, t.prefix))
            for name, parts in words.items():
                ids, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(ids), pa.string()), "word": ids.astype(np.int64), "n": n.astype(np.int64)})

    found = rows.where("lang is not null").select("text", "lang").mapInArrow(counted, "lang string, word long, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    names = sorted(set(langs)) or [""]
    counts = np.full((_PAD + 1, len(names)), 0.5)
    if len(langs):
        counts[found.column("word").to_numpy(), [names.index(x) for x in langs]] += found.column("n").to_numpy()
    logs = np.log(counts / counts.sum(0))
    logs[_PAD] = 0
    return logs.astype(np.float32)


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(h, text, lang, toxic, fold) of every labelled document to learn from, its whole text, stored once.

    Only texts that a bitmap of the labelled ids lets through are shuffled. Of several rows of one id the smallest text counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    seen = common.with_membership(rows, F.xxhash64("doc_id"), common.membership(known, F.xxhash64("doc_id")), "_labelled")
    found = seen.where("_labelled").drop("_labelled").join(known, "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    h = F.xxhash64("doc_id")
    return cut_lineage(one.select(h.alias("h"), "text", "lang", "toxic", F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold")))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, seed: int = 5) -> Network:
    """A network from all whole labelled documents (doc_id, text, lang) and labels (doc_id, toxic 0 or 1), of rows for which
    ``learn`` holds. Each third of them calibrates networks of the other two. Languages are learned as well,
    from lang of the same rows, as the calibration of a text follows the language its words show. With labels of one
    kind only, or none, every score is that kind's constant 0 or 1, or 0."""
    rows = labelled_texts(docs, labels, F.lit(True) if learn is None else learn)
    count, chars = np.zeros((FOLDS, 2)), 0
    for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect():
        count[r.fold, r.toxic] += r.n
        chars += r.chars
    n = count.sum()
    if not n or not count.sum(0).all():
        net = Network(np.zeros((1, 1)), [], [], np.zeros(0), 0.0)
        net.constant = float(count[:, 1].sum() > 0)
        return net
    nets = _networks(rows, count, chars, max(1, -(-int(n) // REPLICA_TEXTS), -(-chars // REPLICA_CHARS)), seed)
    net = nets[FOLDS]
    net.language = _language_table(rows)
    shared = docs.sparkSession.sparkContext.broadcast(nets)

    def judged(batches):
        for batch in batches:
            encoded, fold = _encoded(batch), batch.column("fold").to_numpy()
            for k in np.unique(fold):
                own = np.flatnonzero(fold == k)
                t = _joined([encoded[i] for i in own])
                z = shared.value[k].log_odds(t) if k in shared.value else np.zeros(len(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shared.value[FOLDS].languages(t).astype(np.int64)), pa.array(np.round(np.clip(z, -60, 60) * 1024).astype(np.int64)),
                    pa.array(batch.column("toxic").to_numpy()[own].astype(np.int64))], names=["lang", "z", "y"])

    # To 1/1024, so that what reaches the driver is bounded.
    spread = rows.select("text", "toxic", "fold").mapInArrow(judged, "lang long, z long, y long").groupBy("lang", "z", "y").count().collect()
    shared.destroy()
    lang, z, y, times = np.array(sorted((r.lang, r.z / 1024, r.y, r["count"]) for r in spread), float).T
    calibrate(net, lang.astype(int), z, y, times)
    return net


def _passes(n: int, chars: int, epochs: int = 10, steps: int = 800, batch: int = 32, full: int = 8000, most: int = 10 ** 8) -> int:
    """Up to ``full`` texts are read ``epochs`` times, few texts more often, for ``steps`` steps or ``most`` code points;
    more texts as much less often as they are more, but at least once."""
    return max(epochs, min(-(-steps * batch // max(n, batch)), -(-most // max(chars, 1)))) if n <= full else max(1, round(epochs * full / n))


def _networks(rows: DataFrame, count: np.ndarray, chars: int, replicas: int, seed: int) -> dict[int, Network]:
    """The network of all texts (number FOLDS) and, for each fold, that of the others where they have both labels.

    Every text is learned from. Beyond one replica's texts, replicas of the networks learn side by side, each from texts
    of its own, and their mean goes on, an embedding row's that of the replicas that changed it.
    """
    total = count.sum(0)
    balance = total.sum() / (2 * total)
    without = {k: total - (count[k] if k < FOLDS else 0) for k in range(FOLDS + 1)}
    training = {k: Training(seed, seen[1] / seen.sum()) for k, seen in without.items() if seen.all()}
    states = {k: t.state() for k, t in training.items()}
    passes = _passes(int(total.sum()), chars)
    # (part of the texts or none, passes): one round for one replica, else two, each of half the passes or of half the texts.
    rounds = [(None, passes)] if replicas == 1 else [(0, 1), (1, 1)] if passes == 1 else [(None, passes - passes // 2), (None, passes // 2)]
    context = rows.sparkSession.sparkContext
    for number, (part, times) in enumerate(rounds):
        shared = context.broadcast(states)
        given = rows.select("h", "text", "toxic", "fold", F.pmod(F.xxhash64("h"), F.lit(replicas)).alias("replica"))
        if part is not None:
            given = given.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(2)) == part)
        # A single replica's networks learn in tasks of their own, others one after the other beside their texts.
        nets = [[k] for k in states] if replicas == 1 else [list(states)]
        given = given.withColumn("nets", F.explode(F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in nets])))
        # Spread by number, as little text is much work.
        given = given.repartition(4 * replicas * len(nets), "replica", "nets")
        pieces = max(16, replicas // 4)

        def learned(table: pa.Table) -> pa.Table:
            table = table.sort_by([("h", "ascending"), ("fold", "ascending")])
            encoded, fold, y = _encoded(table), table.column("fold").to_numpy(), table.column("toxic").to_numpy().astype(float)
            out = []
            for k in table.column("nets")[0].as_py():
                own = np.flatnonzero(fold != k)
                t = Training([seed, number, k, table.column("replica")[0].as_py()], 0.5)
                t.load(*shared.value[k])
                if len(own):
                    t.learn([encoded[i] for i in own], y[own], balance[y[own].astype(int)], times)
                embedding, rest = t.state()
                changed = (embedding != shared.value[k][0]).any(1)
                for j in range(pieces):
                    out.append((k, j, pickle.dumps((embedding[j::pieces], changed[j::pieces], rest if j == 0 else rest[:0], len(own)))))
            return pa.table({"net": pa.array([r[0] for r in out], pa.int32()), "piece": pa.array([r[1] for r in out], pa.int32()),
                             "state": pa.array([r[2] for r in out], pa.binary())})

        def averaged(table: pa.Table) -> pa.Table:
            k, j = table.column("net")[0].as_py(), table.column("piece")[0].as_py()
            found = [pickle.loads(x) for x in sorted(table.column("state").to_pylist())]
            changed = np.stack([c for _, c, _, _ in found])
            much, weight = changed.sum(0), np.array([n for *_, n in found], float)
            embedding = np.where(much[:, None] > 0, sum(e * c[:, None] for e, c, _, _ in found) / np.maximum(much, 1)[:, None], shared.value[k][0][j::pieces])
            rest = sum(r * w for (_, _, r, _), w in zip(found, weight)) / max(weight.sum(), 1)
            return pa.table({"net": pa.array([k], pa.int32()), "piece": pa.array([j], pa.int32()), "state": pa.array([pickle.dumps((embedding, rest))], pa.binary())})

        schema = "net int, piece int, state binary"
        result = given.groupBy("replica", "nets").applyInArrow(learned, schema).groupBy("net", "piece").applyInArrow(averaged, schema).collect()
        following = {k: [np.empty_like(v) for v in state] for k, state in states.items()}
        for r in result:
            embedding, rest = pickle.loads(r.state)
            following[r.net][0][r.piece::pieces] = embedding
            if r.piece == 0:
                following[r.net][1][:] = rest
        shared.destroy()
        states = {k: tuple(v) for k, v in following.items()}
    for k, t in training.items():
        t.load(*states[k])
        t.net.out_bias = float(t.bias[0])
    return {k: t.net for k, t in training.items()}


def score(text: Column, net: Network) -> Column:
    """How likely a text is toxic, 0 to 1, from 0.5 on beyond the threshold of its language. The whole text is pooled.
    A null or empty text, or one without letters and digits, has the score of no evidence."""
    @F.arrow_udf("double")
    def scored(batch: pa.Array) -> pa.Array:
        out = np.zeros(len(batch))
        for first, data, offsets in common.text_blocks(batch):
            out[first:first + len(offsets) - 1] = net.scores(encode(data, offsets))
        return pa.array(out)

    return scored(text)
