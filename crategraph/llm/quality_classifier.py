"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a temperature.

Words are lower-cased runs of letters, of digits and of other characters. Each has a sparse random index vector of ``NONZERO``
entries +1 or -1, drawn by its 64-bit hash, and a context vector: the sum of the index vectors of the words up to ``WINDOW``
places away. For the ``head`` most frequent words of all documents these are sums over all documents: tasks sum what
they have read and Spark adds the sums up, a table of a fixed size (head x SIZE numbers, 16 MB) that travels with the tasks.
Of each rarer word it is the sum over its places in the text at hand. A document is the mean of its words' unit-length, centred
context vectors, and the logarithms of the numbers of words and of different words that were pooled.

A network of one hidden layer learns from at most ``examples`` labelled rows (a sample by id hash); a fifth of them is set
apart to choose the temperature that divides its logit, so that scores are calibrated.

Defined results: null and empty texts pool to zeros and get the network's score for that; without labelled rows, or with one
label only, every score is the share of label 1 (0.5 without any); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crategraph.llm import labelled
from crategraph.llm import text as T
from crategraph.llm.language_model import frequent, word_counts

SIZE, NONZERO, WINDOW = 64, 4, 2
WIDTH = SIZE + 2


def index_vectors(words: np.ndarray) -> np.ndarray:
    """The index vector of each word hash."""
    with np.errstate(over="ignore"):
        draw = T.mix(words[:, None] + np.arange(1, NONZERO + 1, dtype=T.U64) * T.U64(0x51ED270B0A1F39C1))
    out = np.zeros((len(words), SIZE), np.int8)
    sign = np.where((draw >> T.U64(32)) & T.U64(1), 1, -1).astype(np.int8)
    rows = np.arange(len(words))
    for k in range(NONZERO):  # one entry of each word at a time, so entries in the same place add up
        out[rows, (draw[:, k] % T.U64(SIZE)).astype(np.int64)] += sign[:, k]
    return out


def surroundings(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of the index vectors around every word of a chunk, given their own."""
    out = np.zeros(own.shape, np.int8)
    for gap in range(1, WINDOW + 1):
        same = (doc[gap:] == doc[:-gap]).astype(np.int8)[:, None]
        out[gap:] += own[:-gap] * same
        out[:-gap] += own[gap:] * same
    return out


def _by(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct groups and the sums of their rows."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return group[starts], np.add.reduceat(rows[order], starts, axis=0, dtype=np.int32) if len(starts) else np.zeros((0, SIZE), np.int32)


def _find(head: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the head, and whether it is there."""
    at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
    return at, head[at] == words if len(head) else np.zeros(len(words), bool)


def context_vectors(texts: DataFrame, head: np.ndarray) -> np.ndarray:
    """The table of the head's context vectors, summed over all documents."""
    columns = [f"v{k}" for k in range(SIZE)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(head), SIZE), np.int32)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                w = T.words(chunk, T.RUNS, lower=True)
                at, known = _find(head, w.hash)
                word, sums = _by(at[known], surroundings(w.doc, index_vectors(w.hash))[known])
                total[word] += sums
        seen = np.flatnonzero(total.any(1))
        for lo in range(0, len(seen), 10_000):
            some = seen[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(SIZE))], names=["word", *columns])

    sums = texts.mapInArrow(gather, "word long, " + ", ".join(f"{c} int" for c in columns)).groupBy("word").agg(*(F.sum(c).cast("float").alias(c) for c in columns)).toArrow()
    out = np.zeros((len(head), SIZE), np.float32)
    out[np.asarray(sums.column(0))] = np.stack([np.asarray(sums.column(k + 1)) for k in range(SIZE)], 1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros(x.shape, np.float32), where=length > 0)


@dataclass
class Model:
    head: np.ndarray
    table: np.ndarray  # unit-length, centred context vectors of the head
    centre: np.ndarray
    layers: list[np.ndarray] | None
    mean: np.ndarray
    scale: np.ndarray
    temperature: float
    share: float

    @classmethod
    def of(cls, head: np.ndarray, context: np.ndarray) -> Model:
        unit = _unit(context)
        some = unit.any(1)
        centre = unit[some].mean(0) if some.any() else np.zeros(SIZE, np.float32)
        unit[some] -= centre
        return cls(head, unit, centre, None, np.zeros(WIDTH), np.ones(WIDTH), 1.0, 0.5)

    def pooled(self, chunk: T.Chunk) -> np.ndarray:
        """A text's vector depends on no other text: sums are taken along its words."""
        w = T.words(chunk, T.RUNS, lower=True)
        out = np.zeros((chunk.size, WIDTH), np.float32)
        if not len(w.doc):
            return out
        at, known = _find(self.head, w.hash)
        context = np.zeros((len(w.doc), SIZE), np.float32)
        context[known] = self.table[at[known]]
        rare = np.flatnonzero(~known)
        if len(rare):
            order = rare[np.lexsort((w.hash[rare], w.doc[rare]))]
            new = (w.doc[order][1:] != w.doc[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
            starts = np.flatnonzero(np.concatenate([[True], new]))
            around = surroundings(w.doc, index_vectors(w.hash))[order]
            local = _unit(np.add.reduceat(around, starts, axis=0, dtype=np.int32).astype(np.float32))
            local[local.any(1)] -= self.centre
            context[order] = np.repeat(local, np.diff(np.concatenate([starts, [len(order)]])), axis=0)
        texts = np.flatnonzero(w.counts)
        out[texts, :SIZE] = np.add.reduceat(context, w.first[texts], axis=0) / w.counts[texts, None]
        out[:, SIZE] = np.log1p(w.counts)
        out[:, SIZE + 1] = np.log1p(np.bincount(T.bag(w.doc, w.hash)[0], minlength=chunk.size))
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, chunk: T.Chunk) -> np.ndarray:
        if self.layers is None:
            return np.full(chunk.size, self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pooled(chunk).astype(np.float64)) / self.temperature, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", *, examples: int = 20_000, head: int = 1 << 16, hidden: int = 32, epochs: int = 60, seed: int = 7, modulus: int = 4, held: int = 2) -> Model:
    """Learn from labelled rows whose id's crc32 modulo ``modulus`` is not ``held``."""
    train = labelled.sample(docs, labels, label_col, id_col, text_col, label_id_col, size=examples, modulus=modulus, held=held)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    often, _, _ = frequent(word_counts(texts, T.RUNS), head)
    model = Model.of(often, context_vectors(texts, often))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(0), 1 << 19):
                x = model.pooled(chunk)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, WIDTH, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(chunk.first, chunk.size), lists], names=["label", "x"])

    rows = sorted(train.select("text", "label").mapInArrow(vectors, "label int, x array<float>").collect(), key=lambda r: (r["x"], r["label"]))
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        model.share = float(y.mean()) if len(y) else 0.5
        return model
    x = np.array([r["x"] for r in rows], float)
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(y)) < len(y) // 5
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    model.mean, model.scale = x[~apart].mean(0), x[~apart].std(0) + 0.02
    model.layers = _train((x[~apart] - model.mean) / model.scale, y[~apart], hidden, epochs, rng)
    if apart.any():
        z = model.logit(x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, -(2 * y[apart] - 1) * z / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rng: np.random.Generator, rate: float = 3e-3, decay: float = 1e-3, batch: int = 128) -> list[np.ndarray]:
    """Adam on the logistic loss with weight decay."""
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(max(epochs, 2000 * batch // max(1, len(y)) if len(y) < 4000 else epochs)):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            at = order[lo : lo + batch]
            a = np.tanh(x[at] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -50, 50))) - y[at]) / len(at)
            back = np.outer(g, p[2]) * (1 - a * a)
            step += 1
            for k, grad in enumerate((x[at].T @ back + decay * p[0], back.sum(0), a.T @ g + decay * p[2], g.sum())):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), labelled.held_out(F.col(id_col), modulus, held).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(2), 1 << 19):
                scores = model.score(chunk)
                ids, out = (batch.column(k).slice(chunk.first, chunk.size) for k in range(2))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
