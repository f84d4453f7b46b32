"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all lower-cased runs of letters and digits of the examples; a beginning of 3 to 10 bytes (a stem stands for its
forms) joins them if the share of toxic examples among those that have it, shrunk towards the base rate by ``SHRINK``
examples, is ``LEAN`` or more away from it, however large the sample. Document frequencies are counted over all documents.
An example is a unit vector of (1 + ln tf) * idf * (``FLOOR`` + the distance of the term's shrunk share from the base rate).

The index of the examples is inverted, with the largest weight of each block of examples for common terms and a column
for each of the most frequent. Rare terms and columns are summed in full; block maxima bound what the common terms can add, and
blocks whose bound stays below the k-th best cosine are not read; where that has seldom spared anything, whole lists are read at once
(the sums are the same), and blocks are tried again now and then. Columns are multiplied out for ``BATCH`` texts at once in
32 bits, within ``SLACK`` of their value, and in 64 bits for the examples that can be among the k best, so the k neighbours are
exact (with weights of 24 bits). They vote with the square of their cosine; votes are shrunk towards the base rate and calibrated
by a logistic curve fitted to about ``calibration`` of the examples, each judged without itself. The evidence of a score names
the nearest examples.

Bounds: at most ``examples`` labelled rows (a sample by id hash) make the model, which is broadcast: its size goes with them. No
text is shuffled but the sample's.

Defined results: a text without vocabulary terms (null and empty ones too) gets the base rate of such training texts;
without labelled rows the score is 0; repeated rows are scored each; other columns are ignored, or passed by ``reject``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crategraph.llm import labelled
from crategraph.llm import text as T
from crategraph.shared import give_back

PREFIXES = (3, 4, 5, 6, 7, 8, 10)
EVIDENCE = 3
SHRINK, LEAN, FLOOR = 5.0, 0.25, 0.02
#: A term of more than this share of the examples has a column.
OFTEN = 1 / 8
#: Terms of more examples than this have block maxima; examples in a block.
COMMON, BLOCK = 256, 64
#: Blocks read first, with one more for each ``BLOCK`` neighbours asked for.
FIRST = 8
#: Share of blocks beyond which postings are read in a row rather than by block.
DENSE = 1 / 8
#: Texts for which whole lists are read at once after one whose blocks spared nothing.
PAUSE = 31
BATCH, SLACK = 64, 1e-4
#: Bytes of text at once.
CHUNK = 1 << 18


def _terms(chunk: T.Chunk, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, first three bytes) of occurrences, -1 for the bytes of a whole word; beginnings only of words whose first
    three bytes ``starts`` allows, if given."""
    w = T.words(chunk, T.PUNCTUATION, lower=True)
    code = w.starts()
    among = np.arange(len(code)) if starts is None else np.flatnonzero(starts[code])
    which, terms = [np.arange(len(code))], [w.hash]
    for size in PREFIXES:
        h, at = w.prefix(size, among)
        which.append(at)
        terms.append(T.mix(h + T.U64(1)))
    at = np.concatenate(which)
    return w.doc[at], np.concatenate(terms), np.concatenate([np.full(len(code), -1), code[at[len(code) :]]])


class Vocabulary:
    """Term hashes in order, with a table of where those of each first 20 bits begin."""

    def __init__(self, terms: np.ndarray, codes: np.ndarray):
        self.terms = np.sort(terms.astype(T.U64))
        self.codes = codes
        self.starts = self.first = None

    def __getstate__(self) -> dict:
        return vars(self) | {"starts": None, "first": None}

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and their numbers. Hashes of the same first bits are few, so they are tried in a row."""
        if self.first is None:
            sizes = np.bincount((self.terms >> T.U64(44)).astype(np.int64), minlength=1 << 20)
            self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        part = (term >> T.U64(44)).astype(np.int32)
        at, end = self.first[part], self.first[part + 1]
        known = np.zeros(len(term), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            here, wanted = self.terms[at[left]], term[left]
            known[left[here == wanted]] = True
            left = left[here < wanted]
            at[left] += 1
            left = left[at[left] < end[left]]
        known = np.flatnonzero(known)
        return known, at[known].astype(np.int64)

    def counts(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, term number) with counts."""
        if self.starts is None:
            self.starts = np.zeros(1 << 24, bool)
            self.starts[self.codes] = True
        doc, term, _ = _terms(chunk, self.starts)
        known, at = self.find(term)
        return T.bag(doc[known], at)


@dataclass
class Index:
    """Postings by term. Terms of over ``COMMON`` examples have the largest weight and the first posting of each block of
    ``BLOCK`` examples besides; terms of many examples have columns instead of postings."""

    examples: np.ndarray
    weights: np.ndarray
    pointers: np.ndarray
    common: np.ndarray
    block_max: np.ndarray
    block_starts: np.ndarray
    column: np.ndarray
    columns: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    #: Texts left for which whole lists are read at once.
    pause: int = 0

    @classmethod
    def build(cls, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, labels: np.ndarray, n_terms: int, ids: np.ndarray | None = None) -> Index:
        """``rows``: the example of each (term, weight); examples are numbered from 0, ``ids`` are their documents'."""
        order = np.lexsort((rows, terms))
        rows, terms, weights = rows[order].astype(np.int32), terms[order].astype(np.int32), weights[order].astype(np.float32)
        del order
        df = np.bincount(terms, minlength=n_terms)
        often = df > max(8, OFTEN * len(labels))
        column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        apart = often[terms]
        columns = np.zeros((len(labels), int(often.sum())), np.float32)
        columns[rows[apart], column[terms[apart]]] = weights[apart]
        rows, terms, weights = rows[~apart], terms[~apart], weights[~apart]
        pointers = np.concatenate([[0], np.cumsum(np.where(often, 0, df))])
        many = (df > COMMON) & ~often
        common = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        blocks = -(-len(labels) // BLOCK)
        inside = np.flatnonzero(many[terms])
        cell = common[terms[inside]].astype(np.int64) * blocks + rows[inside] // BLOCK
        block_max = np.zeros((int(many.sum()), blocks), np.float32)
        starts = np.zeros((len(block_max), blocks + 1), np.int32)
        if len(cell):
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            block_max.ravel()[cell[first]] = np.maximum.reduceat(weights[inside], first)
            np.cumsum(np.bincount(cell, minlength=block_max.size).reshape(block_max.shape), axis=1, out=starts[:, 1:])
            starts += pointers[:-1][many][:, None].astype(np.int32)
        rows = rows.astype(np.uint16 if len(labels) <= 1 << 16 else np.int32)
        return cls(rows, weights, pointers, common, block_max, starts, column, columns, labels, np.arange(len(labels)) if ids is None else ids)

    def often(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """What the columns add to the cosines of texts 0 .. size - 1 with all examples, in 32 bits."""
        by = self.column[terms]
        query = np.zeros((size, self.columns.shape[1]), np.float32)
        query[docs[by >= 0], by[by >= 0]] = weights[by >= 0]
        return query @ self.columns.T

    def _sums(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums by example over ranges of postings, each with a weight."""
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.examples[at], weights=np.repeat(weights, n) * self.weights[at], minlength=len(self.labels)).astype(np.float64, copy=False)

    def _lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums by example over the whole lists of a few long ones."""
        spans = [slice(*x) for x in zip(self.pointers[terms].tolist(), self.pointers[terms + 1].tolist())]
        if not spans:
            return np.zeros(len(self.labels))
        times = np.repeat(weights, [x.stop - x.start for x in spans])
        return np.bincount(np.concatenate([self.examples[x] for x in spans]), weights=times * np.concatenate([self.weights[x] for x in spans]), minlength=len(self.labels))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosines above 0, ties by example number; ``skip`` leaves one out.

        Rare terms' postings and columns are summed for all examples. With the block maxima of common terms that bounds
        each example's cosine. Common terms' postings are read in the ``FIRST`` blocks by bound, then in those blocks
        only whose bound reaches the k-th best cosine found; where these are over ``DENSE`` of all, whole lists are read in a row,
        and without trying blocks for the next ``PAUSE`` texts."""
        size = len(self.labels)
        many = self.common[terms] >= 0
        rare, often_terms = np.flatnonzero(~many), np.flatnonzero(self.column[terms] >= 0)
        t, w = terms[many], weights[many]
        rows = self.common[t]
        sums = self._sums(self.pointers[terms[rare]], self.pointers[terms[rare] + 1], weights[rare])
        fast = self.often(np.zeros(len(terms), np.int64), terms, weights, 1)[0] if often is None else often
        known = sums + fast
        if skip >= 0:
            known[skip] = -9.0

        def best(near: np.ndarray, scores: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
            """Of the examples ``among`` (or all): the k best with their cosines, and the k-th best in 32 bits."""
            mark = float(np.partition(near, len(near) - k)[len(near) - k]) if len(near) > k else 0.0
            e = np.flatnonzero((near >= mark - 2 * SLACK) & (near > -1))
            s = scores[e]
            if among is not None:
                e = among[e]
            s = s + self.columns[np.ix_(e, self.column[terms[often_terms]])] @ weights[often_terms]
            order = np.lexsort((e, -s))[:k]
            order = order[s[order] > 0]
            return s[order], e[order], mark

        def read(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            lo, hi = (self.block_starts[np.ix_(rows, blocks + one)].ravel() for one in (0, 1))
            more = self._sums(lo, hi, np.repeat(w, len(blocks)))
            among = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            among = among[among < size]
            return best(known[among] + more[among], sums[among] + more[among], among)

        if self.pause:
            self.pause -= 1
        else:
            top = np.maximum.reduceat(known, np.arange(0, size, BLOCK)) + np.einsum("i,ij->j", w.astype(np.float32), self.block_max[rows])
            first = np.sort(np.argsort(-top)[: FIRST + k // BLOCK])
            s, e, mark = read(first)
            left = np.union1d(first, np.flatnonzero(top >= mark - 2 * SLACK))
            if len(left) <= DENSE * len(top):
                return (s, e) if len(left) <= len(first) else read(left)[:2]
            self.pause = PAUSE
        more = self._lists(t, w)
        return best(known + more, sums + more)[:2]


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: Index | None
    neighbours: int
    base: float
    empty: float
    curve: tuple[float, float]

    def vectors(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight), unit length for each text."""
        doc, term, count = self.vocabulary.counts(chunk)
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, weights=weight * weight, minlength=chunk.size))
        return doc, term, weight / norm[doc]

    def vote(self, s: np.ndarray, e: np.ndarray) -> float:
        w = s * s
        return float((w @ self.index.labels[e] + 0.5 * self.base) / (w.sum() + 0.5))

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * np.log(v / (1 - v)) + self.curve[1], -50, 50))))

    def score(self, chunk: T.Chunk) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of a chunk's texts, and their nearest examples as evidence."""
        scores = np.full(chunk.size, self.empty)
        evidence: list[list[dict]] = [[] for _ in range(chunk.size)]
        if self.index is None:
            return scores, evidence
        seen: dict[bytes, tuple[float, list[dict]]] = {}  # texts repeat
        for d, t, w, often in self.queries(chunk):
            key = t.tobytes() + w.tobytes()
            if key not in seen:
                s, e = self.index.nearest(t, w, self.neighbours, often=often)
                seen[key] = self.calibrated(self.vote(s, e)), [{"doc_id": int(self.index.ids[x]), "cosine": float(y), "toxic": int(self.index.labels[x])} for x, y in zip(e[:EVIDENCE], s)]
            scores[d], evidence[d] = seen[key]
        return scores, evidence

    def queries(self, chunk: T.Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Number, terms and weights of each text with terms, and what the columns add to its cosines."""
        doc, term, weight = self.vectors(chunk)
        edges = np.searchsorted(doc, np.arange(chunk.size + 1))
        done = 0
        for d in np.flatnonzero(np.diff(edges)).tolist():
            if d >= done:
                done = min(d + BATCH, chunk.size)
                lo, first = edges[d], d
                often = self.index.often(doc[lo : edges[done]] - d, term[lo : edges[done]], weight[lo : edges[done]], done - d)
            yield d, term[edges[d] : edges[d + 1]], weight[edges[d] : edges[d + 1]], often[d - first]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", *, examples: int = 20_000, calibration: int = 2_000, neighbours: int = 15, modulus: int = 4, held: int = 2) -> Model:
    """Learn from labelled rows whose id's crc32 modulo ``modulus`` is not ``held``."""
    T.text_batches(docs.sparkSession)
    train = labelled.sample(docs, labels, label_col, id_col, text_col, label_id_col, size=examples, modulus=modulus, held=held)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(1))
            for chunk in T.chunks(batch.column(0), CHUNK):
                doc, term, code = _terms(chunk)
                known, at = np.unique(term, return_index=True)
                doc, term, _ = T.bag(doc, np.searchsorted(known, term))
                positive = np.bincount(term, weights=y[chunk.first + doc], minlength=len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(code[at]), pa.array(np.bincount(term, minlength=len(known))), pa.array(positive)], names=["term", "code", "n", "p"])

    n, p = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    nothing = Model(Vocabulary(np.zeros(0, T.U64), np.zeros(0, np.int64)), np.zeros(0), None, neighbours, 0.0, p / n if n else 0.0, (1.0, 0.0))
    if not n or not 0 < p < n:
        return nothing
    tied = train.select("text", "label").mapInArrow(presence, "term long, code long, n long, p long").groupBy("term").agg(F.min("code").alias("code"), F.sum("n").cast("double").alias("n"), F.sum("p").cast("double").alias("p"))
    lean = F.abs((F.col("p") + SHRINK * p / n) / (F.col("n") + SHRINK) - p / n)
    picked = tied.select("term", "code", lean.alias("lean")).where((F.col("code") < 0) | (F.col("lean") >= LEAN)).toArrow()
    if not picked.num_rows:
        return nothing
    term, code, lean = (np.asarray(picked.column(k)) for k in range(3))
    vocabulary = Vocabulary(term.view(T.U64), np.unique(code[code >= 0]))
    lean = lean[np.argsort(term.view(T.U64))]

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary.terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for chunk in T.chunks(batch.column(0), CHUNK):
                total += np.bincount(vocabulary.counts(chunk)[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], names=["term", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, times = (np.asarray(counted.column(k)) for k in range(2))
    df = np.zeros(len(vocabulary.terms))
    df[at[at >= 0]] = times[at >= 0]
    total = times[at < 0].sum()
    idf = (np.log((1 + total) / (1 + df)) + 1) * (FLOOR + lean)
    model = Model(vocabulary, idf, None, neighbours, p / n, p / n, (1.0, 0.0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(0), CHUNK):
                doc, term, weight = model.vectors(chunk)
                edges = np.searchsorted(doc, np.arange(chunk.size + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (term.astype(np.int32), weight.astype(np.float32))]
                own = [batch.column(k).slice(chunk.first, chunk.size) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=["label", "id", "terms", "weights"])

    rows = train.select("text", "label", "id").mapInArrow(vectors, "label int, id long, terms array<int>, weights array<float>").toArrow()
    label, ids = (np.asarray(rows.column(k)) for k in range(2))
    lists = [rows.column(k).combine_chunks() for k in (2, 3)]
    edges = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths()))])
    term, weight = (np.asarray(x.flatten()) for x in lists)
    vector = lambda k: (term[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]].astype(np.float64))
    del rows, lists, picked, counted, at, times, code
    give_back()
    sizes = np.diff(edges)
    empty = label[sizes == 0]
    order = sorted(np.flatnonzero(sizes).tolist(), key=lambda k: (hashlib.sha256(b"".join(x.tobytes() for x in vector(k))).digest(), label[k], ids[k]))
    model.empty = float((empty.sum() + p / n) / (len(empty) + 1))
    if not order:
        return model
    number = np.empty(len(label), np.int32)
    number[order] = np.arange(len(order))
    model.index = Index.build(np.repeat(number, sizes), term, weight, label[order], len(vocabulary.terms), ids[order])
    tried = range(0, len(order), max(1, len(order) // calibration))
    votes = np.array([model.vote(*model.index.nearest(*vector(order[k]), neighbours, skip=k)) for k in tried])
    model.curve = _logistic(np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6))), label[order][tried])
    del term, weight  # the index has them
    give_back()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a ridge towards (1, 0)."""
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (p - y) + ridge * (w - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return float(max(w[0], 0.05)), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples) of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), labelled.held_out(F.col(id_col), modulus, held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            for chunk in T.chunks(batch.column(2), CHUNK):
                scores, evidence = shared.value.score(chunk)
                ids, out = (batch.column(k).slice(chunk.first, chunk.size) for k in range(2))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(evidence, kind)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def reject(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(chunk)[0] for chunk in T.chunks(batch.column(at), CHUNK)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
