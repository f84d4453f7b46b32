"""Benchmark decontamination with spaced seeds.

Texts are lower-cased (A-Z) and cut into runs of letters and digits. A mask is a pattern of positions that count and
positions that don't; the hash of the counted words of every window joins documents with benchmark items, so one substituted
word in a window does not hide it. Each hit fixes an alignment without gaps; along it the best-scoring segment (+1 for an
equal word, -2 for a different one) is verified: at least ``min_matches`` equal words, or four fifths of a shorter item, at
an identity of ``min_identity`` or more. Items too short for the masks have seeds of all their words but one, so that for
them nothing that this rule accepts is lost.

The benchmark is a query set: it is taken in blocks of at most ``block_words`` words, each of which travels to the tasks as
a sorted seed table, and every document is held against every block where it lies. No text is shuffled.

Defined results: null and empty texts match nothing; items of fewer than ``min_item_words`` words are too short to be told
from ordinary prose and match nothing; repeated items and rows are reported once each; item ids may be null; columns other
than those named are ignored by ``overlaps`` and passed through by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crategraph.llm import text as T

MASKS = ("111111", "1110111", "1111011", "11011011", "1101100111")
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matches long"


class Seeds:
    """Words and seed table of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...], min_item_words: int):
        self.offsets = [[int(k) for k, c in enumerate(m) if c == "1"] for m in masks]
        same: dict[str, list] = {}  # items of one text are verified once
        for i, t in zip(ids, texts):
            same.setdefault(t, []).append(i)
        self.ids, texts = list(same.values()), list(same)
        self.spans = [len(m) for m in masks]
        parts, counts = [], []
        for chunk in T.chunks(pa.array(texts, pa.string())):
            w = T.words(chunk, T.PUNCTUATION, lower=True)
            parts.append(w.hash)
            counts.append(w.counts)
        self.words = np.concatenate(parts) if parts else np.zeros(0, T.U64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        item = np.repeat(np.arange(len(self.counts)), self.counts)
        good = self.counts[item] >= min_item_words
        hashes, places = [], []
        for k in range(len(masks)):
            h, at = self._windows(self.words, item, k)
            keep = good[at]
            hashes.append(h[keep])
            places.append(at[keep])
        # an item shorter than the longest mask is found by all of its words but one, if one may differ, else by all
        self.kinds: list[tuple[int, ...]] = []
        for n in range(min_item_words, max(self.spans)):
            begin = self.first[:-1][self.counts == n]
            for left_out in range(n) if len(begin) and n - -(-4 * n // 5) else [None] if len(begin) else []:
                kept = [k for k in range(n) if k != left_out]
                kind = tuple(k - kept[0] for k in kept)
                if kind not in self.kinds:
                    self.kinds.append(kind)
                places.append(begin + kept[0])
                hashes.append(self._fold(self.words, places[-1], kind, 99 + self.kinds.index(kind)))
        h, at = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hash, self.place, self.item = h[order], at[order], item[at[order]]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> T.U64(42)).astype(np.int64)] = True

    @staticmethod
    def _fold(words: np.ndarray, at: np.ndarray, offsets, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.full(len(at), T.U64(salt), T.U64)
            for n, k in enumerate(offsets):
                total += words[at + k] * T._STEP[n]
            return T.mix(total)

    def _windows(self, words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        span = self.spans[k]
        n = max(0, len(words) - span + 1)
        with np.errstate(over="ignore"):
            total = np.full(n, T.U64(k), T.U64)
            for j, o in enumerate(self.offsets[k]):
                total += words[o : o + n] * T._STEP[j]
        at = np.flatnonzero(owner[:n] == owner[span - 1 : span - 1 + n]) if n else np.zeros(0, np.int64)
        return T.mix(total[at]), at

    def hits(self, w: T.Words) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed hits in a chunk; diagonal: text position less item position."""
        found = []
        first = w.first
        for k in range(len(self.spans) + len(self.kinds)):
            if k < len(self.spans):
                h, at = self._windows(w.hash, w.doc, k)
            else:
                kind = self.kinds[k - len(self.spans)]
                n = max(0, len(w.hash) - kind[-1])
                at = np.flatnonzero(w.doc[:n] == w.doc[kind[-1] : kind[-1] + n]) if n else np.zeros(0, np.int64)
                h = self._fold(w.hash, at, kind, 99 + k - len(self.spans))
            maybe = np.flatnonzero(self.bits[(h >> T.U64(42)).astype(np.int64)])
            h, at = h[maybe], at[maybe]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            if not n.sum():
                continue
            at = np.repeat(at, n)
            post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[post]
            found.append(np.stack([w.doc[at], item, (at - first[w.doc[at]]) - (self.place[post] - self.first[item])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verify(self, w: T.Words, min_matches: int, min_identity: float) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, text start, item start, words, equal words), the best alignment of each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        first = w.first
        for doc, item, diagonal in self.hits(w).tolist():
            n_doc, n_item = int(w.counts[doc]), int(self.counts[item])
            lo, hi = max(0, -diagonal), min(n_item, n_doc - diagonal)
            a = w.hash[first[doc] + diagonal + lo : first[doc] + diagonal + hi]
            same = a == self.words[self.first[item] + lo : self.first[item] + hi]
            score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
            low = np.minimum.accumulate(score)
            end = int(np.argmax(score - low))
            start = int(np.argmin(score[: end + 1]))
            equal = int(same[start:end].sum())
            if equal >= min(min_matches, -(-4 * n_item // 5)) and equal >= min_identity * (end - start):
                row = (equal, doc, item, diagonal + lo + start, lo + start, end - start)
                if row > best.get((doc, item), (0,)):
                    best[doc, item] = row
        return [(d, i, s, t, n, e) for e, d, i, s, t, n in best.values()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, masks, min_item_words: int, block_words: int) -> Iterator[Seeds]:
    ids, texts, size = [], [], 0
    items = benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).distinct()
    for i, t in items.toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += len(t) // 5 + 1
        if size >= block_words:
            yield Seeds(ids, texts, masks, min_item_words)
            ids, texts, size = [], [], 0
    if ids:
        yield Seeds(ids, texts, masks, min_item_words)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, masks: tuple[str, ...] = MASKS, min_matches: int = 13, min_identity: float = 0.75, min_item_words: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """One row for each contaminated document and benchmark item, with the aligned span in words."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for seeds in _blocks(benchmark, item_col, item_text_col, masks, min_item_words, block_words):

        def find(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches")])
            for batch in batches:
                ids = batch.column(0)
                for chunk in T.chunks(batch.column(1)):
                    rows = seeds.verify(T.words(chunk, T.PUNCTUATION, lower=True), min_matches, min_identity)
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (ids[chunk.first + d].as_py(), item, *rest))) for d, i, *rest in rows for item in seeds.ids[i]], schema)

        found = narrow.mapInArrow(find, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return narrow.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, masks: tuple[str, ...] = MASKS, min_matches: int = 13, min_identity: float = 0.75, min_item_words: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` without the contaminated rows; all columns as they are."""
    at = docs.columns.index(text_col)
    for seeds in _blocks(benchmark, item_col, item_text_col, masks, min_item_words, block_words):

        def keep(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for chunk in T.chunks(batch.column(at)):
                    for row in seeds.verify(T.words(chunk, T.PUNCTUATION, lower=True), min_matches, min_identity):
                        clean[chunk.first + row[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
