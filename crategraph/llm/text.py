"""Words, word hashes and shingles of whole Arrow columns, computed with numpy over the UTF-8 bytes.

Every function works on a *chunk*: the bytes of consecutive texts plus their offsets. A word's hash depends on its bytes
alone (a polynomial modulo 2**64 followed by a finaliser), so it is the same on every machine and in every run. Two
different words share a 64-bit hash with probability about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

_BYTES = np.arange(256)
#: Separators of "words": blank and the five ASCII controls from tab to carriage return.
BLANK = np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes outside letter-and-digit runs; bytes of non-ASCII characters count as letters.
PUNCTUATION = ~((_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES < 0x80))
#: Classes of bytes for runs: 0 blank, 1 letters (all of non-ASCII), 2 digits, 3 the rest.
RUNS = np.where(BLANK, 0, np.where((_BYTES >= 0x30) & (_BYTES <= 0x39), 2, np.where(PUNCTUATION, 3, 1))).astype(np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def text_batches(spark: SparkSession) -> None:
    """Let at most ``BATCH_ROWS`` rows of whole texts travel to Python in a batch; a session's lower setting stays. The default of
    10,000 rows holds tens of MB in a task several times over: as vectors, on the way, and in Python."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INV)):
                out = np.full(size, U64(base), U64)
                out[0] = 1
                _pow[k] = np.multiply.accumulate(out)
    return _pow[0][:n], _pow[1][:n]


@dataclass
class Chunk:
    """Bytes of texts ``first`` .. ``first + len(offsets) - 2`` of a column."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Word spans in text order, the chunk-relative text each belongs to, its hash, and the words of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    data: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.sums, self.start, self.end)

    def starts(self) -> np.ndarray:
        """The first three bytes of each word as a number; bytes beyond its end count as 0."""
        out = np.zeros(len(self.start), np.int64)
        for k in range(3):
            at = self.start + k
            out = (out << 8) | np.where(at < self.end, self.data[np.minimum(at, len(self.data) - 1)], 0) if len(at) else out
        return out

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, with the total at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def prefix(self, size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words longer than that (``among`` some), and which words those are."""
        which = np.flatnonzero(self.end - self.start > size) if among is None else among[(self.end - self.start)[among] > size]
        return span_hash(self.sums, self.start[which], self.start[which] + size), which


def chunks(column: pa.Array, size: int = CHUNK_BYTES, texts: int = 1 << 30) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``size`` bytes and at most ``texts`` texts; a longer text is a chunk of its
    own. Null counts as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(column), at + texts)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inverse[start] ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def words(chunk: Chunk, separators: np.ndarray = BLANK, lower: bool = False) -> Words:
    """Maximal runs of non-separator bytes; no word crosses two texts. ``lower`` folds A-Z only. With a table of classes such
    as ``RUNS`` for separators, a word is a run of one class other than 0."""
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    if separators.dtype == bool:
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
    else:
        kind = separators[data]
        inside = kind > 0
        begins, ends = inside.copy(), inside.copy()
        turn = kind[1:] != kind[:-1]
        begins[1:] &= turn
        ends[:-1] &= turn
    edges = chunk.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, _ = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    doc = np.searchsorted(chunk.offsets, start, "right") - 1
    return Words(start, end, doc, np.bincount(doc, minlength=chunk.size), sums, data)


_STEP = [U64(int(mix(np.array([7919 + i], U64))[0]) | 1) for i in range(64)]


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a text of fewer words, but one at least, has itself as its only run."""
    m = max(0, len(w.hash) - width + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(m, U64)
        for k in range(width):
            total += w.hash[k : k + m] * _STEP[k]
        whole = w.doc[: len(total)] == w.doc[width - 1 :][: len(total)]
        doc, value = w.doc[: len(total)][whole], mix(total[whole])
        few = np.flatnonzero((w.counts > 0) & (w.counts < width))
        if len(few):
            firsts = w.first[few]
            own = np.zeros(len(few), U64)
            for k in range(width - 1):
                has = w.counts[few] > k
                own[has] += w.hash[firsts[has] + k] * _STEP[k]
            own = mix(own ^ (w.counts[few].astype(U64) * U64(0xA24BAED4963EE407)))
            doc, value = np.concatenate([doc, few]), np.concatenate([value, own])
            order = np.argsort(doc, kind="stable")
            doc, value = doc[order], value[order]
    return doc, value


def bag(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, by text and hash."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate([at, [len(doc)]]))
