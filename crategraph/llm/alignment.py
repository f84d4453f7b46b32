"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE, B a piece BPE that puts a blank ahead; both read a blank and the text. Byte offsets where tokens of both
end cut the tokens into groups, and every A token of a group is linked with every B token of it. A pair of ids counts in as
many documents as hold it linked, over the whole corpus.

First pass (``mapInArrow``): the texts of a batch are laid end to end with their byte offsets, the ends of A's and of B's
tokens are counted once with ``np.bincount``, the batch is cut where both occur, and differences of running sums at the
documents' offsets give each document's figures. A task gathers batches into *units* of bounded bytes. A unit holds each
distinct group once; a document is a bag of its unit's groups. Each unit also says how many of its documents hold each pair.
Second pass (Spark): the units' pairs are summed over the corpus, the highest count of each A id is broadcast (a row for each
id of A's vocabulary at most), and each unit gets the counts of its own pairs back, in one group of bounded size.

Tokens of a text are those of its segments, cut at single blanks between two characters that aren't white space: no token of
A or B reaches over such a blank, so a task tokenizes each distinct segment once. Where a segment's bytes don't come
back, the whole text is tokenized and decides.

Defined results: a null or empty text, and one whose joined A or B bytes differ from a blank and the text, has no tokens:
zeros and ''. A null id stays null; repeated rows count as documents of their own; a long text is a unit of its own; columns
other than the two named ones are ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crategraph.llm import text as T
from crategraph.shared import scratch, settle

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
UNIT_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: Bytes of distinct segments that a task remembers.
SEGMENT_BYTES = 8 << 20
_ROWS = pa.schema([("unit", pa.string()), ("part", pa.int64()), ("doc", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("body", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_SCHEMA = "unit string, part bigint, doc string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, body binary, pairs array<bigint>, docs array<bigint>"


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        # a byte-level vocabulary writes the bytes that print as they are and the others from U+0100 on
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [x for x in range(256) if x not in prints]
        byte = {chr(x): x for x in prints} | {chr(0x100 + k): x for k, x in enumerate(other)}
        with open(os.path.join(folder, A_FILE), encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)

        self.tables = [(np.frombuffer(b"".join(x), np.uint8), np.cumsum(n) - n, n) for x, n in ((self.a_bytes, self.a_sizes), (self.b_bytes, self.b_sizes))]

    def encode(self, blanked: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Ids of each text (given with a blank ahead) under A and under B, flat with how many each has, and whether both give
        the text's bytes back."""
        # some at a time: an encoding holds far more than its ids
        a = [e.ids for k in range(0, len(blanked), 2_048) for e in self.a.encode_batch_fast(blanked[k : k + 2_048], add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in blanked], num_threads=1) if blanked else []
        raw = [t.encode() for t in blanked]
        data, length = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        out, good = [], np.ones(len(raw), bool)
        for ids, (blob, first, size) in zip((a, b), self.tables):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            out.append((flat, n))
            of = np.repeat(np.arange(len(n)), n)
            good &= np.bincount(of, size[flat], len(n)) == length
            token, mine = flat[good[of]], np.repeat(good, length)
            of_byte = np.repeat(np.arange(len(n)), length)[mine]
            joined = blob[spread(first[token], size[token])]
            good[of_byte[joined != data[mine]]] = False
        return out, good


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of ``size`` places."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


#: ASCII white space, and first bytes of characters among which there is white space.
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_FIRST2, _FIRST3 = np.arange(256) == 0xC2, np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin in texts that begin with a blank: at each text, and at each single blank between two characters
    that can't be white space."""
    flag = np.zeros(len(data), bool)
    inner = data[3:-1] == 0x20
    inner &= ~(_WHITE | _FIRST2 | _FIRST3)[data[4:]] & ~_WHITE[data[2:-2]] & ~_FIRST2[data[1:-3]] & ~_FIRST3[data[:-4]]
    flag[3:-1] = inner
    flag[offsets[:-1]] = True
    return np.flatnonzero(flag)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(self.held), len(x)), self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Segments:
    """Ids of the distinct segments seen so far, flat, with where each one's begin and how many it has."""

    def __init__(self, t: Tokenizers):
        self.t, self.known, self.bytes = t, {}, 0
        self.flat, self.first, self.size = [Grown(np.int32), Grown(np.int32)], [Grown(np.int64), Grown(np.int64)], [Grown(np.int64), Grown(np.int64)]
        self.valid = Grown(bool)

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of the segment at each start; new ones are tokenized."""
        edges = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        new = [x for x in distinct if x not in known]
        ids, good = self.t.encode([x.decode() for x in new])
        for x in new:
            known[x] = len(known)
        self.bytes += sum(map(len, new))
        for side, (flat, n) in enumerate(ids):
            self.first[side].extend(self.flat[side].n + np.cumsum(n) - n)
            self.size[side].extend(n)
            self.flat[side].extend(flat)
        self.valid.extend(good)
        return np.fromiter((known[x] for x in distinct), np.int64, len(distinct))[np.asarray(coded.indices)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of texts that have tokens, bytes of each with its blank, A ids, A ids of each text, B ids, B ids of each)."""
        used = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
        blanked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(used)).cast(pa.large_string()), pa.scalar("", pa.large_string()))
        if not len(used):
            none = np.zeros(0, np.int64)
            return used, none, none, none, none, none
        offsets = np.frombuffer(blanked.buffers()[1], np.int64)[blanked.offset : blanked.offset + len(blanked) + 1]
        data = np.frombuffer(blanked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = segment_starts(data, offsets)
        number = self.numbers(data, starts)
        per = np.diff(np.searchsorted(starts, offsets))
        whole = np.bincount(np.repeat(np.arange(len(per)), per), ~self.valid.all[number], len(per)) == 0
        number, kept = number[np.repeat(whole, per)], per[whole]
        ids, counts = [], []
        for side in (0, 1):
            n = self.size[side].all[number]
            ids.append(self.flat[side].all[spread(self.first[side].all[number], n)])
            sums, ends = np.concatenate([[0], np.cumsum(n)]), np.cumsum(kept)
            counts.append(sums[ends] - sums[ends - kept])
        lengths, odd = np.diff(offsets), np.flatnonzero(~whole)
        place, lengths_kept = used[whole], lengths[whole]
        if len(odd):  # their segments don't tell what the whole text gives
            more, good = self.t.encode(blanked.take(pa.array(odd)).to_pylist())
            for side, (flat, n) in enumerate(more):
                ids[side] = np.concatenate([ids[side], flat[np.repeat(good, n)]])
                counts[side] = np.concatenate([counts[side], n[good]])
            place, lengths_kept = np.concatenate([place, used[odd[good]]]), np.concatenate([lengths_kept, lengths[odd[good]]])
        return place, lengths_kept, ids[0], counts[0], ids[1], counts[1]


def group_numbers(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a representative of each distinct group, the distinct group of each group). Groups are equal if their tokens are."""
    start_a, start_b = np.searchsorted(of_a, np.arange(n)), np.searchsorted(of_b, np.arange(n))
    size_a, size_b = np.diff(np.append(start_a, len(a))), np.diff(np.append(start_b, len(b)))
    place_a, place_b = np.arange(len(a)) - start_a[of_a], np.arange(len(b)) - start_b[of_b]
    seed = 0
    while True:
        with np.errstate(over="ignore"):
            key_a = T.mix(a.astype(np.uint64) + (place_a.astype(np.uint64) << np.uint64(24)) + np.uint64(seed << 20))
            key_b = T.mix(b.astype(np.uint64) + (place_b.astype(np.uint64) << np.uint64(24)) + np.uint64((seed << 20) + (1 << 63)))
            key = T.mix(np.add.reduceat(key_a, start_a)) + np.add.reduceat(key_b, start_b)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        like = first[inverse]
        same = (size_a == size_a[like]).all() and (size_b == size_b[like]).all()
        if same and (a == a[start_a[like][of_a] + place_a]).all() and (b == b[start_b[like][of_b] + place_b]).all():
            return first, inverse
        seed += 1  # two groups met under one hash


def listed(ids: np.ndarray, size: np.ndarray) -> list[str]:
    """The ids of each run, joined by commas."""
    text, ends = list(map(str, ids.tolist())), np.cumsum(size)
    return [",".join(text[i:j]) for i, j in zip((ends - size).tolist(), ends.tolist())]


class Unit:
    """Documents of bounded bytes, their distinct groups, and the documents that hold each pair."""

    def __init__(self, name: str, segments: Segments):
        self.name, self.t, self.bytes = name, segments.t, 0
        self.segments, self.groups = segments, {}
        self.rows: list[tuple] = []
        self.bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, group, times
        self.made: list[tuple[np.ndarray, ...]] = []  # A ids of new groups, how many each has, B ids, how many

    def add(self, ids: list, texts: pa.Array) -> None:
        base = len(self.rows)
        rows: list[tuple] = [(i, 0, 0, 0, 0, "") for i in ids]
        used, lengths, a, n_a, b, n_b = self.segments.of(texts)
        self.bytes += int(lengths.sum())
        if len(used):
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            end_a, end_b = np.cumsum(self.t.a_sizes[a]), np.cumsum(self.t.b_sizes[b])
            total = int(offsets[-1]) + 1
            cut = (np.bincount(end_a, minlength=total) > 0) & (np.bincount(end_b, minlength=total) > 0)
            before = np.cumsum(cut)
            of_a, of_b = before[end_a] - cut[end_a], before[end_b] - cut[end_b]
            n = int(before[-1])
            links = np.bincount(of_a, minlength=n) * np.bincount(of_b, minlength=n)
            edge = before[offsets]
            running = np.concatenate([[0], np.cumsum(links)])
            n_groups, n_links = np.diff(edge), np.diff(running[edge])
            first, inverse = group_numbers(a, b, of_a, of_b, n)
            from_a, from_b = np.searchsorted(of_a, first), np.searchsorted(of_b, first)
            size_a, size_b = np.searchsorted(of_a, first, "right") - from_a, np.searchsorted(of_b, first, "right") - from_b
            own_a, own_b = a[spread(from_a, size_a)], b[spread(from_b, size_b)]
            names = [f"{x}|{y}" for x, y in zip(listed(own_a, size_a), listed(own_b, size_b))]
            seen = len(self.groups)
            number = np.fromiter((self.groups.setdefault(x, len(self.groups)) for x in names), np.int64, len(names))
            new = number >= seen
            self.made.append((own_a[np.repeat(new, size_a)], size_a[new], own_b[np.repeat(new, size_b)], size_b[new]))
            doc = np.repeat(np.arange(len(used)), n_groups)
            mine = inverse.tolist()
            for k, (i, p, q) in enumerate(zip(used.tolist(), edge[:-1].tolist(), edge[1:].tolist())):
                sha = hashlib.sha256(";".join([names[x] for x in mine[p:q]]).encode()).hexdigest()
                rows[i] = (ids[i], int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), sha)
            key, times = np.unique(doc << 32 | number[inverse], return_counts=True)
            self.bags.append((base + used[key >> 32], key & 0xFFFFFFFF, times))
        self.rows += rows

    def pairs_of_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by group, pair, times) of the distinct pairs within each group; a pair is A's id times 2**20 plus B's."""
        if not self.made:
            return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, n_a, b, n_b = (np.concatenate([x[k] for x in self.made]).astype(np.int64) for k in range(4))
        group = np.arange(len(n_a))
        # distinct ids of a group with their times, then all pairs of them
        id_a, times_a = np.unique(np.repeat(group, n_a) << 20 | a, return_counts=True)
        id_b, times_b = np.unique(np.repeat(group, n_b) << 20 | b, return_counts=True)
        n_b = np.bincount(id_b >> 20, minlength=len(group))
        first_b = np.cumsum(n_b) - n_b
        size = n_b[id_a >> 20]
        other = np.repeat(first_b[id_a >> 20] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.repeat(id_a & 0xFFFFF, size) << 20 | id_b[other] & 0xFFFFF
        per = np.bincount(id_a >> 20, size, len(group)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(per)]), pair, np.repeat(times_a, size) * times_b[other]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row for each document with its bag of groups, then one for the unit with its pairs and how groups are made of them."""
        offsets, pair, times = self.pairs_of_groups()
        distinct, index = np.unique(pair, return_inverse=True)
        held = np.zeros(len(distinct), np.int64)
        body: list[bytes | None] = [None] * len(self.rows)
        for doc, group, n in self.bags:
            size = np.diff(offsets)[group]
            of = np.repeat(doc, size)
            which = index[np.repeat(offsets[group] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            held += np.bincount(np.unique(of << 32 | which) & 0xFFFFFFFF, minlength=len(distinct))
            edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for p, q in zip(edge[:-1].tolist(), edge[1:].tolist()):
                body[doc[p]] = pack(np.diff(group[p:q], prepend=0), n[p:q])
        for at in range(0, len(self.rows), T.BATCH_ROWS):
            some = self.rows[at : at + T.BATCH_ROWS]
            columns = list(zip(*some))
            empty = [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array([self.name] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_ROWS)[2:8])), pa.array(body[at : at + len(some)], pa.binary()), pa.array(empty, _ROWS.field("pairs").type), pa.array(empty, _ROWS.field("docs").type)], schema=_ROWS)
        if len(distinct):
            how = pack(np.diff(offsets), np.diff(index, prepend=0), times)
            row = [self.name, None, None, None, None, None, None, None, how, distinct, held]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ROWS)], schema=_ROWS)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    return zlib.compress(b"".join([head.tobytes(), *(x.astype(np.int32).tobytes() for x in arrays)]), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    flat = np.frombuffer(raw, np.int32, offset=8 * (n + 1)).astype(np.int64)
    return np.split(flat, np.cumsum(sizes)[:-1])


def _units(folder: str, unit_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        segments = Segments(tokenizers(folder))
        unit = Unit(f"{task}-0", segments)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
                unit.add(ids[at:to].to_pylist(), texts[at:to])
                at = to
                if segments.bytes >= SEGMENT_BYTES:
                    segments = unit.segments = Segments(segments.t)
                if unit.bytes >= unit_bytes:
                    yield from unit.batches()
                    k += 1
                    unit = Unit(f"{task}-{k}", segments)
        if unit.rows:
            yield from unit.batches()

    return run


def _settled(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    path = scratch(df.sparkSession, "alignment")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OUT = "doc string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_OUT_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _OUT.split(", ")])


def _valued(documents: pa.Table, values: pa.Table) -> pa.Table:
    """A unit's documents with the counts of their links."""
    part = np.array(documents.column("part").is_null())
    how = documents.column("body").filter(pa.array(part)).to_pylist()
    docs = documents.filter(pa.array(~part)).sort_by("part")
    best_of, sum_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if how:
        order = np.argsort(np.array(values.column("pair")), kind="stable")
        n, best = np.array(values.column("n"))[order], np.array(values.column("best"))[order]
        sizes, index, times = unpack(how[0])
        index = np.cumsum(index)
        group = np.repeat(np.arange(len(sizes)), sizes)
        best_of = np.bincount(group, times * best[index], len(sizes)).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(times * n[index])])
        ends = np.cumsum(sizes)
        sum_of = running[ends] - running[ends - sizes]
    n_best, count_sum = [], []
    for body in docs.column("body").to_pylist():
        if body is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        group, times = unpack(body)
        group = np.cumsum(group)
        n_best.append(int((best_of[group] * times).sum()))
        count_sum.append(int((sum_of[group] * times).sum()))
    named = {c: docs.column(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([named[f.name] for f in _OUT_ARROW], schema=_OUT_ARROW)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str = FOLDER, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    T.text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"))
    units = _settled(source.mapInArrow(_units(folder, unit_bytes), _SCHEMA))
    each = units.where("part IS NULL").select(F.col("unit").alias("of"), F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("of", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    counts = settle(each.groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 20)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # at most one row for each id of A's vocabulary
    values = counts.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = each.select("of", "pair").join(values, "pair")
    held = units.select("unit", "part", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "body")
    out = held.groupBy("unit").cogroup(back.groupBy("of")).applyInArrow(_valued, _OUT)
    return out.select(F.col("doc").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
