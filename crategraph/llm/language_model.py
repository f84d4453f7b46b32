"""Scores of texts under a Brown class-based bigram model trained on the corpus itself.

Words are lower-cased (A-Z) runs of non-blank bytes; each text ends in one end token. A word's probability is
P(class | class before) * P(word | class); transitions are smoothed towards the classes' shares, emissions by one count for
each known word of the class and one for all unknown ones.

Classes come from the exchange algorithm, which moves words between ``classes`` classes as long as the likelihood of the class
bigrams grows. It runs in three steps. The ``types`` most frequent words, and all others by shape (length and last byte), are
exchanged one after the other on their table of bigrams until none moves. Then the ``head`` most frequent words are
exchanged against the classes so found, all at once in Spark: a word's counts after each class are brought together and it
goes where the gain is largest. Then so is every word of the corpus, against the classes of the head. As a context
a word outside the head counts as its shape's class (that much is known wherever it is read); as a word it has its own class.

What grows with the corpus stays in Spark: count and class of every word are a table. Its ``head`` (a bounded number; 6 MB)
travels with the tasks; the other words of a document meet their rows in a join, of which words no key is hot because the hot
ones are in the head. The bigrams that come to the driver are at most (types + 258) squared.

Defined results: null and empty texts are one end token; a row without id counts as training text; repeated rows are
counted and scored each; without training text all counts are 0 and classes equally likely; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crategraph.llm import labelled
from crategraph.llm import text as T
from crategraph.shared import settle

SHAPES = 256
END_HASH = T.U64(0xE7037ED1A0B428DB)
FLUSH = 2_000_000


@dataclass
class Tokens:
    """Hash, shape and text of each word of a chunk; end tokens are left to the caller."""

    hash: np.ndarray
    shape: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def _tokens(chunk: T.Chunk, separators: np.ndarray = T.BLANK) -> Tokens:
    w = T.words(chunk, separators, lower=True)
    last = T.LOWER[chunk.data[w.end - 1]].astype(np.int64)
    return Tokens(w.hash, np.minimum(w.end - w.start - 1, 15) * 16 + (last * 7 >> 1) % 16, w.doc, w.counts)


def _merged(keys: list[np.ndarray], shapes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, s, c = np.concatenate(keys), np.concatenate(shapes), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, s, c = k[order], s[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], s[at], np.add.reduceat(c, at) if len(at) else c


def word_counts(texts: DataFrame, separators: np.ndarray = T.BLANK) -> DataFrame:
    """(h, shape, n) of every word, the end token with shape -1: tasks count what they read, Spark adds up. Settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        held, ends = 0, 0

        def out() -> pa.RecordBatch:
            k, s, c = _merged(*parts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], names=["h", "shape", "n"])

        for batch in batches:
            ends += batch.num_rows
            for chunk in T.chunks(batch.column(0)):
                t = _tokens(chunk, separators)
                k, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                for part, x in zip(parts, (k, t.shape[first], c)):
                    part.append(x)
                held += len(k)
                if held > FLUSH:
                    parts[:] = [[x] for x in _merged(*parts)]
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield out()
                        parts[:], held = [[], [], []], 0
        for part, x in zip(parts, (np.array([END_HASH]), np.array([-1]), np.array([ends]))):
            part.append(x)
        yield out()

    counted = texts.mapInArrow(run, "h long, shape int, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    return settle(counted.where("n > 0"))


def frequent(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, Column]:
    """Hashes and counts of at most ``head`` most frequent words, by hash, and the condition on ``n`` that they meet."""
    grade = F.floor(F.log(1.05, "n")).cast("int")
    left, cut = head, 1 << 30
    for g, n in sorted(counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some hundred grades
        left -= n
        if left < 0:
            break
        cut = g
    rows = counts.where((F.col("shape") >= 0) & (grade >= cut)).select("h", "n").toArrow()
    h, n = (np.asarray(rows.column(k)) for k in range(2))
    order = np.argsort(h.view(T.U64), kind="stable")
    return h.view(T.U64)[order], n[order], grade >= cut


@dataclass
class Model:
    head: np.ndarray
    head_log: np.ndarray
    head_class: np.ndarray  # as a context
    shape_class: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    tokens: int
    words: int
    ends: int
    counts: DataFrame | None = None  # h, n, class of words outside the head
    head_own: np.ndarray | None = None  # as a word

    @property
    def start(self) -> int:
        return len(self.emission) - 2

    def __getstate__(self) -> dict:
        """What travels with tasks: all but the table of rare words."""
        return vars(self) | {"counts": None}

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head, whether it is there, and class of each word."""
        at = np.minimum(np.searchsorted(self.head, t.hash), max(0, len(self.head) - 1))
        known = self.head[at] == t.hash if len(self.head) else np.zeros(len(t.hash), bool)
        group = self.shape_class[t.shape]
        if len(self.head):
            own = known & (self.head_class[at] >= 0)
            group = np.where(own, self.head_class[at], group)
        return at, known, group


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 100) -> np.ndarray:
    """Classes of types 0 .. n-3 of a square table of counts; type n-2 is the start (a context only), n-1 the end.

    Types are taken by falling count and put where the class bigrams' log-likelihood is largest, until none moves."""
    n = len(bigrams) - 2
    weight = bigrams.sum(0)[:n] + bigrams.sum(1)[:n]
    order = np.argsort(-weight, kind="stable")
    group = np.empty(n + 2, np.int64)
    group[order] = np.arange(n) % classes
    group[n], group[n + 1] = classes, classes + 1
    size = classes + 2
    table = np.zeros((size, size))
    np.add.at(table, (group[:, None], group[None, :]), bigrams)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(rounds):
        moved = 0
        for w in order[weight[order] > 0]:
            after = np.bincount(group, weights=bigrams[w], minlength=size)
            before = np.bincount(group, weights=bigrams[:, w], minlength=size)
            self_count, old = bigrams[w, w], group[w]
            after[old] -= self_count
            before[old] -= self_count
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= self_count
            c = slice(0, classes)
            gain = (f(table[c] + after) - f(table[c])).sum(1) + (f(table[:, c].T + before) - f(table[:, c].T)).sum(1)
            d = np.arange(classes)
            diagonal = table[d, d]
            gain += f(diagonal + after[c] + before[c] + self_count) - f(diagonal + after[c]) - f(diagonal + before[c]) + f(diagonal)
            right, left = table.sum(1)[c], table.sum(0)[c]
            gain -= f(right + after.sum() + self_count) - f(right) + f(left + before.sum() + self_count) - f(left)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            group[w] = new
            table[new] += after
            table[:, new] += before
            table[new, new] += self_count
        if not moved:
            break
    return group


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, modulus: int = 7, held: int = 2, head: int = 1 << 18, types: int = 768, classes: int = 48, pull: float = 20.0) -> Model:
    """Learn from rows whose id's crc32 modulo ``modulus`` is not ``held``."""
    train = docs.where(~labelled.held_out(F.col(id_col), modulus, held)).select(F.col(text_col).cast("string").alias("text"))
    counts = word_counts(train)
    tokens, words, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("shape") < 0, F.col("n"))), F.lit(0))).first()
    h, n, often = frequent(counts, head)
    rank = np.full(len(h), -1)
    top = np.lexsort((h, -n))[:types]
    rank[top] = np.arange(len(top))
    model = Model(h, np.log10(n + 1.0), rank, np.arange(SHAPES) + types, np.zeros(0), np.zeros(classes + 2), tokens, words, ends)
    bigrams = _bigrams(train, model, types + SHAPES + 2)
    group = exchange(bigrams, classes)
    model.head_class = np.where(rank >= 0, group[np.maximum(rank, 0)], -1)
    model.shape_class = group[types : types + SHAPES]
    table = np.zeros((classes + 2, classes + 2))
    np.add.at(table, (group[:, None], group[None, :]), bigrams)
    own = _placed(_contexts(train, model, False), table).where("context < 0").select("h", "class").toArrow()
    at = np.searchsorted(h, np.asarray(own.column(0)).view(T.U64))
    inside = at < len(h)
    inside[inside] = h[at[inside]] == np.asarray(own.column(0)).view(T.U64)[inside]
    model.head_class[at[inside]] = np.asarray(own.column(1))[inside]
    placed = settle(_placed(_contexts(train, model, True), _bigrams(train, model, classes + 2)))
    table = np.zeros((classes + 2, classes + 2))
    for r in placed.where("context >= 0").groupBy("context", "class").agg(F.sum("n").alias("n")).collect():  # at most classes + 2 squared
        table[r["context"], r["class"]] = r["n"]
    in_class = np.zeros(classes + 2)
    for r in placed.where("context < 0").groupBy("class").agg(F.count("*").alias("n")).collect():
        in_class[r["class"]] = r["n"]
    own = placed.where((F.col("context") < 0) & often).select("h", "class").toArrow()
    at = np.searchsorted(h, np.asarray(own.column(0)).view(T.U64))
    inside = at < len(h)
    inside[inside] = h[at[inside]] == np.asarray(own.column(0)).view(T.U64)[inside]
    model.head_own = np.array(model.head_class)
    model.head_own[at[inside]] = np.asarray(own.column(1))[inside]
    model.counts = placed.where((F.col("context") < 0) & ~often & (F.col("class") < classes)).select("h", "n", "class")
    share = np.delete(table.sum(0) + 1, classes)
    share = np.insert(share / share.sum(), classes, 0.0)  # nothing leads to the start
    with np.errstate(divide="ignore"):
        model.transition = np.log10((table + pull * share) / (table.sum(1, keepdims=True) + pull))
    model.emission = -np.log10(table.sum(0) + in_class + 1)
    return model


def _contexts(train: DataFrame, model: Model, rare: bool) -> DataFrame:
    """(h, context, old, n): how often each word follows each class, with the class it is read as so far; of the head alone,
    or of all words and the end token. Each word's rows are in one task, side by side."""
    start, held = model.start, len(model.head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = start + 1
        dense, codes, many = np.zeros(held * wide, np.int32), [], 0
        ends = np.zeros(wide, np.int64)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        some = 0

        def poured() -> None:
            if codes:
                c, n = np.unique(np.concatenate(codes), return_counts=True)
                dense[c] += n.astype(np.int32)
                codes.clear()

        def merged() -> list[np.ndarray]:
            h, c, o, n = (np.concatenate(x) for x in parts)
            order = np.lexsort((c, h))
            h, c, o, n = h[order], c[order], o[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
            return [h[at], c[at], o[at], np.add.reduceat(n, at) if len(at) else n]

        def out(h, c, o, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "context", "old", "n"])

        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                t = _tokens(chunk)
                at, known, kind = model.look_up(t)
                _, before, _ = _sequence(kind, t, chunk.size, start, start + 1)
                word, last = before[: len(kind)], before[len(kind) :]
                ends += np.bincount(last, minlength=wide)
                codes.append(at[known] * wide + word[known])
                many += int(known.sum())
                if many > FLUSH:
                    poured()
                    many = 0
                if rare:
                    old, hash_ = kind[~known], t.hash[~known]
                    order = np.argsort(hash_, kind="stable")
                    for part, x in zip(parts, (hash_[order], word[~known][order], old[order], np.ones(len(order), np.int64))):
                        part.append(x)
                    some += len(order)
                    if some > FLUSH:
                        parts[:] = [[x] for x in merged()]
                        some = len(parts[0][0])
                        if some > FLUSH // 2:
                            yield out(*(x[0] for x in parts))
                            parts[:], some = [[], [], [], []], 0
        poured()
        seen = np.flatnonzero(dense)
        yield out(model.head[seen // wide], seen % wide, model.head_class[seen // wide], dense[seen])
        if rare:
            seen = np.flatnonzero(ends)
            yield out(np.full(len(seen), END_HASH), seen, np.full(len(seen), start + 1), ends[seen])
            if parts[0]:
                yield out(*merged())

    return train.mapInArrow(run, "h long, context int, old int, n long").repartition("h").sortWithinPartitions("h")


def gains(word: np.ndarray, context: np.ndarray, n: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gain in the class bigrams' log-likelihood (words, classes) if a word is in a class, against being in none.

    ``word`` numbers the words of entries (context, n) in order; ``old`` is the class in which ``table`` counts each word."""
    classes = len(table) - 2
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    cells, columns = table[:, :classes], table.sum(0)[:classes]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total = np.add.reduceat(n, starts).astype(float)
    steps = np.stack([f(cells + k) - f(cells) for k in range(9)])
    more = steps[np.minimum(n, 8), context]
    many = np.flatnonzero(n > 8)
    more[many] = f(cells[context[many]] + n[many, None]) - f(cells)[context[many]]
    each = np.add.reduceat(more, starts) - f(columns + total[:, None]) + f(columns)
    inside = np.flatnonzero(old < classes)
    o = old[word]
    mine = np.where(o < classes, cells[context, np.minimum(o, classes - 1)], n)
    taken = np.add.reduceat(f(mine) - f(np.maximum(mine - n, 0)), starts)
    whole = columns[np.minimum(old, classes - 1)]
    each[inside, old[inside]] = (taken - f(whole) + f(np.maximum(whole - total, 0)))[inside]
    return each


def _placed(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, n, class, -1) of every word, put where its gain is largest, and (0, n, class, context) of the bigrams of classes."""
    classes = len(table) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(table.shape, np.int64)
        held: list[np.ndarray] | None = None

        def place(h, c, o, n) -> pa.RecordBatch:
            first = np.concatenate([[True], h[1:] != h[:-1]])
            word = np.cumsum(first) - 1
            code, entry = np.unique(word * (classes + 1) + c, return_inverse=True)
            n = np.bincount(entry, weights=n).astype(np.int64)
            w, c, old = code // (classes + 1), code % (classes + 1), o[first]
            group = np.empty(len(old), np.int64)
            for lo in range(0, len(old), 4096):
                a, b = np.searchsorted(w, [lo, lo + 4096])
                g = gains(w[a:b] - lo, c[a:b], n[a:b], old[lo : lo + 4096], table)
                best = np.argmax(g, 1)
                was = np.minimum(old[lo : lo + 4096], classes - 1)
                at = np.arange(len(best))
                group[lo : lo + 4096] = np.where(g[at, best] > g[at, was] + 1e-9, best, was)
            group[old >= classes] = old[old >= classes]
            np.add.at(found, (c, group[w]), n)
            total = np.bincount(w, weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(total), pa.array(group.astype(np.int32)), pa.array(np.full(len(old), -1, np.int32))], names=["h", "n", "class", "context"])

        for batch in batches:
            rows = [np.asarray(batch.column(k)) for k in range(4)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last word may go on in the next batch
            if whole:
                yield place(*(x[:whole] for x in rows))
            held = [x[whole:] for x in rows]
        if held is not None:
            yield place(*held)
        context, group = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(group), np.int64)), pa.array(found[context, group]), pa.array(group.astype(np.int32)), pa.array(context.astype(np.int32))], names=["h", "n", "class", "context"])

    return contexts.mapInArrow(run, "h long, n long, class int, context int")


def _bigrams(train: DataFrame, model: Model, n_types: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_types * n_types, np.int64)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                t = _tokens(chunk)
                _, _, kind = model.look_up(t)
                total += np.bincount(_pairs(kind, t, chunk.size, n_types - 2, n_types - 1, n_types), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    summed = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_types * n_types)
    out[np.asarray(summed.column(0))] = np.asarray(summed.column(1))
    return out.reshape(n_types, n_types)


def _sequence(kind: np.ndarray, t: Tokens, size: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, before, now) of every word and of every text's end token; words first, then ends."""
    first = np.concatenate([[0], np.cumsum(t.counts)])
    before = np.empty(len(kind), np.int64)
    before[1:] = kind[:-1]
    before[first[:-1][t.counts > 0]] = start
    last = np.full(size, start)
    last[t.counts > 0] = kind[first[1:][t.counts > 0] - 1]
    return np.concatenate([t.doc, np.arange(size)]), np.concatenate([before, last]), np.concatenate([kind, np.full(size, end)])


def _pairs(kind: np.ndarray, t: Tokens, size: int, start: int, end: int, base: int) -> np.ndarray:
    _, before, now = _sequence(kind, t, size, start, end)
    return before * base + now


_ROWS = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("tf", pa.int64()), ("context", pa.int32()), ("shaped", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counted", pa.float64()), ("classed", pa.float64())])
_SCHEMA = "rid long, h long, tf long, context int, shaped int, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, classed double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with add-one), score and perplexity of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), labelled.held_out(F.col(id_col), modulus, held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    n_end = model.ends
    start, end = model.start, model.start + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for chunk in T.chunks(batch.column(2)):
                t = _tokens(chunk)
                at, known, kind = model.look_up(t)
                doc, before, _ = _sequence(kind, t, chunk.size, start, end)
                own = model.head_own[at[known]]
                value = model.transition[before[: len(kind)][known], own] + model.emission[own]
                classed = np.bincount(t.doc[known], weights=value, minlength=chunk.size) if known.any() else np.zeros(chunk.size)
                classed = classed + model.transition[before[len(kind) :], end]
                ids = rid + np.arange(chunk.size)
                rid += chunk.size
                counted = np.bincount(t.doc[known], weights=model.head_log[at[known]], minlength=chunk.size) if known.any() else np.zeros(chunk.size)
                # one row for the text, under a hash that no word is likely to have and with tf 0, ...
                with np.errstate(over="ignore"):
                    places = T.mix(ids.astype(T.U64) + T.U64(0x94D049BB133111EB)).view(np.int64)
                none = [pa.nulls(chunk.size, pa.int32())] * 2
                whole = [ids, places, np.zeros(chunk.size, np.int64), *none, batch.column(0).slice(chunk.first, chunk.size), batch.column(1).slice(chunk.first, chunk.size), t.counts + 1, np.bincount(t.doc[known], minlength=chunk.size) + (n_end > 0), counted + np.log10(n_end + 1.0), classed]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(whole, _ROWS)], schema=_ROWS)
                # ... and one for each of its words outside the head, by the class before it
                rare = np.flatnonzero(~known)
                code, h, tf = T.bag((t.doc[rare] * len(model.emission) + before[rare]) * len(model.emission) + kind[rare], t.hash[rare])
                if len(code):
                    code, shaped = np.divmod(code, len(model.emission))
                    d, context = np.divmod(code, len(model.emission))
                    rows = [ids[d], h.view(np.int64), tf, context, shaped]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(rows, _ROWS)), *(pa.nulls(len(d), f.type) for f in list(_ROWS)[5:])], schema=_ROWS)

    rows = narrow.mapInArrow(run, _SCHEMA)
    cells = [(c, g, float(model.transition[c, g] + model.emission[g])) for c in range(start + 1) for g in range(start)]
    values = narrow.sparkSession.createDataFrame(cells, "context int, class int, value double")  # a row for each pair of classes
    joined = rows.join(model.counts.withColumnRenamed("class", "own"), "h", "left").withColumn("class", F.coalesce("own", "shaped"))
    joined = joined.join(F.broadcast(values), ["context", "class"], "left")
    tf = F.col("tf")
    known = F.when(tf > 0, F.when(F.col("n").isNotNull(), tf).otherwise(0)).otherwise(F.col("n_known"))
    counted = F.when(tf > 0, tf * F.log10(F.coalesce("n", F.lit(0)) + 1)).otherwise(F.col("counted"))
    classed = F.when(tf > 0, tf * F.col("value")).otherwise(F.col("classed"))
    rid = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(counted).alias("counted"), F.sum(classed).alias("classed"))
    ends_log = float(np.log10(n_end + 1.0))
    total = F.col("counted") - ends_log + F.col("classed")
    return rid.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.words + 1)))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
