"""Near-duplicate classes of documents by BagMinHash.

A document is the multiset of its runs of five words; its similarity to another is their weighted Jaccard, the sum of the
smaller over the sum of the larger counts. 0.8 or more links two documents, linked documents form a class.

Signatures. The counts of a shingle are discretised into levels 0, 1, 2, ... and the levels into intervals [0,1), [1,2),
[2,4), [4,8), ... Each interval of a shingle carries a Poisson process of a rate equal to its length; every point has a
time, a level within the interval and one of the signature's components. A document of count w keeps the points below
level w, and each component keeps its earliest point. Two documents agree in a component with a probability equal to their
weighted Jaccard. Points are made only up to a time horizon at which all components are filled with high probability
(further on where one is not), so the work is about one point a shingle plus m log m, not m for each shingle.

Links. Signatures are cut into bands; texts that share a band share a bucket. Texts of equal multisets are collapsed first.
Two rounds hold each bucket's most central text against the others, after which that text is done with there; then all pairs left
in buckets that still hold several classes are gone through, so no candidate is dropped. Before a pair is verified on the
whole texts, sketches must come near: 384 bits of 96 components in the rounds of central texts, 2048 bits of 1024
components (made for the texts that are left only) in the last. The margins are more than four standard deviations of the
estimate at 0.8. A pair at exactly 0.8 shares no band with a probability of 3e-6, more similar ones with less.

Defined results: null texts and texts without words form classes of their own; texts of one to four words are one shingle;
the class id is the least document id of the class, null if all its ids are null; repeated rows are in one class, and
``keep_one`` keeps one of them; other columns are ignored, or passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from crategraph.llm import text as T
from crategraph.shared import gathered, release_shuffles, settle

COMPONENTS, BANDS, ROWS, SKETCH = 96, 24, 4, 6
FINE, FINE_SKETCH = 1024, 32
#: Rounds of central texts.
ROUNDS = 2
BROADCAST_ROWS = 500_000
#: Rows in a task at least: edges or places in buckets, multisets with their bands, whole texts.
EDGES_A_TASK, BAGS_A_TASK, TEXTS_A_TASK = 20_000, 5_000, 1_000
MARK = "__dup_bag"


def _bag_keys(docs: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """A 128-bit key of each text's multiset of shingles; None for texts without words."""
    with np.errstate(over="ignore"):
        one = T.mix(value ^ (count.astype(T.U64) * T.U64(0x9FB21C651E98DF25)))
        out = np.zeros((n, 2), T.U64)
        for k, v in enumerate((one, T.mix(one + T.U64(0xD1B54A32D192ED03)))):
            starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
            if len(starts):
                out[docs[starts], k] = np.add.reduceat(v, starts)
        filled = np.zeros(n, bool)
        filled[docs] = True
    raw = T.mix(out).tobytes()
    return [raw[16 * i : 16 * i + 16] if f else None for i, f in enumerate(filled)]


def bag_min_hash(docs: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n, m) of texts given as distinct (text, shingle) with counts; rows of texts without shingles stay 0."""
    signature = np.zeros((n, m), T.U64)
    earliest = np.full((n, m), np.inf)
    # intervals: level [0, 1), then [2**(j-1), 2**j) below each count
    part = [(docs, value, np.zeros(len(docs), np.int64), count)]
    low = 1
    while (more := np.flatnonzero(count > low)).size:
        with np.errstate(over="ignore"):
            part.append((docs[more], T.mix(value[more] + T.U64(low) * T.U64(0xC2B2AE3D27D4EB4F)), np.full(len(more), low), count[more]))
        low *= 2
    d, key, base, limit = (np.concatenate(x) for x in zip(*part))
    rate = np.maximum(base, 1).astype(float)

    def advance(at: np.ndarray) -> None:
        """The next point of some intervals' processes."""
        turn[at] += 1
        with np.errstate(over="ignore"):
            draw[at] = T.mix(key[at] + turn[at].astype(T.U64) * T.U64(0x9E3779B97F4A7C15))
        time[at] -= np.log(T.uniform(draw[at])) / rate[at]

    time, turn, draw = np.zeros(len(d)), np.zeros(len(d), np.int64), np.zeros(len(d), T.U64)
    advance(np.arange(len(d)))
    total = np.maximum(np.bincount(docs, weights=count, minlength=n), 1)
    reach, step = m * (np.log(m) + 0.5) / total, m * 1.5 / total
    while True:
        at, found = np.flatnonzero(time <= reach[d]), []
        while len(at):
            point = T.mix(draw[at] ^ T.U64(0x5851F42D4C957F2D))
            high = np.flatnonzero(base[at] > 0)
            keep = np.ones(len(at), bool)
            level = base[at[high]] + np.floor(T.uniform(T.mix(point[high] ^ T.U64(0x14057B7EF767814F))) * rate[at[high]])
            keep[high] = level < limit[at[high]]
            cell = d[at] * m + (((point >> T.U64(32)) * T.U64(m)) >> T.U64(32)).astype(np.int64)
            found.append((cell[keep], time[at[keep]], point[keep]))
            advance(at)
            at = at[time[at] <= reach[d[at]]]
        if found:
            cell, when, point = (np.concatenate(x) for x in zip(*found))
            better = np.flatnonzero(when < earliest.ravel()[cell])
            order = better[np.argsort(-when[better])]
            earliest.ravel()[cell[order]] = when[order]  # the earliest is written last
            signature.ravel()[cell[order]] = T.mix(point[order]) | T.U64(1)
        open_ = (signature == 0).any(1)
        mine = np.flatnonzero(open_[d])
        if not len(mine):
            break
        d, key, base, limit, rate, time, turn, draw = (x[mine] for x in (d, key, base, limit, rate, time, turn, draw))
        reach, step = reach + step, step * 2
    return signature


_SIG = pa.schema([("doc_id", pa.int64()), ("bag", pa.binary()), ("bands", pa.list_(pa.int64())), *((f"s{k}", pa.int64()) for k in range(SKETCH))])


def _packed(signature: np.ndarray, longs: int) -> list[pa.Array]:
    """64 * longs bits of each signature, the same number from each component, as columns of longs."""
    per = 64 * longs // signature.shape[1]
    bits = ((signature[:, :, None] >> np.arange(8, 8 + per, dtype=T.U64)) & T.U64(1)).astype(np.uint8).reshape(len(signature), -1)
    sketch = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64).reshape(len(signature), longs)
    return [pa.array(sketch[:, k]) for k in range(longs)]


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column(1), 1 << 19, 64):
            signature = bag_min_hash(*T.bag(*T.shingles(T.words(chunk))), chunk.size, FINE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.size), *_packed(signature, FINE_SKETCH)], names=["bag", *(f"f{k}" for k in range(FINE_SKETCH))])


def _bands(signature: np.ndarray, bands: int, rows: int) -> pa.ListArray:
    """A key for each band of each signature."""
    n = len(signature)
    with np.errstate(over="ignore"):
        keys = np.full((n, bands), T.U64(0)) + np.arange(bands, dtype=T.U64)
        for k in range(rows):
            keys = T.mix(keys ^ signature[:, k : bands * rows : rows]) + T.U64(k)
    return pa.ListArray.from_arrays(np.arange(0, bands * (n + 1), bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column(1), 1 << 19, 256):
            w = T.words(chunk)
            bag = T.bag(*T.shingles(w))
            sig = bag_min_hash(*bag, chunk.size)
            lists = _bands(sig, BANDS, ROWS)
            ids = batch.column(0).slice(chunk.first, chunk.size)
            yield pa.RecordBatch.from_arrays([ids, pa.array(_bag_keys(*bag, chunk.size), pa.binary()), lists, *_packed(sig, SKETCH)], schema=_SIG)


def _mark(at: int, schema: pa.Schema | None = None):
    """Append each row's multiset key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            for chunk in T.chunks(batch.column(at)):
                keys += _bag_keys(*T.bag(*T.shingles(T.words(chunk))), chunk.size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, MARK])

    return run


def _occurrences(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every shingle occurrence: the k-th of equal shingles in a text has the same key in all texts."""
    doc, value, count = T.bag(*T.shingles(T.words(chunk)))
    which = np.repeat(np.arange(len(doc)), count)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return doc[which], T.mix(value[which] + turn.astype(T.U64) * T.U64(0xA0761D6478BD642F))


def _spans(batch: pa.RecordBatch, size: int = 1 << 20, pairs: int = 128) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``pairs`` pairs (a, b, text, text) of about ``size`` bytes together; a larger pair is a range of its own."""
    ends = np.cumsum([sum(n.as_py() or 0 for n in row) for row in zip(*(pc.binary_length(batch.column(k)) for k in (2, 3)))])
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right"))
        hi = min(max(hi, lo + 1), lo + pairs, batch.num_rows)
        yield lo, hi
        lo = hi


def _overlap(threshold: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _spans(batch):
                part = batch.slice(lo, hi - lo)
                keys, owner, sizes = [], [], []
                for column in (2, 3):
                    size = np.zeros(part.num_rows, np.int64)
                    for chunk in T.chunks(part.column(column)):
                        d, k = _occurrences(chunk)
                        keys.append(k)
                        owner.append(d + chunk.first)
                        size += np.bincount(d + chunk.first, minlength=part.num_rows)
                    sizes.append(size)
                k, o = np.concatenate(keys), np.concatenate(owner)
                order = np.lexsort((k, o))
                k, o = k[order], o[order]
                both = np.bincount(o[1:][(k[1:] == k[:-1]) & (o[1:] == o[:-1])], minlength=part.num_rows)
                near = both >= threshold * (sizes[0] + sizes[1] - both) - 1e-9
                value = both / np.maximum(sizes[0] + sizes[1] - both, 1)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (*part.columns[:2], pa.array(value))], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (a, b) but the roots, by alternating large and small stars until only stars are
    left. Each pass settles its edges, so lineage stays short; nothing but counts comes to the driver. The number of edges
    sets the number of tasks: at most one for ``EDGES_A_TASK`` edges, so passes over few edges stay cheap. ``edges`` is read
    twice and should be settled."""
    count = edges.count()
    e = gathered(edges, count, EDGES_A_TASK).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = settle(gathered(e.distinct(), count, EDGES_A_TASK))
    while True:
        count = e.count()
        dealt = lambda df, n=count: gathered(df, n, EDGES_A_TASK)
        e = dealt(e)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(e.select("v", F.lit(0)))
        ends = dealt(dealt(ends).groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")))
        if ends.where("ups > 1 OR ups = 1 AND n > 1").isEmpty():
            return e.select("u", F.col("v").alias("root"))
        both = dealt(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        few = F.broadcast if count <= EDGES_A_TASK else lambda df: df
        least = few(dealt(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))))
        large = dealt(dealt(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(few(least), "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = settle(dealt(dealt(small).distinct()))


def _near(column: str, longs: int, similarity: float) -> Column:
    """Whether the sketches of rows ``l`` and ``r`` differ in no more bits than texts of that similarity do on average."""
    bits = sum((F.bit_count(F.col(f"l.{column}{k}").bitwiseXOR(F.col(f"r.{column}{k}"))) for k in range(longs)), F.lit(0))
    return bits <= int(64 * longs / 2 * (1 - similarity))


def _semi(df: DataFrame, ids: DataFrame, on, how: str = "left_semi") -> DataFrame:
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, bag) of every row; (bag, rep_id, n, class_id, keeper) of every multiset; (a, b, similarity) of the verified
    links between multisets, if there are candidates. All settled."""
    T.text_batches(docs.sparkSession)
    release_shuffles(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = [f"s{k}" for k in range(SKETCH)]
    signed = settle(narrow.mapInArrow(_sign, "doc_id long, bag binary, bands array<long>, " + ", ".join(f"{s} long" for s in sketch)))
    reps = settle(signed.where("bag IS NOT NULL").groupBy("bag").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in sketch)))
    n = reps.count()
    reps = gathered(reps, n, BAGS_A_TASK)
    buckets = reps.select("bag", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(buckets.join(crowded, "key"))
    found = links = None
    if places := shared.count():
        found, links = _linked(narrow, reps, gathered(shared, places, EDGES_A_TASK), places, threshold)
    own = reps.select("bag", "rep_id", "n").withColumn("root", F.col("bag"))
    if links is not None:
        own = reps.select("bag", "rep_id", "n").join(links.withColumnRenamed("u", "bag"), "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    heads = own.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "bag")).alias("head"), F.sum("n").alias("class_rows"))
    bags = gathered(settle(own.join(heads, "root").select("bag", "rep_id", "n", F.col("head.rep_id").alias("class_id"), (F.col("head.bag") == F.col("bag")).alias("keeper"), "class_rows")), n, BAGS_A_TASK)
    return signed.select("doc_id", "bag"), bags, found


def _linked(narrow: DataFrame, reps: DataFrame, shared: DataFrame, places: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The verified links among the multisets that share buckets (in so many places), and (u, root) of their components."""
    sketch = [f"s{k}" for k in range(SKETCH)]
    central = shared.groupBy("bag").agg(F.sum("n").alias("score"))
    candidates = settle(reps.join(central, "bag").select("bag", "rep_id", "score", "bands", *sketch))
    marked = narrow.mapInArrow(_mark(1), f"doc_id long, text string, {MARK} binary").withColumnRenamed(MARK, "bag")
    n = candidates.count()
    candidates = gathered(candidates, n, BAGS_A_TASK)
    same = candidates.select("bag", F.col("rep_id").alias("__rep"))
    texts = _semi(marked, same, [marked["bag"] == same["bag"], marked["doc_id"].eqNullSafe(same["__rep"])])
    texts = gathered(settle(texts.groupBy("bag").agg(F.min("text").alias("text"))), n, TEXTS_A_TASK)
    now = shared.select("key", "band", "bag").join(candidates.drop("rep_id", "bands"), "bag").withColumn("comp", F.col("bag"))
    every: DataFrame | None = None
    links: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        if links is not None:
            # what is left: members of buckets of several classes that have not been held against all of the bucket
            now = now.drop("comp").join(links, now["bag"] == links["u"], "left").withColumn("comp", F.coalesce("root", "bag")).drop("u", "root")
            now = now.join(hubs.select("key", "bag"), ["key", "bag"], "left_anti")
            mixed = now.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key")
            now = settle(now.join(mixed, "key", "left_semi"))
            if not (places := now.count()):
                break
            now = gathered(now, places, EDGES_A_TASK)
        if not last:
            hub = now.groupBy("key").agg(F.max_by(F.struct("bag", "comp", *sketch), F.struct("score", "bag")).alias("h"))
            hubs = gathered(settle(hub.select("key", "h.*")), places, EDGES_A_TASK)
            one, two = hubs.alias("l"), now.alias("r")
            new = (F.col("l.bag") != F.col("r.bag")) & _near("s", SKETCH, threshold - 0.21)
            pairs = one.join(two, (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & new)
            pairs = pairs.select(F.least("l.bag", "r.bag").alias("a"), F.greatest("l.bag", "r.bag").alias("b")).distinct()
        else:
            pairs = _remaining(now, candidates, texts, threshold)
        full = pairs.join(texts.withColumnsRenamed({"bag": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"bag": "b", "text": "text_b"}), "b")
        found = settle(full.select("a", "b", "text_a", "text_b").mapInArrow(_overlap(threshold), "a binary, b binary, similarity double"))
        every = found if every is None else every.unionAll(found)
        found = found.select("a", "b")
        links = components(found if links is None else found.unionAll(links.select(F.col("u").alias("a"), F.col("root").alias("b"))))
    return every, links


def _remaining(now: DataFrame, candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs of different classes left in the buckets whose fine sketches come near."""
    fine = now.select("bag").distinct().join(texts, "bag").mapInArrow(_fine, "bag binary, " + ", ".join(f"f{k} long" for k in range(FINE_SKETCH)))
    fine = settle(fine)
    rest = now.select("key", "band", "bag", "comp").join(fine, "bag").join(candidates.select("bag", "bands"), "bag")
    # both sides have the same narrow columns, so they are shuffled once
    rest = rest.withColumn("before", F.slice("bands", 1, F.col("band"))).drop("band", "bands")
    one, two = rest.alias("l"), rest.alias("r")
    # a pair is taken from the first of the bands that it shares
    earlier = F.arrays_overlap("l.before", "r.before")
    new = (F.col("l.key") == F.col("r.key")) & (F.col("l.bag") < F.col("r.bag")) & (F.col("l.comp") != F.col("r.comp"))
    pairs = one.join(two, new & _near("f", FINE_SKETCH, threshold - 0.075) & ~earlier)
    return pairs.select(F.col("l.bag").alias("a"), F.col("r.bag").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_rows (rows of the class) and n_links of every row: the verified links of its text to other
    texts. Links within what other links have made one class already are not looked for."""
    rows, bags, found = _classes(docs, id_col, text_col, threshold)
    if found is None:
        bags = bags.withColumn("n_links", F.lit(0).cast("long"))
    else:
        ends = found.select(F.col("a").alias("bag")).unionAll(found.select("b")).groupBy("bag").agg(F.count("*").alias("n_links"))
        bags = bags.join(ends, "bag", "left")
    known = F.col("class_id").isNotNull() & F.col("bag").isNotNull()
    class_id = F.when(known, F.col("class_id")).otherwise(F.when(F.col("bag").isNull(), F.col("doc_id")))
    own = rows.join(bags.drop("rep_id", "n", "keeper"), "bag", "left")
    return own.select("doc_id", class_id.alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8) -> DataFrame:
    """(left_id, right_id, similarity) of the verified links, each text by the least id of the rows that have its shingles."""
    rows, bags, found = _classes(docs, id_col, text_col, threshold)
    if found is None:
        return rows.select(F.col("doc_id").alias("left_id"), F.col("doc_id").alias("right_id"), F.lit(1.0).alias("similarity")).where("false")
    a, b = (bags.select(F.col("bag").alias(x), F.col("rep_id").alias(y)) for x, y in (("a", "left_id"), ("b", "right_id")))
    return found.join(a, "a").join(b, "b").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of the least id. Texts stay where they are: the multiset key is made again
    and rows to drop are looked up by it; only rows repeated in id and text are brought together."""
    rows, bags, _ = _classes(docs, id_col, text_col, threshold)
    lost = rows.join(bags.select("bag", "rep_id", "keeper"), "bag").where(~F.col("keeper") | ~F.col("doc_id").eqNullSafe(F.col("rep_id")))
    lost = settle(lost.select(F.col("bag").alias(MARK), F.col("doc_id").alias("__dup_id")).distinct())
    twice = settle(rows.where("bag IS NOT NULL").groupBy("bag", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bag").alias(MARK), F.col("doc_id").alias("__dup_id")))
    marked = docs.mapInArrow(_mark(docs.columns.index(text_col)), StructType([*docs.schema.fields, StructField(MARK, BinaryType())]))
    on = lambda t: (marked[MARK] == t[MARK]) & marked[id_col].cast("long").eqNullSafe(t["__dup_id"])
    kept = _semi(marked, lost, on(lost), "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = _semi(kept, twice, on(twice), "left_anti")
    many = _semi(kept, twice, on(twice)).dropDuplicates([MARK, id_col])
    return once.unionAll(many).select(*docs.columns)
