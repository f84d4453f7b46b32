"""Exact similarity and containment joins of short texts within a block such as an artist, however large the block.

``nearest`` gives each left text its best partners under the similarity ratio. What matches is a common subsequence, so twice the
length of the longest one over the total of letters bounds a ratio. Partners of up to 63 letters are kept by their beginnings:
the longest common subsequence with a beginning, and the letters that can still follow, bound all partners that begin so, and none of
them is looked at where that is below the worst one kept. A first walk that follows only the best ``BEAM`` beginnings finds what is
worth keeping. Longer texts have at least the letters in common that they match in, which bounds their ratios. Nothing is lost.
A block is cut into cells of ``side`` texts by so many partners, so that what a task holds is bounded; small blocks share a
task. ``containing`` looks a text up by its rarest piece of four characters among the pieces of the texts that may contain it, so
that what meets is little more than what fits.
"""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.functions.text import ratio
from crategraph.shared import join_measured, settle

#: Texts of a cell, and for each of them so many partners.
SIDE, PARTNERS = 8_000, 4
#: Tasks that share the blocks of one cell.
CELLS = 1 << 16
#: Letters are counted under their code modulo this; letters that fall together only raise the bound.
LETTERS = 64
PIECE = 4


def letter_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), LETTERS), np.int16)
    for k, x in enumerate(texts):
        np.add.at(out[k], np.frombuffer(x.encode("utf-32-le"), np.uint32) % LETTERS, 1)
    return out


#: Texts of at most so many letters have their common subsequences counted in machine words.
WORD = 63
#: Beginnings that the first walk follows; texts that walk together, fewer where they would meet more beginnings than ``PAIRS`` at once.
BEAM, TOGETHER, PAIRS = 8, 256, 1 << 20
EPS = 1e-12


class Beginnings:
    """Distinct texts of at most ``WORD`` letters in order, by their beginnings: for each length, where the texts of a beginning
    lie, its last letter, which beginnings go on from it, and the least and greatest sizes of its texts."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.letters = {c: k for k, c in enumerate(sorted({c for x in texts for c in x}), 1)}
        codes = np.zeros((len(texts), int(self.sizes.max(initial=0))), np.int32)
        for row, x in enumerate(texts):
            codes[row, : len(x)] = [self.letters[c] for c in x]
        lo, hi, letter = np.zeros(min(1, len(texts)), np.int64), np.full(min(1, len(texts)), len(texts)), np.zeros(min(1, len(texts)), np.int64)
        self.levels = []
        new = np.arange(len(texts)) == 0
        for t in range(codes.shape[1] + 1):
            spans = np.stack([lo, hi], 1).ravel()
            whole = np.append(self.sizes, 0)  # a span may end with the last text
            least, most = (f.reduceat(np.append(self.sizes, fill), spans)[::2] if len(lo) else lo for f, fill in ((np.minimum, WORD + 1), (np.maximum, 0)))
            ends = whole[lo] == t
            if t < codes.shape[1]:
                new = new | np.concatenate([[True], codes[1:, t] != codes[:-1, t]])
                edges = np.append(np.flatnonzero(new), len(texts))
                there = codes[edges[:-1], t] > 0
                below = edges[:-1][there]
                kids = np.searchsorted(below, lo), np.searchsorted(below, hi)
                self.levels.append((lo, hi, letter, least, most, ends, *kids))
                lo, hi, letter = below, edges[1:][there], codes[below, t].astype(np.int64)
            else:
                self.levels.append((lo, hi, letter, least, most, ends, np.zeros_like(lo), np.zeros_like(lo)))

    def places(self, texts: list[str]) -> np.ndarray:
        """The places of each letter in each text as bits."""
        out = np.zeros((len(texts), len(self.letters) + 1), np.uint64)
        for q, x in enumerate(texts):
            for k, c in enumerate(x):
                if c in self.letters:
                    out[q, self.letters[c]] |= np.uint64(1 << k)
        return out

    def walk(self, texts: list[str], places: np.ndarray, floor: np.ndarray, after: np.ndarray, beam: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, row, bound) for the rows from ``after`` on whose bound reaches the ``floor`` of the text; with ``beam`` only along
        so many beginnings of each length. The sum counts all letters at once: what it leaves out of the places is in the subsequence."""
        size = np.array([len(x) for x in texts], np.int64)
        full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        q = np.arange(len(texts) if len(self.sizes) else 0)
        node, left, found = np.zeros(len(q), np.int64), full[q], []
        for t, (lo, hi, letter, least, most, ends, first, last) in enumerate(self.levels):
            if t:
                met = left & places[q, letter[node]]
                left = ((left + met) | (left - met)) & full[q]
            common = np.bitwise_count(left ^ full[q]).astype(np.int64)
            # of the sizes of its texts, the one with the highest bound: all that follows can match up to there
            best = np.clip(size[q] - common + t, least[node], most[node])
            total = size[q] + best
            bound = np.where(total == 0, 1.0, 2.0 * np.minimum(common + best - t, size[q]) / np.maximum(total, 1))  # two empty texts are alike
            keep = np.flatnonzero((bound >= floor[q] - EPS) & (hi[node] > after[q]))
            if beam and len(keep) > beam:
                keep = keep[np.lexsort((-bound[keep], q[keep]))]
                begin = np.flatnonzero(np.concatenate([[True], q[keep][1:] != q[keep][:-1]]))
                keep = keep[np.arange(len(keep)) - np.repeat(begin, np.diff(np.append(begin, len(keep)))) < beam]
            q, node, left, common = q[keep], node[keep], left[keep], common[keep]
            own = np.flatnonzero(ends[node] & (lo[node] >= after[q]))
            total = size[q[own]] + t
            exact = np.where(total == 0, 1.0, 2.0 * common[own] / np.maximum(total, 1))
            own, exact = own[exact >= floor[q[own]] - EPS], exact[exact >= floor[q[own]] - EPS]
            found.append((q[own], lo[node[own]], exact))
            n = last[node] - first[node]
            if n.sum() > PAIRS and len(texts) > 1:
                half = len(texts) // 2
                parts = [(k, self.walk(texts[k:to], places[k:to], floor[k:to], after[k:to], beam)) for k, to in ((0, half), (half, len(texts)))]
                return tuple(np.concatenate(x) for x in zip(*((found[0] + k, *found[1:]) for k, found in parts)))
            node = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, left = np.repeat(q, n), np.repeat(left, n)
        return tuple(np.concatenate(x) for x in zip(*found))


class Partners:
    """Texts that others are held against, with what bounds their ratios."""

    def __init__(self, texts: list[str], ids: list):
        rows: dict[str, list] = {}
        for x, i in zip(texts, ids):
            rows.setdefault(x, []).append(i)
        self.texts = sorted(rows)
        self.ids = [sorted(rows[x]) for x in self.texts]
        self.short = [k for k, x in enumerate(self.texts) if len(x) <= WORD]
        self.long = np.array([k for k, x in enumerate(self.texts) if len(x) > WORD], np.int64)
        self.begun = Beginnings([self.texts[k] for k in self.short])
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def counted(self, text: str, rows: np.ndarray, kind: str) -> np.ndarray:
        """The most that each ratio with ``text`` can be by shared letters."""
        if kind not in self.held:
            self.held[kind] = letter_counts([self.texts[k] for k in rows]), np.array([len(self.texts[k]) for k in rows], np.int64)
        counts, sizes = self.held[kind]
        total = sizes + len(text)
        return np.where(total == 0, 1.0, 2.0 * np.minimum(counts, letter_counts([text])).sum(1) / np.maximum(total, 1))

    def _ratio(self, text: str, row: int, known: dict[int, float]) -> float:
        if row not in known:
            known[row] = SequenceMatcher(None, text, self.texts[row]).ratio()
        return known[row]

    def _kept(self, text: str, rows: list[int], bounds: list[float], floor: float, keep: int, known: dict[int, float]) -> list[tuple[float, object]]:
        """Up to ``keep`` (score, id) at ``floor`` or more, by falling score and rising id. A partner that could at best equal the
        worst one kept is compared only if its id is smaller."""
        best: list[tuple[float, object]] = []
        for bound, row in sorted(zip(bounds, rows), key=lambda x: (-x[0], self.ids[x[1]][0])):
            if bound < (floor if len(best) < keep else max(floor, best[-1][0])) - EPS:
                break
            if len(best) == keep and bound <= best[-1][0] and not self.ids[row][0] < best[-1][1]:
                continue
            score = self._ratio(text, row, known)
            if score >= floor:
                best = sorted([*best, *((score, i) for i in self.ids[row][:keep])], key=lambda x: (-x[0], x[1]))[:keep]
        return best

    def best(self, texts: list[str], floors: list[float], keep: int, above: bool) -> list[list[tuple[float, object]]]:
        """For each text up to ``keep`` (score, id) at its floor or more, by falling score and rising id."""
        out: list[list[tuple[float, object]]] = [[] for _ in texts]
        fit = [n for n, x in enumerate(texts) if len(x) <= WORD]
        for at in range(0, len(fit), TOGETHER):
            some = fit[at : at + TOGETHER]
            for n, found in zip(some, self._walked([texts[n] for n in some], [floors[n] for n in some], keep, above)):
                out[n] = found
        every = np.arange(len(self.texts))
        for n, x in enumerate(texts):
            if len(x) > WORD:
                out[n] = self._kept(x, *self._at_least(x, every, "all", floors[n], above), floors[n], keep, {})
        return out

    def _at_least(self, text: str, rows: np.ndarray, kind: str, floor: float, above: bool) -> tuple[list[int], list[float]]:
        bounds = self.counted(text, rows, kind)
        on = np.flatnonzero(bounds >= floor - EPS)
        if above:
            on = on[rows[on] >= bisect_right(self.texts, text)]
        return rows[on].tolist(), bounds[on].tolist()

    def _walked(self, texts: list[str], floors: list[float], keep: int, above: bool) -> list[list[tuple[float, object]]]:
        places, floor = self.begun.places(texts), np.array(floors)
        after = np.array([bisect_right(self.short, x, key=lambda k: self.texts[k]) if above else 0 for x in texts], np.int64)
        known: list[dict[int, float]] = [{} for _ in texts]

        def by_text(q: np.ndarray, row: np.ndarray, bound: np.ndarray) -> list[tuple[list[int], list[float]]]:
            order = np.argsort(q, kind="stable")
            edges = np.searchsorted(q[order], np.arange(len(texts) + 1))
            row, bound = row[order], bound[order]
            return [([self.short[k] for k in row[i:j].tolist()], bound[i:j].tolist()) for i, j in zip(edges[:-1], edges[1:])]

        for n, (rows, bounds) in enumerate(by_text(*self.begun.walk(texts, places, floor, after, BEAM))):
            first = self._kept(texts[n], rows, bounds, floors[n], keep, known[n])
            if len(first) == keep:
                floor[n] = max(floor[n], first[-1][0])
        out = []
        for n, (rows, bounds) in enumerate(by_text(*self.begun.walk(texts, places, floor, after))):
            if len(self.long):
                more = self._at_least(texts[n], self.long, "long", float(floor[n]), above)
                rows, bounds = rows + more[0], bounds + more[1]
            out.append(self._kept(texts[n], rows, bounds, float(floor[n]), keep, known[n]))
        return out


def squares(left: DataFrame, right: DataFrame, by: list[str], *, keep: int, side: int = SIDE, partners: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of ``left`` with the __cell of each square of ``side`` texts by ``partners`` times as many that they are in, and
    rows of ``right`` with theirs (__in). Every pair of a block is in one cell."""
    key = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by))
    there = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "text"]))
    some = settle(there(left).select(*by, "text").distinct())
    first = Window.partitionBy(*by, "text").orderBy("right_id")
    other = there(right).select(*by, "text", "right_id").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= keep).drop("__n")
    other = settle(other)
    sizes = some.groupBy(*by).agg(F.count("*").alias("__l")).join(other.groupBy(*by).agg(F.count("*").alias("__r")), by)
    sizes = sizes.select(*by, *(F.ceil(F.col(c) / n).cast("int").alias(c) for c, n in (("__l", side), ("__r", side * partners))))
    # blocks of one square share cells; a larger block has a cell for each square
    lone = F.concat(F.lit("~"), F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("string"))
    cell = lambda i, j: F.when((F.col("__l") == 1) & (F.col("__r") == 1), lone).otherwise(F.concat_ws("\x1f", key, i, j))
    mine = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int").cast("string")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = some.join(sizes, by).withColumn("__j", each("__r")).select(*by, "text", cell(mine("__l", "text"), F.col("__j").cast("string")).alias("__cell"), key.alias("__key"))
    # new names on this side: both may come from one table
    cols = other.join(sizes, by).withColumn("__i", each("__l"))
    cols = cols.select(F.col("text").alias("partner"), F.col("right_id").alias("id"), cell(F.col("__i").cast("string"), mine("__r", "right_id", "text")).alias("__in"), key.alias("__of"))
    return rows, cols


def nearest(left: DataFrame, right: DataFrame, by: list[str], *, floor: float, keep: int, above: bool = False, floors: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """(by, text, right_id, score): for each distinct text of ``left`` (by, text) its ``keep`` best rows of ``right`` (by, text,
    right_id) with a ratio of ``floor`` or more, ties to the smaller id. ``above``: only texts greater than its own. ``floors`` (by,
    floor) has higher floors of some blocks.

    Null keys and texts have no partners. Of right rows with one text only the ``keep`` least ids can be among the best, so
    only they are compared."""
    rows, cols = squares(left, right, by, keep=keep, side=side, partners=PARTNERS)
    own = F.lit(float(floor))
    rows = (rows if floors is None else rows.join(floors.select(*by, "floor"), by, "left").withColumn("__own", F.greatest("floor", own)).drop("floor")).withColumn("__floor", own if floors is None else F.col("__own"))
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, right.schema["right_id"]]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "text", "right_id"]) + ", score double"

    def compare(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        of: dict[str, tuple[list[str], list]] = {}
        for k, x, i in zip(r["__of"].to_pylist(), r["partner"].to_pylist(), r["id"].to_pylist()):
            texts, ids = of.setdefault(k, ([], []))
            texts.append(x)
            ids.append(i)
        mine: dict[str, list[int]] = {}
        for n, k in enumerate(l["__key"].to_pylist()):
            mine.setdefault(k, []).append(n)
        texts, floors = l["text"].to_pylist(), l["__floor"].to_pylist()
        at, ids, scores = [], [], []
        for k in mine.keys() & of.keys():
            found = Partners(*of[k]).best([texts[n] for n in mine[k]], [floors[n] for n in mine[k]], keep, above)
            for n, best in zip(mine[k], found):
                for score, i in best:
                    at.append(n)
                    ids.append(i)
                    scores.append(score)
        out = l.select([*by, "text"]).take(pa.array(at, pa.int64()))
        return out.append_column("right_id", pa.array(ids, r.schema.field("id").type)).append_column("score", pa.array(scores, pa.float64()))

    found = rows.groupBy("__cell").cogroup(cols.groupBy("__in")).applyInArrow(compare, schema)
    order = Window.partitionBy(*by, "text").orderBy(F.desc("score"), "right_id")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def closest(df: DataFrame, by: list[str], *, keep: int) -> DataFrame:
    """(by, text, right_id, score, n): the ``keep`` pairs of texts of each block (by, text) of the highest ratios above 0, text the
    smaller one, ties by texts. Texts next to each other in order give a floor that all of these reach."""
    texts = settle(df.select(*by, "text").where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "text"])).distinct())
    beside = texts.withColumn("next", F.lead("text").over(Window.partitionBy(*by).orderBy("text"))).where("next IS NOT NULL")
    rank = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *order))
    floors = settle(beside.select(*by, ratio("text", "next").alias("score")).withColumn("n", rank()).where(F.col("n") == keep).select(*by, F.col("score").alias("floor")))
    found = nearest(texts, texts.withColumn("right_id", F.col("text")), by, floor=1e-9, keep=keep, above=True, floors=floors)
    return found.withColumn("n", rank("text", "right_id")).where(F.col("n") <= keep)


def _pieces(c: str, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(F.col(c), i, size)))


def containing(short: DataFrame, long: DataFrame, by: list[str], piece: str, text: str) -> DataFrame:
    """Rows of ``short`` and ``long`` with equal ``by`` where column ``text`` of long contains column ``piece`` of short; columns of
    both, whose names must differ but for ``by``. An empty or null piece is contained in nothing here.

    Each piece of four characters (fewer, where the text has no more) is counted over the long texts; a short text is looked up
    by its rarest one, and not at all if one of its pieces occurs nowhere."""
    found = settle(_contained(short, long, by, piece, text))
    return short.join(found, [*by, piece]).join(long, [*by, text])


def _contained(short: DataFrame, long: DataFrame, by: list[str], piece: str, text: str) -> DataFrame:
    """Distinct (by, piece, text) of ``containing``."""
    size = F.least(F.length(piece), F.lit(PIECE))
    texts = settle(short.where(F.length(piece) > 0).select(*by, piece).distinct())
    sizes = sorted(r[0] for r in texts.select(size).distinct().collect())  # four at most
    cut = F.flatten(F.array(*(F.when(F.length(text) >= n, _pieces(text, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes or [PIECE])))
    held = settle(long.select(*by, text).distinct()).select(*by, text, F.explode(cut).alias("__piece"))
    counts = held.groupBy("__piece").agg(F.count("*").alias("__n"))
    mine = texts.select(piece).distinct().select(piece, F.explode(_pieces(piece, size)).alias("__piece"))
    rarest = mine.join(counts, "__piece", "left").groupBy(piece).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("p"))).alias("__r"))
    rarest = rarest.where("__r.n > 0").select(piece, F.col("__r.p").alias("__piece"))
    return texts.join(rarest, piece).join(held, [*by, "__piece"]).where(F.contains(text, piece)).select(*by, piece, text)


def unblocked(short: DataFrame, long: DataFrame, piece: str, text: str) -> DataFrame:
    """Distinct (piece, text) where a text of ``long`` contains one of ``short``."""
    one = F.lit(0).alias("__all")
    return settle(_contained(short.select(piece, one), long.select(text, one), ["__all"], piece, text).select(piece, text))


def joined_scores(left: DataFrame, scores: DataFrame, by: list[str], text: str) -> DataFrame:
    """Rows of ``left`` with the partners that ``nearest`` gave their texts."""
    return join_measured(left, scores.withColumnRenamed("text", text), [*by, text], "inner")


def ratio_sql(pairs: str) -> str:
    """CTE ``alike`` (a, b, ratio) for DuckDB, after ``WITH RECURSIVE``: the similarity ratio of each pair of the relation
    ``pairs`` (a, b). The longest common stretch, the earliest in a and then in b, splits both texts; the rest on its left and on
    its right goes on alike."""
    longest = lambda x, y: f"list_max(flatten([[{{l: l, i: -i, j: -instr({y}, substr({x}, i, l))}} FOR l IN range(1, length({x}) - i + 2) IF contains({y}, substr({x}, i, l))] FOR i IN range(1, length({x}) + 1)]))"
    return f"""stretch(a, b, x, y, k) AS (
  SELECT a, b, a, b, {longest('a', 'b')} FROM (SELECT DISTINCT a, b FROM {pairs})
  UNION ALL
  SELECT a, b, c.x, c.y, {longest('c.x', 'c.y')}
  FROM (SELECT a, b, unnest([{{x: left(x, (-k.i - 1)::BIGINT), y: left(y, (-k.j - 1)::BIGINT)}}, {{x: substr(x, (k.l - k.i)::BIGINT), y: substr(y, (k.l - k.j)::BIGINT)}}]) AS c FROM stretch WHERE k IS NOT NULL)
  WHERE c.x <> '' AND c.y <> ''),
alike AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(sum(k.l), 0) / (length(a) + length(b)) END AS ratio FROM stretch GROUP BY a, b)
"""
