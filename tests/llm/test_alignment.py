"""Operator 11 against a plain walk over both tokenizations of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crategraph.llm import alignment
from crategraph.llm.queries import QUERIES

ODD = ["", None, "a", " ", "  two  blanks \n\n and\tmore ", "▁", "a ▁ b", "word ▁▁ 日本語 ñ é", "<|endoftext|> </s> <0x41> <s>x", "\x00\x01\x1c\x85  x 　y", "x" * 5_000, "é" * 3_000, "it's they'll 12345 -- !!", "same text here", "same text here", "🙂 🙂🙂 é", "trailing ", "a\r\n b  c  d", "ﬁ ﬂ Å Ⅳ"]


def walk(rows):
    """Rows of ``align`` for (doc_id, text), each text tokenized whole."""
    t = alignment.tokenizers(alignment.FOLDER)
    each = []
    for i, text in rows:
        a = [t.a.encode(" " + text, add_special_tokens=False).ids] if text else [[]]
        b = [t.b.encode(text)] if text else [[]]
        back = lambda ids, table: b"".join(table[k] for k in ids)
        ok = [bool(text) and back(a[0], t.a_bytes) == back(b[0], t.b_bytes) == (" " + text).encode()]
        groups, x, y = [], [], []
        if ok[0]:
            ends, at = {}, 0
            for k in b[0]:
                at += len(t.b_bytes[k])
                ends[at] = len(ends)
            at = pos = 0
            for k in a[0]:
                x.append(k)
                at += len(t.a_bytes[k])
                if at in ends:
                    groups.append((x, b[0][pos : ends[at] + 1]))
                    x, pos = [], ends[at] + 1
        each.append((i, len(a[0]) if ok[0] else 0, len(b[0]) if ok[0] else 0, groups))
    holds = Counter()
    for _, _, _, groups in each:
        holds.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    top = Counter()
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for i, n_a, n_b, groups in each:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
plain = lambda df: sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


@pytest.mark.parametrize("unit_bytes", [1, 4_000, 1 << 24])
def test_odd_texts(spark, unit_bytes):
    rows = [(k if k else None, x) for k, x in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, unit string, pair long").repartition(3)
    assert plain(alignment.align(docs, unit_bytes=unit_bytes)) == sorted(map(str, walk(rows)))


def test_texts_that_do_not_come_back_have_no_tokens(spark):
    rows = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame([(1, "a ▁ b"), (2, "a b")], "doc_id long, text string")).collect()}
    assert rows[1]["n_a"] == rows[1]["n_links"] == 0 and rows[1]["groups_sha256"] == "" and rows[2]["n_a"] > 0


def test_whole_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert plain(QUERIES["op11_cross_tokenizer_alignment"](spark, small)) == sorted(map(str, walk([tuple(r) for r in docs.collect()])))


def test_empty_table_and_odd_columns(spark, odd, nothing):
    assert alignment.align(nothing).count() == 0
    assert alignment.align(odd).count() == odd.count()


def test_groups_of_one_hash_are_told_apart(monkeypatch):
    a, b = np.array([1, 2, 1], np.int32), np.array([7, 8, 7], np.int32)
    of = np.arange(3)
    real, calls = alignment.T.mix, []

    def weak(x):
        calls.append(1)
        return real(x) if len(calls) > 3 else np.zeros(np.shape(x), np.uint64)

    monkeypatch.setattr(alignment.T, "mix", weak)
    first, inverse = alignment.group_numbers(a, b, of, of, 3)
    assert inverse[0] == inverse[2] != inverse[1] and len(first) == 2


def test_many_partitions_and_repeated_rows(spark):
    base = [(k, f"alpha beta gamma{k % 7} delta") for k in range(60)]
    docs = spark.createDataFrame(base + base[:5], "doc_id long, text string")
    assert plain(alignment.align(docs.repartition(9, F.col("doc_id")), unit_bytes=200)) == sorted(map(str, walk(base + base[:5])))
