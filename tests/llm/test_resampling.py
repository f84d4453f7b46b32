"""Operator 13 against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from crategraph.llm import resampling


def plain(docs, target, percent=10, least=20):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), x or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for x in some for w in words(x)) for some in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    out = []
    for i, x in docs:
        w = words(x)
        weight = sum(math.floor(1000 * math.log((t[bucket(v)] + 1.0) * big_s / ((s[bucket(v)] + 1.0) * big_t))) for v in w)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, map(tuple, out)))


def test_crc32():
    texts = [b"", b"a", b"abc", "日本語".encode(), b"x" * 48, b"y" * 49, b"z" * 5_000]
    ends = np.cumsum([len(x) for x in texts])
    got = resampling.crc32(np.frombuffer(b"".join(texts), np.uint8), ends - [len(x) for x in texts], ends)
    assert got.tolist() == [zlib.crc32(x) for x in texts]


def test_whole_result(spark, odd, odd_rows, nothing):
    target = [" ".join(f"word{k}" for k in range(50)), None, "", "Other ÉTÉ 12-34"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    for percent in (10, 100):
        rows = resampling.resample(odd, frame, percent=percent).collect()
        assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in rows) == plain([r[:2] for r in odd_rows], target, percent)
    many = [(k, " ".join(f"word{(k * 7 + j) % 211}" for j in range(k % 60))) for k in range(500)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(7)
    rows = resampling.resample(docs, frame).collect()
    assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in rows) == plain(many, target)
    assert resampling.resample(nothing, frame).count() == 0
    assert resampling.resample(odd, nothing).count() == odd.count()
