"""Every operator and stage on odd and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crategraph.llm import decontaminate, language_model, mixing, near_dedup, quality_classifier, quality_rules, sharding, toxicity, url_filter, warc

from .conftest import prose


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(2)), (2, None), (None, ""), (3, "too short"), (3, "too short")], "item_id long, text string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def test_decontaminate(odd, nothing, items):
    found = decontaminate.overlaps(odd, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(None, 1), (None, 1)]
    assert decontaminate.remove(odd, items).count() == odd.count() - 2
    assert decontaminate.overlaps(nothing, items).count() == 0
    assert decontaminate.overlaps(odd, items.limit(0)).count() == 0
    assert decontaminate.remove(odd, items.limit(0)).count() == odd.count()


def test_quality_rules(odd, nothing):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0 and by[4]["base_failed"]
    assert by[10]["n_symbols"] == 7 and by[7]["n_words"] == 30_000
    assert quality_rules.judge(nothing).count() == 0


def test_sharding(odd, nothing):
    rows = sharding.shard(odd, limit=2_000).collect()
    assert len(rows) == odd.count() and "score" in rows[0].asDict() and "kept" in rows[0].asDict()
    assert sorted(str(r["input_shard"]) for r in rows) == sorted(str(r["shard"]) for r in odd.collect())
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(x) <= 2_000 or len(x) == 1 for x in sizes.values())
    assert all(sum(sizes[r["shard"]]) == r["shard_bytes"] for r in rows)
    assert sharding.shard(nothing, limit=10).count() == 0


def test_repeated_rows_fill_pages(odd, spark):
    same = spark.range(20).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    rows = sharding.shard(same.repartition(4), limit=350).groupBy("shard", "shard_bytes").count().collect()
    assert sorted(r["count"] for r in rows) == [2, 3, 3, 3, 3, 3, 3]
    assert all(r["shard_bytes"] == 100 * r["count"] for r in rows)


def test_near_dedup(odd, nothing):
    rows = near_dedup.classes(odd).collect()
    by = [(r["doc_id"], r["class_id"]) for r in rows]
    assert sorted((a, b) for a, b in by if a is not None) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (10, 10)]
    assert [b for a, b in by if a is None] == [None, None]
    assert ids(near_dedup.keep_one(odd)) == [1, 4, 5, 6, 7, 8, 10, None]
    assert near_dedup.classes(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0


def test_mixing(odd, nothing):
    p = mixing.plan(odd, repetition_limit=3.0)
    rows = mixing.realise(odd, p, block_tokens=1_000).collect()
    assert sum(r["epoch"] == 0 for r in rows) == odd.count()
    assert mixing.apply(odd, p).columns == odd.columns
    assert sorted(map(str, ids(mixing.apply(odd, p)))) == sorted(str(r["doc_id"]) for r in rows)
    empty = mixing.plan(nothing)
    assert mixing.realise(nothing, empty).count() == 0 and mixing.apply(nothing, empty).count() == 0


def test_warc(spark):
    big = "z" * 200
    rows = [(3, "http://a/ x\n", big, 1), (1, None, big, 2), (1, None, big, 2), (None, "u", big, 3), (2, "v", "tiny", 4), (5, "w", "tiny", 5), (6, "w", None, 6), (None, None, None, None), (7, "q", "é" * 300_000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    back = warc.read(warc.write(pages, shard_bytes=500, file_bytes=300)).collect()
    assert len(back) == len(rows)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    assert got == sorted([("3", "revisit", 1, 200), ("1", "response", None, 200), ("1", "response", None, 200), ("None", "revisit", 1, 200), ("2", "response", None, 4), ("5", "response", None, 4), ("6", "response", None, 0), ("None", "response", None, 0), ("7", "response", None, 600_000)])
    assert {r["payload"].decode() for r in back if r["payload"] is not None} == {big, "tiny", "", "é" * 300_000}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_spreads_repeated_rows(spark):
    """10,000 equal rows are no single shard's, and each is written."""
    pages = spark.range(10_000).select(F.lit(5).alias("page_id"), F.lit("u").alias("url"), F.lit("y" * 150).alias("html")).union(spark.sql("SELECT 9, 'u', repeat('y', 150)"))
    manifest = warc.write(pages, shard_bytes=500_000)
    sizes = [r[0] for r in manifest.groupBy("shard").agg(F.sum("records") - F.count("*")).collect()]
    assert len(sizes) >= 9 and max(sizes) <= 500_000 // 450 + 1
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]): r["count"] for r in warc.read(manifest).groupBy("page_id", "record_type", "refers_to").count().collect()}
    assert kinds == {(5, "response", None): 10_000, (9, "revisit", 5): 1}


def test_warc_is_deterministic(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), F.lit(20)).alias("html"))
    one = warc.write(pages.repartition(5), str(tmp_path / "a"), shard_bytes=30_000, file_bytes=4_000)
    two = warc.write(pages.repartition(2), str(tmp_path / "b"), shard_bytes=30_000, file_bytes=4_000)
    name = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["digest"], r["records"]) for r in df.collect())
    assert name(one) == name(two) and len(name(one)) > 6
    read = warc.read(two).orderBy("page_id").select("page_id").collect()
    assert [r[0] for r in read] == list(range(300))


def test_classifiers(odd, nothing, odd_labels):
    for module, label in ((quality_classifier, "quality"), (toxicity, "toxic")):
        model = module.fit(odd, odd_labels, label_col=label)
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(nothing, model).count() == 0
        none = module.fit(nothing, odd_labels.limit(0), label_col=label)
        assert module.score(odd, none).count() == odd.count()
    assert toxicity.reject(nothing, model).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://X.ORG/p?q"), (1, "http://X.ORG/p?q"), (2, None), (3, ""), (4, "no scheme"), (None, "s://a.com#f"), (5, "http://org"), (6, "http://ba.com/")], "page_id long, url string")
    for bits, filters in ((1 << 23, 64), (16, 64), (8, 1)):
        rows = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, max_bits=bits, max_filters=filters).collect())
        assert rows == sorted([("1", "x.org", "/p", "org/", "block")] * 2 + [("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "", "", None, "allow"), ("None", "a.com", "", "a.com", "block"), ("5", "org", "", None, "allow"), ("6", "ba.com", "/", None, "allow")])
        assert url_filter.judge_urls(pages.limit(0), rules, max_bits=bits, max_filters=filters).count() == 0
        assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), max_bits=bits, max_filters=filters).collect()} == {"allow"}


def test_language_model(odd, nothing):
    rows = language_model.score(odd, language_model.fit(odd, head=50)).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == by[6]["n_tokens"] == 1 and by[7]["n_tokens"] == 30_001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    empty = language_model.fit(nothing)
    assert language_model.score(nothing, empty).count() == 0
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in language_model.score(odd, empty).collect())


def test_pipeline_stages(spark, odd, nothing, tmp_path):
    for name in ("labels", "benchmark"):
        table = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int") if name == "labels" else spark.createDataFrame([(1, prose(2))], "item_id long, text string")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
