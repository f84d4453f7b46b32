"""Queries over whole texts."""

from crategraph import plans


def test_document_keys_read_beyond_the_80th_character(spark, tmp_path):
    same = "word " * 20
    spark.createDataFrame([(1, same + "alpha"), (2, same + "omega")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in plans.QUERIES["document_keys"](spark, str(tmp_path)).collect()}
    for key in ("title", "certified", "identity"):
        assert rows[1][key].lower().endswith("alpha") and rows[2][key].lower().endswith("omega")
