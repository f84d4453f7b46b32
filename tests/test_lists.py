"""Lists in several encodings and dialects, split or whole."""

import pytest
from pyspark.sql import functions as F

from crategraph.sources import csv


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes("Nom\tDate\nÉté\t3/2/2001\n\nÀ\x00B\t2001-02-04\n".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("﻿Nom|When|x\r\nÉté|a|\"p|q\"\r\n日本|b\r\n".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    return tmp_path


def test_lines(spark, folder):
    rows = {(r["file"][-5:], r["no"]): r["line"] for r in csv.decoded_lines(spark, f"{folder}/*.txt").collect()}
    assert rows == {("a.txt", 0): "Nom\tDate", ("a.txt", 1): "Été\t3/2/2001", ("a.txt", 2): "", ("a.txt", 3): "ÀB\t2001-02-04", ("b.txt", 0): "Nom|When|x", ("b.txt", 1): 'Été|a|"p|q"', ("b.txt", 2): "日本|b"}


def test_layouts_of_a_folder(spark, folder):
    rows = {(r["Nom"], r["Date"], r["When"], r["x"], str(r["day"])) for r in csv.probed(spark, f"{folder}/*.txt").collect()}
    assert rows == {("Été", "3/2/2001", None, None, "2001-02-03"), ("ÀB", "2001-02-04", None, None, "2001-02-04"), ("Été", None, "a", "p|q", "None"), ("日本", None, "b", None, "None")}
    assert csv.probed(spark, f"{folder}/c.txt").count() == 0


def test_a_large_file_is_split_and_numbered(spark, tmp_path):
    lines = [f"{k};é{k}" for k in range(5_000)]
    (tmp_path / "big.txt").write_bytes(("id;é\n" + "\n".join(lines)).encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = csv.decoded_lines(spark, str(tmp_path / "big.txt"))
        got = [(r["no"], r["line"]) for r in df.orderBy("no").collect()]
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(["id;é", *lines]))


@pytest.mark.parametrize("names, wanted, found", [(["a", "Release Date", "Date de constat"], "date de constat", "Date de constat"), (["a", "my_DATE", "date2"], None, "my_DATE"), (["a"], "a date", None), ([], None, None)])
def test_date_column(names, wanted, found):
    assert csv.date_column(names, wanted) == found


@pytest.mark.parametrize("text, day", [("2001-02-03", "2001-02-03"), (" 3/2/2001 ", "2001-02-03"), ("03.02.2001", "2001-02-03"), ("13-02-2001", "2001-02-13"), ("02/13/2001", "2001-02-13"), ("13/13/2001", "None"), ("soon", "None"), (None, "None")])
def test_days(spark, text, day):
    assert str(spark.createDataFrame([(text,)], "t string").select(csv.read_day(F.col("t"))).first()[0]) == day
