"""Operator 12 against its SQL on planted contexts, and spans by hand."""

import random

import pytest

from crategraph.llm import personal_data
from crategraph.llm.queries import personal_data_sql
from tests.compare import assert_same

from .conftest import prose


def luhn_card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    total = sum(x if k % 2 else 2 * x - 9 * (x > 4) for k, x in enumerate(body))
    return "".join(map(str, [*body, -total % 10]))


def spans(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["spans"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_found"]))
    return out


@pytest.fixture(scope="module")
def planted():
    """Contexts that announce identifiers, known and unknown ones in them, and ordinary text around."""
    rng = random.Random(3)
    rows = []
    for k in range(12):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((k, f"{prose(k, 30)} you can Reach me at {phone} {prose(k + 100, 20)}\nCard number: {luhn_card(rng)} of {prose(k + 200, 5)}"))
    rows.append((100, f"{prose(7, 10)} reach me at 5552485911 please"))  # no known shape, a known context
    rows.append((101, "card number: 4111222233334444 here"))  # fails the check digit
    rows.append((102, f"word1 word2 5552485911 {prose(8, 9)} and 5551234567"))  # the same number elsewhere; another one
    rows.append((103, "new sign 5552485911 x\nnew sign 1112223334 x\nnew sign (7778889990 x\n\n5550001112"))
    rows.append((104, rows[0][1]))
    rows.append((104, rows[0][1]))
    rows.append((105, "a.b+c@mail-1.example.com_d@e.f.g x@y 10.0.0.256 10.1.2.3.4.5.6.7 0.0.0.0000255 +1 2 3 +12345678 1234 5678-9012 3456 78901"))
    rows.append((106, None))
    rows.append((None, "mail: u@v.org, 🙂 1.2.3.4"))
    rows.append((107, "9" * 50_000 + " " + "a" * 50_000 + " " + "1 " * 5_000 + "1." * 5_000))
    return rows


def test_discovers_and_agrees_with_sql(spark, planted, tmp_path):
    docs = spark.createDataFrame([(i, x, "q", 1) for i, x in planted], "doc_id long, text string, kind string, start long").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = personal_data.extract(docs)
    assert_same(out, personal_data_sql(), str(tmp_path))
    got = spans(out)
    text = dict(planted)
    said = lambda i: [(s.split(":")[0], text[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i][0][0].split(",") if s]
    assert said(100) == [("phone", "5552485911")] and got[100][0][5] == 1
    assert got[102][0][5] == 0  # most of the number's places say nothing
    assert said(101) == [("card", "4111222233334444")]
    assert len(got[104]) == 2 and got[104][0] == got[0][0] and got[0][0][5] == 0 and got[0][0][3:5] == (1, 1)
    assert ("email", "a.b+c@mail-1.example.com") in said(105) and ("email", "_d@e.f.g") in said(105)
    assert [x for k, x in said(105) if k == "ip"] == ["10.1.2.3", "4.5.6.7", "0.0.0.0000255"]
    assert got[106][0] == ("", 0, 0, 0, 0, 0)
    assert said(None) == [("email", "u@v.org"), ("ip", "1.2.3.4")]


def test_copies_do_not_make_support(spark):
    """A context of one number, however often it is copied, discovers nothing; two rounds let a found value support a new context."""
    rows = [(k, "dial it: +1 (555) 555-1234") for k in range(50)] + [(99, "dial it: 5556667778")]
    assert spans(personal_data.extract(spark.createDataFrame(rows, "doc_id long, text string")))[99] == [("", 0, 0, 0, 0, 0)]
    rows = [(1_000 + k, f"phone: +1 (555) 555-{1000 + k}") for k in range(300)]
    for k in range(20):
        rows += [(20 + k, f"phone: 55566677{10 + k}"), (40 + k, f"phone: 55566677{10 + k}"), (60 + k, f"ring: 55566677{10 + k}")]
    rows += [(80, "ring: 1231231234"), (81, "other: 1231231239")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, once = spans(personal_data.extract(docs)), spans(personal_data.extract(docs, rounds=1))
    assert got[20][0][5] == got[60][0][5] == once[60][0][5] == 1
    assert (once[80][0][5], got[80][0][5], got[81][0][5]) == (0, 1, 0)


def test_odd_and_empty_tables(spark, odd, nothing):
    rows = personal_data.extract(odd).collect()
    assert len(rows) == odd.count() and all(r["n_found"] == 0 for r in rows)
    assert personal_data.extract(nothing).count() == 0
