"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from crategraph.functions import catalog, parse, text


@pytest.fixture(scope="module")
def value(spark):
    def run(function, *args):
        names = [f"a{k}" for k in range(len(args))]
        kinds = ", ".join(f"{n} {'string' if a is None or isinstance(a, str) else 'bigint' if isinstance(a, int) else 'double'}" for n, a in zip(names, args))
        df = spark.createDataFrame([tuple(args)], kinds)
        return df.select(function(*(F.col(n) for n in names)).alias("out")).first()[0]

    return run


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Nuit blanche (feat. Zoé)", "nuit blanche"), ("Nuit blanche [with X & Y] ", "nuit blanche"), ("Nuit blanche ft. Zoé", "nuit blanche"), ("L’Été d'après", "lete dapres"), ("A.B.C. - Pt. 2", "abc pt2"), ("Vol. 3", "vol3"), ("  Trop   d'espace ", "trop despace"), (None, ""), ("Featherweight", "featherweight")],
)
def test_normalize_title(value, raw, expected):
    assert value(text.normalize_title, raw) == expected


@pytest.mark.parametrize(("raw", "expected"), [("  Héros & Co ", "HEROS AND CO"), ("Ca$h", "CASH"), ("Cœur", "COEUR"), ("L’amour – toujours…", "L'AMOUR - TOUJOURS"), ("«Été»!", "ETE"), (None, ""), ("÷", "")])
def test_normalize_certified(value, raw, expected):
    assert value(text.normalize_certified, raw) == expected


@pytest.mark.parametrize(
    ("raw", "shown", "key"),
    [("Maëlle (Producer)", "Maëlle", "maelle"), ("Dj​ Nord (FRA)", "Dj Nord", "dj nord"), ("D’Or", "D’Or", "d'or"), ("X (live)", "X (live)", "x (live)"), ("STRAẞE", "STRAẞE", "strasse"), ("東京", "東京", "東京"), (None, "", "")],
)
def test_credit_names(value, raw, shown, key):
    assert value(text.display_name, raw) == shown
    assert value(text.identity_key, raw) == key


@pytest.mark.parametrize(("raw", "expected"), [("C?UR DE PIRATE", "CŒUR DE PIRATE"), ("s?ur", "sœur"), ("L?amour", "L'amour"), ("aujourd?hui", "aujourd'hui"), ("DON?T", "DON'T"), ("Pourquoi ?", "Pourquoi ?"), ("?uvre", "œuvre"), ("a?b", "a?b")])
def test_restore_marks(value, raw, expected):
    assert value(text.restore_marks, raw) == expected


def test_other_keys(value):
    assert value(text.enrichment_title, "Été (Remix) feat. X!") == "ete"
    assert value(text.title_core, "Été [2011 Remaster] feat X") == "ete"
    assert value(text.plain_key, "Ça & là") == "ca la"
    assert value(text.loose_title_key, "Booska-Pogo (feat. X) [Live]") == "booska pogo"
    assert value(text.tempo_key, "L’Été  ") == "l'ete"
    assert value(text.line_key, "Oh, oh!  Yeah") == "oh oh yeah"
    assert value(text.slug, "L'Or du Commun") == "Lor-du-commun"
    assert value(text.file_slug, "Été / 2024!") == "ete-2024"
    assert value(text.contains_word, "IAM ET AKH", "IAM") is True
    assert value(text.contains_word, "WILLIAMS", "IAM") is False
    assert value(text.contains_word, "A+B (C)", "(C)") is True
    assert value(text.ratio, "rhythm", "rythm") == pytest.approx(10 / 11)
    assert value(text.containment_score, "Ann Lee", "Sun", "ann lee - sun") == 1.0
    assert value(text.containment_score, "Ann", "Sun", None) == 0.5


@pytest.mark.parametrize(("raw", "expected"), [("2020-02-03", "2020-02-03"), ("2020-02-03T04:05:06Z", "2020-02-03"), ("2020-02-03 04:05", "2020-02-03"), ("2020-02-03xyz", "2020-02-03"), ("2020-13-01", None), ("soon", None), ("", None), (None, None)])
def test_flexible_date(value, raw, expected):
    got = value(parse.flexible_date, raw)
    assert (got and got.strftime("%Y-%m-%d")) == expected


@pytest.mark.parametrize(("raw", "expected"), [("October 17, 2017", "2017-10-17"), ("oct 7, 2017", "2017-10-07"), ("3/4/2019", "2019-03-04"), ("2019-03-04", "2019-03-04"), ("whenever", "whenever"), ("None", ""), (None, "")])
def test_iso_date(value, raw, expected):
    assert value(parse.iso_date, raw) == expected


def test_iso_date_of_other_texts(value):
    """What no format takes stays, however near it comes; names may be written in any case."""
    kept = ("February 30, 2001", "May 32, 2001", "13/1/2001", "Sept 3, 2001", "May 2, 2001May 2, 2001", "May 2, 2001\n", "Mayo 2, 2001", "of May 2, 2001", "2001", "may")
    assert [value(parse.iso_date, x) for x in kept] == list(kept)
    assert [value(parse.iso_date, x) for x in ("MAY 2, 2001", " sep 03, 2001 ", "sEPTEMBER 3, 2001", "1/02/0999", " nOnE ")] == ["2001-05-02", "2001-09-03", "2001-09-03", "0999-01-02", ""]


def test_numbers(value):
    assert [value(parse.duration_seconds, x) for x in ("228", "3:48", "1:02:03", "None", "x:y", None)] == [228, 228, 3723, None, None, None]
    assert [value(parse.format_seconds, x) for x in (228, 3723)] == ["3:48", "1:02:03"]
    assert [value(parse.counted, x) for x in ("1,2 M", "500 k", "3 Md", "2B", "1 234 567", "none", None)] == [1_200_000, 500_000, 3_000_000_000, 2_000_000_000, 1_234_567, None, None]
    assert value(parse.digits, "1,234") == 1234
    assert [value(parse.video_id, x) for x in ("https://youtu.be/abcdefghijk?t=1", "https://y/watch?v=abcdefghijk", "https://y/embed/abcdefghijk", "https://y/shorts/abcdefghijk", "none", None)] == ["abcdefghijk"] * 4 + [None] * 2
    assert value(parse.lrc_line, 83_450, "hey") == "[01:23.45] hey"


def test_structures(value):
    lines = value(parse.timed_lines, "[00:01.50] One\nnoise\n [01:02] Two \n[00:03.123]Three")
    assert [(r["at"], r["text"]) for r in lines] == [(1.5, "One"), (62.0, "Two"), (4.23, "Three")]
    pairs = value(parse.dated_levels, "12/03/2019 : 2x Platine 01/02/2018 : Or")
    assert [(r["date"], r["level"]) for r in pairs] == [("2019-03-12", "2x Platine"), ("2018-02-01", "Or")]
    d = value(parse.song_details, "It has a C♯ key and a Minor mode, written with a C♯ key, time signature of 4 beats per bar")
    assert (d["mode"], d["key"], d["beats"]) == ("minor", "C♯", 4)
    assert value(parse.with_section_artist, "[Couplet 1]\nla\n[Refrain : B]", "A$AP") == "[Couplet 1 : A$AP]\nla\n[Refrain : B]"


@pytest.mark.parametrize(("raw", "expected"), [("C", 0), ("Do#", 1), ("Réb", 1), ("G♯/A♭", 8), ("Em", 4), ("7", 7), ("12", None), ("H", None), (None, None)])
def test_pitch_class(value, raw, expected):
    assert value(catalog.pitch_class, raw) == expected


def test_keys(value):
    assert [value(catalog.normalize_key, x) for x in ("G♯/A♭ majeur", "A minor", "Do# majeur", "Si", "x minor", None)] == ["Sol#/Lab majeur", "La mineur", "Do#/Réb majeur", None, None, None]
    assert value(catalog.french_key, 2, 0) == "Ré mineur"


def test_levels(value):
    assert [value(catalog.level_rank, x) for x in ("Double Platine", "2x Platine", "12x Platine", "or", "?", None)] == pytest.approx([6, 6.9, 6.1, 10, 99, 99])
    assert [value(catalog.plain_us_level, x) for x in ("4x Multi-Platinum", "MultiPlatinum", " Gold ")] == ["4x Platinum", "Platinum", "Gold"]
    assert [value(catalog.level_name, x) for x in ("double or", "DIAMANT", "x")] == ["Double Or", "Diamant", None]
    assert value(catalog.threshold, "Or", "Singles") == 15_000_000 and value(catalog.threshold, "Gold", "Singles") == 0
    assert [value(catalog.category_name, x) for x in ("single", "VIDEOS", None)] == ["Singles", "Vidéos", "Singles"]


def test_streams_and_kinds(value):
    assert [value(catalog.total_estimate, a, b) for a, b in ((40, 25), (40, 0), (0, 25), (0, 0))] == [100, 100, 100, None]
    assert value(lambda c: catalog.thousands(c, " ~Sp"), 15_734_892) == "15 734 892 ~Sp"
    assert [value(catalog.video_kind, a, b) for a, b in (("Song", "Someone - Topic"), ("Song COLORS SHOW", "x"), ("Song (Clip)", "x"), ("Song", "x"))] == ["audio", "show", "clip", "unknown"]
    assert [value(catalog.track_kind, t, "A", 2000) for t in ("Freestyle live", "Song Remix", "Song (Live)", "Song unplugged", "Song demo", "Song")] == ["exotic", "remix", "live", "acoustic", "exotic", "album"]
    assert value(catalog.is_video_credit, "Other", "Drone pilot") is True and value(catalog.is_video_credit, "Other", "Video mix") is False


def test_milestones(spark):
    df = spark.createDataFrame([("2020-01-01", [("Or", "2020-03-01"), ("Or", "2020-02-01"), ("Platine", "2019-01-01"), ("Diamant", "x")])], "release string, e array<struct<certification:string,certification_date:string>>")
    assert [(r["level"], r["days"]) for r in df.select(catalog.milestones(F.col("release"), F.col("e"))).first()[0]] == [("Or", 31)]
