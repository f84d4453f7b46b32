"""Credit and award pages against hand-made cases."""

import random

import pytest

from crategraph.plans import QUERIES
from crategraph.sources import markup

PAGE = """<html><head><style>div{}</style></head><body><br><p>loose<p>text</i>
<div class='Credit__Container a'><div class="Credit__Label">Producer</div><div class="Credit__Contributor"><a href=x>J &amp; K</a><a>J &amp; K</a>, <span>not own</span></div></div>
<div class='Credit__Container'><div class="Credit__Label">Released On</div><div class="Credit__Contributor">May 1</div></div>
<div class='Credit__Container'><div class="Credit__Label">Bass, Guitar</div><div class="Credit__Contributor">Ann, Bob and Cy<br>X<br>Di and Ed<br>Fy + Gus<br>Ho / Io<br>Lone</div></div>
<div class='Credit__Container'><div class="Credit__Contributor">no label</div></div>
<div class='Credit__Container'><div class="Credit__Label">Empty</div></div>
<div data-lyrics-container="true"><script>var x</script>One<br/>two <i>three</i><div class="x SidebarAd">ad</div></div><div data-lyrics-container="true"> </div>
<div data-lyrics-container="true">four<br><br><br><br>five<br>You might also like this<br>six3Embed </div>
<div class="RichText__Container">too short</div><a href="/albums/q">  </a><a href="/albums/r">Other</a>"""


def test_parts_of_a_page():
    page = markup.tree(PAGE)
    names = ["Ann", "Bob and Cy", "Di", "Ed", "Fy", "Gus", "Ho", "Io", "Lone"]  # the first separator found decides
    assert markup.credits_in(page) == [("Producer", "J & K"), *(("Bass, Guitar", n) for n in names)]
    assert markup.lyrics_in(page) == "One\ntwo three\n\nfour\n\nfive\n\nsix"
    assert markup.album_in(page) is None  # the first link decides, and it says nothing
    assert markup.about_in(page) is None


def test_older_layout_and_fallbacks():
    old = '<div class="SongInfo__Credit"><div class="SongInfo__Label">Writers</div>x<span>y</span><div>Ann &amp; Bob</div></div><div class="Lyrics__Container-1">la</div>'
    old += '<div class="AlbumTracklist"><a href="/albums/1">The One (1999)</a></div><a href="/albums/0">Zero</a>'
    old += f'<div class="SongDescription__Content">{"long " * 12}<div class="embedly">no</div>\n end</div>'
    page = markup.tree(old)
    assert markup.credits_in(page) == [("Writers", "Ann"), ("Writers", "Bob")]
    assert markup.lyrics_in(page) == "la" and markup.album_in(page) == "The One" and markup.about_in(page) == "long " * 12 + "end"


@pytest.mark.parametrize("html", [None, "", "<", "</div>", "<div" * 50, "<div>" * 5_000, "text & more &amp;", "<div data-lyrics-container='true'>", "<a href='/albums/'>"])
def test_broken_pages(html):
    page = markup.tree(html)
    assert markup.credits_in(page) == [] and markup.album_in(page) is None and markup.about_in(page) is None and markup.lyrics_in(page) == ""


def test_tables(spark):
    rows = [(1, PAGE, "k", 5), (2, None, "k", 5), (3, "", None, None), (1, PAGE, "k", 5)]
    pages = spark.createDataFrame(rows, "page_id long, html string, kind string, pos long")
    got = markup.song_page_parts(pages).collect()
    assert {(r["kind"], r["role"], r["detail"]) for r in got} == {("credit", "Producer", None), ("credit", "Other", "Bass, Guitar"), ("lyrics", None, None)}
    assert len(got) == 11 and {r["page_id"] for r in got} == {1}
    assert markup.song_page_parts(pages.limit(0)).count() == 0 and markup.award_history(pages.limit(0)).count() == 0


def test_award_rows(spark):
    row = lambda i, artist, title, more="": f'<tr class="x table_award_row" id="{i}"><td class="artists_cell">{artist}</td><td class="others_cell">{title}</td><td class="others_cell">May 2, 2001</td>{more}</tr>'
    step = lambda *cells: '<tr class="content_recent_table">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = row("default_7", "Ann", "One", '<td class="others_cell">House</td><td class="format_cell">ALBUM <b>MORE DETAILS</b></td><td><img class="award" src="/x/10_big.png">') + row("", "No id", "Two") + row("default_8", "", "No artist") + row("default_9", "Ann", "Three")
    html += '<div id="recent_7_detail">' + step("May 1, 1999", "3x Multi-Platinum | <b>June 5, 2003</b>") + step("x", "Gold") + step("x", " ") + step("only one") + step("y", "| June 1, 2000") + "</div>"
    got = [tuple(r) for r in markup.award_history(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("pos", "step").collect()]
    assert got == [
        (1, 0, "Ann", "One", "2001-05-02", "Diamond", 10_000_000, 0, "3x Multi-Platinum", "2003-06-05", "1999-05-01", 3_000_000),
        (1, 0, "Ann", "One", "2001-05-02", "Diamond", 10_000_000, 1, "Gold", "2001-05-02", "x", 500_000),
        (1, 1, "No id", "Two", "2001-05-02", "", None, None, None, None, None, None),
        (1, 2, "Ann", "Three", "2001-05-02", "", None, None, None, None, None, None),
    ]


def test_award_rows_hold_their_histories(spark):
    cells = '<td><img class="award" src="/a/2_big.png"></td><td class="artists_cell">Ann</td><td class="others_cell">One</td><td class="others_cell">May 2, 2001</td><td class="others_cell">House</td><td class="format_cell">ALBUM {}</td></tr>'
    html = '<tr class="table_award_row" id="default_1">' + cells.format("<a>MORE DETAILS</a>") + '<tr><td><table id="recent_1_detail"><tr class="content_recent_table"><td>1/2/1999</td><td>Gold</td></tr><tr class="content_recent_table"><td></td><td>Platinum | <b>x</b></td></tr></table></td></tr>'
    html += '<tr class="table_award_row" id="default_2">' + cells.format("")
    for page in (html, html + "&amp;"):
        got = markup.award_rows(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
        own = ("Ann", "One", "2001-05-02", "House", "ALBUM", "2x Platinum", 2_000_000)
        assert [tuple(r) for r in got] == [(1, 0, *own, [("Gold", "2001-05-02", "1999-01-02", 500_000), ("Platinum", "x", "", 1_000_000)]), (1, 1, *own, [])]


def test_plain_markup_gives_the_parser_s_tree():
    """Pages cut by the pattern are the parser's, and award pages are cut by it at all."""
    flat = lambda e: (e.tag, e.attrs, [c if isinstance(c, str) else flat(c) for c in e.children])
    bits = ["<div>", "</div>", '<p class="a b">', "<br>", "text > x", '<a href="/x" id="1" id="2">', "</a>", "</b>", "\n", "&amp;", "<br/>", "<!-- c -->", "<script>", "</script>", "<DIV>", "<a x>", "<title>", "</title>", "<", "</h1 >", "\0"]
    rng = random.Random(1)
    pages = ["".join(rng.choice(bits[: rng.choice((9, len(bits)))]) for _ in range(rng.randrange(12))) for _ in range(4_000)]
    plain = [x for x in pages if markup.WHOLE.fullmatch(x)]
    assert 1_000 < len(plain) < 4_000
    for html in pages:
        assert flat(markup.tree(html)) == flat(markup._parsed_tree(html))


def award_page(rng: random.Random) -> str:
    """A page of award rows with details, most of them as usual; little of it anything else."""
    odd = lambda usual, *others: rng.choice(others) if rng.random() < 0.02 else usual
    some = lambda *texts: rng.choice(texts)
    gap = lambda: odd("", "\n ", "loose", "<br>", "</i>", "</tr>", "&amp;")

    def step() -> str:
        cells = f'<td class="x">{some("5/6/2001", " ", "a|b")}</td>', gap(), some('<td class="x">3x Platinum | <b> May 2, 1999</b></td>', "<td>Gold</td>", "<td> </td>", "<td>| x</td>", odd("<td></td>", '<td id="recent_1_detail">x</td>'))
        return some('<tr class="content_recent_table">', odd('<tr class="content_recent_table">', "<tr>")) + "".join(cells[: odd(3, 1)]) + gap() + "</tr>"

    def row() -> str:
        key = some("1", "2", "default_3", "")
        cells = [f'<td><img class="award" src="/a/{some(0, 3)}_big.png"></td>', f'<td class="artists_cell">{some(" Ann", "Bo", odd("Cy", "", "<b>D</b>i"))}</td>']
        cells += [f'<td class="{odd("others_cell", "x others_cell")}">{x}</td>' for x in (some("One ", "Two", ""), "May 2, 2001", "House")] + [f'<td class="format_cell">SINGLE {some("", "<a>MORE DETAILS</a>", odd("", "<i>x</i>"))}</td>']
        detail = f'<tr><td><table id="{some("recent_", odd("recent_", "default_"))}{odd(key, "2")}_detail">' + "".join(step() + gap() for _ in range(rng.randrange(4))) + "</table></td></tr>"
        return f'<tr class="{odd("table_award_row", "a table_award_row")}" id="default_{key}">' + gap() + gap().join(odd(cells, cells[:4], cells[::-1])) + "</tr>" + gap() + some(detail, detail, "")

    return odd("<table>", "") + "".join(row() + gap() for _ in range(rng.randrange(4))) + odd("</table>", "", "<p>more")


def test_usual_award_rows_are_those_of_the_tree(monkeypatch):
    rng = random.Random(4)
    pages = [award_page(rng) for _ in range(4_000)]
    usual = [markup._usual_rows(x) is not None for x in pages]
    assert 1_000 < sum(usual) < 3_500
    got = [list(markup.award_rows_in(x)) for x in pages]
    monkeypatch.setattr(markup, "_usual_rows", lambda html: None)
    assert got == [list(markup.award_rows_in(x)) for x in pages]
    for kind in (True, False):  # both have entries
        assert sum(len(r[-1]) for x, u in zip(got, usual) if u is kind for r in x) > 400


def test_award_pages_of_the_query_need_no_tree(spark, small, monkeypatch):
    """Its pages are usual ones, made of lines after these were shuffled."""
    monkeypatch.setattr(markup, "award_history", lambda pages: pages)
    pages = QUERIES["award_histories"](spark, small)
    assert all(markup._usual_rows(r["html"]) for r in pages.limit(300).collect())
    gathered, below = pages._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[2].split("\n", 1)
    assert "table_award_row" in gathered and "table_award_row" not in below
