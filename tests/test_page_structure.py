import time

from rosterlake.functions.page_structure import entries_of
from rosterlake.operators import listing


def names(page, min_repeats=3):
    return [e[0] for e in entries_of(page, min_repeats)]


def test_lists_in_lists():
    page = "<ul><li>A <a href=/a>An</a><ul><li><a href=/b>B</a></li></ul></li><li><a href=/c>C</a><li><a href='/d'>D</a></ul>"
    assert entries_of(page, 3) == [("An", "/a", "", "A An"), ("B", "/b", "", "B"), ("C", "/c", "", "C"), ("D", "/d", "", "D")]
    deep = "<ul><li><a href=/l>L</a><ul><li><a href=/m>M</a><ul><li><a href=/n>N</a></li></ul></li></ul></li><li><a href=/o>O</a></li></ul>"
    assert names(deep) == ["L", "M", "N", "O"]


def test_terms():
    page = "<dl><dt>Ann<dd>x@y.edu<dd>Room 1<dt>Bob</dt><dd><a href='mailto:b@y.edu?s=1'>mail</a></dd><dt>Cy<dd>none</dl>"
    assert entries_of(page, 3) == [("Ann", "", "", "Ann x@y.edu Room 1"), ("Bob", "", "b@y.edu", "Bob mail")]


CARD = '<div><div><b><a href="/p{0}">P {0}</a></div><ul><li>Room {0}<li>p{0}@x.edu</ul></div>'


def test_cards_keep_what_is_inside():
    page = "<div>" + "".join(CARD.format(i) for i in range(4)) + "</div>"
    assert entries_of(page, 3) == [(f"P {i}", f"/p{i}", "", f"P {i} Room {i} p{i}@x.edu") for i in range(4)]
    assert entries_of(page, 9) == []


def test_sections_of_cards_are_no_entries():
    page = "".join(
        f"<div class=s><h2>S{s}</h2>" + "".join(f"<div class='c x'><a href=/{s}{i}>P{s}{i}</a></div>" for i in range(4)) + "</div>"
        for s in range(3)
    )
    assert names(page) == [f"P{s}{i}" for s in range(3) for i in range(4)]


def test_menus_scripts_comments_and_stray_ends():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{i}</a>" for i in range(5)) + "</ul>"
    shown = "</section></li><script><div></script><!-- <div> --><p><b>" + "".join(f"<div><a href=/p{i}>P{i}</a></div>" for i in range(3))
    assert names(f"<nav>{menu}</nav>{shown}<footer>{menu}</footer>") == ["P0", "P1", "P2"]
    assert entries_of("", 3) == entries_of("<", 3) == entries_of("<div", 3) == entries_of("plain text", 3) == []


def test_deep_and_stray_tags_take_linear_time():
    start = time.perf_counter()
    assert entries_of("<div>" * 16000 + "</section>" * 16000 + "</div>" * 16000, 3) == []
    assert entries_of("<div><li>" * 16000, 3) == []
    assert entries_of("<dl><dt>" * 16000, 3) == []
    assert time.perf_counter() - start < 5


def test_records_mined(spark):
    page = "<table><tr><th>Name<th>Mail<tr><td>Prof. Ann Lee, Chair<td>a [at] x.edu<tr><td>Bo Ng<td><a href='mailto:Bo@x.edu'>write</a><tr><td><a href='cy'>Cy</a><td></table>"
    pages = spark.createDataFrame([("https://x.edu/p/", page), ("https://x.edu/q", None), (None, page)], "url string, html string")
    rows = sorted(map(tuple, listing.records_mined(pages).where("url is not null").select("pos", "name", "profile_url", "email", "title").collect()))
    assert rows == [
        (0, "Prof. Ann Lee", None, "a@x.edu", "Prof."),
        (1, "Bo Ng", None, "bo@x.edu", None),
        (2, "Cy", "https://x.edu/p/cy", None, None),
    ]
    assert listing.records_mined(pages.limit(0)).count() == 0
