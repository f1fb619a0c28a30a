import random

import numpy as np
import pytest

from rosterlake.llm import main_text
from rosterlake.llm.boosting import BoostedTrees

TEXT = [
    "A headline about rivers",
    "Rivers run from the hills to the sea, and they carry sand and stones with them all the way.",
    "Some of them freeze in winter, others dry up in summer; a few never change at all, it seems.",
    "People have always lived near rivers, because water is needed every day by man and beast.",
]


@pytest.fixture(scope="module")
def model():
    return main_text.train([])


def read(model, source):
    page = main_text.parse(source)
    return main_text._text(page, model.log_odds(main_text.features(page)))


def blocks(source):
    return [t for _, t in main_text.parse(source).blocks]


def test_parsing_of_broken_markup():
    assert blocks("<p><b>one<br>two<p>three &amp; &#233;<p >four</p>") == ["one two", "three & é", "four"]
    assert blocks('a<script>var t="</p>";</script>b<style>p{}</style><!-- <p>x</p> -->c') == ["abc"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("<div title='a>b'>x</span></b></div><a href=\"y>z\">l</a>") == ["x", "l"]
    assert blocks("text < 5 and <3 and <p class='open") == ["text < 5 and <3 and <p class='open"]
    assert blocks("<head><title>no</title><meta></head><body>yes<noscript>no</noscript>") == ["yes"]
    assert blocks("a \n\t b<div> c&nbsp; d</div>") == ["a b", "c d"]
    assert blocks("") == blocks(None) == blocks("<p></p><div> </div>") == []


@pytest.mark.parametrize(
    "page",
    [
        "<body>{0}<br>{1}<br><br>{2}",
        "<body><b>{0}</b> {1} <i>{2}</i></body>",
        "<body><my-story>{0} {1} {2}</my-story></body>",
        "<body><h1>{0}</h1><p>{1}</p>{2}",
        "{0} {1} {2}",
        "<html><head><title>no</title><meta charset=utf-8><body><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article>",
        "<html><head><title>no</title><link rel=x><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article>",
        "<head><title>no</title>{0} {1} {2}",
    ],
)
def test_text_in_no_block_and_open_heads(model, page):
    got = read(model, page.format(*TEXT[1:]))
    assert got.split() == " ".join(TEXT[1:]).split()


def test_menus_in_no_block_go(model):
    body = "".join(f"<p>{t}</p>" for t in TEXT[1:])
    menu = '<a href="/a">Home</a> | <a href="/b">News</a> | <a href="/c">Contact</a>'
    assert read(model, f"<body>{menu}<article>{body}</article></body>") == "\n".join(TEXT[1:])


def test_kept_nodes_are_the_best_closed_set():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = 9
        page = main_text.Page(tag=["div"] * n, parent=[-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        odds = rng.normal(size=n)
        kept = main_text.keep_nodes(page, odds)
        best = -np.inf
        for bits in range(1 << (n - 1)):
            own = [True] + [bool(bits >> k & 1) for k in range(n - 1)]
            if all(not own[i] or own[page.parent[i]] for i in range(1, n)):
                best = max(best, sum(odds[i] for i in range(1, n) if own[i]))
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, n))
        assert sum(odds[i] for i in range(1, n) if kept[i]) == pytest.approx(best)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((trees.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize("holder", ["article", "main", 'div class="content"'])
@pytest.mark.parametrize(
    "extra",
    [
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>",
        "<header><p>The daily river paper</p></header>",
        "<footer>Copyright, all rights reserved.</footer>",
        '<aside class="sidebar"><h3>More</h3><p>Lakes are calm, and seas are not. Read on.</p></aside>',
        '<div class="cookie-notice"><p>We use cookies, as all do. Please accept.</p></div>',
        '<div class="advert"><p>Buy boats now, they are cheap.</p></div>',
        "<form><label>Name</label><input><button>Send</button></form>",
        '<section id="comments"><div class="comment"><p>I once saw a river, it was wide. Nice text.</p></div></section>',
    ],
)
def test_boilerplate_goes_wherever_it_stands(model, holder, extra):
    body = f"<h1>{TEXT[0]}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT[1:])
    main = f"<{holder}>{body}</{holder.split()[0]}>"
    inside = f"<{holder}>{body}{extra}</{holder.split()[0]}>"
    for page in (f"{extra}{main}", f"{main}{extra}", inside):
        assert read(model, f"<html><body>{page}</body></html>") == "\n".join(TEXT)


def test_held_out_pages(model):
    rng = random.Random(9)
    right = n = 0
    for _ in range(60):
        body = [" ".join(rng.choices("alpha beta gamma delta, epsilon. zeta".split(), k=rng.randrange(8, 60))) for _ in range(rng.randrange(3, 9))]
        source, _ = main_text.training_page(body, body, rng, plain=False)
        page = main_text.parse(source)
        kept = main_text.keep_nodes(page, model.log_odds(main_text.features(page)))
        right += sum(bool(kept[node]) == (main_text.MARK in t) for node, t in page.blocks)
        n += len(page.blocks)
    assert right / n > 0.93


def test_awkward_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "<div>" * 3000 + "deep"), (5, "<article><p>" + "long words here, yes. " * 50_000), (5, "<article><p>" + "long words here, yes. " * 50_000)]
    pages = spark.createDataFrame([(i, "u", h, "mine") for i, h in rows], "page_id int, url string, html string, text string")
    out = main_text.extract(pages, model).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 6 and by[1] == by[2] == by[3] == "" and len(by[5]) > 1_000_000
    assert main_text.extract(pages.limit(0), model).count() == 0 and main_text.sample(pages.limit(0)) == []
    same = main_text.extract(pages, model, name="html")
    assert same.count() == 6
