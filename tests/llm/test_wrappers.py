"""Main texts of pages with many layouts, whose articles are known."""

import random
from html import escape

import pytest
from helpers import VOCABULARY

from palestra.llm import wrappers

PAGES = "page_id long, url string, html string"


def sentence(rng, n=12):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def layout(kind, rng, paragraphs):
    """A page of one of the layouts around the paragraphs; menus and the like differ by page."""
    title, *rest = paragraphs
    body = "".join(f"<p>{escape(p)}</p>" for p in rest)
    menu = "".join(f'<li><a href="/{k}">{sentence(rng, 1)}</a></li>' for k in range(rng.randrange(3, 8)))
    ad, foot, note = sentence(rng), sentence(rng), sentence(rng)
    comments = "".join(f'<div class="comment"><p>{sentence(rng)}</p><p>{sentence(rng)}</p></div>' for _ in range(rng.randrange(4)))
    if kind == "article":
        return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var x='</p><article>'</script></head><body><nav><ul>{menu}</ul></nav>"
                f"<div class='ad'>{ad}</div><article><h1>{title}</h1>{body}</article><footer>{foot}</footer></body></html>")
    if kind == "main":
        return (f"<body><header><h2>{note}</h2></header><main><h1>{title}</h1>{body}<section id=comments>{comments}</section></main>"
                f"<aside><p>{ad}</p></aside>")
    if kind == "classes":
        return (f"<html><body class='page'><div class='top-menu'><ul>{menu}</ul></div><div id='wrap'><div class='post-body entry'><h1>{title}</h1>{body}"
                f"</div><div class='comments'>{comments}</div></div><div class='sidebar'><p>{ad}</p></div><div id='footer'>{foot}</div></body></html>")
    if kind == "bare":  # no word tells what is what: the template says the same on each page
        return (f"<html><body><div><p>All about our club and its many members since long ago.</p><p>Call us by day or night.</p></div>"
                f"<div><h1>{title}</h1>{body}</div><div><p>Made with care in our house by the water.</p></div></body></html>")
    if kind == "table":
        return (f"<table><tr><td><ul>{menu}</ul></td></tr></table><table><tr><td><h1>{title}</h1>{body}</td></tr></table>"
                f"<form><p>{note}</p><input></form>")
    if kind == "sloppy":
        open_ = "".join(f"<p>{escape(p)}\n" for p in rest)
        return f"<body><UL CLASS=menu>{menu}</UL><ARTICLE><H1>{title}</H1>{open_}<!-- <p>gone</p> --></ARTICLE><p class=copyright>{foot}"
    raise ValueError(kind)


KINDS = ["article", "main", "classes", "bare", "table", "sloppy"]


def site(kind, n, seed, host):
    rng = random.Random(seed)
    found = []
    for k in range(n):
        paragraphs = [sentence(rng, 5), *(sentence(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(2, 9)))]
        found.append((f"http://{host}/{k}", layout(kind, rng, paragraphs), "\n".join(paragraphs)))
    return found


@pytest.fixture(scope="module")
def sites():
    found = [p for k, kind in enumerate(KINDS) for p in site(kind, 12, k, f"{kind}.example.org")]
    return [(k, *p) for k, p in enumerate(found)]


def pages(spark, data):
    made = spark.createDataFrame([d[:3] for d in data], PAGES)
    return made.selectExpr("*", "1 AS host", "'x' AS wrapper", "2 AS text")


def answers(df):
    return sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bytes_,fan_in,heavy", [(1 << 25, 64, 256), (0, 2, 1), (0, 2, 10**9)])
def test_main_texts_of_many_layouts(spark, sites, bytes_, fan_in, heavy, monkeypatch):
    monkeypatch.setattr(wrappers, "HEAVY_HOSTS", heavy)
    found = answers(wrappers.main_texts(pages(spark, sites).repartition(5), bytes_, fan_in))
    assert found == sorted(((k, u, t, len(t)) for k, u, _, t in sites), key=repr)


def test_awkward_pages(spark):
    data = [(1, "http://a.example/x", None), (2, "http://a.example/y", ""), (3, None, "<article><p>no address</p></article>"),
            (None, "not an address", "<article>one<br>two &amp; three&nbsp;four &am &lt;p&gt;</article>"), (5, "http://b.example/", "plain text"),
            (5, "http://b.example/", "plain text"), (6, "http://c.example/", "<nav>only <a href=x>menu</a></nav>"),
            (7, "http://d.example/", "<div>" * 3000 + "deep" + "</div>" * 3000), (8, "http://e.example/", "<article>" + "<p>w</p>" * 20000 + "</article>"),
            (9, "http://f.example/", "<article><p>it<a title=it's href=\"x\">'s</a> <b>b</b>old<wbr>er</p><style>p{}</style><p hidden>no</p></article> <p>out"),
            (10, "http://g.example/", "<article><p>a < b and <3 <!-- x --> <img alt='no'>end<script>if (a</b) '</article>'</script></article"),
            (11, "http://h.example/", "<article><h1>T</h1><p>one</p><article class=comment><p>no</p></article><div class=comments>no</div></article>")]
    found = {(k, u): t for k, u, t, _ in answers(wrappers.main_texts(pages(spark, data)))}
    assert found == {(1, "http://a.example/x"): "", (2, "http://a.example/y"): "", (3, None): "no address",
                     (None, "not an address"): "one two & three four &am <p>", (5, "http://b.example/"): "plain text",
                     (6, "http://c.example/"): "", (7, "http://d.example/"): "deep", (8, "http://e.example/"): "\n".join(["w"] * 20000),
                     (9, "http://f.example/"): "it's bolder", (10, "http://g.example/"): "a < b and <3 end", (11, "http://h.example/"): "T\none"}
    assert wrappers.main_texts(pages(spark, [])).count() == 0


def test_wrapper_has_optional_repeated_and_grouped_parts(spark):
    shapes = ["<h2>a</h2><p>b</p><h2>c</h2><p>d</p><ul><li>x</ul>", "<h2>a</h2><p>b</p><p>c</p>", "<h2>z</h2><p>y</p><hr><p>v</p><ul><li>x<li>y</ul>"]
    data = [(k, "http://w.example/", f"<body><div>{s}</div><div class=ad>say</div></body>") for k, s in enumerate(shapes)]
    rows = wrappers.wrappers(pages(spark, data), 2).collect()
    assert [(r["host"], r["pages"]) for r in rows] == [("w.example", 3)]
    import json

    root = wrappers.Part.read(json.loads(rows[0]["wrapper"]))
    content, ad = root.children[0].children
    assert [(c.label, c.many, c.pages) for c in content.children] == [("h2", True, 3), ("p", True, 3), ("ul", False, 2)]
    assert (ad.label, ad.says is not None, content.children[1].says) == ("div ad", True, None)


def test_wrappers_stay_small(spark):
    rng = random.Random(1)
    many = "".join(f"<div class='{''.join(rng.choices('abcdefgh', k=9))}'><p>{k}</p></div>" for k in range(400))
    mixed = "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</ul>", "<pre>d</pre>"]) for _ in range(600))
    data = [(k, "http://x.example/", f"<article>{many}{mixed}</article>") for k in range(4)]
    row = wrappers.wrappers(pages(spark, data)).first()
    assert row["pages"] == 4 and len(row["wrapper"]) < 20_000
    texts = {t for _, _, t, _ in answers(wrappers.main_texts(pages(spark, data)))}
    assert len(texts) == 1 and len(texts.pop().split("\n")) == 1000
