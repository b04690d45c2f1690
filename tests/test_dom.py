"""Pages by their elements, against trees that the tests make and know."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dom
from tidewire.functions import extract as X


def tree(rng, depth=0):
    """(html, elements) of a random fragment: elements (tag, class, data attribute, own texts with those inside), in document order."""
    out, found = "", []
    for _ in range(rng.randrange(1, 4)):
        if depth > 4 or rng.random() < 0.4:
            word = f"w{rng.randrange(1000)}"
            out += f" {word} "
            found.append(("", "", "", [word]))
            continue
        tag, cls, kind = rng.choice(["div", "p", "b", "section"]), rng.choice(["a", "a b", "c-d", ""]), rng.choice(["", "text"])
        inner, below = tree(rng, depth + 1)
        void = rng.choice(["", "<br>", "<img src=x>", "<!-- <p> -->", "<script>'</p><div class=a>'</script>"])
        attrs = f' class="{cls}"' * bool(cls) + f" data-k='{kind}'" * bool(kind)
        out += f"<{tag.upper() if rng.random() < 0.2 else tag}{attrs}>{void}{inner}</{tag}>"
        found.append((tag, cls, kind, [w for e in below if not e[0] for w in e[3]]))
        found += below
    return out, found


@pytest.mark.parametrize("seed", range(8))
def test_selected_texts_equal_those_of_the_tree(seed):
    html, found = tree(random.Random(seed))
    page = dom.read(html)
    flat = lambda want: [" ".join(e[3]) for e in found if want(e)]
    # texts of a tree's elements: each word belongs to all elements around it
    assert [dom.text_of(page, i) for i in dom.select(page, 0, "p")] == flat(lambda e: e[0] == "p")
    assert [dom.text_of(page, i) for i in dom.select(page, 0, ".a")] == flat(lambda e: "a" in e[1].split())
    assert [dom.text_of(page, i) for i in dom.select(page, 0, "div.a.b", "section[data-k='text']")] == flat(lambda e: e[0] == "div" and e[1] == "a b" or e[0] == "section" and e[2] == "text")
    assert dom.text_of(page, 0) == " ".join(w for e in found if not e[0] for w in e[3])


def test_steps_inside_one_another():
    page = dom.read("<main class=x><div><p class=y>1<span>2</span></p></div></main><p class=y>3</p>")
    take = lambda *s: [dom.text_of(page, i) for i in dom.select(page, 0, *s)]
    assert take("main p") == ["1 2"] == take(".x div .y") == take("main.x [class='y']") and take("div main") == [] and take("p.y") == ["1 2", "3"]
    with pytest.raises(ValueError):
        dom.path("a > b")


def test_unclosed_void_and_stray_tags():
    page = dom.read("<div class=a>one<p>two<br>three</span></div>four</div><ul><li>five<li>six")
    assert dom.text_of(page, dom.select(page, 0, ".a")[0]) == "one two three" and dom.text_of(page, 0) == "one two three four five six"
    assert dom.text_of(dom.read("a &eacute;&#8212;&amp;lt; b , c ."), 0) == "a é—&lt; b, c."
    assert dom.text_of(dom.read(""), 0) == "" and dom.text_of(dom.read("<<>< <p"), 0) != "x"


ARTICLE = """<div class="article__body"><div class="article__block" data-type="text"><div class="article__text">{a}<div><div>inner</div></div>after</div></div>
<div class="article__block" data-type="quote"><div class="article__quote-text">said</div><div>who</div></div><div class="article__block" data-type="media">no</div>
<div class="article__block" data-type="text">bare<figure>no</figure></div><div class="article__block" data-type="text">Обсуждение ЗАКРЫТО</div></div><div class="article__block" data-type="text">outside</div>"""


def test_sites():
    made = dom.article(dom.read(ARTICLE.format(a="x" * 100)), dom.SITES["ria"])
    assert made["text"] == f"{'x' * 100} inner after\n\nsaid\n\nbare" and made["blocks"] == 3
    short = ARTICLE.format(a="y" * 30)
    assert dom.article(dom.read(short), dom.SITES["ria"])["text"] is None and dom.article(dom.read(short), dom.SHORT["ria"])["text"].startswith("y" * 30)
    assert dom.article(dom.read("<p>none of it</p>"), dom.SHORT["ria"])["text"] is None
    bfm = '<section class="inner-news article-news"><div class="current-article js-mediator-article"><p class="about-article">Lead</p><p>{b}<div class=see_also>also</div>more</p><div><p>nested</p></div><blockquote>q</blockquote></div></section>'
    made = dom.article(dom.read(bfm.format(b="z" * 250)), dom.SITES["bfm"])
    assert made == {"text": f"{'z' * 250} more\n\nq", "lead": "Lead", "tags": [], "blocks": 2}
    assert dom.article(dom.read("<p>" + "z" * 300), dom.SITES["bfm"])["text"] is None  # its root must be there
    rt = '<div class="article__summary">Sum</div><div class="article__text"><p>{c}</p><ul><li>item</li></ul><script>x</script></div><div class="article__tags-trends"><a>one</a><a> </a><a>two</a></div>'
    assert dom.article(dom.read(rt.format(c="v" * 200)), dom.SITES["rt"]) == {"text": f"Sum\n\n{'v' * 200}\nitem", "lead": None, "tags": ["one", "two"], "blocks": 2}
    ved = '<p class="article-headline__subtitle">Lead</p><div class="article-boxes-list"><div class="article-boxes-list__item"><h2 class="box-paragraph__subtitle">S</h2><p class="box-paragraph__text">{d}</p></div><p class="box-paragraph__text">no</p></div>'
    assert dom.article(dom.read(ved.format(d="u" * 200)), dom.SITES["vedomosti"])["text"] == f"Lead\n\nS\n\n{'u' * 200}"


LONG = "This is a sentence of the body that is long enough."


def test_dense_text():
    page = dom.read(f"<title>T</title><nav>{LONG}</nav><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p><a href=x>{LONG}</a> x</p><p>short</p><aside>{LONG} aside</aside><h2>End</h2></article><p>{LONG} outside</p>")
    assert dom.dense(page) == f"Head\n{LONG}"
    assert dom.dense(page, recall=True) == f"Head\n{LONG}\nshort\n{LONG} aside\nEnd\n{LONG} outside"
    assert dom.dense(dom.read("")) is None and dom.dense(dom.read("<p>x"), recall=True) == "x"


def test_levels_in_order(spark):
    body = "a" * 210
    rows = [(1, f"<article><p>{body}</p></article>", "pages"), (2, f"<article><p>{body}</p></article>", None), (3, f"<article><p>{'b' * 120}</p></article>", "pages"), (4, "<p>c</p>", "pages"), (5, None, "pages"), (6, f"<nav>{body}</nav><p>{body}", None)]
    extractor = dom.Extractor({"pages": dom.Site(("p",), roots=("article",), must=True)}, drop=("nav",))
    df = spark.createDataFrame(rows, "id int, html string, site string").select("id", extractor.column(F.col("html"), F.col("site")).alias("f"))
    text, status, method = X.levels(F.col("f"))
    got = {r["id"]: (r["t"], r["s"], r["m"]) for r in df.select("id", text.alias("t"), status.alias("s"), method.alias("m")).collect()}
    assert got == {1: (body, "ok", "site"), 2: (body, "ok", "precision"), 3: ("b" * 120, "partial", "recall"), 4: (None, "extraction_failed", "failed_all_levels"), 5: (None, "extraction_failed", "failed_all_levels"), 6: (body, "ok", "precision")}


def test_drop_keeps_the_rest_in_place():
    made = dom.Extractor(drop=(".x", "figure[data-y]"))
    page = made.read("a<div class=x>b<p class=x>c</p></div><div>d<figure data-y=1>e</figure><b>f</b></div><p class=x>g</p>h")
    assert dom.text_of(page, 0) == "a d f h" and dom.text_of(page, dom.select(page, 0, "div b")[0]) == "f" and page[0].end == len(page)
    assert dom.text_of(dom.Extractor(escaped=True).read("&lt;p&gt;x &amp;amp; y&lt;/p&gt;"), 0) == "x & y"


def test_structured_blocks(spark):
    html = '<header>no</header><h2>Head</h2><p>one<div data-block="slider"><figure><img src=1><figcaption>cap</figcaption></figure></div>two</p><figure data-turbo-ad-id=3><img src=9></figure><figure><img src=1></figure><figure><img src=2></figure><figure><img src=t></figure><div data-block=feed><p>no</p></div><h5>no</h5>'
    got = spark.createDataFrame([(html, "t"), (None, None)], "h string, t string").select(dom.structured_blocks(F.col("h"), F.col("t")).alias("b")).collect()
    assert [(b["kind"], b["text"], b["src"]) for b in got[0]["b"]] == [("heading", "Head", None), ("image", "cap", "1"), ("paragraph", "one two", None), ("image", None, "2")] and got[1]["b"] == []


def test_titles_and_candidates(spark):
    rows = [("A  title\n\nlead\nbody\nmore", "a Title"), ("body", "a"), ("t", "T"), (None, "t"), ("", ""), ("x\ny", None)]
    df = spark.createDataFrame(rows, "x string, t string")
    assert [r[0] for r in df.select(X.without_title(F.col("x"), F.col("t"), lead=True)).collect()] == ["body\nmore", "body", None, None, "", "x\ny"]
    assert df.select(X.without_title(F.col("x"), F.col("t"))).first()[0] == "lead\nbody\nmore"
    line = "m" * 60
    rows = [("\n".join([line] * 9), 3, None), ("short", 3, "p" * 600), ("short", 3, "p" * 300), ("\n".join([line] * 9 + ["..."]), 3, None), ("\n".join([line] * 9), 1, None)]
    df = spark.createDataFrame(rows, "t string, n int, p string")
    text, status, reason = X.turbo_or_page(F.col("t"), F.col("n"), F.col("p"), F.lit(500))
    got = [tuple(r) for r in df.select(F.length(text), status, reason).collect()]
    assert got == [(548, "ok", "ok"), (600, "ok", "turbo_too_short"), (5, "partial", "turbo_too_short"), (552, "partial", "punctuation_only_paragraph"), (548, "partial", "not_enough_turbo_paragraph_blocks")]


def test_few_pages_of_a_batch_are_objects_at_a_time(spark, monkeypatch):
    """Whatever the batch, with the results of taking it whole; an empty one too."""
    import pyarrow as pa

    pages = [f"<article><h1>T{i}</h1><p>{'Text of some length. ' * 9}{i}</p></article>" for i in range(11)] + [None, ""]
    html, site = pa.array(pages), pa.array([None] * len(pages), pa.string())
    whole, seen = dom.Extractor()(html, site), []
    monkeypatch.setattr(dom, "PART", 4)
    work = lambda h, s: seen.append(len(h)) or dom.Extractor()(h, s)
    assert dom._parted(work, html, site).equals(whole) and seen == [4, 4, 4, 1]
    assert len(dom._parted(work, html.slice(0, 0), site.slice(0, 0))) == 0
