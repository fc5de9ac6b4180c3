"""Site template removal: pages of known articles, broken markup, edge cases, and the query against a plain reading of the driver's pages."""

import os
import random
import re
from html import escape, unescape

import pytest
from pyspark.sql import functions as F

from gristmill.llm import html_text, queries

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows, **kw):
    return {r["page_id"]: r for r in html_text.extract(frame(spark, rows), **kw).collect()}


def alone(page):
    """The text of a page of a host of its own: only rules remove."""
    _, up, rule, parts, _ = html_text.parse(page, "")
    gone = []
    for p, r in zip(up, rule, strict=True):
        gone.append(r or (p >= 0 and gone[p]))
    return " ".join("".join(" " if n >= 0 and gone[n] else t for t, n in parts).split())


CASES = {
    "nothing": ("", ""),
    "no markup": ("  a\n b &lt; c ", "a b < c"),
    "inline and block": ("<p>foo<b>bar</b> <i>baz</i>.</p><p>next<br>line<div>x</div>y", "foobar baz. next line x y"),
    "references": ("<p>&amp;amp; &eacute;&#233;&#xe9; &nbsp;&nbsp; &copy &unknown; a&b</p>", "&amp; ééé © &unknown; a&b"),
    "raw text": ("<title>t</title><style>p{}</style><script>var t='</p><p>no</p>';</script ><p>yes</p><SCRIPT>x</SCRIPT>", "yes"),
    "comments": ("a<!-- <p>no</p> -->b<!--> c<!-- x --!> -->d<!-- open <p>e", "ab c -->d"),
    "no tags": ("1 < 2 and 3 > 2 <3 </ 4> </é>x <", "1 < 2 and 3 > 2 <3 x <"),
    "declarations": ("<!DOCTYPE html><?xml version='1'?><p>a</p><![CDATA[b]]>c", "a c"),
    "quotes": ("""<p title="a > b" class='c>d'>one</p><p title="open>two</p><p>three</p>""", "one two three"),
    "unclosed": ("<p><b>one<br><p>two<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>f", "one two a b c d e f"),
    "ends of nothing": ("</div></p>a</b></td></article>b", "a b"),
    "menus": ("<nav>no</nav><header>no</header><article><h1>T</h1>yes</article><aside>no</aside><footer>no</footer>", "T yes"),
    "forms": ("<article>a<form>no<p>no</p></form>b<button>no</button><select><option>no</select></article>", "a b"),
    "names": ('<div class="side-bar sidebar">no</div><div id="cookieNotice">no</div><p class="lead">yes</p><div class="ad">no</div><div class="badge">yes</div>', "yes yes"),
    "roles": ('<div role="navigation">no</div><div role=main>yes</div><div aria-hidden="true">no</div><div hidden>no</div><p style="display: none">no</p>', "yes"),
    "comments of readers": ('<article>yes</article><section id="comments"><article class="comment">no</article></section><div class="replies"><article>no</article></div>', "yes"),
    "an unlucky name around it": ('<div class="content with-sidebar"><article>long enough text</article></div><div class="sidebar">no</div>', "long enough text"),
    "a form around it": ('<form id="aspnet"><div>the whole page is in a form</div><nav>no</nav></form>', "the whole page is in a form"),
    "an article's header": ('<article><header><h1>Title</h1><p>by someone</p></header><p>text</p><footer>no</footer></article>', "Title text"),
    "a header by class": ('<article><div class="entry-header"><div><h2>Title</h2></div>by someone</div><p>text</p></article>', "Title text"),
    "teasers": ("<div>" + "the real text " * 9 + "</div><aside><article>no</article></aside>", "the real text " * 8 + "the real text"),
    "a shut article": ("<article><p>a<div>b</article><footer>no</footer>", "a b"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_page(name):
    page, want = CASES[name]
    assert alone(page) == want


def test_long_and_deep_pages():
    """Megabytes of one thing, each read in one pass."""
    assert alone("<div>" * 200_000 + "x" + "</div>" * 200_000) == "x"
    assert alone("<p><b>" * 100_000 + "x") == "x"
    assert len(alone("<" * 1_000_000)) == 1_000_000
    assert alone("<a " * 500_000) == " ".join(["<a"] * 500_000)
    assert alone("<!--" * 300_000 + "-->x") == "x"
    assert len(alone("<p>word</p>" * 300_000)) == 5 * 300_000 - 1
    assert alone("<script>" + "</p>" * 500_000) == ""
    assert alone("<a ''" * 100_000 + '">x') == "x"


WORDS = [f"w{i}é" for i in range(300)]


def site(rng, host, n, shape):
    """(url, html, article) of a host's pages: parts alike in all of them, parts that differ, shared paragraphs, copies of articles."""
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    menu, foot, box, passage = say(5), say(8), say(12), say(15)
    out, articles = [], []
    for i in range(n):
        if articles and rng.random() < 0.3:
            blocks = rng.choice(articles)
        else:
            blocks = [say(5), *(say(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))]
            if rng.random() < 0.5:
                blocks.insert(1, passage)
            articles.append(blocks)
        h, *ps = blocks
        body = f"<h1>{escape(h)}</h1>" + "".join(f"<p>{escape(p)} &amp; so\n on</p>" for p in ps)
        text = " ".join([h, *(f"{p} & so on" for p in ps)])
        if shape == "article":  # boxes of no telling name around and in it, whose texts differ or are the same
            page = f'<div class="x1">{say(6)}<ul><li>{say(2)}</ul></div><article>{body}<div class="x2">{box}</div></article><div class="x3">{foot}</div>'
        else:  # nothing is called anything
            page = f"<div><div>{menu}</div><div>{body}</div><div>{box}</div><p>{foot}</p></div>"
        out.append((f"https://{host}/{i}", f"<html><head><title>{say(3)}</title></head><body>{page}<script>s({i})</script></body></html>", text))
    return out


@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
@pytest.mark.parametrize("shape", ["article", "plain"])
def test_templates(spark, shape, max_broadcast):
    """Only recurrence can remove these, and it leaves alone copies and shared passages inside articles."""
    rng = random.Random(4)
    pages = [x for k, n in enumerate([60, 25, 8]) for x in site(rng, f"s{k}.example.com", n, shape)]
    got = texts(spark, [(i, u, h) for i, (u, h, _) in enumerate(pages)], max_broadcast=max_broadcast, **({} if shape == "article" else {"min_share": 0.7}))
    for i, (_, _, want) in enumerate(pages):
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(want)
        assert got[i]["n_template"] == 3 and got[i]["n_rule"] == 0


def test_few_pages_have_no_template(spark):
    rng = random.Random(4)
    pages = site(rng, "s.example.com", 4, "article")
    got = texts(spark, [(i, u, h) for i, (u, h, _) in enumerate(pages)])
    assert all(r["n_template"] == 0 for r in got.values())
    again = [(i, "https://one.example.com/", pages[0][1]) for i in range(30)]  # one page, many times
    assert all(r["n_template"] == 0 for r in texts(spark, again).values())
    nowhere = [(i, [None, "", "no host", "https:///x"][i % 4], pages[i % 4][1]) for i in range(40)]
    assert all(r["n_template"] == 0 for r in texts(spark, nowhere).values())


def test_edges(spark):
    rows = [(1, "http://a/", None), (1, "http://a/", None), (None, None, ""), (2, "http://a/", "<p>퟿ \U0001f600 &#xD800; &#0;</p>"), (3, "x", "<nav>only a menu</nav>")]
    docs = frame(spark, rows).withColumns({"text": F.lit("clash"), "site": F.lit("s"), "keys": F.lit(1), "c0": F.lit(2), "row": F.lit(3), "a b`c": F.lit(4)})
    got = html_text.extract(docs)
    assert got.columns == ["page_id", "url", "site", "keys", "c0", "row", "a b`c", "text", "n_chars", "n_template", "n_rule"]
    rows = got.collect()
    assert len(rows) == 5 and all((r["site"], r["keys"], r["c0"], r["row"]) == ("s", 1, 2, 3) for r in rows)
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0)] * 4 + [("퟿ \U0001f600 � �", 7)]
    assert html_text.extract(frame(spark, [])).collect() == []


def test_long_page(spark):
    """Longer than an Arrow batch."""
    para = "<p>" + "many words " * 20 + "</p>"
    rows = [(1, "http://a/", "<nav>no</nav><article>" + para * 40_000 + "</article>"), (2, "http://a/", para)]
    got = texts(spark, rows)
    assert got[1]["n_chars"] == 40_000 * 220 - 1 and got[2]["n_chars"] == 219


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query(spark):
    """The pages' articles, read plainly."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op12_html_extraction(spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(unescape(re.sub("</?b>", "", re.sub("</?(p|br|h1)>", " ", inside))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))
    assert sum(r["n_template"] for r in got) > sum(r["n_rule"] for r in got) > 0  # hosts of few pages have the latter
