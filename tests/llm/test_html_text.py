import html
import random

import pytest

from stemforge.llm import html_text as H

CASES = {
    "<body><nav>menu <a href=x>y</a></nav><article><h1>T</h1><p>One &amp; two<p>Three</article><footer>f</footer>": "T\nOne & two\nThree",
    "<body><header>Site</header><div class='post'><header><h1>T</h1></header><p>Hello there,  my\n friend</p></div><aside>s</aside>": "T\nHello there, my friend",
    "<body><article><p>a <b>bold</b> and <a href=x>link</a>.</p><ul><li>one<li>two</ul><script>var x='<p>no</p>';</script></article>": "a bold and link.\none\ntwo",
    "<body><article><h1>T</h1><p>text</p><div class='comments'><p>first!</p></div><div id=cookie-notice>ok?</div><form>f<p>x</form></article>": "T\ntext",
    "<p><b>Title here.<br><p>Then text</p>": "Title here.\nThen text",
    "<body><article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>": "a\nb\nc\nx y",
    "<body><div class=ad>Buy a lot of these things today and tomorrow</div><article><p>x</p></article>": "x",
    "<article><p>never closed <i>at all": "never closed at all",
    "<article><p>cut in a ta</p><p cla": "cut in a ta",
    "<!-- c --><!DOCTYPE html><title>t</title>": "",
    "plain": "plain",
    "": "",
    "<p style='display: none'>hidden</p><p>shown</p>": "shown",
    "<article><p title=\"a > b\">x</p><p>1 < 2 &lt; 3 &eacute;&#233;&#xe9;</p></article>": "x\n1 < 2 < 3 ééé",
    "<body class='has-sidebar menu'><article><p>fine</p></article></body>": "fine",
    "<p title='the hidden valley'>a</p><p data-id='share-1'>b</p><section aria-label='a hidden gem'>c</section>": "a\nb\nc",
    "<p title=it's>Hello</p>": "Hello",
    "<p title=\"never closed>Hello</p>": "Hello",
    "<p =x y = 'a>b' z>Hello</p><p a='1'b=\"2\">there</p>": "Hello\nthere",
    "<article><p>first paragraph of it</p><p class='social-history'>a second one of the article</p><p>third paragraph of it</p></article>": "first paragraph of it\na second one of the article\nthird paragraph of it",
    "<article><p>first paragraph, which is not short</p><div class='social-share'>Tell others</div><div class='notice'>Note</div><div class='related-posts'><a href=x>more of this</a></div></article>": "first paragraph, which is not short",
    "<article><p>short</p><div class='notice'>a part whose name may mean a notice but which is as long as the text itself, or longer, and so is text</div></article>": "short\na part whose name may mean a notice but which is as long as the text itself, or longer, and so is text",
    "<div hidden>a</div><div aria-hidden=true>b</div><div role=navigation>c</div><p class=hidden-gem>d</p>": "d",
    "<script>if (a < b) { '</scripty>' }</script ><p>x</p></p><p>y": "x\ny",
    "a <3 b </ c> d <> e": "a <3 b d <> e",
    "<div class='main-sidebar-wrap'><h1>T</h1><p>long text of the article itself, which holds most of the page</p></div><div class=sidebar>x</div>": "T\nlong text of the article itself, which holds most of the page",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert H.main_text(source) == CASES[source]


def test_articles_without_semantic_elements():
    r = random.Random(2)
    words = "the of and in on to this with reason theme subject".split()
    line = lambda n: " ".join(r.choices(words, k=n)) + "."
    for _ in range(20):
        body = [line(r.randint(30, 80)) for _ in range(r.randint(5, 12))]
        links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words)
        page = f"<html><head><title>x</title></head><body><div><ul>{links}</ul></div><div><div><h1>Heading</h1>{''.join(f'<p>{html.escape(p)}</p>' for p in body)}</div></div><div><ul>{links}{links}</ul></div></body></html>"
        assert H.main_text(page) == "\n".join(["Heading", *body])


def test_sections_beside_the_densest_one_and_main_columns():
    r = random.Random(5)
    words = "the of and in on to this with reason theme subject".split()
    line = lambda n: " ".join(r.choices(words, k=n)) + "."
    for k in range(12):
        sections = [[line(r.randint(20, 60)) for _ in range(r.randint(2, 7))] + ["Short."] for _ in range(3)]
        inner = "".join("<section>" + "".join(f"<p>{p}</p>" for p in s) + "</section>" for s in sections)
        menu = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in words) + "</ul>"
        tag = ("article", "main", "div")[k % 3]
        page = f"<body>{menu}<div><{tag}><h1>Heading</h1>{inner}{menu if k % 2 else ''}</{tag}><div>{menu}</div></div><footer>{line(60)}</footer></body>"
        want = ["Heading", *(p for s in sections for p in s)]
        got = H.main_text(page).split("\n")
        if tag == "div":
            # without an element that holds the article a short line alone may miss the threshold; no link and no footer gets in
            assert [g for g in got if g != "Short."] == [w for w in want if w != "Short."]
        elif k % 2:
            assert [g for g in got if len(g) > 8] == [w for w in want if len(w) > 8]
        else:
            assert got == want


def test_deep_and_long_pages_take_linear_time():
    import time

    start = time.perf_counter()
    n = 100_000
    assert H.main_text("<div>" * n + "text" + "</div>" * n) == "text"
    assert H.main_text("<div>" * n + "text" + "</p></i></section>" * n) == "text"
    assert len(H.main_text("<article>" + "<p>some words here</p>" * 20000 + "</article>").split("\n")) == 20000
    assert H.main_text("<ul>" + "<li>x" * 20000).count("x") == 20000
    assert H.main_text("<p title=\"" * 20000 + ">x") == "x"
    assert H.main_text("< " * n + "<!--" * n).count("<") == n
    assert time.perf_counter() - start < 30


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (None, None, "<p>x", "t"), (2, "u", "<p>x", "t"), (2, "u", "<p>x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, H.extract(pages).collect()), key=str) == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "u", "x", 1), (2, "u", "x", 1)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def test_the_small_tables_pages(spark):
    """Against the pages' own marks: the article element, its blocks cut at p, br and h1."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("<p>|<br>|</p>|<h1>|</h1>", inner)]
        assert got[r["page_id"]] == "\n".join(filter(None, want))


PARAGRAPH = "The council met again on the bridge, and what it said of the price of salt was long, dull and in the end of no use to anyone at all."
FRAMED = {
    "<body><form id=aspnet><div><h1>T</h1><p>{0}</p><p>{0}</p><input name=q><select><option>a</select><label>User</label></div></form></body>": "T\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><p class=comment>{0}</p><p class=share>{0}</p><p>{0}</p></article>": "T\n{0}\n{0}\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><section id=login><p>{0}</p><p>{0}</p></section><section class=subscription><p>{0}</p></section></article>": "T\n{0}\n{0}\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><p>{0}</p></article><section class=discussion><div class=item><span class=author>Ann</span><p>I read this twice and still can't say that I agree with a word of it.</p></div></section>": "T\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><p>{0}</p><section class=discussion><div class=item><span class=author>Ann</span><p>{0}</p></div><div class=item><span class=author>Bob</span><p>{0}</p></div></section></article>": "T\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><p>{0}</p><div><ul><li><b>Ann</b> <time>2020-01-02</time><p>{0}</p></li><li><b>Bob</b> <time>2020-01-03</time><p>{0}</p></li></ul></div></article>": "T\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><div class=share><a href=x>Tell a friend of yours about this piece of news, which is on salt and drains and bridges</a></div><div class=login><p>{0}</p><input name=user></div><p class=subscribe>Get more.</p></article>": "T\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><div class=comments><div class=comment><p>{0}</p></div></div><div class=ad><p>{0}</p></div></article>": "T\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><form><p>{0}</p><input></form><p>{0}</p><p>{0}</p></article>": "T\n{0}\n{0}\n{0}",
    "<body><article><h1>T</h1><p>{0}</p><ul><li>In 1997 the bridge fell.</li><li>In 2001 it was built anew.</li></ul><p>{0}</p></article>": "T\n{0}\nIn 1997 the bridge fell.\nIn 2001 it was built anew.\n{0}",
}


@pytest.mark.parametrize("source", FRAMED)
def test_names_and_forms_only_nominate(source):
    assert H.main_text(source.format(PARAGRAPH)) == FRAMED[source].format(PARAGRAPH)


def test_whole_pages_with_other_elements_around_the_article():
    import duckdb

    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    names = ["x1", "content-42", "share", "comment", "login"]
    for k, page in enumerate(pages):
        want = H.main_text(page)
        inner = page.replace("<article>", f"<div class='{names[k % 2]}'>").replace("</article>", "</div>")
        assert H.main_text(inner) == want
        assert H.main_text(page.replace("<body>", "<body><form action=x method=post>").replace("</body>", "<input type=hidden name=state></form></body>")) == want
        if page.count("<p>") > 4:
            assert H.main_text(page.replace("<p>", f"<p class={names[k % 5]}>")) == want
