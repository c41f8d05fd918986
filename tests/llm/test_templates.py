import pytest

from hazegrid.llm import templates
from hazegrid.llm.html_blocks import read_page

HEAD = "<!DOCTYPE html><html><head><title>T {n}</title><style>p{{x}}</style><script>var t='</p><article>no</article>';</script></head><body>"
ARTICLE = HEAD + (
    "<nav><ul><li><a href='/{n}'>menu {n}</a></ul></nav><header>Site</header><!-- <p>note</p> --><div class='ad big'>buy {n}</div>"
    "<article><h1>Title&nbsp;{n} &amp; more</h1><p><b>First  {n}<br>line<p>Second\n one <em>em</em>phasis &lt;b&gt;</p><p>The same<span class='ad'>BUY <i>now</i></span> line.</p>"
    "<form><input><p>mail?</p></form><div class=\"share-buttons\">share</div><ul><li>one<li>two</ul><section id='comments'><p>reader {n}</p></section></article>"
    "<aside>side</aside><div role='contentinfo'>c</div><footer>&copy; host</footer></body></html>"
)
WANT = "Title {n} & more\n\nFirst {n} line\n\nSecond one emphasis <b>\n\nThe same line.\n\none\n\ntwo"
PLAIN = HEAD + "<div class='top'>Welcome to the site</div><div class='wrap'><div class='story'><h2>Head {n}</h2><p>" + "Words of page {n}. " * 9 + "</p></div></div><div class='low'>Imprint here</div></body>"


def test_pages(spark):
    rows = [(i, "http://a.example/x", ARTICLE.format(n=i)) for i in range(4)] + [(i, "http://b.example/y", PLAIN.format(n=i)) for i in range(4, 8)]
    rows += [(8, "http://b.example/z", None), (9, None, ARTICLE.format(n=9)), (10, "http://c.example/", ""), (11, "http://c.example/1", "no tags at all &amp; more"), (0, "http://a.example/x", ARTICLE.format(n=0))]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, slot string")
    got = templates.extract(pages)
    assert got.columns == ["page_id", "url", "slot", "text", "n_chars"] and got.count() == len(rows)
    for r in got.collect():
        i = r["page_id"]
        if i < 4 or i == 9:
            assert r["text"] == WANT.format(n=i)
        elif i < 8:
            assert r["text"] == f"Head {i}\n\n" + " ".join([f"Words of page {i}."] * 9)
        assert r["n_chars"] == len(r["text"])
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert texts[8] == texts[10] == "" and texts[11] == "no tags at all & more"
    assert templates.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("source", ["<", "<p", "<!--", "<script>", "</p></b>", "<p x='", "<![CDATA[ x", "<a b=\"c' d>t</a>", "<p>" * 3000 + "x", "<div>" * 500 + "x", "&#x0;&bad;&am", "<script>a</script", "x" * 200_000, "<b " * 20_000, "<a='" * 5_000])
def test_broken_pages_are_read(source):
    read_page(source)


def test_copies_of_a_page_are_no_template(spark):
    one, two, three = (PLAIN.format(n=n) for n in (1, 2, 3))
    rows = [(1, "http://a.example/1", one), (2, "http://a.example/2", one)]
    rows += [(3, "http://b.example/1", two), (4, "http://b.example/2", two), (5, "http://b.example/3", two), (6, "http://b.example/4", one), (7, "http://b.example/5", three)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in templates.extract(pages).collect()}
    story = lambda n: f"Head {n}\n\n" + " ".join([f"Words of page {n}."] * 9)
    assert story(1) in texts[1] and texts[1] == texts[2]
    assert [texts[i] for i in (3, 4, 5, 6, 7)] == [story(n) for n in (2, 2, 2, 1, 3)]
    # runs of the template are kept if nothing else is there
    assert templates.main_text("<p>all the same</p>", None, {templates._run_token("/p", "all the same")}) == "all the same"


STORY = "A story that is long enough to be the page. " * 5


@pytest.mark.parametrize(
    "source",
    [
        "<body class='has-sidebar right-sidebar'><article><p>{s}</article><div class=sidebar>side</div>",
        "<html id=header><body class='menu'><p>{s}</p>",
        "<article class='post comments-open'><p>{s}</p></article><div class='comments'><article>other</article></div>",
        "<main class='search'><p>{s}</p></main>",
        "<div id='content-with-menu'><p>{s}</p></div>",
        "<div class='search-result'><p>{s}</p></div><div class='main-menu'>go</div>",
        "<div class='widget'><p>{s}</p></div><div class='ad'>buy</div>",
        "<div class='social'><article>{s}</article></div><p class='site-footer'>imprint</p>",
    ],
)
def test_names_around_the_article_do_not_drop_it(source):
    assert templates.main_text(source.format(s=STORY), None, set()) == STORY.strip()


@pytest.mark.parametrize("name", ["comments", "related-posts", "comment-list", "replies"])
def test_long_texts_of_readers_stay_out(name):
    assert templates.main_text(f"<div><p>short</p></div><div class='{name}'><article><p>{STORY}</p></article></div>", None, set()) == "short"
