import html as H
import re

from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import html as M


def plain(page):
    """The article by patterns, for pages of the test data's one shape."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    texts = (" ".join(H.unescape(re.sub(r"<[^>]*(>|$)", lambda t: " " if t[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_all_pages_against_patterns(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = M.query(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: plain(v) for k, v in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_article_without_its_surroundings():
    page = """<html><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Ti&amp;tle</h1></header><p>One  two<br>three<p>Four <b>bo</b>ld&nbsp;x<div class="share">Share</div>
    <ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><form>f</form><script>var a = "<p>no</p>"</script>
    <section id="comments"><p>Nice!</p></section></article><aside>side</aside><footer>foot</footer></body>"""
    assert M.main_text(page) == "Ti&tle\nOne two three\nFour bold x\na\nb\n1 2\n3"


def test_names_do_not_drop_the_text():
    cases = {
        "<article class='post has-sidebar'><p>Text of the page</p></article>": "Text of the page",
        "<div class='layout sidebar'><article><p>Text of the page</p></article></div>": "Text of the page",
        "<div class='sidebar'>Short</div><div class='widget'><article><p>Text</p></article></div><div class=x>Other text, longer than all else</div>": "Text",
        "<div class='layout sidebar'><p>Text without any mark</p></div><div class='sidebar'>Box</div>": "Text without any mark",
        "<article><p>One, the longest of all of them</p><h2 id='related-work'>Related work</h2><p class='comment'>Two</p></article>": "One, the longest of all of them\nRelated work\nTwo",
        "<article><p>One, the longest of all of them</p><section id='comments-in-python'><p>Three</p></section></article>": "One, the longest of all of them\nThree",
        "<article><p>One, the longest of all of them</p><pre><code>x <span class='hljs-comment'># y</span></code></pre></article>": "One, the longest of all of them\nx # y",
        "<article><p>One, the longest of all of them</p><div class='share-box'>S</div><ul class='social'><li>S</ul><div id='comments'>C</div></article>": "One, the longest of all of them",
        "<div class='related'><article>A teaser of another page</article></div><article><p>The text itself, longer than the teaser</p></article>": "The text itself, longer than the teaser",
    }
    for page, want in cases.items():
        assert M.main_text(page) == want, page


def test_broken_pages():
    cases = {
        "plain < text & more": "plain < text & more", "<p>un<i>closed": "unclosed", "<div><p>a</div>b": "a\nb", '<a href="x>y">z</a> t<!-- c -- > d --> e <!-- open': "z t e", "</p></div>x": "x", "<h1>A<p>B</h1>C": "A\nB\nC",
        "<p>a<div>b</div>c</p>d": "a\nb\nc\nd", "&#65;&eacute;&lt;b&gt; &amp &am": "Aé<b> & &am", "text <p": "text", "<p>x</p": "x", "<script>lost": "", "<!DOCTYPE html><?xml ?>x": "x", "": "", "<p>a\u3000 b</p>": "a b",
    }
    for page, want in cases.items():
        assert M.main_text(page) == want, page
    assert M.main_text(None) == ""


def test_words_of_classes_above_and_in_an_article():
    text = "<p>Text of the article itself, of some length</p>"
    for page in (f'<div class="layout has-sidebar"><article>{text}</article></div>', f'<article class="post comments-open">{text}</article>', f'<article id="menu-guide">{text}</article>', f'<div id="sidebar"><div class="widget"><article>{text}</article></div></div>'):
        assert M.main_text(page) == "Text of the article itself, of some length"
    assert M.main_text(f'<article>{text}<section id="market-share"><p>Shares</p></section><p class="widget-free">Free</p></article>').endswith("\nShares\nFree")


def test_all_articles_in_page_order():
    assert M.main_text("<main><article><p>One</p></article><article><p>Two, longer</p></article></main><article>Three</article>") == "One\nTwo, longer\nThree"
    assert M.main_text("<article><p>The text</p></article><article><a href=x>A teaser that is a link</a></article>") == "The text"
    assert M.main_text("<article><script>" + "x = 1; " * 100 + "</script></article><article>Text</article>") == "Text"
    assert M.main_text("<main><script>" + "x = 1; " * 100 + "</script></main><div role=main><p>Text</p></div>") == "Text"


def test_time_is_linear_in_nesting():
    import time

    pages = ["<span>{}<li>", "<div></p></b>{}", "<b>{}<hr>", "<i>{}<td>", "<ul><span>{}</li></q>", "<a 'x>{}</a \">"]
    for page in pages:
        start, _, stop = page.partition("{}")
        took = []
        for n in (10_000, 100_000):
            began = time.process_time()
            M.main_text(start * n + stop * n + "x")
            took.append(time.process_time() - began)
        assert took[1] < 40 * max(took[0], 0.05), (page, took)


def test_deep_and_long_pages():
    assert M.main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(M.main_text("<p>word</p>" * 50_000)) == 5 * 50_000 - 1
    assert M.main_text("<" * 100_000 + " x") == "<" * 100_000 + " x"


def site(n, host="h.com"):
    return [(i, f"http://{host}/{i}", f"<div class=x1><p>Same box</p><p>more</p></div><div><p>Text number {i} here</p></div>") for i in range(n)]


SCHEMA = "page_id bigint, url string, html string"


def test_recurring_subtrees_are_template(spark):
    for n, want in ((9, "Text number 3 here"), (M.MIN_PAGES, "Text number 3 here"), (M.MIN_PAGES - 1, "Same box\nmore\nText number 2 here")):
        found = {r["id"]: r["text"] for r in M.extract(spark.createDataFrame(site(n), SCHEMA)).collect()}
        assert found[min(3, n - 1)] == want


def test_another_host_keeps_the_same_text(spark):
    rows = [*site(9), (100, "http://other.com/", "<div class=x1><p>Same box</p><p>more</p></div>")]
    assert {r["id"]: r["text"] for r in M.extract(spark.createDataFrame(rows, SCHEMA)).collect()}[100] == "Same box\nmore"


def test_copied_articles_keep_their_text(spark):
    page = "<body><div>Box of the site</div><article><h1>T</h1><p>Same article everywhere</p><div class=q>Also in it, on all pages</div></article></body>"
    rows = [(i, f"http://h.com/{i}", page) for i in range(12)]
    assert {r["text"] for r in M.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T\nSame article everywhere\nAlso in it, on all pages"}


def test_copies_do_not_vote_their_body_out(spark):
    parts = "".join(f"<section><p>Part {k} of the text</p></section>" for k in range(3))
    marked = [(i, f"http://h.com/{i}", f"<body><div>Box {i}</div><article>{parts}</article></body>") for i in range(12)]
    other = [(100 + i, f"http://h.com/o{i}", f"<article><div>Site box</div><section><p>Own text {i}, longer than it</p></section></article>") for i in range(6)]
    bare = [(200 + i, f"http://b.com/{i}", f"<body>{parts}</body>") for i in range(12)]
    found = {r["id"]: r["text"] for r in M.extract(spark.createDataFrame([*marked, *other, *bare], SCHEMA)).collect()}
    whole = "\n".join(f"Part {k} of the text" for k in range(3))
    assert {found[i] for i in [*range(12), *range(200, 212)]} == {whole}
    assert [found[100 + i] for i in range(6)] == [f"Own text {i}, longer than it" for i in range(6)]


def counted(pages, min_pages=M.MIN_PAGES, share=M.MIN_SHARE):
    """Hashes that recur on each host, counted page by page."""
    seen = {}
    for _, url, page in pages:
        host = url.split("/")[2]
        content, keys = M.subtree_keys(page)
        seen.setdefault(host, {}).setdefault(content, set()).update(keys)
    out = {}
    for host, by_content in seen.items():
        if len(by_content) >= min_pages:
            n = {}
            for keys in by_content.values():
                for k in keys:
                    n[k] = n.get(k, 0) + 1
            out[host] = {k for k, v in n.items() if v >= min_pages and v >= share * len(by_content)}
    return out


def test_templates_equal_a_plain_count(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()] + site(9) + site(60, "g.com") + site(3, "k.com")
    found = {r["host"]: {k & (2**64 - 1) for k in r["keys"]} for r in M.templates(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert found == counted(pages) and any(found.values())


def test_notices_and_boxes_whose_text_differs(spark):
    notice = "<p class=notice>Read all of our offers of this week</p>"
    lists = "".join(f"<div class='teasers'><a href=x>Teaser number {i} of a list</a></div>" for i in range(2))
    page = "<body><div class=promo-box>Buy number {0} of it</div>" + lists + "<article><h2>Summary</h2><p>Text number {0} of the article</p>{1}<div class='comments'>Reader {0} says</div></article></body>"
    rows = [(i, f"http://h.com/{i}", page.format(i, notice if i % 2 else "")) for i in range(12)]
    found = {r["id"]: (r["text"], r["n_template"]) for r in M.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(v == (f"Summary\nText number {k} of the article", found[0][1]) for k, v in found.items()) and found[0][1] >= 3
    bare = [(i, u, h.replace("article", "div")) for i, u, h in rows]
    found = {r["id"]: r["text"] for r in M.extract(spark.createDataFrame(bare, SCHEMA)).collect()}
    assert all(v == f"Text number {k} of the div" for k, v in found.items()), found[3]


def test_lines_that_articles_share_stay(spark):
    page = "<body><nav>Menu</nav><article><h1>T</h1><p>A line that all articles have</p><p>Text number {0}</p></article></body>"
    found = M.extract(spark.createDataFrame([(i, f"http://h.com/{i}", page.format(i)) for i in range(12)], SCHEMA)).collect()
    assert all(r["text"] == f"T\nA line that all articles have\nText number {r['id']}" for r in found)


def test_a_name_alone_deletes_nothing_on_a_counted_host(spark):
    rows = [(i, f"http://h.com/{i}", f"<article><p>Text number {i} of the article, some words long</p></article>") for i in range(8)]
    rows.append((8, "http://h.com/8", "<article><p>Text of an article on the trade in shares</p><div class='share notice'>Part of its text</div></article>"))
    found = {r["id"]: r["text"] for r in M.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[8].endswith("\nPart of its text")


def test_edge_rows_and_foreign_columns(spark):
    rows = [(1, None, "<p>a</p>"), (2, "x", None), (None, "http://h/", ""), (3, "http://h/", "<p>b</p>"), (3, "http://h/", "<p>b</p>")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "keys": F.lit(2), "text": F.lit("t")})
    found = sorted(((r["id"], r["text"], r["n_chars"]) for r in M.extract(pages).collect()), key=str)
    assert found == sorted([(1, "a", 1), (2, "", 0), (None, "", 0), (3, "b", 1), (3, "b", 1)], key=str)
    assert M.extract(pages.limit(0)).collect() == []


ARTICLE = "<article><h1>T</h1><p>The text of the page, some words long</p></article>"
BODY = "T\nThe text of the page, some words long"


def test_what_only_surrounds_the_text_stays():
    for tag in ("form", "aside", "fieldset", "dialog", "search", "div hidden", "div role=search", "div role=dialog", "section aria-hidden=true", "div style='display: none'", "nav", "footer", "header"):
        name = tag.split()[0]
        assert M.main_text(f"<body><nav><a href=/>Home</a></nav><{tag}>{ARTICLE}</{name}><footer>Imprint</footer></body>") == BODY, tag
        assert M.main_text(f"<body><{tag}><div><{tag}>{ARTICLE}</{name}></div></{name}></body>") == BODY, tag
        if name not in ("nav", "footer"):
            assert M.main_text(f"<body><{tag}><p>A text without any mark that is most of the page</p></{name}><div>Box</div></body>").startswith("A text without any mark"), tag
    form = f"<form><input value=x><header>Site</header><nav><a href=/>Home</a></nav>{ARTICLE}<aside><article>A teaser in a sidebar</article></aside><button>Send</button><footer>Imprint</footer></form>"
    assert M.main_text(f"<body>{form}</body>") == BODY
    assert M.main_text(f"<body>{ARTICLE}<aside><article>A teaser in a sidebar</article></aside><form><article>Another</article></form></body>") == BODY
    assert M.main_text("<article><form><p>All of the text stands in a form</p></form></article>") == "All of the text stands in a form"


def test_main_gives_its_own_text_beside_its_articles():
    assert M.main_text(f"<main><h1>Before</h1><p>Lead</p>{ARTICLE}<p>After</p><nav>Menu</nav><article><a href=x>A teaser that is a link</a></article></main><p>Outside</p>") == f"Before\nLead\n{BODY}\nAfter"
    assert M.main_text(f"<div role=main><p>Lead</p><div>{ARTICLE}</div><div>{ARTICLE}</div></div>{ARTICLE}") == f"Lead\n{BODY}\n{BODY}\n{BODY}"


def test_main_without_template_in_spark(spark):
    page = "<body><main><p>Lead number {0}</p><div class=x><p>Box of the site</p></div><article><p>Text number {0}, some words long</p></article></main></body>"
    found = M.extract(spark.createDataFrame([(i, f"http://h.com/{i}", page.format(i)) for i in range(12)], SCHEMA)).collect()
    assert all(r["text"] == f"Lead number {r['id']}\nText number {r['id']}, some words long" for r in found)


def test_reader_comments_go_on_every_host(spark):
    said = "<article class=comment><p>A reader says much more than the article itself, in very many words indeed</p></article>"
    boxes = [f"<div id=comments>{said}</div>", f"<section class='post comments-area'>{said}</section>", f"<ol class=comment-list><li class=comment>{said}</li></ol>", f"<aside class='reader-comments'>{said}</aside>", said]
    rows = [(i, f"http://h.com/{i}", f"<body>{ARTICLE.replace('some', str(i))}</body>") for i in range(40)]
    rows += [(100 + i, "http://h.com/c", f"<body>{ARTICLE}{box}</body>") for i, box in enumerate(boxes)] + [(200 + i, "http://h.com/d", f"<body>{ARTICLE.replace('</article>', box + '</article>')}</body>") for i, box in enumerate(boxes)]
    found = {r["id"]: r["text"] for r in M.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {v for k, v in found.items() if k >= 100} == {BODY}
    assert M.main_text("<body><div class=comments><p>A page of comments alone</p></div></body>") == "A page of comments alone"
    assert M.main_text(f"<body>{ARTICLE}<div class='comments-policy'>x</div></body>") == BODY
    assert M.main_text("<article><p>Text</p><div class='comment-syntax'>How to comment</div></article>", frozenset()) == "Text\nHow to comment"
