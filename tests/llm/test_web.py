import gzip
import hashlib
import io
import random
from html.parser import HTMLParser

import pytest

from lonewood.llm.html import extract_text, host_of, main_text, site_templates
from lonewood.llm.warc import WarcError, read_warc, record, records, write_warc

PAGES = "page_id long, url string, html string"


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="single-comment-page">
    <header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- x --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One  <i>two</i><br>three<p>four&nbsp;&eacute;<ul><li>a<li>b</ul><blockquote>q</blockquote>
    <script>if (a < b) "</p>"</script><aside>side</aside><form>f<input></form><div class="comments"><p>c</div><table><tr><td>1<td>2</table></article>
    <footer>&copy;</footer></body>"""
    assert main_text(page) == "Head & line\nOne two three\nfour é\na\nb\nq\n1\n2"
    assert main_text("<div><p>no article</p>tail</div><nav>x</nav>") == "no article\ntail"
    assert main_text("a < b and 2 > 1 <p") == "a < b and 2 > 1 <p"
    assert main_text("<p>cut off <b") == "cut off <b"
    assert main_text(None) == main_text("") == main_text("<nav>x") == ""
    assert main_text("<main><div id='cookie-notice'>n</div>text<br/>more</main>") == "text more"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_unclosed_elements_lose_no_text():
    assert main_text("<html><head><meta charset=utf-8><title>x</title><body><article><p>text</p></article>") == "text"
    assert main_text("<html><head><title>x</title><style>p{}</style><p>text</p>") == "text"
    for tag in ("object", "noscript", "select", "svg", "audio", "video", "canvas", "iframe", "math", "template"):
        assert main_text(f"<article><p>a</p><{tag} x='1'><p>b</p></article>") == "a\nb"
        assert main_text(f"<p>a</p><{tag}>no</{tag}><p>b</p><{tag}><p>c</p><{tag} y>no<{tag}>no</{tag}></{tag}><p>d</p>") == "a\nb\nc\nd"
        assert main_text(f"<p>a</p><{tag}/><p>b</p></{tag}><!-- <{tag}> --><script><{tag}></script><{tag}>no</{tag}><p>c</p>") == "a\nb\nc"
    for tag in ("script", "style", "textarea", "title"):
        assert main_text(f"<p>a</p><{tag}><p>b</p>") == "a"
    assert main_text("<video-player><p>a</p></video-player><p>b</p>") == "a\nb"


def test_classes_of_wrappers_lose_no_text():
    for wrap in ("<div class='site-content no-sidebar'>{}</div>", "<div class='with-sidebar'>{}</div>", "<div class='left-sidebar'>{}</div>", "<div class='sidebar'>{}</div>"):
        assert main_text(wrap.format("<article><p>text</p></article><div class='sidebar'>x</div>")) == "text"
    assert main_text("<div class='left-sidebar'><p>text</p></div><div class='no-sidebar'>more</div>") == "text\nmore"
    assert main_text("<article class='post comments-open'><h2 id='related'>head</h2><p class='notice-text'>text<p class='notice'>more</article>") == "head\ntext\nmore"
    assert main_text("<div class='sidebar' role='main'><p>text</p></div><p>out</p>") == "text"
    for name in ("ad", "x ads", "sidebar-left", "site-footer", "widget_area", "Comment-List", "ad-1", "cookie-notice", "main-nav"):
        assert main_text(f"<article><p>a</p><div class='{name}'><div><p>no</p></div>no</div><p>b</p></article>") == "a\nb"
        assert main_text(f"<p>a</p><div id='{name}'><div class=ad><p>no</p></div>no</div><p>b</p>") == "a\nb"


ARTICLE = "<h1>Head</h1><p>First line</p><p>Second line</p>"
PLAIN = "Head\nFirst line\nSecond line"


def test_wrappers_lose_no_article():
    a = f"<article>{ARTICLE}</article>"
    for page in (f"<form id=aspnetForm>{a}</form>", f"<form><nav>m</nav><main>{ARTICLE}</main><footer>f</footer></form>", f"<form id=f><h1>Head</h1>{ARTICLE[13:]}</form>",
                 f"<nav><ul><li>m</ul>{a}", f"<aside>side{a}", f"<button>go{a}", f"<body><nav>m<aside>x{a}<footer>f</footer></body>", f"<header>{a}</header>",
                 f"<div><nav>m{a}</div><p>out</p>", f"<nav>{a}</nav>", f"<fieldset>{a}</fieldset>", f"<div class=sidebar>{a}</div>", f"<span class=ad>x{a}"):
        assert main_text(page) == PLAIN, page
    assert main_text("<form><label>Name<input></label></form><p>text</p>") == "text"
    assert main_text(f"<aside><article><p>teaser</p></article></aside>{a}") == PLAIN
    assert main_text(f"<nav><article><p>teaser</p></article></nav><header>{a}</header>") == PLAIN  # the larger one


def test_comments_and_teasers_go():
    a = f"<article>{ARTICLE}</article>"
    for extra in ("<div id='comments' class='comments-area'><ol><li><article class='comment-body'>reader<p>says</p></article></ol></div>",
                  "<section class='related-posts'><article><p>teaser</p></article></section>", "<article class='comment'><p>reader</p></article>",
                  "<div class='post-comments'><p>reader</p></div>", "<div class='related-articles'><p>more</p></div>", "<section class='comments'><article><p>x</p></article></section>"):
        assert main_text(a + extra) == PLAIN, extra
        assert main_text(f"<article>{ARTICLE}{extra}</article>") == PLAIN, extra
        assert main_text(f"<main>{ARTICLE}{extra}</main>") == PLAIN, extra
    assert main_text(f"<main>{a}<article><p>next</p></article></main>") == PLAIN + "\nnext"


def test_adverts_inside_the_article_go():
    assert main_text("<article><p>a</p><p class='ad'>buy</p><p>b <span class='ad'>buy <b>now</b></span> c</p></article>") == "a\nb c"
    assert main_text("<article><p>a <span class='ads'>buy<p>b</p></article>") == "a\nb"
    assert main_text("<article><div class='entry-header'><h1>t</h1></div><div class='header'>x</div><p class='sponsored'>s</p></article>") == "t\nx"
    assert main_text("<p>a <a class='share'>share</a> b</p>") == "a b"


class Slow(HTMLParser):
    """Main text of plain pages by another way: a tree, then a walk."""

    GO = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "script", "style", "title", "head", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = ["", {}, None, []]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "ul", "div", "article") and self.now[0] == "p":
            self.now = self.now[2]
        node = [tag, dict(attrs), self.now, []]
        self.now[3].append(node)
        if tag not in ("br", "meta", "img", "input", "link", "hr"):
            self.now = node

    def handle_endtag(self, tag):
        x = self.now
        while x is not None and x[0] != tag:
            if x[0] in ("article", "div", "body", "nav", "ul") and tag not in ("article", "div", "body", "html", "nav", "ul"):
                return
            x = x[2]
        if x is not None:
            self.now = x[2] or self.root

    def handle_data(self, data):
        self.now[3].append(data)

    def text(self):
        lines, line = [], []

        def end():
            t = " ".join("".join(line).split())
            line.clear()
            if t:
                lines.append(t)

        def walk(node, inside):
            for x in node[3]:
                if isinstance(x, str):
                    if inside:
                        line.append(x)
                    continue
                if x[0] in self.GO or "ad" in (x[1].get("class") or "").split():
                    if inside:
                        end()
                    continue
                block = x[0] not in ("b", "i", "a", "em", "span", "br")
                if block:
                    end()
                if x[0] == "br" and inside:
                    line.append(" ")
                walk(x, inside or x[0] in ("article", "main"))
                if block:
                    end()

        walk(self.root, False)
        return "\n".join(lines)


def slow_text(page):
    p = Slow()
    p.feed(page)
    p.close()
    return p.text()


def test_given_pages_by_another_implementation(spark):
    """On pages with an article whose own parts no host repeats."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    whole = [r for r in rows if r.html and "<article>" in r.html]
    assert len(whole) > 0.9 * len(rows)
    assert [got[r.page_id] for r in whole] == [slow_text(r.html) for r in whole]


def test_broken_pages_keep_their_article():
    rng = random.Random(7)
    parts = ["<nav>m</nav>", "<nav><ul><li>m", "<aside>s", "<div class=ad>buy</div>", "<form>f</form>", "<button>go", "<!-- c -->", "<div class='sidebar'>s</div>", "<p>out", "</div>", "<header>h</header>"]
    tails = ["<footer>f</footer>", "<div class=comments><article>r</article></div>", "</p>", "<aside>x</aside>", "</body></html>", "<nav>m"]
    for _ in range(400):
        page = "".join(rng.choices(parts, k=rng.randint(0, 4))) + f"<article>{ARTICLE}</article>" + "".join(rng.choices(tails, k=rng.randint(0, 3)))
        assert main_text(page) == PLAIN, page


def site(n=10, host="h.example"):
    body = "<div class='x{0}'><p>Welcome to our site, page by page</p></div><div><p>Own text {0}</p><p>Shared line</p></div><section><h3>Also here</h3><p>All the same</p></section>"
    return [(i, f"https://{host}/{i}", "<html><body>" + body.format(i) + "</body></html>") for i in range(n)]


def test_template_of_a_site_goes(spark):
    rows = site() + [(100, "https://other.example/a", site()[0][2]), (101, None, "<p>x</p>"), (102, "", None)]
    r = {x.page_id: x for x in extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert all("Own text" in r[i].text and "Also here" not in r[i].text and "Welcome" not in r[i].text for i in range(10))
    assert "Also here" in r[100].text and "Welcome" in r[100].text  # one page shows no template
    assert (r[101].text, r[102].text, r[102].n_chars) == ("x", "", 0)
    assert r[101].n_chars == 1


def test_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://h/", f"<article><h1>Same</h1><p>Same line</p><p>{i}</p><div class='box'>Read on</div></article><p>after</p>") for i in range(10)]
    r = extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(x.text for x in r) == sorted(f"Same\nSame line\n{i}" for i in range(10))


def test_copies_of_a_page_are_one_page_of_the_host(spark):
    own = "<div><ul><li>first of {0}</li><li>second {0}</li></ul></div><table><tr><td>cell {0}</td></tr></table>"
    for wrap in ("<article><h1>T</h1>{}</article>", "<section>{}</section>"):
        same = [(i, f"http://h/{i}", wrap.format(own.format("x"))) for i in range(5)]
        rows = same + [(i, f"http://h/{i}", wrap.format(own.format(i))) for i in range(5, 12)]
        r = {x.page_id: x.text for x in extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
        assert all(r[i].endswith("first of {0}\nsecond {0}\ncell {0}".format("x" if i < 5 else i)) for i in range(12)), r


def test_near_copies_keep_their_article(spark):
    page = "<div class='top'>Menu</div><div class='w'><article><h1>T</h1><div><ul><li>A long list of own words</li></ul></div></article></div><p>Seen {} times</p>"
    r = extract_text(spark.createDataFrame([(i, "http://h/", page.format(i)) for i in range(10)], PAGES)).collect()
    assert {x.text for x in r} == {"T\nA long list of own words"}


def test_templates_are_bounded_and_names_may_clash(spark):
    d = spark.createDataFrame(site(20), PAGES)
    t = site_templates(d).collect()
    assert [x.host for x in t] == ["h.example"] and 0 < len(t[0].templates) < 40
    assert site_templates(spark.createDataFrame([], PAGES)).count() == extract_text(spark.createDataFrame([], PAGES)).count() == 0
    clash = d.selectExpr("page_id as host", "url", "html", "page_id as templates")
    assert sorted(x.host for x in extract_text(clash).collect()) == list(range(20))
    more = d.selectExpr("page_id", "url", "html", "1 as text", "2 as n_chars", "3 as `a.b`")
    assert {(x["a.b"], x.n_chars == len(x.text)) for x in extract_text(more).collect()} == {(3, True)}
    with pytest.raises(ValueError):
        extract_text(d.withColumnRenamed("page_id", "text"), keep=["text"])


def test_hosts(spark):
    urls = ["https://User:pw@WWW.a.Example:8080/x?y#z", "ftp://b.example", "no url", None, "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.h for r in df.select(host_of(df.u).alias("h")).collect()] == ["www.a.example", "b.example", "", "", ""]


def test_round_trip_by_brute_force(spark, tmp_path):
    long, other = "x" * 100, "é" * 60
    html = [long, long, "x" * 99, "x" * 99, other, None, "", long, other, "<p>" + "y" * 300000, "\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(20 - i, f"http://h/{i}" if i % 3 else None, h) for i, h in enumerate(html)] + [(10, "dup", long), (10, "dup", long), (None, "http://a b\r\n", other)]
    files = write_warc(spark.createDataFrame(rows, PAGES).repartition(4), folder=str(tmp_path / "w"), file_bytes=500)
    assert files.count() > 3
    got = read_warc(files, payload=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), first.get(h)
        to = None if to == i else to
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", str(to), None if to is not None else raw))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload and bytes(r.payload) if r.payload is not None else None) for r in got) == sorted(want)
    assert {r.url for r in got if r.page_id is None} == {"http://a%20b%0D%0A"}
    assert read_warc(write_warc(spark.createDataFrame([], PAGES))).count() == 0


def test_one_member_per_record_and_checks():
    data = [record(i, "http://h/", b"payload %d" % i, None) for i in range(5)]
    stream = b"".join(data)
    assert len(list(records(io.BytesIO(stream)))) == 5
    assert gzip.decompress(data[2]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    for broken in (stream[:-3], stream + b"x", gzip.compress(gzip.decompress(data[0]).replace(b"payload 0", b"payload 9")),
                   gzip.compress(gzip.decompress(data[0])[:-1]), gzip.compress(b"nothing")):
        with pytest.raises(WarcError):
            list(records(io.BytesIO(broken)))
    assert list(records(io.BytesIO(b""))) == []
