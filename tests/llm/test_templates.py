"""Site template removal against a brute-force count, and what is kept."""

from collections import defaultdict
from html.parser import HTMLParser

from quarry.llm import html


def site(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def unnamed(k, menu, foot):
    """A page without telling tags or names: only recurrence tells the template."""
    return f"<html><body><div><ul><li>home</li><li>{menu}</li></ul></div><div><p>story {k} begins</p><div><p>and goes on {k}</p></div></div><div><p>{foot}</p></div></body></html>"


def test_recurring_subtrees_decide(spark):
    rows = [(k, f"http://a.example/{k}", unnamed(k, "menu a", "foot a")) for k in range(6)]
    rows += [(100 + k, f"http://b.example/{k}", unnamed(k, "menu b", "foot b")) for k in range(3)]  # too few pages to tell
    for sent in (html.SENT_KEYS, 0):  # broadcast, and joined by page
        got = {r["page_id"]: r["text"] for r in html.main_text(site(spark, rows), sent_keys=sent).collect()}
        assert all(got[k] == f"story {k} begins and goes on {k}" for k in range(6))
        assert all(got[100 + k] == f"home menu b story {k} begins and goes on {k} foot b" for k in range(3))


def test_templates_match_a_brute_force_count(spark):
    rows = []
    for k in range(40):
        rows.append((k, f"http://{'ab'[k % 2]}.example/{k}", unnamed(k // 4, f"menu {k % 3}", f"foot {k % 7}") if k % 5 else unnamed(k, "same", "same")))
    rows += rows[:4]  # copies count once

    class Divs(HTMLParser):
        """Texts of the outermost div elements."""

        def __init__(self, source):
            super().__init__()
            self.depth, self.found = 0, []
            self.feed(source)

        def handle_starttag(self, tag, attrs):
            if tag == "div":
                self.depth += 1
                if self.depth == 1:
                    self.found.append("")

        def handle_endtag(self, tag):
            self.depth -= tag == "div"

        def handle_data(self, data):
            if self.depth:
                self.found[-1] += f" {data}"

    pages = defaultdict(set)
    for _, url, source in rows:
        for text in Divs(source).found:
            pages[url.split("/")[2], text].add(source)
    template = {key for key, on in pages.items() if len(on) >= html.MIN_PAGES}
    got = {r["page_id"]: r["text"] for r in html.main_text(site(spark, rows)).collect()}
    for k, url, source in rows:
        assert got[k] == " ".join(" ".join(t for t in Divs(source).found if (url.split("/")[2], t) not in template).split())
    assert len(template) == 5


def test_nothing_else_is_dropped():
    keep = {
        "<article>a <math><mi>x</mi> = 2</math> b</article>": "a x = 2 b",
        "<article><p>a <svg><path d=1><p>rest</article>": "a rest",
        "<article><p>a</p><math><mi>b<p>rest</article>": "a b rest",
        "<article><div class='promotion-history'>p</div><div class='social-science'>s</div></article>": "p s",
        "<nav>menu</nav><article>one</article><div>other</div><article>two</article>": "one two",
        "<article><p>t</p><button>b</button><aside>q</aside></article><aside>side</aside>": "t b q",
        "<div class=widget><article>main</article></div>": "main",
        "<div class=widget>all there is</div>": "all there is",
        "<article>x</article><article>x</article>": "x x",
    }
    assert {k: html.extract(k) for k in keep} == keep
    cut = {
        "<body><div class=comment>" + "c " * 500 + "</div><p>text</p></body>": "text",
        "<article>a<div class='share-buttons'>no</div><div id=comments-2>no</div><form>no</form></article>": "a",
        "<div id=comments><article>c</article></div><article>main</article>": "main",
        "<header class=site-header>h</header><main><p>m</p></main><footer>f</footer>": "m",
        "<div class='cookie-banner'>c</div><p>t</p><dialog>d</dialog>": "t",
    }
    assert {k: html.extract(k) for k in cut} == cut


def test_repeated_pages_are_rows_of_their_own(spark):
    rows = [(1, "http://a.example/", "<p>x</p>"), (1, "http://a.example/", "<p>x</p>"), (None, None, "<p>y</p>"), (2, None, None)]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.main_text(site(spark, rows)).collect())
    assert got == [(0, "y", 1), (1, "x", 1), (1, "x", 1), (2, "", 0)]


def test_registered_query(spark, sf_dir):
    from quarry.llm.registry import QUERIES
    from quarry.session import table

    got = QUERIES["op9_html"](spark, sf_dir)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == table(spark, sf_dir, "pages").count()
