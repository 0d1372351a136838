from __future__ import annotations

import html
import re

from foresift.llm import html_wrapper as H
from tests.llm.helpers import clash

PAGES = "page_id bigint, url string, html string"


def brute(page):
    """Text of the one article of a page of the given tables."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in lines if x)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in H.extract_main_text(pages).collect()}
    assert got == want


def by_layout(pages):
    """Templates of all pages, learned without Spark."""
    found = {}
    for url, page in pages:
        root = H.parse(page)
        key = url.split("/")[2], H.layout(root)
        found[key] = H.learn(found.get(key), H.skeleton(root)[0])
    return found


def test_templates_decide_without_any_names(monkeypatch):
    import pyarrow.parquet as pq
    rows = [(r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    monkeypatch.setattr(H, "DROP_TAGS", H.HIDDEN)
    monkeypatch.setattr(H, "DROP_WORDS", frozenset())
    monkeypatch.setattr(H, "DROP_ROLES", frozenset())
    templates = by_layout(rows)
    lone = [t for t in templates.values() if len(t[1]) < H.TEMPLATE_PAGES]
    same = differs = 0
    for url, page in rows:
        got = H.extract(page, templates[url.split("/")[2], H.layout(H.parse(page))])
        same += got == brute(page)
        differs += got != H.extract(page, None)
    assert same >= 0.99 * (len(rows) - len(lone) * H.TEMPLATE_PAGES) and differs >= 0.99 * same


def words(seed, n):
    """Text that differs from page to page."""
    return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(n))


def extract_site(spark, page, n=6):
    rows = [(i, "http://a.example/x", page(i)) for i in range(n)]
    return {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_varying_menus_adverts_and_footers_go_by_measure(spark):
    def page(i):
        menu = "".join(f"<li><a href=/{k}>{words(i * 50 + k, 1)}</a></li>" for k in range(6))
        return (f"<body><div class=xa><ul>{menu}</ul></div><div class=xb>{words(i + 900, 5)}</div><header><h1>{words(i, 6)}</h1></header>"
                f"<p>{words(i + 50, 12)}</p><div class=xc><h2>{words(i + 70, 4)}</h2><p>{words(i + 100, 150 if i else 3)}</p><ul><li>{words(i + 200, 2)}"
                f"</ul><div class=xd>{words(i + 300, 3)}</div></div><div class=xe>{words(i + 400, 6)}</div></body>")
    want = {i: "\n".join([words(i, 6), words(i + 50, 12), words(i + 70, 4), words(i + 100, 150 if i else 3), words(i + 200, 2),
                          words(i + 300, 3)]) for i in range(6)}
    assert extract_site(spark, page) == want            # also on the page whose own text is shorter than its advert


def test_names_do_not_outweigh_the_text(spark):
    def named(i):
        return (f"<body><form><div class=discussion><div class=notice><p>{words(i, 90)}</p><div class=share>{words(i + 9, 2)}</div></div></div></form>"
                f"<div class=bottom>{words(i + 20, 3)}</div>")

    def commented(i):
        return f"<body><div class=text><p>{words(i, 40)}</p></div><div class=comments><p>{words(i + 50, 150)}</p></div>"
    assert extract_site(spark, named) == {i: words(i, 90) for i in range(6)}
    assert extract_site(spark, commented) == {i: words(i, 40) for i in range(6)}


def test_deep_nesting(spark):
    def page(i):
        return (f"<body>{'<b>' * 1500}deep {i}{'</b>' * 1500}{'<div>' * 2000}<p>deeper {i}{'</div>' * 2000}<p>end {i}")
    assert extract_site(spark, page, 3) == {i: f"deep {i}\ndeeper {i}\nend {i}" for i in range(3)}


def site(i):
    return (f"<html><body><div class='top'>Our site</div><ul id='menu'><li>Home</ul><div class=content><h2>Title {i}</h2><p>Body &amp; text {i}"
            f"<p>More {i * i} words<br>and a line</div><div class='box'>Always the same</div><div class='comments'><p>Reader {i}</div></body>")


def test_template_finds_content_without_an_article(spark):
    rows = [(i, "http://a.example/x", site(i)) for i in range(6)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i}\nBody & text {i}\nMore {i * i} words and a line" for i in range(6)}


def test_same_text_on_small_hosts_and_titles_outside_the_content(spark):
    def page(i):
        return (f"<body><header><h2>Our site</h2></header><div class=top><a href=/>Home</a> <a href=/a>About</a></div><h1>Title {i}</h1>"
                f"<p>Lead {i}<div class=content><p>{f'Long body of page {i}. ' * 20}</div><div class=box>Always <b>the</b> same</div>")
    rows = [(10 * n + i, f"http://h{n}.example/", page(i)) for n in (2, 6) for i in range(n)]
    rows += [(100 + i, "http://copies.example/", page(0)) for i in range(4)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    want = [f"Title {i}\nLead {i}\n{(f'Long body of page {i}. ' * 20).strip()}" for i in range(6)]
    assert [got[20 + i] for i in range(2)] == want[:2]
    assert [got[60 + i] for i in range(6)] == want
    # copies prove nothing constant: only the header and the links go
    assert all(got[100 + i] == want[0] + "\nAlways the same" for i in range(4))


def test_templates_overrule_article_tags(spark):
    def teasers(i):
        cards = "".join(f"<article class=card>Teaser {i} {k}</article>" for k in range(2))
        return f"<body><div class=top>Our site</div><div class=text><h1>Title {i}</h1><p>{f'Body {i} words. ' * 20}</div>{cards}"

    def marked(i):
        return (f"<body><div class=top>Our site</div><h1>Title {i}</h1><article><p>{f'Body {i} words. ' * 20}</p><h2>Terms</h2>"
                f"<div>Repeated in all</div></article><div class=box>Always the same</div>")
    rows = [(10 * k + i, f"http://h{k}.example/", f(i)) for k, f in enumerate([teasers, marked]) for i in range(5)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(5):
        body = f"Title {i}\n" + (f"Body {i} words. " * 20).strip()
        assert got[i] == f"{body}\nTeaser {i} 0\nTeaser {i} 1"
        assert got[10 + i] == f"{body}\nTerms\nRepeated in all"


def test_host_with_many_layouts(spark):
    def page(k, i):
        parts = "".join(f"<div class='l{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + m)}'><b>Part {i} {m}</b></div>" for m in range(20))
        return f"<body><div class='view{chr(97 + k % 26)}{chr(97 + k // 26)}'>{parts}<div class=box>Always the same {k}</div></div>"
    rows = [(10 * k + i, "http://big.example/", page(k, i)) for k in range(100) for i in range(3)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {10 * k + i: "\n".join(f"Part {i} {m}" for m in range(20)) for k in range(100) for i in range(3)}


def test_boilerplate_inside_an_article():
    page = ("<body><nav>x</nav><main><article><header><h1>A&nbsp; B</h1></header><p>one<p>two <b>bold</b><aside>no</aside>"
            "<div class='share-buttons'>no</div><form>no</form><script>no</script><ul><li>i<li>j</ul><article class='comment'>no</article>"
            "</article></main><footer>no</footer>")
    assert H.extract(page, None) == "A B\none\ntwo bold\ni\nj"


def test_tree_matching():
    def t(name, *children):
        return [name, 1, 0, 0, list(children)]
    a = t("div", t("p"), t("ul", t("li"), t("b")), t("p"))
    b = t("div", t("ul", t("b")), t("hr"), t("p"))
    assert H.tree_match(a, b, {}) == 4
    assert H.tree_match(a, t("span"), {}) == 0
    assert H.pairs(a[4], b[4], {}) == [(1, 0), (2, 2)]


def test_awkward_rows(spark):
    rows = [(0, None, None), (1, "not a url", ""), (2, "http://h.example/", "<p>open <b>tags <i>x"), (2, "http://h.example/", "<p>open <b>tags <i>x"),
            (None, "http://h.example/", "<!-- never closed <p>x"), (3, "http://h.example/", "<p>" + "word " * 200_000)]
    got = H.extract_main_text(clash(spark.createDataFrame(rows, PAGES))).collect()
    by = sorted((r.page_id if r.page_id is not None else -1, len(r.text), r.text[:12]) for r in got)
    assert by == [(-1, 0, ""), (0, 0, ""), (1, 0, ""), (2, 11, "open tags x"), (2, 11, "open tags x"), (3, 999_999, "word word wo")]
    assert H.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0
