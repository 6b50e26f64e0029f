"""URL rules and HTML extraction."""

import os
import sys
import time
from html.parser import HTMLParser

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

from lookupforge.llm import html_consensus as H  # noqa: E402
from lookupforge.llm import url_rules as U  # noqa: E402
from lookupforge.llm.common import stage  # noqa: E402

URLS = [None, "", "no scheme", "http://", "https://ORG", "https://org/", "http://a.org/x", "http://aorg/x", "http://Example.ORG/es/1", "http://sub.example.org/es/", "http://example.org/ES/1", "http://example.org/en/123", "http://example.org/en/2", "http://x.com/fr/1?q=/de/", "http://x.com/de/?a", "http://x.com#/de/", "ftp://x.com:80/de/1", "http://cheap-pills.net/", "http://x.net/a-casino-b", "http://x.net/casinos", "http://spam-farm.example.org/en/9", "x://y://z.org/p", "http://İ.com/de/x", "http://a.com/fr/casino"]


def plain(url):
    """The contract's rules, one by one."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best and best[2]


def test_urls(spark):
    df = stage(spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, key string"), "t")
    got = {r.page_id: r for r in U.judge_urls(df, (*U.LIST_RULES, *U.PATTERN_RULES)).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        r = got[i]
        assert (r.host, r.path, r.rule if r.listed else None) == (host, path, rule), u
        if verdict:
            assert r.verdict == verdict
        else:
            assert r.verdict == ("block" if any(w in (u or "") for w in ("cheap-pills", "-casino-", "spam-farm")) else "allow"), u


def test_url_blocks(spark, monkeypatch):
    """Rules sent in several blocks judge alike."""
    df = stage(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), "t")
    rules = (*U.LIST_RULES, *U.PATTERN_RULES)
    whole = sorted(U.judge_urls(df, rules).collect(), key=str)
    monkeypatch.setattr(U, "BLOCK_BYTES", 60)
    assert sorted(U.judge_urls(df, rules).collect(), key=str) == whole


def test_only_candidates_run():
    index = U.RuleIndex((*U.LIST_RULES, *U.PATTERN_RULES), {"org": 100, "example": 5, "es": 50, "en": 60})
    assert {r.name for r, _ in index.candidates("a.org", "/x")} == {"org/"}
    assert {r.name for r, _ in index.candidates("example.org", "/de/")} == {"org/", "example.org/es/", "example.org/en/1", "com/de/"} & {r.name for r, _ in index.candidates("example.org", "/de/")}


def test_url_query(spark, sf_dir):
    for sf in (sf_dir, sf_dir.replace("0.001", "0.01")):
        assert oracle.compare(U.op7_url_rules(spark, sf), oracle.connect(sf), U.OP7_SQL) is None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="x">
<nav><ul><li><a href="/a">menu</a></li></ul></nav><header><h1>Site</h1></header><!-- ad --><div class="ad">buy</div>
<div class="cookie-notice">cookies</div><article class="post-12"><header><h1>Head&amp;line</h1><p>by me</p></header><p>One <b>bold</b>word
 and&nbsp;more.<br>Next<p>Two &lt;3<ul><li>item</li></ul><aside>aside</aside><form><p>form</p><input></form><table><tr><td>cell</td></tr></table>
<section><p>Deep.</p></section></article><div id="comments"><p>reader comment that is very long indeed, longer than the article itself, really, on and on</p></div>
<footer>&copy; me</footer></body></html>"""


def test_page():
    found, paths = H.blocks(PAGE)
    want = "Head&line\nOne boldword and more. Next\nTwo <3\nitem\ncell\nDeep."
    path = H.best_path(found, paths)[2]
    assert path == "/html/body.x/article.post-#" and H.main_text(found, paths, path) == want
    assert H.main_text(found, paths, "/not/here") == want and H.main_text([], H.Paths(), path) == ""


@pytest.mark.parametrize("page", [None, "", "<", "plain text", "<p>open", "<article>" * 50, "<!-- never closed <p>x</p>", "<script>x", '<p a="x>y', "</p></div></html>", "<nav><a>m</a><article><p>Body</p></article>"])
def test_broken_pages(page):
    text = H.main_text(*H.blocks(page or ""), None)
    assert text == {"plain text": "plain text", "<p>open": "open", "<nav><a>m</a><article><p>Body</p></article>": "Body"}.get(page, text)
    assert "x</p>" not in text


def test_consensus(spark):
    """A page whose longest container is not its article still yields the article, for its host's other pages say so."""
    rows = [(i, f"http://h.com/{i}", f"<body><div class='main-{i}'><p>{'good text ' * 30}{i}</p></div><div class='lower'><p>{'x ' * (600 if i == 3 else 5)}</p></div></body>", "p") for i in range(9)] + [(99, None, None, "p")]
    df = stage(spark.createDataFrame(rows, "page_id long, url string, html string, path string"), "t")
    got = {r.page_id: r for r in H.extract_pages(df).collect()}
    assert len(got) == 10 and got[99].text == "" and got[99].n_chars == 0
    assert all(got[i].text == ("good text " * 30 + str(i)) for i in range(9))


def test_winners_too_large_to_broadcast(spark, sf_dir, monkeypatch):
    whole = sorted(H.op5_html_consensus(spark, sf_dir).collect(), key=str)
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(H.op5_html_consensus(spark, sf_dir).collect(), key=str) == whole
    assert all(r.n_chars == len(r.text) and r.text for r in whole)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_pages(none).count() == 0 and U.judge_urls(none, U.LIST_RULES).count() == 0


def test_parts_of_plain_divs():
    """Sibling parts of a text in plain divs stay together, whatever their sizes; a container alone keeps its own path."""
    text = "long text " * 20
    page = f"<body><div class='content'><div class='intro'><p>intro</p></div><div class='text'><p>{text}</p></div></div></body>"
    assert H.main_text(*H.blocks(page), None) == f"intro\n{text.strip()}"
    page = f"<body><div class='content'><p>own</p><div class='text'><p>{text}</p></div></div></body>"
    assert H.main_text(*H.blocks(page), None) == f"own\n{text.strip()}"
    page = f"<body><div class='a'><div class='b'><p>{text}</p></div></div></body>"
    assert H.best_path(*H.blocks(page))[2] == "/body/div.a/div.b"
    page = f"<body><div class='a'><article><p>short</p></article><div class='x'><p>y</p></div></div></body>"
    assert H.main_text(*H.blocks(page), None) == "short"


@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_article_in_labelled_wrapper(name, tag):
    long_ = "card " * 50
    assert H.main_text(*H.blocks(f"<body><div class='{name}'><{tag}><p>Text</p></{tag}><div class='sidebar'><p>{long_}</p></div><p>loose</p></div></body>"), None) == "Text"
    assert H.main_text(*H.blocks(f"<body><main><div class='{name}'><article><p>Text</p><div class='share'><p>x</p></div></article></div></main></body>"), None) == "Text"
    # What labels drop beside an article stays dropped, as do hidden parts and comments.
    assert H.main_text(*H.blocks(f"<body><main><article><p>Text</p></article><div class='related'><article><p>{long_}</p></article></div></main></body>"), None) == "Text"
    assert H.main_text(*H.blocks(f"<body><div class='x'><p>Text</p></div><div id='comments'><article class='comment'><p>{long_}</p></article></div></body>"), None) == "Text"
    assert H.main_text(*H.blocks(f"<body><p>Text</p><div class='{name}' hidden><{tag}><p>{long_}</p></{tag}></div></body>"), None) == "Text"


class Plain(HTMLParser):
    """The text of a page's only article, block by block, with the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out, self.parts = 0, 0, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.inside and tag in H.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "aside", "form", "nav", "footer")

    def handle_endtag(self, tag):
        if self.inside and tag in H.BLOCKS:
            self.flush()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "form", "nav", "footer")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_pages_against_plain(spark, sf_dir):
    """Every page of the smallest tables, and repeated rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted((r.page_id, "\n".join(Plain(r.html or "").out)) for r in pages.collect() for _ in range(2))
    twice = stage(pages.union(pages), "t")
    assert sorted((r.page_id, r.text) for r in H.extract_pages(twice).collect()) == want


def test_hostile_nesting():
    """Deep nesting costs what its tags cost."""
    n = 20_000
    page = "<body>" + "".join(f"<div class='c{'x' * 20}'>a{i} " for i in range(n))
    began = time.time()
    assert H.main_text(*H.blocks(page), None).count("\n") == n - 1
    assert H.best_path(*H.blocks("<div class='w-1/2'><p>x</p></div>"))[2] == "/div.w-#|#"
    assert time.time() - began < 20


def test_vote_ties_and_names(spark):
    """Of paths with equal votes the last in order wins; one huge page has a bounded vote; clashing names do no harm."""
    page = lambda c, n: f"<body><div class='{c}'><p>{'w ' * n}</p></div><div class='{'ab'[c == 'a']}'><p>x</p></div></body>"
    rows = [(1, "http://t/1", page("a", 10), 1, "s"), (2, "http://t/2", page("b", 10), 1, "s")] + [(10 + i, "http://u/", page("a", 900), 1, "s") for i in range(4)] + [(20, "http://u/", page("b", 90_000), 1, "s")]
    got = {r.page_id: r for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int, path string")).collect()}
    assert got[1].path == got[2].path == "/body/div.b" and got[1].text == "x"
    assert got[10].path == "/body/div.a" == got[20].path and got[20].text == "x"


def test_rules_from_table(spark):
    """Many rules of all kinds, and only candidates run."""
    rows = [("domain", "block", f"host{i}.net", None) for i in range(100_000)] + [("wildcard", "block", "x.com/*/ads/", None), ("phrase", "block", "free-money", None), ("regex", "block", r"/id-\d+$", "id"), ("prefix", "allow", "host7.net", "/ok/")]
    index = U.RuleIndex(U.rules_from(rows), {})
    best = lambda host, path: (r := index.best(host, path)) and (r.name, r.verdict)
    assert best("a.host99.net", "/x") == ("domain:host99.net", "block") and best("nohost99.net", "/") is None
    assert best("host7.net", "/ok/1") == ("host7.net/ok/", "allow") and best("host7.net", "/no")[1] == "block"
    assert best("www.x.com", "/a/ads/1")[0] == "wildcard:x.com/*/ads/" and best("y.z", "/id-12")[1] == "block" and best("y.z", "/id-x") is None
    assert len(index.candidates("host99.net", "/free-money")) < 10
    with pytest.raises(ValueError):
        list(U.rules_from([("other", "block", "x", None)]))


def test_host_columns(spark):
    """The Columns cut URLs as the plain function does."""
    urls = [*URLS, "http://A\nb/c\nd?e", "http://é.com/ü#x", "://", "a://b://c/d", "http://x.com?q#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", U.host_of(df.url).alias("h"), U.path_of(df.url).alias("p")).collect():
        assert (r.h, r.p) == U.split_url(r.url) == plain(r.url)[:2], r.url
