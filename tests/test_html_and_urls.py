import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import urls as U
from lakeloom.functions import whatwg
from lakeloom.functions.html import DepthError, parse_tree, semantic_document
from lakeloom.functions.privacy import redacted, redacted_text, safe_error
from lakeloom.operators.extract import ExtractOptions, extract, extract_report, extracted, rendered
from lakeloom.sources.pages import captured_documents, documents, parsed_nodes

SHOP = (
    '<title>Shop</title><main><section><h2>Starter</h2><button aria-labelledby="label">X</button><span id="label">Buy now</span><label for="search">Search docs</label><input id="search">'
    '<input type="password" value="SECRET"><input type="checkbox" checked><a href="/docs">Docs</a><div hidden>Hidden</div><script>SECRET</script></section></main>'
)


def find(nodes, **want):
    return next(n for n in nodes if all(n[k] == v for k, v in want.items()))


def test_names_places_links_and_states():
    d = semantic_document(SHOP, "https://example.com")
    n = d["nodes"]
    button = find(n, role="button")
    assert (d["title"], button["name"], button["semantic_role"], button["context"]) == ("Shop", "Buy now", "checkout", "Starter")
    assert button["node_id"] in find(n, node_id=button["parent_id"])["children"] and button["ancestors"][-1] == button["parent_id"]
    assert next(x for x in n if x["locator"]["html_id"] == "search")["name"] == "Search docs"
    assert find(n, role="checkbox")["checked"] is True and find(n, role="link")["href"] == "https://example.com/docs"
    assert "SECRET" not in str(n) and "Hidden" not in str(n)
    assert find(n, tag="h2")["locator"]["css"] == "html > body:nth-of-type(1) > main:nth-of-type(1) > section:nth-of-type(1) > h2:nth-of-type(1)"


def test_what_users_type_is_left_out():
    n = semantic_document('<div contenteditable>typed</div><textarea aria-label="Note">typed</textarea><div role="slider" aria-valuetext="typed" aria-label="Size">x</div><select aria-label=Plan><option>Pro</select>', "https://a.test")["nodes"]
    assert "typed" not in str(n) and {x["role"] for x in n} == {"textbox", "slider", "combobox", "text"} and find(n, tag="textarea")["name"] == "Note"
    n = semantic_document('<fieldset disabled><button>Go</button></fieldset><a role="button" aria-expanded="false" href="javascript:x">M</a><section data-entity="plan:1"><p>In</section>', "https://a.test")["nodes"]
    assert find(n, name="Go")["disabled"] and find(n, name="M")["expanded"] is False and find(n, name="M")["href"] is None and find(n, tag="p")["entity"] == "plan:1"


def tree(e):
    return e.tag + ("(" + " ".join(k if isinstance(k, str) else tree(k) for k in e.kids) + ")" if e.kids else "")


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b", "p(a) p(b)"), ("<ul><li>a<li>b</ul>c", "ul(li(a) li(b)) c"), ("<p><b>x<p>y", "p(b(x)) p(b(y))"), ("<table><tr><td>1<td>2</table>", "table(tbody(tr(td(1) td(2))))"),
    ("a<br>b</p>", "a br b p"), ("<h1>a<h2>b", "h1(a) h2(b)"), ("<dl><dt>a<dd>b", "dl(dt(a) dd(b))"), ("<a href=x>1<a href=y>2", "a(1) a(2)"), ("<button>a<button>b", "button(a) button(b)"),
    ("<b>1<b>1<b>1<b>1<p>2", "b(1 b(1 b(1 b(1 p(2)))))"), ("<p>1</div>2", "p(1 2)"), ("<select><option>a<option>b</select>", "select(option(a) option(b))"), ("&lt;x&gt; &amp;", "<x> &"),
    ("<div><b>x</div>y", "div(b(x)) b(y)"), ("<table><tr><td><b>x</table>y", "table(tbody(tr(td(b(x))))) y"), ("x<!-- c --><script>if (a<b) {}</script>", "x script(if (a<b) {})"),
])
def test_tree(html, want):
    assert tree(parse_tree("<body>" + html).kids[1]) == f"body({want})"


def test_deep_and_broken_pages(spark):
    with pytest.raises(DepthError):
        semantic_document("<div>" * 120, "https://a.test")
    rows = [(1, "https://a.test/", SHOP, "x"), (2, "https://a.test/d", "<div>" * 5000 + "x", "y"), (3, None, "<p>x", "z"), (4, "https://a.test/", None, None), (None, "https://a.test/", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, nodes string")
    got = {r.page_id: r for r in documents(df).collect()}
    assert got[1].title == "Shop" and len(got[1].nodes) == 10 and got[2].error and got[4].error == "no HTML" and got[3].nodes[0].text == "x" and got[None].nodes == []
    assert parsed_nodes(df).where("page_id = 1").count() == 10 and documents(df.limit(0)).count() == 0


def test_rendered_pages(spark):
    node = lambda i, **x: {"id": f"f0-1:n{i}", "tag": "p", "text": f"t{i}", "framePath": [], "locator": {"css": "p", "testId": "q"}} | x
    rows = [(1, json.dumps({"url": "https://a.test/", "title": "T", "nodes": [node(i) for i in range(5)]})), (2, json.dumps({"nodes": [node(0, framePath=["f"] * 11), node(1)], "warnings": ["slow"]})), (3, "{"), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, document string")
    got = {r.page_id: r for r in captured_documents(df, 3).collect()}
    assert len(got[1].nodes) == 3 and got[1].warnings == ["more than 3 nodes, the rest left out"] and got[1].nodes[1].pos == 1 and got[1].nodes[0].locator.test_id == "q" and got[1].source == "browser"
    assert [n.node_id for n in got[2].nodes] == ["f0-1:n1"] and got[2].warnings == ["slow", "frames deeper than 10 left out"]
    assert got[3].warnings == got[4].warnings == ["unreadable document"] and not got[3].nodes
    for wrong in (0, 100_001, True):
        with pytest.raises(ValueError):
            captured_documents(df, wrong)


def test_extract_and_render(spark):
    html = '<title>Plans</title><h1>Plans</h1><ul><li><a href="/a_(b)">Pro *plan*</a></li></ul><p>Costs $5</p><h3>More</h3><button>Buy Pro</button><p>x</p>'
    pages = spark.createDataFrame([(1, "https://a.test/p", html), (2, "https://a.test/q", "<title></title>")], "page_id long, url string, html string")
    docs, nodes = documents(pages), parsed_nodes(pages)
    blocks = {r.text: r for r in extracted(nodes).collect()}
    assert blocks["Pro *plan*"].tag == "li" and blocks["Pro *plan*"].href == "https://a.test/a_(b)"
    body = {r.page_id: r.body for r in rendered(extract_report(docs, nodes)).collect()}
    assert body[1] == "# Plans\n\nSource: <https://a.test/p>\n\n[Pro \\*plan\\*](<https://a.test/a_%28b%29>)\n\nCosts $5\n\n### More\n\nBuy Pro\n\nx\n"
    assert body[2].startswith("# Untitled page\n\nSource: <https://a.test/q>\n\n> No readable content")
    text = {r.page_id: r.body for r in rendered(extract_report(docs, nodes, ExtractOptions(limit=2)), "text").collect()}
    assert text[1] == "Plans\n\nhttps://a.test/p\n\nPlans\n\nPro *plan* (https://a.test/a_(b))\n\nNote: Showing 2 of 6 matching blocks; increase --limit to include more.\n"
    best = extract(nodes, ExtractOptions(query="buy pro", limit=1)).collect()
    assert [(r.text, r.total) for r in best] == [("Buy Pro", 2)]
    assert extract(nodes, ExtractOptions(role="HEADING ")).count() == 2 and extract(nodes, ExtractOptions(scope="nothing")).count() == 0
    for wrong in ({"limit": 0}, {"limit": 10_001}, {"query": " "}, {"role": ""}, {"limit": True}):
        with pytest.raises(ValueError):
            ExtractOptions(**wrong)
    with pytest.raises(ValueError):
        rendered(extract_report(docs, nodes), "html")


URLS = {
    "https://example.com/docs?b=2&utm_source=test&a=1#title": "https://example.com/docs?a=1&b=2", "HTTP://Example.COM:80": "http://example.com/", "https://a.test/a/../b/./c%20d e": "https://a.test/b/c%20d%20e",
    "https://bücher.test/ü?ü=1 2": "https://xn--bcher-kva.test/%C3%BC?%C3%BC=1+2", "https://u:p@a.test/": None, "file:///etc/passwd": None, "mailto:a@b.c": None, "": None, "https://a.test/?a": "https://a.test/?a=", "https://a.test:8443/x?&&": "https://a.test:8443/x",
    "https://0x7f.1/": "https://127.0.0.1/", "https://[::1]:443/": "https://[::1]/", "https://a b.test/": None, "https://a.test/?FBCLID=1&gclidx=2": "https://a.test/?gclidx=2", "  https://a.test/x  ": "https://a.test/x", "https://a.test/.hidden/x": "https://a.test/.hidden/x",
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(k, v) for k, v in URLS.items()] + [(None, None)], "u string, want string")
    assert [(r.u, r.got) for r in df.select("u", U.canonical_url(F.col("u")).alias("got")).collect()] == [*URLS.items(), (None, None)]
    rel = spark.createDataFrame([("../x?b=1&a=2#h", "https://a.test/d/e/f"), ("//b.test", "http://a.test/"), ("?q=1", "https://a.test/p?z"), ("x", None), ("javascript:x", "https://a.test/")], "u string, b string")
    assert [r[0] for r in rel.select(U.canonical_url(F.col("u"), F.col("b"))).collect()] == ["https://a.test/d/x?a=2&b=1", "http://b.test/", "https://a.test/p?q=1", None, None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_one_form_is_final(tail):
    try:
        once = whatwg.canonical("https://a.test/" + tail)
    except ValueError:
        return
    assert whatwg.canonical(once) == once and once.isascii()


def test_hosts(spark):
    closed = ["localhost", "localhost:3000", "[::1]", "user@localhost", "LOCALHOST.", "2130706433", "0x7f.1", "a.local", "x.internal", "10.0.0.1", "[::ffff:10.0.0.1]", "224.0.0.1", "[64:ff9b::808:808]", "", None, "300.1.1.1"]
    free = ["example.com", "8.8.8.8", "8.8.8.8:80", "[2606:4700::1111]", "a-b.example.co.uk", "EXAMPLE.com."]
    df = spark.createDataFrame([(h,) for h in closed + free], "h string")
    assert [r[0] for r in df.select(U.public_host(F.col("h"))).collect()] == [False] * len(closed) + [True] * len(free)
    assert whatwg.target_allowed("https://example.com/x") and not whatwg.target_allowed("https://a:b@example.com/") and not whatwg.target_allowed("ftp://example.com/")


def test_redaction(spark):
    texts = ["mail é a.b@c.io", "see https://u:p@x.test/a?token=1&b=2#h now", "password: hunter2, ok", "Bearer abc.def", "plain", None, "sk-" + "a" * 24, "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redacted(F.col("t"))).collect()]
    assert got == [None if t is None else redacted_text(t) for t in texts]
    assert got[1] == "see https://x.test/a?token=%5BREDACTED%5D&b=2 now" and got[2] == "password=[REDACTED], ok" and "hunter2" not in str(got) and "BEGIN" not in got[7]
    assert safe_error(ValueError("/home/me/x failed: a@b.io"), "/home/me") == "[HOME]/x failed: [REDACTED EMAIL]"
