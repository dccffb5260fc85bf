import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakeloom import cli, doctor
from lakeloom.api import Engine
from lakeloom.functions.registered import NAMES, register
from lakeloom.operators.discover import DiscoverOptions, RawPages
from lakeloom.operators.locate import CACHE, cache_delete, cache_get, cache_set, locate
from lakeloom.operators.store import Closed
from lakeloom.sources.http import Answer, HttpFetcher, fetched
from lakeloom.sources.pages import parsed_nodes

PAGES = [
    (1, "https://a.test/1", '<h1>Shop</h1><button data-testid="buy">Buy now</button><button>Search</button><a href="/x">Docs</a>'),
    (2, "https://a.test/2", "<section><h2>Pro</h2><button>Buy now</button></section><section><h2>Team</h2><button>Buy now</button></section>"),
    (3, "https://a.test/3", "<button disabled>Buy now</button><button>Help</button>"), (4, "https://a.test/4", "<p>nothing"), (5, "https://a.test/5", '<button id="go">Checkout</button>'),
]


def raw(spark, pages=PAGES):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_locate(spark):
    got = {r.page_id: r for r in locate(parsed_nodes(raw(spark)), "buy").found.collect()}
    assert (got[1].status, got[1].kind, got[1].value, got[1].via) == ("found", "test_id", "buy", "heuristic")
    assert got[2].status == "ambiguous" and got[2].candidates.count('button "Buy now"') == 2
    assert got[3].status == "weak" and got[4].status == "none" and (got[5].kind, got[5].confidence) == ("html_id", 0.8)
    with pytest.raises(ValueError):
        locate(parsed_nodes(raw(spark)), " ")


def test_cache(spark):
    pages = raw(spark)
    now = F.lit(dt.datetime(2025, 1, 10)).cast("timestamp_ntz")
    first = locate(parsed_nodes(pages), "Buy ", pages, None, now)
    assert first.cache.count() == 2
    again = {r.page_id: r for r in locate(parsed_nodes(pages), "buy", pages, first.cache, now).found.collect()}
    assert again[1].via == "cache" and again[1].value == "buy" and again[2].status == "ambiguous"
    moved = raw(spark, [(1, "https://a.test/1", '<button data-testid="buy">Buy later</button>'), (5, "https://a.test/5", "<button>Checkout</button>")])
    got = locate(parsed_nodes(moved), "buy", moved, first.cache, now)
    assert {r.page_id: (r.via, r.kind) for r in got.found.collect()} == {1: ("heuristic", "test_id"), 5: ("heuristic", "role")}
    late = locate(parsed_nodes(pages), "buy", pages, first.cache, F.lit(dt.datetime(2025, 1, 18)).cast("timestamp_ntz"))
    assert {r.via for r in late.found.collect()} == {"heuristic"}
    e = [(k, *["x"] * 9, 0.5, dt.datetime(2025, 1, d)) for k, d in (("a", 1), ("b", 5), ("c", 9))]
    cache = cache_set(spark.createDataFrame([], CACHE), spark.createDataFrame(e, CACHE), 2)
    assert {r.key for r in cache.collect()} == {"b", "c"} and cache_delete(cache, spark.createDataFrame([("b",)], "key string")).count() == 1
    assert cache_get(cache, cache, now).count() == 2 and cache_get(cache, cache, F.lit(dt.datetime(2025, 1, 14)).cast("timestamp_ntz")).count() == 1


def web(answers):
    seen = []

    def opener(url, timeout, most):
        seen.append(url)
        a = answers[url]
        return a.pop(0) if isinstance(a, list) else a

    return opener, seen


HTML = {"content-type": "text/html; charset=utf-8"}


def test_fetcher(spark):
    waits = []
    opener, seen = web({
        "https://a.test/": [Answer(503, {}, b""), Answer(429, {"retry-after": "3"}, b""), Answer(200, HTML, "<p>é".encode())], "https://a.test/r": Answer(302, {"location": "/"}, b""), "https://a.test/local": Answer(302, {"location": "http://127.1/"}, b""),
        "https://a.test/loop": Answer(301, {"location": "/loop"}, b""), "https://a.test/big": Answer(200, HTML, b"x" * 2_000_001), "https://a.test/pdf": Answer(200, {"content-type": "application/pdf"}, b"x"), "https://a.test/404": Answer(404, HTML, b""),
        "https://a.test/wait": Answer(503, {"retry-after": "60"}, b""), "https://a.test/date": [Answer(503, {"retry-after": "Thu, 01 Jan 1970 00:00:05 GMT"}, b""), Answer(200, HTML, b"ok")],
    })
    f = HttpFetcher(opener=opener, sleep=waits.append, clock=lambda: 0.0)
    assert f.load("https://A.test/r").text == "<p>é" and waits == [0.25, 3.0] and seen[0] == "https://a.test/r"
    assert f.load("https://a.test/date").text == "ok" and waits[-1] == 5.0
    for path in ("local", "loop", "big", "pdf", "404", "wait"):
        with pytest.raises(ValueError):
            f.load(f"https://a.test/{path}")
    with pytest.raises(ValueError):
        f.load("https://a.test/r", lambda u: u.endswith("/r"))
    for wrong in ({"retries": 6}, {"timeout": -1}, {"retries": True}, {"timeout": float("inf")}):
        with pytest.raises(ValueError):
            HttpFetcher(**wrong)
    got = fetched(spark.createDataFrame([(1, "http://localhost/"), (2, None), (3, "x")], "page_id long, url string")).collect()
    assert all(r.error and r.html is None for r in got)


def test_engine(spark, tmp_path):
    e = Engine(spark, RawPages(raw(spark)), storage=str(tmp_path / "state"))
    nodes = e.nodes(raw(spark))
    assert e.locate(nodes, "buy", raw(spark)).found.count() == 5 and {r.via for r in e.locate(nodes, "buy", raw(spark)).found.where("page_id = 1").collect()} == {"cache"}
    assert [p["url"] for p in e.discover(DiscoverOptions("https://a.test/1", "shop", delay_ms=0)).pages] == ["https://a.test/1"]
    assert e.extract(raw(spark).withColumn("title", F.lit("T")), nodes, form="text").count() == 5
    doc = spark.createDataFrame([("https://a.test/", "all", '{"nodes":[{"id":"n1","text":"x"}]}', "2025-01-01")], "url string, watch_for string, document string, captured_at string")
    assert e.watch(doc).baselines.count() == 1 and e.history("https://a.test/", "all").count() == 0 and "<rss" in e.feed("https://a.test/", "all") and e.reset_watch("https://a.test/", "all")["baseline_removed"]
    e.close()
    e.close()
    for call in (lambda: e.nodes(raw(spark)), lambda: e.watch(doc), lambda: e.locate(nodes, "x")):
        with pytest.raises(Closed):
            call()
    with pytest.raises(ValueError):
        Engine(spark).watch(doc)


def test_command_line(spark, tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text(PAGES[0][2])
    base = ["https://a.test/1", "--html", str(page)]
    assert cli.main(["extract", *base, "--format", "markdown"], spark) == 0 and "# Untitled page" in capsys.readouterr().out
    assert cli.main(["dom", *base, "--compact"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["nodes"][0]["text"] == "Shop"
    assert cli.main(["locate", *base, "--query", "buy"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["value"] == "buy"
    raw(spark).write.parquet(str(tmp_path / "pages"))
    assert cli.main(["crawl", "https://a.test/1", "--pages", str(tmp_path / "pages"), "--goal", "shop", "--delay-ms", "0", "--output", str(tmp_path / "o" / "crawl.json")], spark) == 0
    assert json.loads((tmp_path / "o" / "crawl.json").read_text())["visited"] == 1
    watch = ["--for", "all", "--db", str(tmp_path / "db")]
    assert cli.main(["watch", *base, *watch, "--feed", str(tmp_path / "f.xml")], spark) == 0 and json.loads(capsys.readouterr().out)["baselines"] == 1 and "<rss" in (tmp_path / "f.xml").read_text()
    page.write_text(PAGES[0][2].replace("Docs", "Guides for all"))
    assert cli.main(["watch", *base, *watch], spark) == 0 and json.loads(capsys.readouterr().out)["events"]
    assert cli.main(["history", "https://a.test/1", *watch, "--limit", "1"], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 1
    assert cli.main(["reset", "https://a.test/1", *watch], spark) == 0 and json.loads(capsys.readouterr().out)["baseline_removed"]
    assert cli.main(["doctor", "--db", str(tmp_path / "db")], spark) == 0 and "FAIL" not in capsys.readouterr().out
    for wrong in (["crawl", *base], ["extract", *base, "--goal", "x"], ["dom"], ["watch", *base, *watch, "--format", "text"], ["extract", *base, "--limit", "0"], ["extract", "https://a.test/1"], ["history", "https://a.test/1", "--for", " ", "--db", "x"]):
        assert cli.main(wrong, spark) == 2
    assert all(c["ok"] for c in doctor.checks(spark))


def test_registered_functions(spark):
    assert register(spark) == NAMES
    r = spark.sql("SELECT tokens('Find the Café') AS t, lexical_score('buy', 'checkout') AS s, semantic_role('Buy', 'button') AS r, canonical_url('HTTPS://A.test?b=1&a=2#x') AS u, canonical_url('x') AS n, redact_text('a@b.io') AS e, redact_url('https://a.test/?key=1') AS k, public_host('localhost') AS h").first()
    assert r.t == ["cafe"] and r.s == 0.8 and r.r == "checkout" and r.u == "https://a.test/?a=2&b=1" and r.n is None and r.e == "[REDACTED EMAIL]" and r.k == "https://a.test/?key=%5BREDACTED%5D" and r.h is False
    raw(spark).createOrReplaceTempView("raw_pages")
    got = spark.sql("SELECT page_id, n.role, n.name FROM raw_pages, LATERAL parse_nodes(html, url) n WHERE page_id = 1").collect()
    assert {(x.role, x.name) for x in got} == {("heading", "Shop"), ("button", "Buy now"), ("button", "Search"), ("link", "Docs")}
