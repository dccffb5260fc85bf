import pytest

from lakeloom.operators.discover import Cancelled, DiscoverOptions, RawPages, discover
from lakeloom.operators.plugins import Candidate, EmbeddingRanker, decide, rerank, rerank_frame
from lakeloom.operators.robots import RobotsError, parse_robots, robots_of

SITE = {
    "/": '<title>Home</title><a href="/careers">Careers</a><a href="/oauth?utm_source=x">OAuth authentication</a><a href="/oauth#top">OAuth</a><a href="/private">OAuth private</a><a href="/oauth-authentication.png">OAuth</a><a href="https://other.test/oauth">OAuth</a><a href="/secret/oauth">OAuth</a><a href="/gone-oauth">authentication oauth</a>',
    "/oauth": '<title>OAuth guide</title><p>authentication</p><a href="/api">auth api</a><a href="/">home</a>', "/api": "<title>API</title><p>oauth</p>", "/careers": "<title>Careers</title>", "/private": "x", "/secret/oauth": "x",
}


def source(spark):
    return RawPages(spark.createDataFrame([("https://a.test" + p, h) for p, h in SITE.items()], "url string, html string"))


def test_best_links_first(spark):
    seen, waits = [], []
    options = DiscoverOptions("https://A.test/?utm_source=q", "OAuth authentication", max_pages=4, exclude_paths=("/secret",), delay_ms=100)
    robots = parse_robots("User-agent: *\nDisallow: /private\nCrawl-delay: 2\n")
    got = discover(source(spark), options, robots, progress=seen.append, clock=lambda: 0.0, sleep=waits.append)
    assert [p["url"] for p in got.pages] == ["https://a.test/", "https://a.test/oauth", "https://a.test/api"] and got.visited == 4
    assert [e["url"] for e in got.errors] == ["https://a.test/gone-oauth"]
    reasons = {s["url"].rpartition("/")[2]: s["reason"] for s in got.skipped}
    assert reasons["private"] == "robots.txt" and reasons["oauth-authentication.png"] == "non-HTML asset extension" and reasons["oauth"] == "path policy"
    assert got.pages[1]["relevance"] == 1 and got.pages[2]["depth"] == 2 and waits == [2.0] * 3
    assert seen[-1]["visited"] == 4 and got.frame(spark).count() == 3 + 1 + len(got.skipped)


def test_provider_ranker_and_stops(spark):
    class Api:
        def rank(self, goal, candidates):
            return [(c.id, 1.0) for c in candidates if c.id.endswith("/careers")]

        def choose(self, goal, candidates):
            return candidates[0].id

    got = discover(source(spark), DiscoverOptions("https://a.test/", "OAuth", max_pages=2, delay_ms=0, concurrency=2), ranker=Api(), provider=Api())
    assert [p["url"] for p in got.pages][1] in ("https://a.test/careers", "https://a.test/oauth")
    assert discover(source(spark), DiscoverOptions("https://b.test/", "x", delay_ms=0)).errors[0]["message"] == "no such page"

    def stop(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        discover(source(spark), DiscoverOptions("https://a.test/", "x", delay_ms=0), progress=stop)
    with pytest.raises(Cancelled):
        discover(source(spark), DiscoverOptions("https://a.test/", "x", delay_ms=0), cancelled=lambda: True)
    for wrong in ({"max_pages": 0}, {"max_depth": 21}, {"concurrency": 9}, {"min_score": 2}, {"include_paths": ("x",)}, {"goal": " "}, {"max_queue": 0}):
        with pytest.raises(ValueError):
            DiscoverOptions(**({"start": "https://a.test/", "goal": "x"} | wrong))


def test_robots():
    r = parse_robots("# x\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.php$\nDisallow:\n")
    assert r.allowed("https://x.test/") and not r.allowed("https://x.test/a/c") and r.allowed("https://x.test/a/b/c") and not r.allowed("https://x.test/q.php") and r.allowed("https://x.test/q.php5")
    assert not parse_robots("user-agent: lakeloom\nuser-agent: z\ndisallow: /\ncrawl-delay: 1.5").allowed("https://x.test/") and robots_of(404, "x").rules == []
    for status in (401, 403, 429, 503):
        with pytest.raises(RobotsError):
            robots_of(status, "")


def test_plugins(spark):
    c = [Candidate("a", "mail me at a@b.com", 0.2), Candidate("b", "x", 0.4)]

    class Fixed:
        def __init__(self, got):
            self.got, self.seen = got, None

        def rank(self, goal, candidates):
            return self.got

        def choose(self, goal, candidates):
            self.seen = candidates[0].text
            return self.got

    assert [x.id for x in rerank(Fixed([("a", 0.9)]), "g", c)] == ["a", "b"] and rerank(None, "g", c) == c
    for wrong in ([("z", 0.1)], [("a", 0.1), ("a", 0.2)], [("a", 1.1)], [("a", float("nan"))]):
        with pytest.raises(ValueError):
            rerank(Fixed(wrong), "g", c)
    p = Fixed("b")
    assert decide(p, "g", c) == "b" and p.seen == "mail me at [REDACTED EMAIL]" and decide(Fixed(None), "g", c) is None
    with pytest.raises(ValueError):
        decide(Fixed("q"), "g", c)
    calls = []
    ranker = EmbeddingRanker(lambda texts: calls.append(list(texts)) or [[1.0, 0.0] if t != "x" else [0.6, 0.8] for t in texts], 2)
    assert dict(ranker.rank("g", c)) == {"a": 1.0, "b": 0.6} and len(ranker.kept) == 2 and ranker.rank("g", []) == []
    cand = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.1)], "query_id int, id string, score double")
    got = rerank_frame(cand, spark.createDataFrame([(1, "a", 0.9)], "query_id int, id string, score double"), 1).collect()
    assert {(r.query_id, r.id, r.score) for r in got} == {(1, "a", 0.9), (2, "a", 0.1)}
    for wrong in ([(1, "z", 0.5)], [(1, "a", 0.5), (1, "a", 0.6)], [(1, "a", 1.5)]):
        with pytest.raises(Exception, match="ranker returned"):
            rerank_frame(cand, spark.createDataFrame(wrong, "query_id int, id string, score double"), 1).collect()
