import json

import pytest

from lakeloom.operators.store import Closed, Conflict, WatchStore, complaint, watch_key

SCHEMA = "url string, watch_for string, document string, captured_at string, ignore_text array<string>, extra string"


def doc(*nodes, **more):
    return json.dumps({"url": "https://a.test/", "nodes": [dict(id=f"n{i}", tag="p", role="text", text=t, name=t, interactive=False, disabled=False, **x) for i, (t, x) in enumerate(nodes)]} | more)


def price(text):
    return (text, {"semanticRole": "price", "context": "Plans"})


def captures(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (6 - len(r))) for r in rows], SCHEMA)


def test_check_history_feed_reset(spark, tmp_path):
    store = WatchStore(spark, str(tmp_path), max_events=3)
    url = "https://a.test/?utm_source=x"
    first = store.check(captures(spark, (url, "All", doc(price("$10 / month"), ("Hello there", {})), "2025-01-01"), (url, "all", doc(("old", {})), "2024-01-01"), ("mailto:x", "all", doc(("x", {})), "2025-01-01"), (url, "other", doc(), "2025-01-01")))
    assert first.version == 1 and first.events.count() == 0 and first.baselines.count() == 1
    assert sorted(r.reason.split(" ")[0] for r in first.rejected.collect()) == ["Empty", "No"]
    second = store.check(captures(spark, ("https://a.test/", "all", doc(price("$12 / month"), ("Hello there", {})), "2025-01-02")))
    e = second.events.collect()
    assert [(r.event_type, r.before_text, r.after_text, r.context) for r in e] == [("pricing-change", "$10 / month", "$12 / month", "Plans")] and second.baselines.count() == 0
    assert store.check(captures(spark, (url, "all", doc(price("$12 / month"), ("Hello there", {})), "2025-01-03"))).events.count() == 0
    bad = store.check(captures(spark, (url, "all", doc(warnings=["cut"]), "2025-01-04"), (url, "all", "{", "2025-01-04"), (url, "all", None, "2025-01-04")))
    assert bad.rejected.count() == 3 and json.loads(store.snapshots().first().document)["nodes"]
    for i in range(4):
        store.check(captures(spark, (url, "all", doc(price(f"${20 + i} / month")), f"2025-02-0{i + 1}")))
    history = store.history(url, "ALL ").collect()
    assert len(history) == 3 and history[0].after_text == "$23 / month" and store.history(url, "all", limit=1, offset=1).first().after_text == "$22 / month"
    rss, atom = store.feed(url, "all"), store.feed(url, "all", "atom")
    assert rss.count("<item>") == 3 and rss.startswith("<?xml") and atom.count("<entry>") == 3 and "2025-02-04T00:00:00.000Z" in atom
    assert "<item>" not in store.feed("https://b.test/", "all") and "1970-01-01" in store.feed("https://b.test/", "all", "atom")
    assert store.reset(url, "all") == {"baseline_removed": True, "events_removed": 3} and store.reset(url, "all") == {"baseline_removed": False, "events_removed": 0}
    assert store.snapshots().count() == 0 and store.events().count() == 0


def test_goals_and_ignored_text(spark, tmp_path):
    store = WatchStore(spark, str(tmp_path))
    one, two = doc(price("$1"), ("seen by 5 people", {}), ("Welcome", {})), doc(price("$2"), ("seen by 6 people", {}), ("Goodbye", {}))
    rows = [("https://a.test/", "pricing", None), ("https://a.test/", "all", ["SEEN BY"]), ("https://a.test/", "all", None)]
    for d, at in ((one, "2025-01-01"), (two, "2025-01-02")):
        found = store.check(captures(spark, *[(u, g, d, at, i) for u, g, i in rows]))
    n = lambda **o: store.history("https://a.test/", "all", **o).count()
    assert store.history("https://a.test/", "pricing").count() == 1 and found.events.count() == store.events().count()
    assert n(ignore_text=["SEEN BY"]) == 3 and n() >= 4
    assert watch_key("https://a.test", "x") == watch_key("https://A.test/#y", " X ") != watch_key("https://a.test", "x", scope="s")


def test_conflict_poll_and_close(spark, tmp_path):
    store, other = WatchStore(spark, str(tmp_path)), WatchStore(spark, str(tmp_path))
    one = captures(spark, ("https://a.test/", "all", doc(("a b", {})), "2025-01-01"))
    on = other.version()
    store.check(one)
    with pytest.raises(Conflict):
        other._commit(on, other.snapshots(), other.events())
    assert store.version() == 1 and store.snapshots().count() == 1
    seen, waits = [], []
    docs = iter([one, captures(spark, ("https://a.test/", "all", doc(("quite other words", {})), "2025-01-02"))])
    assert store.poll(lambda: next(docs), 2, 5, True, seen.append, waits.append) == 1 and waits == [5] and len(seen) == 1
    store.close()
    with pytest.raises(Closed):
        store.version()
    for bad in (-1, 100_001, True):
        with pytest.raises(ValueError):
            WatchStore(spark, "x", bad)
    assert complaint("[]") and complaint(doc(("x", {}))) is None


def test_folders(spark, tmp_path):
    import os

    from lakeloom.operators.store import state_folder
    from lakeloom.plans.session import release, shared_dir, written

    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    assert state_folder(new, old) == new
    os.mkdir(old)
    assert state_folder(new, old) == old
    os.mkdir(new)
    assert state_folder(new, old) == new
    release(spark)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    assert written(spark.range(3)).count() == 3 and release(spark) == 1
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before
