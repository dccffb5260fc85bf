"""Command line: doctor, dom, extract, crawl, locate, watch, history, reset.

Pages are Parquet tables (page_id, url, html) or single HTML files; with --web they are fetched.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from lakeloom import __version__

#: Options beyond the common ones, and the commands that take them.
ALLOWED = {
    "goal": ["crawl"], "query": ["extract", "locate"], "watch_for": ["watch", "history", "reset"], "max_pages": ["crawl"], "depth": ["crawl"], "delay_ms": ["crawl"], "concurrency": ["crawl"], "max_queue": ["crawl"],
    "min_score": ["crawl"], "include_path": ["crawl"], "exclude_path": ["crawl"], "progress": ["crawl"], "robots": ["crawl"], "db": ["watch", "history", "reset", "doctor"], "interval": ["watch"], "count": ["watch"],
    "changes_only": ["watch"], "feed": ["watch"], "max_events": ["watch"], "offset": ["history"], "role": ["extract"], "limit": ["extract", "history"], "format": ["extract", "watch"],
    "scope": ["extract", "watch", "history", "reset"], "ignore_text": ["watch", "history", "reset"], "keep_timestamps": ["watch", "history", "reset"],
}
COMMANDS = ["doctor", "dom", "extract", "crawl", "locate", "watch", "history", "reset"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lakeloom", description="Semantic pages on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("url", nargs="?", help="the page, or where a crawl starts")
    p.add_argument("--pages", help="Parquet table of page_id, url, html")
    p.add_argument("--html", help="file with the HTML of the page")
    p.add_argument("--web", action="store_true", help="fetch the page")
    p.add_argument("--allow-private-network", action="store_true")
    p.add_argument("--output", help="file for the result instead of standard output")
    p.add_argument("--compact", action="store_true", help="JSON on one line")
    p.add_argument("--for", dest="watch_for")
    for name in ("goal", "query", "db", "feed", "role", "scope", "robots"):
        p.add_argument(f"--{name}")
    for name in ("max-pages", "depth", "delay-ms", "concurrency", "max-queue", "count", "max-events", "offset", "limit"):
        p.add_argument(f"--{name}", type=int)
    for name in ("min-score", "interval"):
        p.add_argument(f"--{name}", type=float)
    for name in ("include-path", "exclude-path", "ignore-text"):
        p.add_argument(f"--{name}", action="append")
    for name in ("progress", "changes-only", "keep-timestamps"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    p.add_argument("--format", choices=["json", "markdown", "text", "rss", "atom"])
    return p


def validate(a: argparse.Namespace) -> None:
    """ValueError for options that the command doesn't take, empty ones, and what is missing."""
    for name, commands in ALLOWED.items():
        if getattr(a, name) is not None and a.command not in commands:
            raise ValueError(f"--{name.replace('_', '-').replace('watch-for', 'for')} applies to {', '.join(commands)}")
    for name in ("output", "feed", "db", "scope", "query", "role", "goal", "watch_for"):
        if getattr(a, name) is not None and not getattr(a, name).strip():
            raise ValueError(f"--{name} must not be empty")
    if a.command != "doctor" and not a.url:
        raise ValueError("a URL is needed")
    if a.command in ("dom", "extract", "crawl", "locate", "watch") and not (a.pages or a.html or a.web):
        raise ValueError("give the pages by --pages, --html or --web")
    for command, name in (("crawl", "goal"), ("locate", "query"), ("watch", "watch_for"), ("history", "watch_for"), ("reset", "watch_for"), ("watch", "db"), ("history", "db"), ("reset", "db")):
        if a.command == command and getattr(a, name) is None:
            raise ValueError(f"{command} needs --{name.replace('watch_for', 'for')}")
    if a.format and a.format not in (("rss", "atom") if a.command == "watch" else ("json", "markdown", "text")):
        raise ValueError(f"--format {a.format} does not fit {a.command}")


def save(path: str, text: str) -> None:
    """Write a file whole or not at all, readable by its owner only."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, mode=0o700, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def emit(value, a: argparse.Namespace) -> None:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str, **({"separators": (",", ":")} if a.compact else {"indent": 2})) + "\n"
    save(a.output, text) if a.output else sys.stdout.write(text)


def _rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def run(a: argparse.Namespace, spark) -> int:
    from pyspark.sql import functions as F

    from lakeloom import doctor
    from lakeloom.api import Engine
    from lakeloom.functions.privacy import safe_error
    from lakeloom.functions.urls import canonical_url
    from lakeloom.functions.whatwg import canonical
    from lakeloom.operators.discover import DiscoverOptions, RawPages
    from lakeloom.operators.extract import ExtractOptions
    from lakeloom.operators.robots import parse_robots, robots_of
    from lakeloom.sources.http import HttpFetcher, WebPages, fetched
    from lakeloom.sources.pages import documents

    if a.command == "doctor":
        found = doctor.checks(spark, a.db)
        emit(doctor.told(found) + "\n" if a.format != "json" and not a.compact else found, a)
        return 0 if all(c["ok"] for c in found) else 1
    if a.pages:
        pages = spark.read.parquet(a.pages)
    elif a.html:
        with open(a.html, encoding="utf-8") as f:
            pages = spark.createDataFrame([(1, a.url, f.read())], "page_id long, url string, html string")
    elif a.web:
        fetcher = HttpFetcher(allow_private_network=a.allow_private_network)
        pages = fetched(spark.createDataFrame([(1, a.url)], "page_id long, url string"), fetcher).persist()
        bad = pages.where("error is not null").first()
        if bad and a.command != "crawl":
            raise ValueError(bad["error"])
    watch = {k: v for k, v in (("ignore_timestamps", False if a.keep_timestamps else None), ("ignore_text", a.ignore_text), ("scope", a.scope)) if v is not None}
    given = lambda **names: {k: getattr(a, v) for k, v in names.items() if getattr(a, v) is not None}
    if a.command == "crawl":
        source = WebPages(spark, fetcher) if a.web else RawPages(pages)
        if a.robots:
            with open(a.robots, encoding="utf-8") as f:
                rules = parse_robots(f.read())
        else:
            origin = canonical(a.url).split("/", 3)[:3]
            got = fetcher.request("/".join(origin) + "/robots.txt") if a.web else None
            rules = robots_of(got.status, got.text) if got else None
        told = (lambda p: print(json.dumps(p), file=sys.stderr)) if a.progress else None
        options = DiscoverOptions(a.url, a.goal, include_paths=tuple(a.include_path or ()), exclude_paths=tuple(a.exclude_path or ()), **given(max_pages="max_pages", max_depth="depth", delay_ms="delay_ms", concurrency="concurrency", max_queue="max_queue", min_score="min_score"))
        got = Engine(spark, source).discover(options, rules, told)
        emit(vars(got), a)
        return 0 if got.pages else 1
    if a.command in ("history", "reset"):
        engine = Engine(spark, storage=a.db)
        emit(_rows(engine.history(a.url, a.watch_for, **given(limit="limit", offset="offset"), **watch)) if a.command == "history" else engine.reset_watch(a.url, a.watch_for, **watch), a)
        return 0
    own = pages.where(canonical_url(F.col("url")) == canonical(a.url)) if a.pages else pages
    docs = documents(own).persist()
    failed = docs.where("error is not null").first()
    if failed or docs.isEmpty():
        raise ValueError(failed["error"] if failed else "no such page")
    nodes = docs.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")
    engine = Engine(spark, storage=a.db, **given(max_events="max_events"))
    if a.command == "dom":
        emit(_rows(docs.drop("page_id", "error")), a)
    elif a.command == "extract":
        report = engine.extract(docs, nodes, ExtractOptions(**given(query="query", role="role", scope="scope", limit="limit")), a.format if a.format in ("markdown", "text") else None)
        emit("".join(r["body"] for r in report.collect()) if a.format in ("markdown", "text") else _rows(report), a)
    elif a.command == "locate":
        found = _rows(engine.locate(nodes, a.query).found)
        emit(found, a)
        return 0 if all(r["status"] == "found" for r in found) else 1
    else:
        camel = {"node_id": "id", "semantic_role": "semanticRole", "parent_id": "parentId", "document_url": "documentURL", "frame_path": "framePath"}
        names = ["node_id", "tag", "role", "text", "name", "semantic_role", "href", "interactive", "disabled", "checked", "expanded", "parent_id", "children", "context", "entity", "document_url", "frame_path"]
        slim = F.transform("nodes", lambda n: F.struct(*[n[c].alias(camel.get(c, c)) for c in names]))
        columns = [F.lit(watch[k]).alias(k) if not isinstance(watch[k], list) else F.array(*map(F.lit, watch[k])).alias(k) for k in watch]
        captured = docs.select("url", F.lit(a.watch_for).alias("watch_for"), F.to_json(F.struct("url", "title", slim.alias("nodes"))).alias("document"), F.current_timestamp().alias("captured_at"), *columns)

        def tell(c) -> None:
            emit({"version": c.version, "baselines": c.baselines.count(), "events": _rows(c.events), "rejected": _rows(c.rejected)}, a)
            if a.feed:
                save(a.feed, engine.feed(a.url, a.watch_for, a.format or "rss", **watch))

        try:
            engine.store().poll(lambda: captured, a.count or 1, a.interval or 0, bool(a.changes_only), tell)
        except RuntimeError as e:
            raise ValueError(safe_error(e)) from e
    engine.close()
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        validate(a)
        if spark is None:
            from lakeloom.plans.session import local_session

            spark = local_session()
            spark.sparkContext.setLogLevel("ERROR")
        return run(a, spark)
    except (ValueError, OSError) as e:
        from lakeloom.functions.privacy import safe_error

        print(safe_error(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
