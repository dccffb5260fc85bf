"""Feeds of change events as RSS 2.0 and Atom documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.values import escaped_xml

#: Events that a feed holds at most, and who wrote its entries.
LIMIT, AUTHOR = 100, "lakeloom"
_RFC_1123, _ISO = "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def feed_document(events: DataFrame, key: str, title: Column, url: Column, form: str = "rss") -> DataFrame:
    """(key, body): one feed for each key, its newest ``LIMIT`` events first.

    events: key, ``n`` (1 for the newest of the key), event_id, url, event_at, event_type, context, before_text, after_text. ``title`` and
    ``url`` are the feed's own, the same for all rows of a key. Rows without an ``event_id`` make no entry, but a feed of their own.
    """
    if form not in ("rss", "atom"):
        raise ValueError("a feed is rss or atom")
    told = escaped_xml(F.concat(F.coalesce("context", F.lit("")), F.lit(": "), F.coalesce("before_text", F.lit("(added)")), F.lit(" → "), F.coalesce("after_text", F.lit("(removed)"))))
    name, link = escaped_xml(F.coalesce("event_type", F.lit(""))), escaped_xml(F.coalesce("url", F.lit("")))
    iso = F.date_format("event_at", _ISO)
    if form == "atom":
        entry = F.concat(F.lit("<entry><id>urn:uuid:"), "event_id", F.lit("</id><title>"), name, F.lit("</title><updated>"), iso, F.lit('</updated><link href="'), link, F.lit('"/><content type="text">'), told, F.lit(f"</content><author><name>{AUTHOR}</name></author></entry>"))
    else:
        entry = F.concat(F.lit('<item><guid isPermaLink="false">'), "event_id", F.lit("</guid><title>"), name, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format("event_at", _RFC_1123), F.lit("</pubDate><description>"), told, F.lit("</description></item>"))
    rows = events.where(F.col("n") <= LIMIT).select(F.col(key).alias("_k"), F.struct("n", entry.alias("entry"), iso.alias("at")).alias("x"), escaped_xml(title).alias("_title"), escaped_xml(url).alias("_url"))
    one = rows.groupBy("_k").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("_title").alias("_title"), F.max("_url").alias("_url"))
    entries = F.array_join(F.filter(F.transform("x", lambda e: e["entry"]), lambda e: e.isNotNull()), "")
    if form == "atom":
        updated = F.coalesce(F.get(F.filter(F.transform("x", lambda e: e["at"]), lambda t: t.isNotNull()), F.lit(0)), F.lit("1970-01-01T00:00:00.000Z"))
        body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>'), "_url", F.lit("</id><title>"), "_title", F.lit("</title><updated>"), updated, F.lit('</updated><link href="'), "_url", F.lit('"/>'), entries, F.lit("</feed>"))
    else:
        body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), "_title", F.lit("</title><link>"), "_url", F.lit("</link><description>Significant semantic changes</description>"), entries, F.lit("</channel></rss>"))
    return one.select(F.col("_k").alias(key), body.alias("body"))
