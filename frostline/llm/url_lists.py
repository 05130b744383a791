"""URL filters over dated lists: which entry was in force when a page was fetched.

List entries are events: on a day a key is added (with a verdict) or removed. Each event
holds until the next one of its key, which makes intervals that never overlap. A capture is
judged by the entries in force on its day for its domain and the domains above it, its host,
and all prefixes of its path; the most specific one decides.

Only built-in functions are used. Captures are first reduced to distinct sites (host, path
prefix, day), so a host that fills a third of the crawl is looked up once per prefix and
day; paths are followed as deep as the list's deepest prefix goes, since no entry can match
below. Events are reduced to one per key and day before their intervals are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("domain", "host", "prefix")

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def site_columns(url: Column, depth: int) -> list[Column]:
    """Host, and path down to ``depth`` segments."""
    parts = segments_of(url)
    return [host_of(url).alias("host"), F.array_join(F.slice(parts, 1, depth), "/").alias("path")]


def deepest(events: DataFrame) -> int:
    """Path segments of the list's longest prefix."""
    slashes = F.size(F.split("key", "/")) - 1
    return events.where("kind = 'prefix' AND key IS NOT NULL").agg(F.max(slashes)).first()[0] or 0


def keys_of(host: Column, path: Column) -> Column:
    """All (kind, key, weight) that can decide about a site; more weight is more specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda k: F.struct(
            F.lit("domain").alias("kind"),
            F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".").alias("key"),
            k.cast("int").alias("weight"),
        ),
    )
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1000).alias("weight")))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(
        parts,
        lambda _, i: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i + 1), "/")).alias("key"),
            (F.lit(1001) + i).cast("int").alias("weight"),
        ),
    )
    return F.concat(F.when(n >= 2, domains).otherwise(F.filter(domains, lambda _: F.lit(False))), exact, prefixes)


def intervals(events: DataFrame) -> DataFrame:
    """(kind, key, verdict, from, until) of (kind, key, day, action, verdict) events.

    ``until`` is the day of the next event and exclusive, null where none follows. Of several
    events of a key on one day a removal counts before an addition, and 'block' before
    'allow'. Events without a kind, key or day are no entries. Hosts and domains are compared in
    lower case, paths as they are.
    """
    kinds = events.where("kind IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL")
    kinds = kinds.withColumn("key", F.concat(F.lower(F.regexp_extract("key", "^[^/]*", 0)), F.regexp_extract("key", "/.*$", 0)))
    removed = F.max(F.when(F.col("action") == "remove", 1).otherwise(0))
    blocked = F.max(F.when(F.col("verdict") == "block", 1).otherwise(0))
    daily = kinds.groupBy("kind", "key", "day").agg(removed.alias("removed"), blocked.alias("blocked"))
    following = F.lead("day").over(Window.partitionBy("kind", "key").orderBy("day"))
    return (
        daily.withColumn("until", following)
        .where("removed = 0")
        .select(
            "kind", "key", F.col("day").alias("from"), "until",
            F.when(F.col("blocked") == 1, "block").otherwise("allow").alias("verdict"),
        )
    )


def evaluate(captures: DataFrame, events: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., host, n_active, rule, blocked) of every capture (url, fetched).

    Prefix entries, host and path segments joined by '/', may have any number of segments.
    ``rule`` names the deciding entry as kind:key, null if none was in force. A capture whose
    URL is null or has no host, or whose day is null, matches nothing and is not blocked.
    Repeated rows are judged alike; empty tables give no rows or no matches.
    """
    named = captures.select(*keep, *site_columns(F.col("url"), deepest(events)), F.col("fetched").alias("_day"))
    sites = named.where("host IS NOT NULL AND _day IS NOT NULL").select("host", "path", "_day").distinct()
    asked = sites.select("*", F.inline(keys_of(F.col("host"), F.col("path"))))
    active = asked.join(intervals(events), ["kind", "key"]).where(
        (F.col("from") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))
    )
    best = F.max_by(F.struct("kind", "key", "verdict"), "weight")
    judged = active.groupBy("host", "path", "_day").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best"))
    return named.join(judged, ["host", "path", "_day"], "left").select(
        *keep,
        "host",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.when(F.col("best").isNotNull(), F.concat_ws(":", "best.kind", "best.key")).alias("rule"),
        F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"),
    )


def _drawn(key: Column) -> Column:
    """A fixed number that stands for what a list keeper decided about a key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long")


FIRST_DAY = "2024-01-01"


def fetch_day(page_id: Column) -> Column:
    """The tables record no fetch time; a day of 2024 is derived from the page's id."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(page_id * 37, F.lit(365)).cast("int"))


def list_history(pages: DataFrame) -> DataFrame:
    """List events about the crawl's own domains, hosts and path prefixes of every depth.

    The tables hold no lists, so which keys were listed, and when, is drawn from the keys.
    """
    sites = pages.select(host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("parts"))
    sites = sites.where("host IS NOT NULL").distinct()
    host, parts = F.col("host"), F.col("parts")
    parent = F.regexp_replace(host, r"^[^.]+\.", "")
    hosts = sites.select(F.lit("host").alias("kind"), host.alias("key")).distinct()
    above = sites.where(F.size(F.split(parent, r"\.")) >= 3).select(F.lit("domain").alias("kind"), parent.alias("key"))
    each = F.transform(parts, lambda _, i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i + 1), "/")))
    prefixes = sites.select(F.lit("prefix").alias("kind"), F.explode(each).alias("key"))
    keys = hosts.union(above.distinct()).union(prefixes.distinct()).withColumn("d", _drawn(F.col("key")))
    rules = (  # kind, every n-th key, day within, days later, action, verdict
        ("host", 3, 200, 0, "add", "block"),
        ("host", 6, 200, 40, "remove", "block"),
        ("host", 12, 200, 80, "add", "allow"),
        ("domain", 5, 150, 0, "add", "block"),
        ("domain", 10, 150, 60, "remove", "block"),
        ("prefix", 7, 250, 0, "add", "allow"),
        ("prefix", 14, 250, 30, "add", "block"),
    )
    events = F.filter(
        F.array(
            *[
                F.when(
                    (F.col("kind") == kind) & (F.col("d") % every == 0),
                    F.struct(
                        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("d") % within + later).cast("int")).alias("day"),
                        F.lit(action).alias("action"),
                        F.lit(verdict).alias("verdict"),
                    ),
                )
                for kind, every, within, later, action, verdict in rules
            ]
        ),
        lambda e: e.isNotNull(),
    )
    return keys.select("kind", "key", F.inline(events))
