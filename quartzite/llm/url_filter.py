"""URL filters by a temporal list join.

A list is dated entries: on listed_at, key is added with an action ("block" or
"allow") or taken off ("remove"). The next entry of the same key ends it, so
entries become validity intervals [from, until). A key is a domain, which holds
for its subdomains too (but no ending of one label), or a numeric address or a
name of one label, which hold for themselves; each with any number of leading
path segments, whose case counts. Each capture
is matched, as of its fetch time, with every entry active then whose key its
address has; the entry with the longest key decides.

Captures are reduced to distinct (url, time) pairs, each gives the few keys of
its address, and an equi join on the key with the interval as its condition is
the as-of join; Spark may split it where a host has a third of all captures.
The verdict is the greatest match by a partial aggregate.

Defined cases: a null url or fetch time matches nothing and is not blocked; a
url without a host has no keys; entries with a null key, time or action are
passed over; of entries of one key with one time the last in order of action
counts; repeated captures share a verdict; empty tables match nothing; other
columns of captures are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved


def intervals(entries: DataFrame, key: str = "key", listed_at: str = "listed_at", action: str = "action") -> DataFrame:
    """key, action, from_at, until_at (null: still active)."""
    host = F.substring_index(key, "/", 1)  # hosts are of any case, paths are not
    whole = F.rtrim(F.concat(F.lower(host), F.substr(F.col(key), F.char_length(host) + F.lit(1))), F.lit("/"))
    e = entries.select(whole.alias("key"), F.col(listed_at).alias("from_at"), F.lower(F.col(action)).alias("action")).dropna()
    e = e.groupBy("key", "from_at").agg(F.max("action").alias("action"))
    e = e.withColumn("until_at", F.lead("from_at").over(Window.partitionBy("key").orderBy("from_at")))
    return e.where(F.col("action") != "remove")


def depth(intervals: DataFrame) -> int:
    """Path segments of the deepest key."""
    return intervals.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0


def keys(url: Column, segments: int) -> Column:
    """The keys of an address: its host and, unless that is numeric, every ending of two labels or more, alone and with up to so many path segments."""
    rest = F.regexp_replace(F.trim(url), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(rest, "/", 1), r"^.*@", ""), r"(:\d*)?\.?$", ""))
    path = F.slice(F.filter(F.slice(F.split(rest, "/"), F.lit(2), F.size(F.split(rest, "/"))), lambda s: s != ""), 1, segments)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    whole = (n == 1) | host.rlike(r"^(\d+(\.\d+){3}|\[.*\])$")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    domains = F.when(host == "", F.array().cast("array<string>")).when(whole, F.array(host)).otherwise(endings)
    depths = F.sequence(F.lit(0), F.size(path))
    paths = F.transform(depths, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"))))
    return F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with n_active (active entries that match), list_key and list_action (of the longest) and blocked."""
    c = captures.select(F.col(url).alias("u"), F.col(fetched_at).alias("t")).dropna().distinct()
    e = saved(intervals(entries), "intervals")  # plain tables on both sides, so that Spark may split a host's join
    k = c.select("u", "t", F.explode(F.array_distinct(keys(F.col("u"), depth(e)))).alias("key"))
    m = k.join(e, (k["key"] == e["key"]) & (k["t"] >= e["from_at"]) & (e["until_at"].isNull() | (k["t"] < e["until_at"])))
    best = F.max(F.struct(F.char_length(k["key"]).alias("n"), k["key"].alias("key"), e["action"].alias("action")))
    v = saved(m.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"), best.alias("best")), "verdicts")
    n_active, list_key, action, blocked = (fresh(captures, x) for x in ("n_active", "list_key", "list_action", "blocked"))
    j = captures.join(v, (captures[url] == v["u"]) & (captures[fetched_at] == v["t"]), "left")
    return j.select(
        *(captures[x] for x in captures.columns),
        F.coalesce(v["n"], F.lit(0)).alias(n_active),
        v["best"]["key"].alias(list_key),
        v["best"]["action"].alias(action),
        F.coalesce(v["best"]["action"] == "block", F.lit(False)).alias(blocked),
    )
