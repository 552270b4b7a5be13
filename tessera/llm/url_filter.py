"""URL filters whose lists change over time.

``intervals`` turns dated list entries (key, action "add" or "remove", day) into validity intervals: an
addition is in force until the key's next entry. ``evaluate`` joins every capture as of its fetch day: a
capture has a few keys (its host, each parent domain of two labels or more, and its host with the first
segment of the path), and an entry counts if its key is one of them and its interval holds the day.

DataFrame functions only. The range condition meets the distinct days of a key, not its captures, so a host that holds
a third of all captures and has a long history costs its days times its entries. Captures then find the days on which
a key is in force by an equi-join, whose skewed side adaptive execution splits. Results meet by capture, not by host.

Defined cases: hosts compare in lower case, without user, port and a trailing dot; a null url or one
without a host, and a null day, match nothing; entries with a null key, day or action are left out; on
one day additions come before removals, and an interval of no length matches nothing; captures that
repeat an id are told apart by url and day (128 bits of them), and fully repeated ones keep their rows; empty tables give
empty results or captures without matches; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """The host of a URL in lower case, empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))


def path_key(url: Column) -> Column:
    """host/segment, null where there is no segment."""
    segment = F.regexp_extract(F.lower(url), SEGMENT, 1)
    return F.when((segment != "") & (host(url) != ""), F.concat(host(url), F.lit("/"), segment))


def keys(url: Column) -> Column:
    """All keys under which a list may name the URL."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.when(host(url) != "", F.array(host(url))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(domains, F.array_compact(F.array(path_key(url)))))


def intervals(entries: DataFrame) -> DataFrame:
    """key, since, until (null: still in force) of each stretch in which a key is listed; entries: key, action, day."""
    order = Window.partitionBy("key").orderBy("day", "action")
    known = entries.select("key", "action", "day").filter("key is not null and day is not null and action in ('add', 'remove')")
    steps = known.withColumn("until", F.lead("day").over(order))
    return steps.filter("action = 'add' and (until is null or until > day)").select("key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, day, host, n_active, first_key, blocked of each capture (page_id, url, day)."""
    rows = captures.select("page_id", "url", "day").withColumn("capture", F.struct(F.xxhash64("page_id", "url", "day").alias("h"), F.xxhash64(F.lit(1), "page_id", "url", "day").alias("g")))
    asked = rows.select("capture", "day", F.explode(keys(F.col("url"))).alias("key")).distinct()
    # as of each day that a key is asked for, once: a host's captures of a day share one look at its history
    days = asked.filter("day is not null").select("key", "day").distinct()
    since, until = F.col("day") >= F.col("since"), F.col("until").isNull() | (F.col("day") < F.col("until"))
    active = days.join(listed, "key").filter(since & until).select("key", "day").distinct()
    met = asked.join(active, ["key", "day"])
    found = met.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))
    n = F.coalesce("n", F.lit(0))
    joined = rows.join(found, "capture", "left")
    return joined.select("page_id", "day", host(F.col("url")).alias("host"), n.alias("n_active"), "first_key", (n > 0).alias("blocked"))
