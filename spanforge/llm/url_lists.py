"""URL filters by dated lists: every capture against the entries active when it was fetched.

A list is a log of dated events: `kind` (host: the host and its subdomains;
exact: that host alone; prefix: host and path from the start), `value`,
`action` (add or remove) and `at`.  Events of one (kind, value) become validity
intervals [from, to).  A capture's URL gives the keys that could match it: its
host, each parent domain, and each path prefix that ends at a slash or the end.
Keys are joined to intervals by equality, and the fetch time picks the interval.

Only keys that the list has travel on: intervals are broadcast where they are few
(`BROADCAST_VALUES`), and otherwise joined by a shuffle that the engine splits
where a key is frequent.

Defined results: a null or unparsable URL, or a null fetch time, matches
nothing; at the instant of a removal an entry is no longer active; of several
events of one entry at one instant removal wins; a removal without an earlier
addition, and a repeated addition, change nothing; values are compared in lower
case, hosts without a leading "www." or port; rows repeat as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: List entries up to which intervals are broadcast: about 150 bytes each.
BROADCAST_VALUES = 200_000


def intervals(events: DataFrame) -> DataFrame:
    """kind, value, valid_from, valid_to (null: open) from kind, value, action, at."""
    clean = events.where("kind is not null and value is not null and at is not null and action in ('add', 'remove')")
    one = clean.groupBy("kind", F.lower("value").alias("value"), "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    w = Window.partitionBy("kind", "value").orderBy("at")
    changes = one.withColumn("was", F.lag("gone", 1, 1).over(w)).where("gone <> was")
    spans = changes.withColumn("valid_to", F.lead("at").over(w)).where("gone = 0")
    return spans.select("kind", "value", F.col("at").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """Lower-case host without user, port and leading www.; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path from its first slash, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def match_keys(url: Column) -> Column:
    """array<struct<kind, value>> of all list entries that could match the URL."""
    h = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(h, i, F.size(h)), ".").alias("value")))
    steps = F.split(F.lower(path(url)), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host(url), F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i < F.size(steps), F.lit("/")).otherwise(F.lit(""))).alias("value")),
    )
    exact = F.array(F.struct(F.lit("exact").alias("kind"), host(url).alias("value")))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(parents, exact, prefixes)))


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with blocked, n_matches and matched (sorted "kind:value" of the entries active at fetch time)."""
    if {"blocked", "n_matches", "matched"} & set(captures.columns):
        raise ValueError("a column would clash with the result")
    active = work.table(intervals(events))
    few = active.count() <= BROADCAST_VALUES
    # Numbered rows are written before they are read twice, so that both reads agree on the numbers.
    rows = work.table(captures.withColumn("__row", F.monotonically_increasing_id()))
    # Each capture stays whole; only its keys that are on the list travel.
    keys = rows.select("__row", F.col(at).alias("__at"), F.inline(match_keys(F.col(url))))
    right = F.broadcast(active) if few else active
    hit = keys.join(right, ["kind", "value"]).where((F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    found = hit.groupBy("__row").agg(F.array_sort(F.collect_set(F.concat("kind", F.lit(":"), "value"))).alias("matched"))
    out = rows.join(found, "__row", "left")
    matched = F.coalesce("matched", F.array().cast("array<string>"))
    return out.withColumn("matched", matched).withColumns({"blocked": F.size("matched") > 0, "n_matches": F.size("matched").cast("long")}).drop("__row")
