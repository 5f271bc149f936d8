"""URL filters by a temporal list join.

A list is a history of dated entries: a pattern is added or removed at a time. Each
entry holds from its time until the next entry of the same list and pattern, which
makes validity intervals; intervals of one list and pattern never overlap. A capture
is judged as of its fetch time: its URL's domain suffixes and path prefixes are
joined by equality with the patterns, and by time with the intervals.

The equality keys let the engine split a host with very many captures, and an
interval is matched at most once by list and pattern, so no capture fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(
    entries: DataFrame, list_col: str = "list", pattern_col: str = "pattern", action_col: str = "action", time_col: str = "at"
) -> DataFrame:
    """(list, pattern, since, until): when each pattern is on its list; ``until`` is null while it still is.

    ``action`` is ``add`` or ``remove``; at one time a removal comes last. Entries with a null
    list, pattern, action or time, and other actions, are ignored; repeated entries change nothing.
    """
    clean = entries.select(
        F.col(f"`{list_col}`").cast("string").alias("list"),
        F.lower(F.trim(F.col(f"`{pattern_col}`").cast("string"))).alias("pattern"),
        F.col(f"`{action_col}`").cast("string").alias("action"),
        F.col(f"`{time_col}`").alias("since"),
    ).where("list is not null and pattern is not null and since is not null and action in ('add', 'remove')")
    w = Window.partitionBy("list", "pattern").orderBy("since", "action")
    held = clean.select("list", "pattern", "since", F.lead("since").over(w).alias("until"), "action")
    return held.where("action = 'add' and (until is null or since < until)").drop("action")


def keys(url: Column) -> Column:
    """The patterns that a URL can match: its host and the host's parent domains, and its host with
    each prefix of its path, of whole segments. Scheme, user, port, query and fragment play no part."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/]*)", 1), r"^.*@", ""), r":\d*$|\.+$", "")
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_extract(bare, r"^[^/]*/(.*)$", 1), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(
        F.size(segments) > 0,
        F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths)))


def judge(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
    **names: str,
) -> DataFrame:
    """One row per capture: id, url, time, ``blocked``, ``n_lists``, ``lists`` (sorted, comma-joined),
    ``matched`` (the longest pattern that holds) and ``since`` (when the earliest of all that hold began).

    A null URL, one without a host, and a null time match nothing and are not blocked. Repeated
    captures are judged each. Other columns are ignored. ``names``: column names for ``intervals``.
    """
    held = intervals(entries, **names)
    rows = captures.select(
        F.monotonically_increasing_id().alias("_uid"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{url_col}`").cast("string").alias("_url"),
        F.col(f"`{time_col}`").alias("_at"),
    ).select("*", F.explode_outer(keys(F.col("_url"))).alias("_key"))
    on = (
        (F.col("_key") == F.col("pattern"))
        & (F.col("since") <= F.col("_at"))
        & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    )
    longest = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("pattern"))))
    return (
        rows.join(held, on, "left")
        .groupBy("_uid", "_id", "_url", "_at")
        .agg(F.array_sort(F.collect_set("list")).alias("_lists"), longest.alias("_longest"), F.min("since").alias("since"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_url").alias(url_col),
            F.col("_at").alias(time_col),
            (F.size("_lists") > 0).alias("blocked"),
            F.size("_lists").cast("long").alias("n_lists"),
            F.array_join("_lists", ",").alias("lists"),
            F.col("_longest.pattern").alias("matched"),
            "since",
        )
    )
