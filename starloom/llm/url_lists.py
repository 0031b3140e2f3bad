"""URL filter lists with dates: every capture is judged by the entries in force when it was fetched.

Dated additions and removals of an entry become validity intervals. A capture's
URL gives a bounded number of keys (its host's parent domains, its path's
prefixes, either no deeper than any entry is, so a long URL stays linear); an
equi-join on the key with the interval as condition finds the entries in force,
and the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.llm.common import Workspace, free_name, small


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, verdict, since, until) of ``entries(list, key, verdict, action, at)``; until is null while in force.

    An action is add or remove. A second addition of an entry in force goes on
    from its own date; a removal of what is not in force does nothing. Of
    several actions of one moment the removal counts first. Rows with a null
    key, date, action or verdict are no entries. Hosts ignore case and a dot at
    their end, paths do not ignore case.
    """
    domain = F.regexp_replace(F.lower("key"), r"\.+$", "")
    path = F.concat(F.regexp_replace(F.lower(F.regexp_extract("key", "^[^/]*", 0)), r"\.+$", ""), F.regexp_extract("key", "^[^/]*(.*)$", 1))
    key = F.when(F.startswith("key", F.lit("||")), domain).otherwise(path)
    rows = entries.select("list", key.alias("key"), "verdict", "action", "at").dropna(subset=["key", "verdict", "action", "at"]).distinct()
    after = W.partitionBy("list", "key", "verdict").orderBy("at", F.when(F.col("action") == "remove", 0).otherwise(1))
    ended = rows.withColumn("until", F.lead("at").over(after)).filter("action = 'add'")
    return ended.filter("until is null or until > at").select("list", "key", "verdict", F.col("at").alias("since"), "until")


def url_keys(url: F.Column, labels: int, depth: int) -> F.Column:
    """Keys a list entry can match: ``||domain`` for the host and its parents of at most ``labels`` labels,
    ``host/path`` prefixes of at most ``depth`` whole segments."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://|[?#][\s\S]*$", "")
    host = F.regexp_replace(F.lower(F.split(bare, "/", 2)[0]), r"^[^@]*@|:[0-9]*$", "")
    host = F.regexp_replace(host, r"\.+$", "")
    parts = F.split(host, r"\.", -1)
    last = F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), max(labels, 1))
    domains = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.concat(F.lit("||"), F.array_join(F.slice(last, i, F.size(last)), ".")))
    segments = F.filter(F.split(F.regexp_replace(bare, "^[^/]*/?", ""), "/", -1), lambda s: s != "")
    top = F.slice(segments, 1, depth) if depth > 0 else F.array().cast("array<string>")
    paths = F.transform(F.sequence(F.lit(0), F.size(top)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(top, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths) if labels else paths)


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_at", verdict: str = "verdict", key: str = "matched_key", name: str = "matched_list") -> DataFrame:
    """``captures`` with the verdict (deny, allow, or none), the key and the list that decided.

    The longest key in force decides; at equal keys deny beats allow, then the
    first list by name. A null URL or time is judged none. Repeated rows get
    equal results; other columns pass through, and a new name that one of them
    has gets underscores before it. No entries: all none.
    """
    verdict, key, name = (free_name(captures, c) for c in (verdict, key, name))
    ws = Workspace(captures.sparkSession, "urls")
    valid = ws.save(intervals(entries), "intervals")
    is_domain = F.startswith("key", F.lit("||"))
    widest = valid.agg(F.max(F.when(is_domain, F.size(F.split("key", r"\.", -1)))).alias("labels"), F.max(F.when(~is_domain, F.size(F.split("key", "/", -1)))).alias("depth")).first()
    # Each distinct URL and moment is judged once, so a hot page costs one row.
    asked = captures.select(F.col(url_col).alias("u"), F.col(at_col).alias("t")).dropna().distinct()
    keyed = asked.select("u", "t", F.explode_outer(F.array_distinct(url_keys(F.col("u"), widest["labels"] or 0, widest["depth"] or 0))).alias("key"))
    live = keyed.join(small(valid), "key").filter("since <= t and (until is null or t < until)")
    best = F.min(F.struct((-F.length("key")).alias("a"), F.when(F.col("verdict") == "deny", 0).otherwise(1).alias("b"), "list", "key", "verdict")).alias("best")
    u, t, b = (free_name(captures, c) for c in ("judged_url", "judged_at", "best"))
    judged = live.groupBy("u", "t").agg(best).select(F.col("u").alias(u), F.col("t").alias(t), F.col("best").alias(b))
    joined = captures.join(judged, (captures[url_col] == F.col(u)) & (captures[at_col] == F.col(t)), "left")
    return joined.select(*(captures[c] for c in captures.columns), F.coalesce(f"{b}.verdict", F.lit("none")).alias(verdict), F.col(f"{b}.key").alias(key), F.col(f"{b}.list").alias(name))
