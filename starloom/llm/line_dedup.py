"""Removes line runs that an earlier place in the corpus already holds.

Windows of three consecutive lines overlap; each is known by a 128-bit hash.
Only hashes and positions are shuffled. The first occurrence of a window, by
document id, text hash and line, stays; the lines of all later occurrences are
merged into runs and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, free_name

#: Covered positions up to this many in all are broadcast; more are shuffled.
BROADCAST_POSITIONS = 1_000_000


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(id, th, covered): for each text with lines to remove, the sorted starts of its repeated windows.

    th is the text's xxhash64: rows equal in id and text count as one place.
    Windows without any word are no windows. Null ids come last in the order.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), lines.alias("l")).filter(F.size("l") >= window)
    own = own.select(
        "id", "th",
        F.transform("l", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("l", lambda x: F.xxhash64(F.lit("line"), x)).alias("b"),
        F.transform("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("w"),
    )

    def at(c: str, i: F.Column) -> list:
        return [F.get(c, i + k) for k in range(window)]

    def some(i: F.Column) -> F.Column:
        out = F.lit(False)
        for x in at("w", i):
            out = out | x
        return out

    starts = F.transform(F.sequence(F.lit(0), F.size("a") - window), lambda i: F.struct(i.alias("pos"), F.xxhash64(*at("a", i)).alias("k1"), F.xxhash64(*at("b", i)).alias("k2"), some(i).alias("ok")))
    places = own.select("id", "th", F.explode_outer(starts).alias("s")).filter("s.ok").select("id", "th", "s.pos", "s.k1", "s.k2")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")
    first = places.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min(place).alias("first")).filter("m > 1")
    later = places.join(first, ["k1", "k2"]).filter(F.col("first") != place)
    return later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, removed: str | None = None) -> DataFrame:
    """``docs`` with repeated lines gone from its text; with ``removed``, also a column of that name: lines removed.

    A null text stays null; a text of fewer than ``window`` lines stays whole; a
    text that loses every line becomes empty. Rows that repeat both id and text
    get the same result. Other columns pass through; if ``removed`` is one of
    them the new one gets underscores before it. A window may repeat onto itself
    (A B A B A): its later start goes with all three lines, those of the first
    occurrence that it overlaps among them. No rows: no rows.
    """
    removed = removed and free_name(docs, removed)
    ws = Workspace(docs.sparkSession, "lines")
    covered = ws.save(repeated_lines(docs, id_col, text_col, window), "covered")
    total = covered.agg(F.coalesce(F.sum(F.size("covered") + 4), F.lit(0)).alias("n")).first()["n"]
    names = {n: free_name(docs, n) for n in ("id", "th", "covered", "text_key")}
    covered = covered.toDF(*(names[n] for n in ("id", "th", "covered")))
    if total <= BROADCAST_POSITIONS:
        covered = F.broadcast(covered)
    th, own, runs = names["th"], names["text_key"], F.col(names["covered"])
    keyed = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    joined = keyed.join(covered, keyed[id_col].eqNullSafe(F.col(names["id"])) & (F.col(own) == F.col(th)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # Runs of covered lines: [begin, end) where the next window starts beyond the last one's end.
    begins = F.filter(runs, lambda p, i: (i == 0) | (p > F.get(runs, i - 1) + window))
    ends = F.transform(F.filter(runs, lambda p, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1) > p + window)), lambda p: p + window)
    kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(begins, F.array(F.size(lines))), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    left = F.flatten(F.transform(kept, lambda k: F.slice(lines, k["a"] + 1, k["n"])))
    text = F.when(runs.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    gone = F.when(runs.isNull(), F.lit(0)).otherwise(F.aggregate(F.zip_with(begins, ends, lambda a, b: b - a), F.lit(0), lambda n, x: n + x))
    out = [text.alias(c) if c == text_col else keyed[c] for c in docs.columns]
    return joined.select(*out, *([gone.cast("bigint").alias(removed)] if removed else []))
