"""Union-find grouping over a table of links, as star contraction.

Every step is an aggregation and an equi-join. A hub that holds a third of all
links is summed before the shuffle, and joined without one: nodes of more than
``DEGREE`` links, or of more than a ``1 / HUBS`` part of all link ends, are
fewer than ``HUBS`` whatever the graph, so their few numbers are broadcast.
Nothing is gathered on the driver but some numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace


#: Nodes of more links than this, and than a 1 / HUBS part of all link ends, are hubs: so there are at most HUBS.
DEGREE, HUBS = 200, 20_000


def _attach(ends: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``ends(u, v)`` with m of ``least(u, m, n)``; every u of ``ends`` is in ``least``, n are its ends.

    The rows of hubs stay where they are.
    """
    bound = max(DEGREE, 2 * links // HUBS)
    hubs = least.filter(F.col("n") > bound).select("u", F.col("m").alias("hub_m"))
    marked = ends.join(F.broadcast(hubs), "u", "left")
    others = marked.filter("hub_m is null").select("u", "v").join(least.filter(F.col("n") <= bound).select("u", "m"), "u")
    return marked.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(others)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node of its component.

    Links may repeat and may be given either way round; an end that is null or
    equal to the other is no link. No links: no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    name = f"{label}-0"
    e = ws.save(e, name)
    before, step = _state(e), 0
    while before[0]:
        step += 1
        # Large star: every larger neighbour of u is hung on u's smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = ws.save(_attach(both.filter("v > u"), least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-large")
        # Small star: u and its smaller neighbours are hung on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = _attach(large, low, before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, old = f"{label}-{step}", name
        e = ws.save(low.select("u", F.col("m").alias("v")).union(hung).distinct(), nxt)
        name, now = nxt, _state(e)
        ws.drop(old, f"{label}-large")
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
