"""Mixes sources to target weights by balanced sampling with the cube method.

Every document's expected number of copies is its source's target over its
source's size: a whole part that is taken for certain and a fraction that is an
inclusion probability. The flight phase moves the fractions of a block of
documents along directions that change neither the block's expected words nor
its expected documents until all but two are 0 or 1; what is left of all blocks
meets in fewer blocks, and so on to one block a source, where at most two
documents land on the choice nearest to both totals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import WORD, Workspace, small

#: Documents of one source that a task balances together, on average.
BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, and the greatest target of a source, as multiples of sizes.
SHARE, MOST = 1.5, 2.0


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` in the null space of the totals of ``size`` and of ones; at most two stay fractional."""
    p = p.astype(float).copy()
    todo = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    held: list[int] = []
    draws = iter(rng.random(2 * len(todo) + 4))
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) == 3:
            a, b, c = (float(size[i]) for i in held)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        held = [i for i in held if 1e-9 < p[i] < 1 - 1e-9]


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the last fractions to the choice whose words, then documents, are nearest to what they stood for."""
    open_ = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    out = np.round(p)
    words, docs = sum(p[i] * float(size[i]) for i in open_), sum(p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(size[i]) for k, i in enumerate(open_) if m >> k & 1) - words), abs(bin(m).count("1") - docs), m))
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    return out


def source_targets(ws: Workspace, sized: DataFrame) -> DataFrame:
    """(source, n, source_size, target) by water filling: an aggregate a round, whatever the number of sources."""
    totals = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # Rank by code point, null last: dealt by range, counted a partition, then numbered within it.
    ranged = totals.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranged = ws.save(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offset = ws.spark.createDataFrame(offsets, "part int, before bigint")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("at") + F.col("before"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = ws.save(ranged.join(F.broadcast(offset), "part").select("source", "n", "source_size", weight.alias("weight")), "weighed")
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level > MOST * F.col("source_size")
        row = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.count_if(full).alias("capped"),
            F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["capped"] == capped or not row["w"]:
            break
        capped, level = row["capped"], (SHARE * row["all"] - row["full"]) / row["w"]
    target = F.least(MOST * F.col("source_size"), F.col("weight") * F.lit(level))
    return weighed.select("source", "n", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, source, th, size, source_size, target, repeats (0, 1 or 2), taken.

    size counts the words of the whole text (null: 0), th is the text's xxhash64
    (null for null), taken is ``repeats * size``. The choice depends on ids,
    texts and sources alone, so reruns and other partitionings agree; rows equal
    in all three are interchangeable. A null source is a source of its own.
    A row without words is never taken. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    th = F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col)))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), th.alias("th"), size.alias("size"))
    # Rows equal in all get numbers, so that they can be dealt to different blocks; counted first, so a hot one is no hot group.
    counted = sized.groupBy("id", "source", "th", "size").agg(F.count("*").alias("m"))
    sized = ws.save(counted.select("id", "source", "th", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("copy")), "sized")
    targets = ws.save(source_targets(ws, sized), "targets")
    joined = sized.join(small(targets, 50_000), sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "n", "source_size", "target")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + 1e-9).cast("int")
    open_ = ws.save(joined.select("*", whole.alias("whole"), F.when(F.col("size") > 0, F.greatest(F.lit(0.0), share - whole)).otherwise(F.lit(0.0)).alias("p")), "expected")
    kept = [open_.filter("p <= 1e-9 or p >= 1 - 1e-9")]
    open_ = open_.filter("p > 1e-9 and p < 1 - 1e-9")
    widest = targets.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        last = widest <= BLOCK
        moved = ws.save(_balance(open_, level, widest, last), f"level-{level}")
        fixed = "p <= 1e-9 or p >= 1 - 1e-9"
        kept.append(moved.filter(fixed))
        open_ = moved.filter(f"not ({fixed})")
        if last:
            break
        level, widest = level + 1, 3 * math.ceil(widest / BLOCK)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    repeats = (F.col("whole") + F.round("p").cast("int")).cast("int")
    repeats = F.when(F.col("size") > 0, repeats).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "th", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("bigint").alias("taken"))


def _balance(rows: DataFrame, level: int, widest: int, last: bool) -> DataFrame:
    """One flight over every block of every source; landing too, where a source is one block."""
    most = max(1, math.ceil(widest / BLOCK))
    blocks = F.least(F.lit(most), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
    block = F.pmod(F.xxhash64("id", "th", "size", "copy", F.lit(level)), F.greatest(blocks, F.lit(1)))
    dealt = rows.withColumn("block", block.cast("int"))
    columns = rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("th", "ascending"), ("copy", "ascending")])  # nulls last
        size, p = table["size"].to_numpy(), table["p"].to_numpy()
        rng = np.random.default_rng([level, int(size.sum()) & 0xFFFFFFFF, len(size), int(table["block"][0].as_py())])
        perm = rng.permutation(len(size))
        moved = np.empty(len(size))
        moved[perm] = flight(size[perm], p[perm], rng)
        if last:
            moved = land(size, moved)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(moved)).select(columns)

    return dealt.groupBy("source", "block").applyInArrow(run, rows.schema)
