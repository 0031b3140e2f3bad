"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by
its nearest pivots in order and posted, with its place in that order, in the
inverted file of each of them. A query walks the files of its own few nearest
pivots, sums the footrule distance over them, and the candidates of least
distance are ranked again by the true inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace

#: Vectors sampled to choose pivots from, pivots, how many of them represent a vector, and how many files a query walks.
SAMPLE, PIVOTS, LENGTH, WALK = 1024, 256, 128, 32
#: Rows of a shard of the index and of a block of queries: bounds on a task's memory.
SHARD, BLOCK = 8192, 16384
#: Part of a shard's vectors that are ranked again; besides them all whose agreement with the
#: query's order is so near the full one that order alone cannot tell them apart.
CANDIDATES, ALIKE = 0.125, 0.75


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The indices of the nearest pivots of each vector by angle, nearest first."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    near = -(vectors / norm) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    return np.argsort(near, axis=1, kind="stable")[:, :length].astype(np.int32)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` of the sample in its order, passing over those nearly parallel to a chosen one."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(sample)):
        if len(chosen) < count and (not chosen or (unit[chosen] @ unit[i]).max() < 0.8):
            chosen.append(i)
    return sample[chosen]


class Shard:
    """The pivot inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        own = orders(self.vectors, pivots)
        # One file a pivot: every vector's place for it, LENGTH where it is not posted.
        self.files = np.full((len(pivots), len(ids)), own.shape[1], np.uint8)
        self.files[own.reshape(-1), np.repeat(np.arange(len(ids)), own.shape[1])] = np.tile(np.arange(own.shape[1], dtype=np.uint8), len(ids))

    def search(self, qid: np.ndarray, q: np.ndarray, q_order: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, length = len(self.ids), q_order.shape[1]
        walk = min(WALK, length)
        take = min(n, max(4 * k, int(np.ceil(CANDIDATES * n))))
        at = np.arange(walk, dtype=np.uint8)[:, None]
        full = walk * length - walk * (walk - 1) // 2
        for i in range(len(qid)):
            # Footrule: a pivot that both orders hold brings them nearer by its distance to the end in either.
            gain = walk * length - np.maximum(self.files[q_order[i, :walk]], at).sum(axis=0, dtype=np.int32)
            least = min(np.partition(gain, n - take)[n - take], int(ALIKE * full))
            chosen = np.flatnonzero(gain >= least)  # ties are never cut
            chosen = chosen[self.ids[chosen] != qid[i]]
            exact = np.einsum("ij,j->i", self.vectors[chosen], q[i])
            best = np.lexsort((self.ids[chosen], -exact))[:k]
            yield int(qid[i]), self.ids[chosen][best], exact[best]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` vectors of greatest inner product among those found.

    Scores are double precision on the original vectors, ties go to the smaller
    id. Null or zero vectors, vectors with a null, NaN or infinite component and
    null ids take no part,
    nor do vectors of another length than most; a query never finds its own id. Vectors that repeat
    an id are separate candidates; of query rows that repeat an id the least vector asks. Empty tables
    give no rows; columns other than the two are ignored, whatever their names.
    """
    ws = Workspace(vectors.sparkSession, "ann")

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v")
        fine = F.forall(v, lambda x: x.isNotNull() & (x == x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))

    own = sound(vectors)
    length = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return ws.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    alike = F.size("v") == length["d"]
    own = ws.save(own.filter(alike), "vectors")
    n = own.count()
    # Pivots come from the distinct vectors of least hash, whatever their ids or partitions.
    picked = own.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(SAMPLE).collect()
    pivots = choose_pivots(np.array([r["v"] for r in picked], float))
    shards = max(1, -(-n // SHARD))
    asked = ws.save(sound(queries).filter(alike).groupBy("id").agg(F.min("v").alias("v")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    # One row a vector and block of queries, one a query and shard: a task holds one shard and one block.
    index = own.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.select("shard", "block", "id", "v", F.lit(False).alias("asks")).union(posed.select("shard", "block", "id", "v", F.lit(True).alias("asks")))

    def run(table: pa.Table) -> pa.Table:
        column = table["v"].combine_chunks()
        v = column.flatten().to_numpy().reshape(len(column), -1)
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if asks.any() and not asks.all():
            shard = Shard(ids[~asks], v[~asks], pivots)
            out = list(shard.search(ids[asks], v[asks], orders(v[asks], pivots), k))
        return pa.table(
            {
                "query_id": pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)),
                "score": pa.array(np.concatenate([x[2] for x in out]) if out else np.empty(0)),
            }
        )

    found = both.groupBy("shard", "block").applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    top = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("top"))  # at most k from each shard
    return top.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
