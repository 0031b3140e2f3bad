"""The corpus pipeline: five stages over documents, each one operator applied to what its predecessor kept.

Between stages the documents are written as Parquet and read again, so a stage
starts from files, not from lineage. All stages but the last return the columns
of documents; the last adds what it decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, free_name, read_table, small
from starloom.llm.decontaminate import contained_items
from starloom.llm.line_dedup import line_dedup
from starloom.llm.mixing import mix_sources
from starloom.llm.near_dedup import near_duplicates
from starloom.llm.toxicity import score, train

#: No SQL twin: the first and third stages are not SQL-expressible.
ORACLE_SQL = None
#: A document goes when it is likelier toxic than not.
TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression-distance score stays under ``TOXIC``; repeated rows share their fate.

    A null or empty text has the score of no windows, a null id no label; both
    stay unless that score rejects them.
    """
    name = free_name(docs, "toxic_score")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")), name=name)
    return scored.filter(F.col(name) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; n_chars follows. A document that loses every line goes.

    Null, empty and short texts have no windows and stay; rows that repeat id
    and text are one place and stay alike; null ids come last in the order.
    """
    name = free_name(docs, "n_removed")
    cut = line_dedup(docs, removed=name).filter((F.col(name) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cut.select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame, key: F.Column) -> DataFrame:
    """``docs`` less the rows whose id and text key are in ``gone(gone_id, gone_key)``."""
    name = free_name(docs, "text_key")
    keyed = docs.withColumn(name, key)
    return keyed.join(small(gone), keyed["doc_id"].eqNullSafe(F.col("gone_id")) & (F.col(name) == F.col("gone_key")), "left_anti").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in five-word shingles, the one with the smallest id.

    A null id is smaller than none: it stays only where a group has no other.
    Of rows that repeat id and text one stays, with the other columns of any of
    them. Texts that are null or without words are alike to nothing but their
    own repetition.
    """
    ws = Workspace(spark, "pipeline-near")
    groups = near_duplicates(docs, digest="text_digest")
    gone = ws.save(groups.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_digest").alias("gone_key")).distinct(), "gone")
    left = ws.save(_without(docs, gone, F.unhex(F.md5(F.col("text")))), "left")
    return _once(ws, left)


def _once(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those that repeat id and text; only such rows are shuffled whole."""
    id_, key = free_name(docs, "own_id"), free_name(docs, "own_key")
    keyed = docs.withColumn(key, F.md5(F.col("text")))
    again = ws.save(keyed.groupBy(F.col("doc_id").alias(id_), F.col(key).alias(key)).agg(F.count("*").alias("n")).filter("n > 1").select(id_, F.col(key).alias(f"{key}_again")), "again")
    same = keyed["doc_id"].eqNullSafe(F.col(id_)) & F.col(key).eqNullSafe(F.col(f"{key}_again"))
    rest = keyed.join(small(again), same, "left_anti").select(*docs.columns)
    return rest.unionByName(keyed.join(small(again), same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and wordless texts hold none and stay; rows that repeat id and text
    are judged alike, null ids among them.
    """
    ws = Workspace(spark, "pipeline-leaks")
    leaks = contained_items(docs, read_table(spark, sf_dir, "benchmark"))
    gone = ws.save(leaks.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_key")).distinct(), "gone")
    return _without(docs, gone, F.xxhash64("text"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with mix_repeats (how often) and mix_words (words taken in all).

    Rows that repeat id, source and text are drawn one by one and come out as
    one row with what was drawn of all of them; any other row has 1 or 2
    repeats. Documents without words, null texts among them, are never taken. A
    null id or source is a value of its own.
    """
    ws = Workspace(spark, "pipeline-mix")
    of = F.struct("doc_id", "source", F.col("th").alias("key"))
    plan = mix_sources(docs).groupBy(of.alias("of")).agg(F.sum("repeats").cast("int").alias("mix_repeats"), F.sum("taken").alias("mix_words"), F.count("*").alias("n")).filter("mix_repeats > 0")
    plan = ws.save(plan.select(*(F.col(f"of.{c}").alias(f"plan_{c}") for c in ("doc_id", "source", "key")), "mix_repeats", "mix_words", F.col("n").alias("plan_n")), "plan")
    name = free_name(docs, "text_key")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(F.col("plan_doc_id")) & keyed["source"].eqNullSafe(F.col("plan_source")) & (F.col(name) == F.col("plan_key"))
    columns = [*docs.columns, "mix_repeats", "mix_words"]
    single, again = (plan.filter(f"plan_n {sign} 1") for sign in ("=", ">"))
    taken = keyed.join(single, same).select(*columns)
    if again.isEmpty():
        return taken
    return taken.unionByName(keyed.join(small(again), same).dropDuplicates(["doc_id", "source", name]).select(*columns))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
