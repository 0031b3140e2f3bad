"""The pipeline's stages against their contracts, each on its own input."""

from __future__ import annotations

import corpus_pipeline as cp
from starloom.llm.decontaminate import contained_items
from starloom.llm.line_dedup import repeated_lines
from test_brute_force import components

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    # A planted exact copy, a near copy, and a benchmark item inside a longer text.
    first = docs.filter("doc_id = 0").first()
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    text = " ".join(f"word{i}" for i in range(200))
    more = [(9000, text), (9001, text), (9002, text + " tail"), (9003, text[:400] + " " + item + " " + text[400:] + " end"), (9004, None), (9005, "")]
    extra = spark.createDataFrame([(i, t, first["lang"], first["source"], len(t or "")) for i, t in more], docs.schema)
    kept = docs.union(extra)
    before = None
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, kept, DIR).write.parquet(str(tmp_path / str(i)))
        before, kept = kept, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert kept.columns == docs.columns
            assert kept.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in kept.collect()}
        if i == 1:
            assert repeated_lines(kept).count() <= repeated_lines(before).count()
            assert {9000, 9001, 9002, 9003} <= ids  # single lines are no windows
        if i == 2:
            want = components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert ids == {d for d, c in want.items() if d == c}
        if i == 3:
            leaks = {r["doc_id"] for r in contained_items(before, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
            assert 9003 in leaks and ids == {r["doc_id"] for r in before.collect()} - leaks
            assert 9000 in ids
    assert set(kept.columns) == {*docs.columns, "mix_repeats", "mix_words"}
    assert {r["mix_repeats"] for r in kept.collect()} <= {1, 2}


def test_no_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, DIR).count() == 0
