"""Every registered image query against its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from starloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events labels lineitem nation orders pages part region conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def key(row):
    return repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row])


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, name):
    got = catalog.queries()[name](spark, DIR)
    want = con.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(([r[c] for c in names] for r in got.collect()), key=key)
    order = [want.columns.index(c) for c in names]
    b = sorted(([r[i] for i in order] for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_whole_texts_are_read(spark, tmp_path):
    import base64

    texts = ["", "a", "abcd" * 99 + "é", "x" * 400 + "tail", "語" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def checksum(b):
        b += bytes(-len(b) % 4)
        s = sum(int.from_bytes(b[i : i + 4], "big") for i in range(0, len(b), 4))
        while s >> 32:
            s = (s & 0xFFFFFFFF) + (s >> 32)
        return s

    sums = {r["doc_id"]: r["checksum"] for r in catalog.fits_checksum_whole(spark, str(tmp_path)).collect()}
    assert sums == {i: checksum(t.encode()) for i, t in enumerate(texts)}
    coded = {r["doc_id"]: r["b64"] for r in catalog.base64_whole(spark, str(tmp_path)).collect()}
    assert coded == {i: base64.b64encode(t.encode()).decode() for i, t in enumerate(texts)}
