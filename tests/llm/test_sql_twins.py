"""The text queries that SQL can express, against DuckDB; and awkward tables for every operator."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from starloom.llm import queries

DIR = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    want = con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted((repr([r[c] for c in names]) for r in got.collect())) == sorted(repr([r[i] for i in order]) for r in want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


LONG = " ".join(f"w{i}" for i in range(5000))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long and repeated texts, repeated and null ids, and extra columns with clashing names."""
    rows = [(1, "a b c d e f\ng\nh\ni"), (1, "a b c d e f\ng\nh\ni"), (2, None), (None, "x\ny\nz"), (3, ""), (4, " \n \n "), (5, LONG), (6, LONG + " more"), (None, None), (2, "x\ny\nz")]
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}", "e", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in ("id", "th", "covered", "score", "node", "u", "text_key", "n_removed", "toxic_score")})


def both(f, df):
    """Runs on the table and on none of its rows; the empty one must give no rows."""
    assert f(df.limit(0)).count() == 0
    return f(df).collect()


def test_line_dedup_awkward(awkward):
    from starloom.llm.line_dedup import line_dedup

    out = both(lambda d: line_dedup(d, removed="gone"), awkward)
    assert len(out) == 10
    assert [r["gone"] for r in out if r["doc_id"] == 1] == [0, 0]
    assert {(r["doc_id"], r["text"], r["gone"]) for r in out if r["gone"]} == {(None, "", 3)}  # null ids come last
    assert all(r["th"] == 7 and r["covered"] == 7 for r in out)


def test_near_dedup_awkward(awkward):
    from starloom.llm.near_dedup import near_duplicates

    out = both(near_duplicates, awkward)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in out)
    assert got == [(-1, 0, -1, True), (-1, 1, 2, False), (1, 5, 1, True), (1, 5, 1, True), (2, 0, 2, True), (2, 1, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 4996, 5, True), (6, 4997, 5, False)]


def test_decontaminate_awkward(awkward, spark):
    from starloom.llm.decontaminate import contained_items

    items = spark.createDataFrame([(1, "B C D e f"), (2, "x y"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(40, 60)))], "item_id bigint, text string").withColumn("h", F.lit(1))
    out = both(lambda d: contained_items(d, items), awkward)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in out)
    assert got == [(-1, 2, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1), (5, 5, 16, 16), (6, 5, 16, 16)]
    assert contained_items(awkward, items.limit(0)).count() == 0


def test_mixing_awkward(awkward):
    from starloom.llm.mixing import mix_sources

    out = both(mix_sources, awkward)
    assert len(out) == 10
    assert all(r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 2 for r in out)
    assert all(r["repeats"] == 0 for r in out if not r["size"])


def test_toxicity_awkward(awkward, spark):
    from starloom.llm.toxicity import toxicity

    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1)], "doc_id bigint, toxic int")
    out = both(lambda d: toxicity(d, labels), awkward)
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] < 0.5 for r in toxicity(awkward, labels.limit(0)).collect())


def test_licences_awkward(awkward, spark):
    from starloom.llm.licences import scan

    assert all(r["licences"] == "" for r in both(scan, awkward))
    text = "Released under the MIT License. All rights reserved.\nLicensed under CC BY-NC 4.0."
    row = scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row["licences"], row["n_sentences"], row["unmatched"]) == ("MIT CC-BY-NC-4.0 all-rights-reserved", 3, "")


def test_licence_rules_take_the_longest_sequence(spark):
    from starloom.llm.licences import SENTENCES, scan

    def text(*ids):
        return "\n".join(SENTENCES[i][0].capitalize() + "." for i in ids)

    rows = [(1, text("BsdPermission", "BsdSource", "BsdBinary", "BsdNames")), (2, text("BsdPermission", "BsdSource", "BsdBinary")), (3, text("BsdSource", "BsdPermission")), (4, text("MitPermission", "MitNotice", "AsIs", "MitNoLiability"))]
    got = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("BSD-3-Clause", ""), 2: ("BSD-2-Clause", ""), 3: ("", "<BsdSource><BsdPermission>"), 4: ("MIT", "")}


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_wrapped_and_commented_licences(spark):
    import textwrap

    from starloom.llm.licences import HINTS, SENTENCES, scan

    def wrapped(*ids):
        return "\n\n".join(textwrap.fill(SENTENCES[i][0].capitalize() + ".", 79) for i in ids)

    def commented(text, mark):
        return "\n".join(mark + line for line in text.split("\n"))

    mit = wrapped("MitPermission", "MitNotice", "AsIs", "MitNoLiability")
    bsd = wrapped("BsdPermission", "BsdSource", "BsdBinary", "BsdNames")
    texts = [mit, commented(mit, "// "), bsd, commented(bsd, " * "), GPL2, commented(GPL2, "# "), APACHE, commented(APACHE, "# "), "Released under the MIT License" + " " * 5000 + "*\nmore"]
    rows = {r["doc_id"]: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [rows[i]["licences"] for i in range(9)] == ["MIT"] * 2 + ["BSD-3-Clause"] * 2 + ["GPL-2.0-or-later"] * 2 + ["Apache-2.0"] * 2 + ["MIT"]
    assert all(r["unmatched"] == "" for r in rows.values())
    assert all(any(h in s for h in HINTS.split("|")) for found in SENTENCES.values() for s in found)
