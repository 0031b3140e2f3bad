"""Pixel arithmetic and geometry against plain Python and NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.functions import codecs, pixels
from starloom.operators import images as im
from starloom.operators import metadata as md


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("v", "source", "target", "want"),
    [(255, "UInt8", "UInt16", 65535), (257, "UInt16", "UInt8", 1), (65535, "UInt16", "UInt8", 255), (128, "UInt8", "UInt8", 128), (float("nan"), "Float32", "UInt8", 0), (float("inf"), "Float32", "UInt8", 255), (-1.0, "Float64", "UInt16", 0), (0.5, "Float32", "UInt8", 128), (255, "UInt8", "Float64", 1.0)],
)
def test_convert(spark, v, source, target, want):
    assert one(spark, pixels.convert(F.lit(v), source, target)) == pytest.approx(want)


def test_empty_float_range_is_the_unit(spark):
    assert one(spark, pixels.convert(F.lit(0.5), "Float32", "UInt8", 3.0, 3.0)) == 128


def test_mtf_fixes_its_ends_and_middle(spark):
    row = spark.range(1).select(*(pixels.mtf(F.lit(0.2), F.lit(x)).alias(f"x{i}") for i, x in enumerate((0.0, 0.2, 1.0, -1.0)))).first()
    assert list(row) == pytest.approx([0.0, 0.5, 1.0, 0.0])


@pytest.mark.parametrize("values", [[], [3.0], [4.0, 1.0], [1.0, 9.0, 2.0, 4.0]])
def test_array_median(spark, values):
    want = float(np.median(values)) if values else 0.0
    got = spark.createDataFrame([(values,)], "a array<double>").select(pixels.array_median(F.col("a"))).first()[0]
    assert got == want


def test_sizes():
    assert pixels.smaller_size(8, bin_=3) == 2
    assert pixels.smaller_size(5, bin_=9) == 1
    assert pixels.smaller_size(10, scale=0.25) == 3
    assert pixels.smaller_size(10, scale=2.0) == 10
    assert pixels.smaller_size(10, fit=4) == 4


def cells(spark, image):
    rows = [("a", int(y), int(x), float(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, v double")


def as_array(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize(("size", "to"), [((6, 4), (3, 2)), ((5, 7), (3, 2)), ((3, 3), (3, 3)), ((4, 4), (1, 1))])
def test_downsample_shares(spark, size, to):
    image = np.random.default_rng(1).random(size)
    image[0, 0] = np.nan
    got = as_array(im.downsample(cells(spark, image), ["image"], size, to), *to)
    want = np.zeros(to)
    for j in range(to[0]):
        for i in range(to[1]):
            total = weight = 0.0
            for y in range(size[0]):
                for x in range(size[1]):
                    wy = max(0, min((y + 1) * to[0], (j + 1) * size[0]) - max(y * to[0], j * size[0]))
                    wx = max(0, min((x + 1) * to[1], (i + 1) * size[1]) - max(x * to[1], i * size[1]))
                    if wy * wx and math.isfinite(image[y, x]):
                        total, weight = total + image[y, x] * wy * wx, weight + wy * wx
            want[j, i] = total / weight if weight else np.nan
    np.testing.assert_allclose(got, want)


def test_all_samples_not_finite(spark):
    got = as_array(im.downsample(cells(spark, np.full((2, 2), np.inf)), ["image"], (2, 2), (1, 1)), 1, 1)
    assert np.isnan(got).all()


def test_range_skips_what_is_not_finite(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", -2.0), ("b", float("inf"))], "k string, v double")
    got = {r["k"]: (r["lower"], r["upper"], r["non_finite"]) for r in im.finite_range(rows, "k").collect()}
    assert got == {"a": (-2.0, 1.0, True), "b": (0.0, 0.0, True)}


def test_partition_count_does_not_matter(spark):
    image = np.random.default_rng(2).random((8, 8))
    a, b = (as_array(im.downsample(cells(spark, image).repartition(n), ["image"], (8, 8), (3, 3)), 3, 3) for n in (1, 8))
    np.testing.assert_allclose(a, b, rtol=1e-12)


@pytest.mark.parametrize(("pattern", "text", "want"), [("*.fits", "a.fits", True), ("*.fits", "a.fitsx", False), ("a?c", "abc", True), ("[a]", "a", False), ("[a]", "[a]", True), ("a*", "a\nb", True)])
def test_glob(spark, pattern, text, want):
    assert one(spark, md.glob_match(F.lit(text), pattern)) is want


@pytest.mark.parametrize(("text", "want"), [("a b", "a_b"), ("9x", "_9x"), ("--", "none"), ("é", "none")])
def test_identifier(spark, text, want):
    assert one(spark, md.identifier(F.lit(text), F.lit("none"))) == want


def test_offsets_and_cover(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 5000), ("a", 3, 1)], "k string, n int, size int")
    got = [r["position"] for r in md.aligned_offsets(rows, "k", "n", F.col("size"), 4096, 4096).orderBy("n").collect()]
    assert got == [4096, 8192, 16384]
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 7), ("a", 8, 12), ("a", 20, 21)], "k string, a bigint, b bigint")
    assert md.covered_length(spans, "k", "a", "b").first()["covered"] == 13


def test_verdict(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", True), ("c", True)], "k string, ok boolean")
    assert {r["k"]: r["verdict"] for r in md.verdict(rows, "k").collect()} == {"a": "NOT FULLY CHECKED", "b": "FAILED", "c": "OK"}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["zlib", "zstd"]), st.sampled_from([1, 2, 4, 8]))
def test_codecs_undo_themselves(data, codec, item):
    assert codecs.decompress(codecs.compress(data, codec, item=item), codec, len(data), item) == data


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([8, 16, 32]), st.lists(st.integers(0, 2**32 - 1), max_size=100))
def test_rice_undoes_itself(bits, values):
    x = np.array([v % (1 << bits) for v in values], np.int64)
    assert np.array_equal(codecs.rice_decode(codecs.rice_encode(x, bits), len(x), bits), x)


def test_wrong_size_is_an_error():
    with pytest.raises(ValueError):
        codecs.decompress(codecs.compress(b"abcd", "zlib"), "zlib", 3)


def test_ids_already_taken_are_passed_over(spark):
    rows = spark.createDataFrame([("f", 1, "x"), ("f", 2, "x_2"), ("f", 3, "x"), ("f", 4, "x")], "file string, pos int, name string")
    assert [r["id"] for r in md.unique_identifiers(rows, "file", "pos", "name").orderBy("pos").collect()] == ["x", "x_2", "x_3", "x_4"]


def test_what_does_not_fit_uses_nothing_up(spark):
    rows = spark.createDataFrame([("f", 1, 6), ("f", 2, 9), ("f", 3, 4), ("f", 4, 1)], "file string, pos int, size int")
    assert md.within_budget(rows, "file", "pos", "size", 10).first()["kept"] == [1, 3]


@pytest.mark.parametrize(
    ("kind", "text", "fine"),
    [("UInt64", "18446744073709551615", True), ("UInt64", "18446744073709551616", False), ("Int8", "-128", True), ("Int8", "-129", False), ("Int32", "1.0", False), ("Boolean", "true", True), ("Boolean", "1", False), ("Float32", "3.4e38", True), ("Float32", "3.5e38", False), ("Float64", "1e999", False), ("Float64", "nan", False), ("String", "x", True), ("Int128", "1", False), ("UInt8", "9" * 50, False)],
)
def test_property_problem(spark, kind, text, fine):
    assert (one(spark, md.property_problem(F.lit(kind), F.lit(text))) is None) is fine


def test_unique_identifiers_against_an_ordered_fold(spark):
    import random

    r = random.Random(5)
    rows = [(g, i, r.choice(["x", "x_2", "x_2_2", "x_3", "y", "y_2", "_2", "z"])) for g in ("a", "b", "c") for i in range(60)]
    rows += [("d", i, "x") for i in range(300)]
    want = {}
    for g, i, n in sorted(rows):
        taken = {v for (h, _), v in want.items() if h == g}
        k, found = 1, n
        while found in taken:
            k += 1
            found = f"{n}_{k}"
        want[g, i] = found
    df = spark.createDataFrame(rows, "file string, pos int, name string").repartition(7)
    assert {(x["file"], x["pos"]): x["id"] for x in md.unique_identifiers(df, "file", "pos", "name").collect()} == want
