"""Files written and read back: FITS, XISF and PNG, damage included."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest


from starloom.plans.convert import Options, convert, read
from starloom.sources import fits, png, tiff, xisf
from starloom.sources.files import save
from starloom.streaming.incremental import convert_new, windowed_events

DTYPES = {"UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "Float32": "f4", "Float64": "f8"}


def sample(kind, shape=(2, 5, 7)):
    r = np.random.default_rng(3)
    if kind.startswith("Float"):
        return r.random(shape).astype(DTYPES[kind])
    out = r.integers(0, 1 << (8 * np.dtype(DTYPES[kind]).itemsize), shape, dtype=np.uint64).astype(DTYPES[kind])
    out.flat[0], out.flat[-1] = 0, np.iinfo(out.dtype).max
    return out


def rows_of(spark, image, name):
    c, h, _ = image.shape
    return spark.createDataFrame([(name, ch, y, image[ch, y].astype(float).tolist()) for ch in range(c) for y in range(h)], "path string, channel int, y bigint, values array<double>")


def as_image(df):
    rows = sorted((r["channel"], r["y"], r["values"]) for r in df.collect())
    return np.array([r[2] for r in rows]).reshape(rows[-1][0] + 1, rows[-1][1] + 1, -1)


@pytest.mark.parametrize("kind", list(DTYPES))
def test_fits_round_trip(spark, tmp_path, kind):
    image = sample(kind)
    cards = spark.createDataFrame([("a.fits", 0, "OBJECT", "'M 31'", "what"), ("a.fits", 1, "EXPTIME", "30.5", "")], "path string, pos int, name string, value string, comment string")
    save(fits.files(rows_of(spark, image, "a.fits"), kind, cards), str(tmp_path)).collect()
    fits.register(spark)
    assert (tmp_path / "a.fits").stat().st_size % 2880 == 0
    bands = spark.read.format("fits_bands").load(str(tmp_path))
    np.testing.assert_array_equal(as_image(bands), image.astype(float))
    facts = spark.read.format("fits_images").load(str(tmp_path))
    assert fits.sample_formats(facts, bands).first()["sample_format"] == kind
    found = {r["name"]: (r["value"], r["comment"]) for r in spark.read.format("fits_keywords").load(str(tmp_path)).collect()}
    assert found["OBJECT"] == ("'M 31'", "what")
    assert found["EXPTIME"][0] == "30.5"


def test_fits_cards():
    assert fits.parse_card("NAME    = 'it''s  '           / text".ljust(80)) == ("NAME", "'it''s'", "text")
    assert fits.parse_card("HIERARCH ESO DET = 3 / n".ljust(80)) == ("ESO DET", "3", "n")
    assert fits.join_cards([("A", "'one &'", ""), ("CONTINUE", "'two'", "c")]) == [("A", "'one two'", "c")]


def test_damaged_fits_is_reported(tmp_path):
    whole = fits.encode(sample("UInt16"), "UInt16", [])
    (tmp_path / "b.fits").write_bytes(whole[: 2880 + 10])
    assert [u["skipped"] for u in fits.units(str(tmp_path / "b.fits"))] == ["the file ends inside the data"]


@pytest.mark.parametrize("kind", list(DTYPES))
@pytest.mark.parametrize("codec", [None, "zlib", "zstd"])
def test_xisf_round_trip(spark, tmp_path, kind, codec):
    image = sample(kind)
    save(xisf.files(rows_of(spark, image, "a.xisf"), kind, codec), str(tmp_path)).collect()
    np.testing.assert_array_equal(as_image(xisf.bands(spark, str(tmp_path))), image.astype(float))
    row = xisf.images(spark, str(tmp_path)).first()
    assert (row["width"], row["height"], row["channels"], row["sample_format"]) == (7, 5, 2, kind)
    assert [r["ok"] for r in xisf.verify(spark, str(tmp_path)).collect()] == [True]


def test_xisf_metadata_and_damage(spark, tmp_path):
    data = xisf.encode(sample("UInt16"), "UInt16", keywords=[("OBJECT", "'M 1'", "<&>")], properties=[("Instrument:ExposureTime", "Float32", "3.5")])
    (tmp_path / "m.xisf").write_bytes(data)
    assert [tuple(r)[3:] for r in xisf.keywords(spark, str(tmp_path)).collect()] == [("OBJECT", "'M 1'", "<&>")]
    assert [tuple(r)[3:6] for r in xisf.properties(spark, str(tmp_path)).collect()] == [("Instrument:ExposureTime", "Float32", "3.5")]
    (tmp_path / "m.xisf").write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert [(r["ok"], r["problem"]) for r in xisf.verify(spark, str(tmp_path)).collect()] == [(False, "checksum mismatch")]


def test_png_holds_the_samples():
    image = sample("UInt16", (3, 4, 5))
    data = png.encode(image)
    assert struct.unpack(">IIBB", data[16:26]) == (5, 4, 16, 2)
    at, body = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows, last, out = np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1), np.zeros(30, int), []
    for row in rows:
        now = np.zeros(30, int)
        for i, x in enumerate(row[1:].astype(int)):
            a, b, c = (now[i - 6] if i >= 6 else 0), last[i], (last[i - 6] if i >= 6 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now[i] = (x + [0, a, b, (a + b) // 2, near][row[0]]) & 255
        out.append(now)
        last = now
    got = np.array(out, np.uint8).reshape(4, 5, 3, 2).view(">u2")[..., 0].transpose(2, 0, 1)
    np.testing.assert_array_equal(got, image)


def test_convert_stretches_and_flips(spark, tmp_path):
    image = np.random.default_rng(5).normal(0.1, 0.01, (1, 6, 6)).astype("f4")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fits").write_bytes(fits.encode(image, "Float32", []))
    bands = read(spark, str(tmp_path / "in"))
    plain, flipped = (as_png(convert(bands, Options("png", stretch="unlinked", flip=f)).first()["content"]) for f in (False, True))
    np.testing.assert_array_equal(plain, flipped[::-1])
    m = np.float64(np.median(image))
    d = 1.4826 * np.median(np.abs(image.astype(float) - m).astype("f4").astype(float))
    s = max(0.0, m - 2.8 * d)
    mid = (0.25 - 1) * (m - s) / ((2 * 0.25 - 1) * (m - s) - 0.25)
    x = np.clip((image[0].astype(float) - s) / (1 - s), 0, 1)
    want = np.floor(np.clip((mid - 1) * x / ((2 * mid - 1) * x - mid), 0, 1) * 255 + 0.5)
    assert np.abs(plain.astype(int) - want).max() <= 1


def as_png(data):
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(h, -1)
    out, last = [], np.zeros(w, int)
    for row in rows:
        now = np.zeros(w, int)
        for i, x in enumerate(row[1:].astype(int)):
            a, b, c = (now[i - 1] if i else 0), last[i], (last[i - 1] if i else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now[i] = (x + [0, a, b, (a + b) // 2, near][row[0]]) & 255
        out.append(now)
        last = now
    return np.array(out, np.uint8)


def test_options_are_checked_first(spark):
    with pytest.raises(ValueError):
        convert(spark.createDataFrame([], "path string, image int, channel int, y bigint, values array<double>"), Options("gif"))


def test_new_files_are_converted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fits").write_bytes(fits.encode(sample("UInt16", (1, 3, 3)), "UInt16", []))
    for _ in range(2):
        convert_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), Options("xisf", sample_format="Float32"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.xisf"]


def test_windowed_events(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r["n"], r["total"]) for r in windowed_events(rows).collect()] == [(2, 3.0)]


def tiff_samples(data):
    """A reader of its own for what the writer makes."""
    at, n = struct.unpack("<I", data[4:8])[0], 0
    n = struct.unpack("<H", data[at : at + 2])[0]
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack("<HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
        size = {3: 2, 4: 4}[kind]
        raw = value if count * size <= 4 else data[struct.unpack("<I", value)[0] :]
        tags[tag] = struct.unpack(f"<{count}{'H' if kind == 3 else 'I'}", raw[: count * size])
    (w,), (h,), (c,), (per,), (predictor,) = (tags[t] for t in (256, 257, 277, 278, 317))
    kind = np.dtype({1: "u", 3: "f"}[tags[339][0]] + str(tags[258][0] // 8))
    out = []
    for offset, size in zip(tags[273], tags[279], strict=True):
        raw = np.frombuffer(zlib.decompress(data[offset : offset + size]), np.uint8)
        if predictor == 3:
            rows = raw.reshape(-1, w * c * kind.itemsize).copy()
            for x in range(c, rows.shape[1]):
                rows[:, x] += rows[:, x - c]
            out.append(np.ascontiguousarray(rows.reshape(len(rows), kind.itemsize, w * c).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, w, c))
        else:
            rows = raw.view(kind).reshape(-1, w, c).copy()
            out.append(np.cumsum(rows, axis=1, dtype=kind) if predictor == 2 else rows)
    got = np.concatenate(out)
    assert len(got) == h and all(len(x) <= per for x in out)
    return got.transpose(2, 0, 1)


@pytest.mark.parametrize("kind", list(DTYPES))
@pytest.mark.parametrize("shape", [(1, 4, 5), (3, 7, 3), (4, 2, 2)])
def test_tiff_holds_the_samples(monkeypatch, kind, shape):
    monkeypatch.setattr(tiff, "STRIP", 64)
    image = sample(kind, shape)
    np.testing.assert_array_equal(tiff_samples(tiff.encode(image, kind)), image)
