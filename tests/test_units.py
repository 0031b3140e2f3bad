"""XISF units, compressed FITS, cards and codecs: round trips, known bytes and damage."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from starloom.functions import codecs
from starloom.sources import cards, fits, xisf
from starloom.sources.files import save


def picture(kind, shape=(2, 9, 11), seed=1):
    r = np.random.default_rng(seed)
    return r.random(shape).astype("f4" if kind == "Float32" else "f8") if kind.startswith("Float") else r.integers(0, 2 ** min(int(kind[4:]), 50), shape)


def pictures(**more):
    out = []
    for i, kind in enumerate(("UInt8", "UInt16", "UInt32", "Float32", "Float64")):
        out.append({"samples": picture(kind, (1 + i % 3, 9, 11), i), "sample_format": kind, "name": f"im {i}", "keywords": [("OBJECT", "'M 31'", "")], "properties": [
            {"id": "A:b", "type": "F64Vector", "block": True, "rows": 2, "columns": 0, "value": struct.pack("<2d", 1, 2), "comment": "é", "format": ""},
            {"id": "A:long", "type": "UI16Vector", "block": True, "rows": 5000, "columns": 0, "value": bytes(10000), "comment": "", "format": ""},
            {"id": "A:c", "type": "Float64", "value": "1.25", "comment": "", "format": "", "block": False, "rows": 0, "columns": 0}]} | more)
    return out


def planes(df):
    out = {}
    for r in df.collect():
        out[r["path"], r["image"], r["channel"], r["y"]] = r["values"]
    return out


def wanted(path, images):
    return {(path, i, c, y): row.astype(float).tolist() for i, m in enumerate(images) for c, plane in enumerate(m["samples"]) for y, row in enumerate(plane)}


@pytest.mark.parametrize("tiled", [False, True])
def test_fits_with_several_images(spark, tmp_path, tiled):
    made = [dict(m, properties=[dict(p, value=p["value"].encode() if isinstance(p["value"], str) else p["value"]) for p in m["properties"]]) for m in pictures()]
    (tmp_path / "a.fits.fz").write_bytes(fits.encode_all(made, tiled))
    fits.register(spark)
    bands = spark.read.format("fits_bands").load(str(tmp_path))
    path = str(tmp_path / "a.fits.fz")
    assert planes(bands) == wanted(path, made)
    part = bands.filter("image = 1 and channel = 1 and y between 3 and 5")
    assert planes(part) == {k: v for k, v in wanted(path, made).items() if k[1:3] == (1, 1) and 3 <= k[3] <= 5}
    found = spark.read.format("fits_properties").load(str(tmp_path)).collect()
    assert len(found) == 15 and {(r["image"], bytes(r["value"]), r["comment"]) for r in found if r["id"] == "A:b"} == {(i, struct.pack("<2d", 1, 2), "é") for i in range(5)}
    assert all(ok is not False for _, ok, _ in fits.verify_units(path))
    if tiled:
        data = bytearray((tmp_path / "a.fits.fz").read_bytes())
        at = fits.images(path)[1]["offset"]
        data[at : at + 100] = bytes(100)
        (tmp_path / "a.fits.fz").write_bytes(data)
        assert any(ok is False for _, ok, _ in fits.verify_units(path))


def test_pushed_filters_choose_partitions(tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.encode_all(pictures()[1:3]))
    reader = fits._Reader({"path": str(tmp_path)}, "bands")
    every = sum(len(p.pieces) for p in reader.partitions())
    list(reader.pushFilters([fits.EqualTo(("image",), 1), fits.GreaterThan(("y",), 6)]))
    pieces = [x for p in reader.partitions() for x in p.pieces]
    assert len(pieces) < every and {(p.image, p.first, p.count) for p in pieces} == {(1, 7, 2)}


@pytest.mark.parametrize("codec", [None, "zlib", "zstd", "lz4", "lz4hc"])
@pytest.mark.parametrize("subblocks", [None, 100])
def test_xisf_with_several_images(spark, tmp_path, codec, subblocks):
    made = pictures()
    (tmp_path / "a.xisf").write_bytes(xisf.encode_all(made, codec, subblocks=subblocks, checksum="sha-256"))
    head, body = xisf.encode_unit(made, "b", codec, subblocks=subblocks)
    (tmp_path / "b.xish").write_bytes(head)
    (tmp_path / "b.xisb").write_bytes(body)
    assert planes(xisf.bands(spark, str(tmp_path))) == wanted(str(tmp_path / "a.xisf"), made) | wanted(str(tmp_path / "b.xish"), made)
    found = xisf.properties(spark, str(tmp_path)).filter("id = 'A:b'").collect()
    assert {bytes(r["data"]) for r in found} == {struct.pack("<2d", 1, 2)} and len(found) == 10
    assert {r["id"] for r in xisf.images(spark, str(tmp_path)).collect()} == {f"im_{i}" for i in range(5)}
    assert all(r["ok"] is not False for r in xisf.verify(spark, str(tmp_path)).collect())


def test_rewriting_changes_only_the_storage(spark, tmp_path):
    made = pictures()
    (tmp_path / "a.xisf").write_bytes(xisf.encode_all(made, "zlib"))
    out = xisf.rewrite(spark, str(tmp_path / "a.xisf"), codec="lz4hc", subblocks=64, checksum="sha-512")
    row = out.first()
    assert row["blocks"] == 5 and row["kept"] == 0  # small blocks stand in the header
    save(out.select("path", "content"), str(tmp_path / "out")).collect()
    assert planes(xisf.bands(spark, str(tmp_path / "out"))) == wanted(str(tmp_path / "out/a.xisf"), made)
    listed = xisf.blocks(spark, str(tmp_path / "out")).filter("kind = 'attachment' and codec is not null").collect()
    assert listed and all(r["codec"] == "lz4hc" and r["checksum"].startswith("sha-512:") for r in listed)
    again = xisf.rewrite(spark, str(tmp_path / "a.xisf"), codec="zlib", checksum="keep").first()
    assert again["kept"] > 0
    save(xisf.rewrite(spark, str(tmp_path / "a.xisf"), unit="u").select("path", "content"), str(tmp_path / "u")).collect()
    assert planes(xisf.bands(spark, str(tmp_path / "u"))) == wanted(str(tmp_path / "u/u.xish"), made)


def handmade(tmp_path, inner, name="h.xish"):
    (tmp_path / name).write_text(f'<xisf version="1.0">{inner}</xisf>')
    return str(tmp_path / name)


def test_external_blocks_stay_in_the_folder(tmp_path):
    path = str(tmp_path / "h.xish")
    assert xisf.external(path, "path(@header_dir/b.xisb):0x1f") == (str(tmp_path / "b.xisb"), 31)
    for bad in ("path(/etc/passwd)", "path(@header_dir/../b.xisb):1", "url(http://x/y):1"):
        with pytest.raises(PermissionError):
            xisf.external(path, bad)
    assert xisf.external(path, "path(/data/b)", "Anywhere") == ("/data/b", None)
    with pytest.raises(PermissionError):
        xisf.external(str(tmp_path / "h.xisf"), "path(@header_dir/b.xisb):1")


def test_block_index_circles_are_refused(tmp_path):
    (tmp_path / "c.xisb").write_bytes(b"XISB0100" + bytes(8) + struct.pack("<IIQ", 0, 0, 16))
    with pytest.raises(ValueError, match="circle"):
        xisf.block_index(str(tmp_path / "c.xisb"))


def test_references_tables_and_stretch(spark, tmp_path):
    image = '<Image geometry="2:2:1" sampleFormat="UInt8" location="inline:hex" >01020304'
    table = '<Table id="t" rows="1" columns="2"><Structure><Field id="a" type="String"/><Field id="n" type="Int32"/></Structure><Row><Cell value="x"/><Cell>7</Cell></Row></Table>'
    handmade(tmp_path, f'<Property uid="p" id="X:y" type="String" value="v"/>{image}<Reference ref="p"/>{table}<Table id="bad"><Row/></Table><DisplayFunction m="0.1:0.5:0.5:0.5" s="0:0:0:0" h="1:1:1:1" l="0:0:0:0" r="1:1:1:1"/><ColorFilterArray pattern="RGGB" width="2" height="2"/></Image>')
    assert [(r["id"], r["text"]) for r in xisf.properties(spark, str(tmp_path)).collect()] == [("X:y", "v")]
    assert [(r["id"], r["row"], r["field"], r["text"], r["problem"]) for r in xisf.tables(spark, str(tmp_path)).collect()] == [("t", 0, "a", "x", None), ("t", 0, "n", "7", None), ("bad", None, None, None, "the table has no fields")]
    row = xisf.images(spark, str(tmp_path)).first()
    assert row["stretch"][0][0] == 0.1 and (row["cfa"], row["cfa_width"]) == ("RGGB", 2)


def test_long_texts_go_on():
    text = "it's a long one & more " * 12
    made = cards.format_card("NOTE", cards.quoted(text.strip()), "c")
    assert all(len(c) == 80 for c in made) and len(made) > 2
    back = fits.join_cards([fits.parse_card(c.decode()) for c in made])
    assert [(n, cards.unquoted(v), t) for n, v, t in back] == [("NOTE", text.strip(), "c")]
    assert cards.format_card("LONGER NAME", "1.5e3")[0].startswith(b"HIERARCH LONGER NAME = 1.5E3")
    assert cards.format_card("EXPTIME", "30")[0][:30] == b"EXPTIME =                   30"
    assert len(cards.format_card("HISTORY", "", "x" * 100)) == 2


@pytest.mark.parametrize(("x", "want"), [(0.1, "0.1"), (1 / 3, "0.333333333333333") if float("0.333333333333333") == 1 / 3 else (1 / 3, "0.3333333333333333"), (1e22, "1e+22"), (2.5, "2.5"), (-0.0, "-0")])
def test_format_double(x, want):
    assert cards.format_double(x) == want and float(cards.format_double(x)) == x


@pytest.mark.parametrize(("text", "ok"), [("2024-02-29T12:00:60Z", True), ("2023-02-29", False), ("-12345-01-01T00:00:00+05:30", True), ("2024-1-1", False), ("2024-01-01T24:00:00", False)])
def test_time_points(text, ok):
    assert cards.is_time_point(text) is ok


def test_dates_at_no_offset():
    assert cards.fits_date("2024-01-01T00:00:00Z") == "2024-01-01T00:00:00"
    assert cards.fits_date("2024-01-01T00:00:00+01:00") is None
    assert cards.exif_time("2024:01:31 12:00:00") == "2024-01-31T12:00:00"


def test_rice_has_its_defined_bytes():
    # Two samples 1, 2: the first as 16 bits, split 0 (code 1 in four bits), differences 0 and 1 mapped to 0 and 2: 1, 001.
    assert codecs.rice_encode(np.array([1, 2]), 16) == bytes([0x00, 0x01, 0b00011001])
    assert codecs.rice_encode(np.array([5, 5, 5]), 8) == bytes([5, 0])
    assert codecs.rice_decode(bytes([0x00, 0x01, 0b00011001]), 2, 16).tolist() == [1, 2]
    with pytest.raises(ValueError):
        codecs.rice_decode(bytes([0x00, 0x01, 0b00010000]), 2, 16)


def test_codecs_have_their_defined_bytes():
    assert codecs.decompress(bytes([0x50]) + b"hello", "lz4", 5) == b"hello"  # one sequence of literals
    assert codecs.decompress(zlib.compress(b"abab"), "zlib", 4, 2) == b"aabb"
    with pytest.raises(ValueError):
        codecs.decompress(b"x" * 10, "lz4", 1 << 30)
    with pytest.raises(ValueError):
        codecs.unpack_subblocks(b"abc", "zlib", "2,5", 5)
    with pytest.raises(ValueError):
        codecs.compress(b"", "zstd", 30)


def test_pixel_lists_and_dither():
    # Header of seven words, then: value 3 by its low twelve bits, run of 2 zeros, run of 3 threes.
    words = [0, 7, -100, 10, 0, 0, 0, 0x1003, 0x0000 | 0, 0x0002, 0x4003]
    words[3] = len(words)
    assert codecs.plio_decode(np.array(words, np.int32), 5).tolist() == [0, 0, 3, 3, 3]
    first = codecs.dither_numbers()
    assert first[0] == pytest.approx(16807 / 2147483647) and round(first[-1] * 2147483647) == 1043618065
    got = codecs.dithered(np.array([10.0, -2147483646.0, 5.0]), 2.0, 1.0, 0, 1, "SUBTRACTIVE_DITHER_2", 5)
    assert got[1] == 0 and np.isnan(got[2])
