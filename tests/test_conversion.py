"""Conversion of whole folders, ASDF trees, raw files and plate solutions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from starloom.operators import metadata as md
from starloom.operators import wcs
from starloom.plans.convert import Options, convert_files, convert_to, open_files
from starloom.sources import asdf, cards, dng, fits, tiff, xisf
from starloom.sources.files import detect, listing


def image(kind, shape, seed=0, **more):
    r = np.random.default_rng(seed)
    samples = r.random(shape).astype("f4") if kind == "Float32" else r.integers(0, 2 ** int(kind[4:]), shape)
    return {"samples": samples, "sample_format": kind, "name": "", "keywords": [], **more}


def read_planes(collection):
    return {(r["path"].rsplit("/", 1)[-1], r["image"], r["channel"], r["y"]): r["values"] for r in collection.bands.collect()}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    words = [("OBJECT", "'M 31'", "what"), ("NAXIS1", "5", ""), ("GAIN", "1.5", "")]
    (tmp_path / "in/a/x.fits").write_bytes(fits.encode_all([image("UInt16", (1, 4, 5), 1, keywords=words), image("Float32", (2, 3, 3), 2)]))
    (tmp_path / "in/b/x.fits").write_bytes(fits.encode_all([image("UInt8", (1, 2, 2), 3)], tiled=True))
    (tmp_path / "in/b/y.fits").write_bytes(xisf.encode_all([image("UInt32", (1, 3, 4), 4)]))  # named otherwise than it is
    (tmp_path / "in/b/z.asdf").write_bytes(asdf.encode_all([image("UInt16", (3, 4, 4), 5)]))
    (tmp_path / "in/b/none.fits").write_bytes(b"nothing")
    return tmp_path


@pytest.mark.parametrize("to", ["fits", "xisf", "asdf"])
def test_a_mixed_folder_keeps_everything(spark, folder, to):
    files = open_files(spark, str(folder / "in"))
    assert [p.rsplit("/", 1)[-1] for p in files.skipped] == ["none.fits"]
    formats = {(r["path"].rsplit("/in/", 1)[-1], r["image"]): r["sample_format"] for r in files.images.collect()}
    assert formats == {("a/x.fits", 0): "UInt16", ("a/x.fits", 1): "Float32", ("b/x.fits", 0): "UInt8", ("b/y.fits", 0): "UInt32", ("b/z.asdf", 0): "UInt16"}
    out = folder / "out"
    made = {r["path"].rsplit("/out/", 1)[-1] for r in convert_to(spark, str(folder / "in"), str(out), Options(to)).collect()}
    assert made == {f"a/x.{to}", f"b/x.{to}", f"b/y.{to}", f"b/z.{to}"}
    again = open_files(spark, str(out))
    strip = lambda planes: sorted((k[0].rsplit(".", 1)[0], *k[1:], v) for k, v in planes.items())
    assert strip(read_planes(again)) == strip(read_planes(files))
    if to != "asdf":
        words = {(r["name"], r["value"]) for r in again.keywords.filter("name in ('OBJECT', 'GAIN')").collect()}
        assert words == {("OBJECT", "'M 31'"), ("GAIN", "1.5")}
    assert {r["sample_format"] for r in again.images.collect()} == set(formats.values())


def test_integers_keep_their_range_in_pictures(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.encode_all([image("UInt16", (1, 4, 5), 1)]))
    row = convert_files(open_files(spark, str(tmp_path)), Options("png")).first()
    assert struct.unpack(">IIB", row["content"][16:25]) == (5, 4, 16)


def test_smaller_and_debayered(spark, tmp_path):
    mosaic = image("UInt16", (1, 4, 6), 3, keywords=[("BAYERPAT", "'RGGB'", "")])
    (tmp_path / "a.fits").write_bytes(fits.encode_all([mosaic]))
    files = open_files(spark, str(tmp_path))
    small = convert_files(files, Options("fits", bin=2)).first()["content"]
    (tmp_path / "small.fits").write_bytes(small)
    got = np.array([v for _, v in sorted((r["y"], r["values"]) for r in open_files(spark, str(tmp_path / "small.fits")).bands.collect())])
    want = np.floor(mosaic["samples"][0].reshape(2, 2, 3, 2).mean(axis=(1, 3)) + 0.5)
    np.testing.assert_array_equal(got, want)
    (tmp_path / "rgb.fits").write_bytes(convert_files(files, Options("fits", debayer=True)).first()["content"])
    planes = {(r["channel"], r["y"]): r["values"] for r in open_files(spark, str(tmp_path / "rgb.fits")).bands.collect()}
    s = mosaic["samples"][0].astype(int)
    assert len(planes) == 12
    assert planes[0, 0][0] == s[0, 0] and planes[2, 1][1] == s[1, 1] and planes[1, 0][1] == s[0, 1]
    assert planes[0, 0][1] == (2 * (s[0, 0] + s[0, 2]) + 2) // 4
    assert planes[0, 1][1] == (2 * (s[0, 0] + s[0, 2] + s[2, 0] + s[2, 2]) + 4) // 8


def test_options_that_cannot_be(spark):
    for bad in (Options("gif"), Options("fits", bin=0), Options("xisf", codec="rar"), Options("tif", sample_format="Int8")):
        with pytest.raises(ValueError):
            bad.check()


def test_patterns_and_first_mentions(tmp_path):
    for name in ("a1.fits", "a2.fits", "b1.fits", ".h.fits", "[x].fits"):
        (tmp_path / name).write_bytes(b"")
    names = lambda spec: [p.rsplit("/", 1)[-1] for p in listing(spec, (".fits",))]
    assert names(f"{tmp_path}/a?.fits") == ["a1.fits", "a2.fits"]
    assert names(f"{tmp_path}/*.fits") == ["[x].fits", "a1.fits", "a2.fits", "b1.fits"]
    assert names(f"{tmp_path}/b1.fits\n{tmp_path}/*1.fits") == ["b1.fits", "a1.fits"]
    assert detect(f"{tmp_path}/a1.fits") is None


YAML = """#ASDF 1.0.0
%YAML 1.1
%TAG ! tag:stsci.edu:asdf/
--- !core/asdf-1.1.0
a: &x {b: [1, 0x1F, 017, 1:30, 1.5, 1e3, .inf, yes, ~], "q: r": 'it''s'}
b: *x
c: |
  two
   lines
d: >-
  fold
  ed
e:
- 1
- - 2
  - 3
- k: v
  l: !core/ndarray-1.0.0
    shape: [2, 3]
f: plain text
  goes on
...
"""


def test_yaml_trees():
    tree = asdf.as_json(asdf.parse(YAML))
    first = {"m": [["b", [1, 31, 15, 90, {"f": "1.5"}, "1e3", {"f": "inf"}, True, None]], ["q: r", "it's"]]}
    assert tree == {"t": "tag:stsci.edu:asdf/core/asdf-1.1.0", "m": [["a", first], ["b", first], ["c", "two\n lines\n"], ["d", "fold ed"], ["e", [1, [2, 3], {"m": [["k", "v"], ["l", {"t": "tag:stsci.edu:asdf/core/ndarray-1.0.0", "m": [["shape", [2, 3]]]}]]}]], ["f", "plain text goes on"]]}
    with pytest.raises(ValueError):
        asdf.parse("a: *nowhere\n")


@pytest.mark.parametrize(("text", "want"), [("0b101", 5), ("-0o7", "-0o7"), ("190:20:30", 685230), ("1_000", 1000), (".5", 0.5), ("1.5e+3", 1500.0), ("-.INF", float("-inf")), ("No", False), ("nO", "nO"), ("", None), ("0x_1F", 31), ("1e5", "1e5")])
def test_yaml_scalars(text, want):
    assert asdf.scalar(text) == want and type(asdf.scalar(text)) is type(want)


def test_damaged_asdf_blocks_are_named(spark, tmp_path):
    data = bytearray(asdf.encode_all([image("UInt16", (1, 4, 4), 1), image("UInt16", (1, 4, 4), 2)], codec=None))
    at = data.index(asdf.MAGIC) + 60
    data[at] ^= 1
    (tmp_path / "a.asdf").write_bytes(data)
    assert [(r["element"], r["ok"]) for r in asdf.verify(spark, str(tmp_path)).collect()] == [("block 0", False), ("block 1", True)]


def jpeg(rows, predictor=1, precision=12):
    """A lossless JPEG of one component with a code of its category's number, twelve bits wide or fewer."""
    h, w = rows.shape
    table = bytes([0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17))
    bits = ""
    for y in range(h):
        for x in range(w):
            a, b, c = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
            p = (1 << precision - 1 if not x else a) if not y else b if not x else {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[predictor]
            d = int(rows[y, x]) - p
            s = abs(d).bit_length()
            bits += f"{s:05b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    return b"\xff\xd8" + part(0xC4, b"\0" + table) + part(0xC3, struct.pack(">BHHB", precision, h, w, 1) + b"\1\x11\0") + part(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + data + b"\xff\xd9"


def raw_file(chunks, w, h, cw, ch, bits, compression, predictor=1, active=None, linear=None, order="<"):
    tags = {254: (4, [0]), 256: (4, [w]), 257: (4, [h]), 258: (3, [bits]), 259: (3, [compression]), 262: (3, [32803]), 277: (3, [1]), 317: (3, [predictor]), 322: (4, [cw]), 323: (4, [ch]), 324: (4, [0] * len(chunks)), 325: (4, [len(c) for c in chunks]), 33421: (3, [2, 2]), 33422: (1, [0, 1, 1, 2]), 50706: (1, [1, 4, 0, 0])}
    if active:
        tags[50829] = (4, active)
    if linear:
        tags[50712] = (3, linear)
    code = {1: "B", 3: "H", 4: "I"}
    at = 8 + 2 + 12 * len(tags) + 4
    body, tail = struct.pack(order + "H", len(tags)), b""
    room = sum(len(v) * struct.calcsize(code[k]) for k, v in tags.values() if len(v) * struct.calcsize(code[k]) > 4)
    starts = np.cumsum([at + room] + [len(c) for c in chunks])[:-1].tolist()
    for tag in sorted(tags):
        kind, values = tags[tag]
        packed = struct.pack(f"{order}{len(values)}{code[kind]}", *(starts if tag == 324 else values))
        body += struct.pack(order + "HHI", tag, kind, len(values))
        if len(packed) > 4:
            body += struct.pack(order + "I", at + len(tail))
            tail += packed
        else:
            body += packed.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + bytes(4) + tail + b"".join(chunks)


def tiles_of(whole, cw, ch):
    h, w = whole.shape
    padded = np.pad(whole, ((0, -h % ch), (0, -w % cw)))
    return [padded[y : y + ch, x : x + cw] for y in range(0, padded.shape[0], ch) for x in range(0, padded.shape[1], cw)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("bits", "compression", "predictor"), [(16, 1, 1), (12, 1, 1), (14, 1, 1), (8, 1, 1), (16, 8, 1), (16, 8, 2), (16, 8, 34892), (12, 7, 1), (12, 7, 2), (12, 7, 4), (12, 7, 5), (12, 7, 6), (12, 7, 7), (24, 1, 1)])
def test_raw_chunks(tmp_path, order, bits, compression, predictor):
    whole = np.random.default_rng(bits).integers(0, 1 << min(bits, 20), (10, 14))

    def packed(t):
        if compression == 7:
            return jpeg(t, predictor)
        if predictor != 1:
            step = {2: 1, 34892: 2}[predictor]
            t = t.copy()
            t[:, step:] = (t[:, step:] - tile[:, :-step]) % (1 << bits)
        if bits in (8, 16):
            raw = t.astype(f"{order}u{bits // 8}").tobytes()
        elif bits == 24:
            raw = b"".join(int(v).to_bytes(3, "little" if order == "<" else "big") for v in t.reshape(-1))
        else:
            raw = b"".join(int((b := "".join(f"{v:0{bits}b}" for v in row)) + "0" * (-len(b) % 8), 2).to_bytes(-(-len(b) // 8), "big") for row in t)
        return zlib.compress(raw) if compression == 8 else raw

    chunks = []
    for tile in tiles_of(whole, 8, 4):
        chunks.append(packed(tile))
    path = tmp_path / "a.dng"
    path.write_bytes(raw_file(chunks, 14, 10, 8, 4, bits, compression, 1 if compression == 7 else predictor, [1, 2, 9, 13], order=order))
    assert detect(str(path)) == "dng"
    facts = dng.image(str(path))
    np.testing.assert_array_equal(dng.samples(str(path), facts)[0], whole[1:9, 2:13])
    assert facts["cfa"] == "GBRG" and facts["format"] == ("UInt32" if bits == 24 else "UInt16")


def test_raw_files_in_the_plan(spark, tmp_path):
    whole = np.arange(24).reshape(4, 6) % 4
    (tmp_path / "a.dng").write_bytes(raw_file([t.astype("<u2").tobytes() for t in tiles_of(whole, 6, 4)], 6, 4, 6, 4, 16, 1, linear=[10, 20, 30]))
    files = open_files(spark, str(tmp_path))
    assert sorted(r["values"] for r in files.bands.collect()) == sorted(np.array([10, 20, 30, 30])[whole].astype(float).tolist())
    assert [r["ok"] for r in dng.verify(spark, str(tmp_path)).collect()] == [None]
    row = files.images.first()
    assert (row["cfa"], row["sample_format"]) == ("RGGB", "UInt16")


SOLVED = {"CTYPE1": "'RA---TAN-SIP'", "CTYPE2": "'DEC--TAN-SIP'", "CRVAL1": "10.5", "CRVAL2": "-20.25", "CRPIX1": "200.5", "CRPIX2": "151", "CD1_1": "-2.5E-4", "CD1_2": "1e-5", "CD2_1": "1e-5", "CD2_2": "2.5D-4", "A_ORDER": "2", "B_ORDER": "2", "A_2_0": "1e-6", "A_1_1": "-2e-6", "B_0_2": "3e-6", "B_2_0": "5e-7"}


def test_solutions_there_and_back():
    rows, note = wcs.solution(SOLVED, 400, 300)
    assert "Gnomonic" in note and "control points" in note
    values = {i: np.frombuffer(d, "<f8") if d is not None else t for i, _, t, d, _, _ in rows}
    back = dict(wcs.keywords(values, 400, 300, order=3))
    for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "A_2_0", "A_1_1", "B_0_2", "B_2_0"):
        assert float(back[k]) == pytest.approx(float(SOLVED[k].replace("D", "e")), rel=1e-6, abs=1e-12)
    assert abs(float(back["A_3_0"])) < 1e-12 and back["CTYPE1"] == "'RA---TAN-SIP'"
    # The inverse terms undo the distortion.
    x, y = 120.0, -90.0
    f = lambda p, x, y: sum(float(v) * x ** int(k.split("_")[1]) * y ** int(k.split("_")[2]) for k, v in back.items() if k.startswith(p + "_") and k.count("_") == 2)
    u, v = x + f("A", x, y), y + f("B", x, y)
    assert (u + f("AP", u, v), v + f("BP", u, v)) == pytest.approx((x, y), abs=1e-3)


@pytest.mark.parametrize(("change", "said"), [({"CTYPE1": "'GLON-TAN'"}, "ascension"), ({"CTYPE1": "'RA---TPV'", "CTYPE2": "'DEC--TPV'"}, "TPV"), ({"CUNIT1": "'rad'"}, "degrees"), ({"CD1_1": "0", "CD1_2": "0"}, "singular")])
def test_solutions_that_cannot_be(change, said):
    rows, note = wcs.solution(SOLVED | change, 400, 300)
    assert not rows and said in note


def test_three_forms_of_the_linear_part():
    pc = wcs.linear_part({"CDELT1": -2.0, "CDELT2": 3.0, "PC1_2": 0.5})
    np.testing.assert_allclose(pc, [[-2, -1], [0, 3]])
    turned = wcs.linear_part({"CDELT1": -2.0, "CDELT2": 3.0, "CROTA2": 90.0})
    np.testing.assert_allclose(turned, [[0, -3], [-2, 0]], atol=1e-12)


def test_solutions_of_many_images(spark):
    rows = [(p, i, k, v) for p in ("a", "b") for i in (0, 1) for k, v in SOLVED.items()]
    found = wcs.solutions(spark.createDataFrame(rows, "path string, image int, name string, value string"), spark.createDataFrame([(p, i, 400, 300) for p in ("a", "b") for i in (0, 1)], "path string, image int, width bigint, height bigint"))
    assert found.groupBy("path", "image").count().collect()[0]["count"] == 15
    words = wcs.solution_keywords(found, spark.createDataFrame([("a", 0, 400, 300)], "path string, image int, width bigint, height bigint"), order=2)
    assert {r["name"] for r in words.collect()} >= {"CRPIX2", "A_2_0", "BP_0_2"}


def test_rows_in_the_other_order(spark):
    rows = [("k", k, v) for k, v in (("CTYPE1", "'RA---TAN'"), ("CRPIX2", "10.25"), ("CD1_2", "0"), ("CD2_2", "-1.50"), ("CDELT2", "2"), ("A_0_1", "3"), ("A_0_2", "3"), ("B_0_2", "+3"), ("BP_1_1", "4"), ("CTYPE1A", "'RA'"), ("CDELT2A", "2D0"))]
    got = {r["name"]: r["value"] for r in md.flip_wcs(spark.createDataFrame(rows, "key string, name string, value string"), "key", md.F.lit(100)).collect()}
    assert got == {"CTYPE1": "'RA---TAN'", "CRPIX2": "90.75", "CD1_2": "-0", "CD2_2": "1.50", "CDELT2": "2", "A_0_1": "-3", "A_0_2": "3", "B_0_2": "-3", "BP_1_1": "4", "CTYPE1A": "'RA'", "CDELT2A": "-2D0", "CRPIX2A": "101.0"}


def test_patterns_are_resolved(spark):
    F = md.F
    rows = spark.createDataFrame([(1, "RGGB", None, None, None), (2, None, "RGGB", "1", "0"), (3, None, "RGGB", "0", "1"), (4, None, "RRRR", None, None), (5, None, "GRBG", "1", "1")], "k int, cfa string, bayer string, x string, y string")
    got = {r["k"]: r["p"] for r in rows.select("k", md.resolved_pattern(F.col("cfa"), F.col("bayer"), F.col("x"), F.col("y")).alias("p")).collect()}
    assert got == {1: "RGGB", 2: "GRBG", 3: "GBRG", 4: None, 5: "GBRG"}


def test_big_tiff_has_wide_offsets():
    data = tiff.encode_pages([image("UInt8", (1, 3, 3)), image("UInt16", (5, 2, 2))], big=True)
    assert data[:8] == b"II+\0\x08\0\0\0"
    at, pages = struct.unpack("<Q", data[8:16])[0], 0
    while at:
        count = struct.unpack("<Q", data[at : at + 8])[0]
        at = struct.unpack("<Q", data[at + 8 + 20 * count : at + 16 + 20 * count])[0]
        pages += 1
    assert pages == 6


def test_wcs_names(spark):
    names = {"CRPIX1": True, "CD1_2A": True, "A_2_0": True, "AP_1_1": True, "WAT1_001": True, "PV1_1": True, "GAIN": False, "OBJECT": False, "APTDIA": False, "RADESYS": True}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["w"] for r in rows.select("n", wcs.is_wcs_keyword(md.F.col("n")).alias("w")).collect()} == names
    assert cards.is_number("1.5D3") and cards.is_number("(1, -2.5)") and not cards.is_number("1 2")
