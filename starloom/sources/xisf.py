"""XISF units as DataFrames: images, properties, tables, blocks and bands; writers, a rewriter and a verifier.

A unit is one file, or a header file (.xish) whose blocks lie in block files
(.xisb) with an index. Files outside a header's own folder are read only on
request, and never one that a URL names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import secrets
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from starloom.functions.codecs import LEVELS, compress, decompress, pack_subblocks, unpack_subblocks
from starloom.sources.files import listing, place, read_range
from starloom.sources.fits import band_batch

SIGNATURE = b"XISF0100"
ALIGN = 4096
KINDS = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "UInt64": "<u8", "Float32": "<f4", "Float64": "<f8"}
HASHES = {"sha-1": "sha1", "sha1": "sha1", "sha-256": "sha256", "sha256": "sha256", "sha-512": "sha512", "sha512": "sha512", "sha3-256": "sha3_256", "sha3-512": "sha3_512"}


#: Where a header's external blocks may lie: its own folder, anywhere, or nowhere.
POLICIES = ("HeaderDirectory", "Anywhere", "None")
NAMESPACE = "http://www.pixinsight.com/xisf"
HEAD = 1 << 16

# Element size and numpy kind of vector and matrix types, by prefix.
ELEMENTS = {"I8": "<i1", "UI8": "<u1", "Byte": "<u1", "I16": "<i2", "UI16": "<u2", "I32": "<i4", "UI32": "<u4", "I": "<i4", "UI": "<u4", "I64": "<i8", "UI64": "<u8", "F32": "<f4", "F": "<f4", "F64": "<f8", "": "<f8", "C32": "<c8", "C64": "<c16", "C": "<c16"}


def element_type(name: str) -> tuple[str, bool] | None:
    """(numpy kind, whether a matrix) of a vector or matrix property type; None for others."""
    if name == "ByteArray":
        return "<u1", False
    m = re.fullmatch(r"([A-Z]*[a-z]*\d*)(Vector|Matrix)", name)
    return (ELEMENTS[m[1]], m[2] == "Matrix") if m and m[1] in ELEMENTS else None


def item_size(type_name: str) -> int:
    """Bytes of an item of a type without a name of ours, told by the first number in it; 1 if that says nothing."""
    m = re.search(r"\d+", type_name)
    return int(m[0]) // 8 if m and m[0] in ("16", "32", "64") else 1


def header_text(uri: str) -> bytes:
    """The XML of a monolithic file or of a header file."""
    start = read_range(uri, 0, 16)
    if start[:8] == SIGNATURE:
        return read_range(uri, 16, struct.unpack("<I", start[8:12])[0]).rstrip(b"\0")
    if re.search(rb"<(?:[A-Za-z_][\w.-]*:)?xisf[\s>/]", read_range(uri, 0, HEAD)):
        return read_range(uri).rstrip(b"\0")
    raise ValueError("not an XISF unit")


def header(uri: str) -> ET.Element:
    """The header's tree, its Reference elements replaced by what their ref names (the first of that uid)."""
    root = ET.fromstring(header_text(uri))
    known: dict[str, ET.Element] = {}
    for e in root.iter():
        known.setdefault(e.get("uid", ""), e)
    for parent in list(root.iter()):
        for i, e in enumerate(list(parent)):
            found = known.get(e.get("ref", "")) if _tag(e) == "Reference" else None
            if found is not None and parent not in list(found.iter()):  # never a circle
                parent[i] = found
    return root


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def block_index(uri: str) -> list[tuple[int, int, int, int]]:
    """(id, position, size, raw size) of a block file's index, free elements (position 0) among them.

    Nodes that form a circle, overlap or leave the file are refused.
    """
    system, path = place(uri)
    end = system.get_file_info(path).size
    if read_range(uri, 0, 8) != b"XISB0100":
        raise ValueError("not a block file")
    at, seen, out = 16, [], []
    while at:
        if at + 16 > end:
            raise ValueError("the block index leaves the file")
        count, _, after = struct.unpack("<IIQ", read_range(uri, at, 16))
        stop = at + 16 + 40 * count
        if stop > end:
            raise ValueError("the block index leaves the file")
        if any(at < b and a < stop for a, b in seen):
            raise ValueError("index nodes overlap or form a circle")
        seen.append((at, stop))
        data = read_range(uri, at + 16, 40 * count)
        out += [struct.unpack("<QQQQ", data[i : i + 32]) for i in range(0, len(data), 40)]
        at = after
    return out


def external(uri: str, location: str, policy: str = "HeaderDirectory") -> tuple[str, int | None]:
    """(file, block id or None) of a path or url location of the header at ``uri``; refusals raise PermissionError."""
    m = re.fullmatch(r"(path|url)\((.*)\)(?::(0x[0-9A-Fa-f]+|\d+))?", location, re.S)
    if not m:
        raise ValueError(f"block location not read: {location}")
    name, number = m[2], int(m[3], 0) if m[3] else None
    if policy == "None" or not uri.lower().endswith(".xish"):
        raise PermissionError("external blocks are not read here")
    if m[1] == "url":
        raise PermissionError("no block is fetched from a URL")
    folder = uri.rsplit("/", 1)[0]
    inside = name.startswith("@header_dir/")
    rest = name.removeprefix("@header_dir/")
    if policy == "HeaderDirectory" and (not inside or rest.startswith("/") or ".." in rest.split("/")):
        raise PermissionError("the block lies outside the header's folder")
    return (f"{folder}/{rest}" if inside else rest), number


def stored(uri: str, e: ET.Element, policy: str = "HeaderDirectory") -> bytes:
    """The bytes of an element's block as stored."""
    kind, *rest = e.get("location", "").split(":")
    if kind == "attachment":
        position, size = map(int, rest)
        return _exactly(uri, position, size)
    if kind in ("inline", "embedded"):
        holder = e if kind == "inline" else next(x for x in e if _tag(x) == "Data")
        how = rest[0] if rest else holder.get("encoding", "base64")
        text = "".join((holder.text or "").split())
        return bytes.fromhex(text) if how in ("hex", "base16") else base64.b64decode(text)
    file, number = external(uri, e.get("location", ""), policy)
    if number is None:
        return read_range(file)
    for block, position, size, _ in block_index(file):
        if block == number and position:
            return _exactly(file, position, size)
    raise ValueError(f"the index has no block {number:#x}")


def _exactly(uri: str, position: int, size: int) -> bytes:
    system, path = place(uri)
    if position + size > system.get_file_info(path).size:
        raise ValueError("the block goes beyond the file")
    return read_range(uri, position, size)


def checked(e: ET.Element, data: bytes) -> bool | None:
    """Whether the block's checksum holds; None if it has none that is known."""
    name, _, value = e.get("checksum", "").partition(":")
    if name not in HASHES:
        return None
    return hashlib.new(HASHES[name], data, usedforsecurity=False).hexdigest() == value.lower()


def _holder(e: ET.Element) -> ET.Element:
    """An embedded block's attributes stand at its Data element."""
    return next((x for x in e if _tag(x) == "Data"), e) if e.get("location") == "embedded" else e


def unpacked(e: ET.Element, data: bytes) -> bytes:
    e = _holder(e)
    if not e.get("compression"):
        return data
    codec, size, *item = e.get("compression").split(":")
    width = int(item[0]) if codec.endswith("+sh") else 1
    codec = codec.removesuffix("+sh")
    if e.get("subblocks"):
        return unpack_subblocks(data, codec, e.get("subblocks"), int(size), width)
    return decompress(data, codec, int(size), width)


def block(uri: str, e: ET.Element, policy: str = "HeaderDirectory") -> bytes:
    """A block's content; a checksum that differs wins over whatever decoding would say."""
    data = stored(uri, e, policy)
    if checked(_holder(e), data) is False:
        raise ValueError("checksum mismatch")
    return unpacked(e, data)


def _images(root: ET.Element) -> list[ET.Element]:
    return [e for e in root.iter() if _tag(e) == "Image"]


def _over_files(spark: SparkSession, path: str, read, schema: str, endings: tuple[str, ...] = (".xisf", ".xish")) -> DataFrame:
    """A task a file: ``read(uri)`` yields the rows."""
    paths = listing(path, endings)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for row in read(uri):
                    if isinstance(row, pa.RecordBatch):
                        yield row
                    else:
                        rows.append(dict(zip(names, row, strict=True)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return listed.mapInArrow(run, schema)


def images(spark: SparkSession, path: str) -> DataFrame:
    """One row an image: geometry, format, bounds (null where none are given or they are empty), colour filter, resolution, stored stretch, profile."""

    def read(uri: str) -> Iterator[tuple]:
        for i, e in enumerate(_images(header(uri))):
            w, h, *c = map(int, e.get("geometry").split(":"))
            lo, _, hi = e.get("bounds", "").partition(":")
            bounds = (float(lo), float(hi)) if hi and float(hi) > float(lo) else (None, None)
            part = {_tag(x): x for x in reversed(list(e))}
            cfa, res, shown, icc = (part.get(k) for k in ("ColorFilterArray", "Resolution", "DisplayFunction", "ICCProfile"))
            stretch = [[float(v) for v in shown.get(k, d).split(":")] for k, d in zip("mshlr", ("0.5:0.5:0.5:0.5", "0:0:0:0", "1:1:1:1", "0:0:0:0", "1:1:1:1"), strict=True)] if shown is not None else None
            yield (uri, i, e.get("id", ""), w, h, c[0] if c else 1, e.get("sampleFormat"), *bounds, e.get("colorSpace", "Gray"), cfa.get("pattern") if cfa is not None else None, int(cfa.get("width")) if cfa is not None else None, int(cfa.get("height")) if cfa is not None else None,
                   float(res.get("horizontal")) if res is not None else None, float(res.get("vertical")) if res is not None else None, res.get("unit", "inch") if res is not None else None, stretch, block(uri, icc) if icc is not None else None)

    return _over_files(spark, path, read, "path string, image int, id string, width bigint, height bigint, channels int, sample_format string, lower double, upper double, color_space string, cfa string, cfa_width int, cfa_height int, horizontal double, vertical double, unit string, stretch array<array<double>>, icc binary")


def properties(spark: SparkSession, path: str) -> DataFrame:
    """One row a property of an image, or of the file (image -1): text of its value, or a block's bytes with their shape; why it could not be read."""

    def read(uri: str) -> Iterator[tuple]:
        root = header(uri)
        owners = [*enumerate(_images(root)), *((-1, e) for e in root if _tag(e) == "Metadata")]
        for i, owner in owners:
            for pos, e in enumerate(x for x in owner if _tag(x) == "Property"):
                yield (uri, i, pos, e.get("id"), e.get("type"), *_value(uri, e), e.get("comment", ""), e.get("format", ""))

    return _over_files(spark, path, read, "path string, image int, pos int, id string, type string, text string, data binary, rows bigint, columns bigint, block boolean, problem string, comment string, format string")


def _value(uri: str, e: ET.Element) -> tuple:
    """(text, data, rows, columns, block, problem)."""
    if e.get("value") is not None or not e.get("location"):
        return e.get("value", e.text), None, None, None, False, None
    try:
        data = block(uri, e)
        if e.get("type") == "String":
            return data.rstrip(b"\0").decode("utf-8"), None, None, None, True, None
        kind = element_type(e.get("type", ""))
        rows, columns = int(e.get("rows", e.get("length", len(data)))), int(e.get("columns", 0))
        if kind:
            if np.dtype(kind[0]).itemsize * rows * (columns or 1) != len(data):
                raise ValueError("the block has another size than its shape")
            if e.get("byteOrder") == "big":
                data = np.frombuffer(data, np.dtype(kind[0]).newbyteorder(">")).astype(kind[0]).tobytes()
        return None, data, rows, columns, True, None
    except Exception as error:  # damage costs the one property
        return None, None, None, None, True, str(error)


def tables(spark: SparkSession, path: str) -> DataFrame:
    """One row a cell of property tables: (path, image, id, row, field, type, text); a table that is not understood is one row with its problem."""

    def read(uri: str) -> Iterator[tuple]:
        root = header(uri)
        for i, image in enumerate(_images(root)):
            for t in (x for x in image if _tag(x) == "Table"):
                try:
                    yield from ((uri, i, t.get("id"), *c, None) for c in _cells(t))
                except ValueError as error:
                    yield uri, i, t.get("id"), None, None, None, None, str(error)

    return _over_files(spark, path, read, "path string, image int, id string, row int, field string, type string, text string, problem string")


def _cells(table: ET.Element) -> list[tuple]:
    shape = next((x for x in table if _tag(x) == "Structure"), None)
    fields = [(f.get("id"), f.get("type")) for f in shape if _tag(f) == "Field"] if shape is not None else []
    rows = [x for x in table if _tag(x) == "Row"]
    if not fields:
        raise ValueError("the table has no fields")
    if table.get("rows") not in (None, str(len(rows))) or table.get("columns") not in (None, str(len(fields))):
        raise ValueError("the table has another size than it says")
    out = []
    for y, row in enumerate(rows):
        cells = [c for c in row if _tag(c) == "Cell"]
        if len(cells) != len(fields):
            raise ValueError(f"row {y} has {len(cells)} cells")
        for (name, kind), c in zip(fields, cells, strict=True):
            if c.get("location"):
                raise ValueError("cells in blocks are not read")
            out.append((y, name, kind, c.get("value", c.text or "")))
    return out


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a data block: where it lies and how it is stored."""

    def read(uri: str) -> Iterator[tuple]:
        for e in header(uri).iter():
            if e.get("location"):
                kind, *rest = e.get("location").split(":")
                held = _holder(e)
                codec, size, *item = (held.get("compression") or "::").split(":")
                at = (int(rest[0]), int(rest[1])) if kind == "attachment" else (None, None)
                yield uri, e.get("id") or _tag(e), kind.partition("(")[0], *at, codec.removesuffix("+sh") or None, codec.endswith("+sh"), int(item[0]) if item and item[0] else None, int(size) if size else None, held.get("subblocks"), held.get("checksum")

    return _over_files(spark, path, read, "path string, element string, kind string, position bigint, size bigint, codec string, shuffled boolean, item_size int, raw_size bigint, subblocks string, checksum string")


def keywords(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[tuple]:
        for i, image in enumerate(_images(header(uri))):
            for pos, e in enumerate(x for x in image if _tag(x) == "FITSKeyword"):
                yield uri, i, pos, e.get("name"), e.get("value", ""), e.get("comment", "")

    return _over_files(spark, path, read, "path string, image int, pos int, name string, value string, comment string")


def bands(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[tuple]:
        for i, e in enumerate(_images(header(uri))):
            w, h, *c = map(int, e.get("geometry").split(":"))
            kind = np.dtype(KINDS[e.get("sampleFormat")])
            if e.get("byteOrder") == "big":
                kind = kind.newbyteorder(">")
            channels = c[0] if c else 1
            raw = block(uri, e)
            if len(raw) != w * h * channels * kind.itemsize:
                raise ValueError("the block has another size than the image")
            data = np.frombuffer(raw, kind)
            planes = data.reshape(h, w, channels).transpose(2, 0, 1) if e.get("pixelStorage", "").lower() == "normal" else data.reshape(channels, h, w)
            step = max(1, (1 << 20) // w)
            for ch in range(channels):
                for y in range(0, h, step):
                    yield band_batch(uri, i, ch, y, planes[ch, y : y + step])

    return _over_files(spark, path, read, "path string, image int, channel int, y bigint, values array<double>")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(path, element, ok, problem): each block's checksum and decoded size; ok is null where nothing could be checked."""

    def read(uri: str) -> Iterator[tuple]:
        try:
            root = header(uri)
        except Exception as error:  # damage is what this reports
            yield uri, "header", False, str(error)
            return
        for e in root.iter():
            if not e.get("location"):
                continue
            name = e.get("id") or _tag(e)
            try:
                data = stored(uri, e)
                ok = checked(_holder(e), data)
                if ok is False:
                    yield uri, name, False, "checksum mismatch"
                    continue
                unpacked(e, data)
                yield uri, name, ok, None
            except Exception as error:
                yield uri, name, False, str(error)

    return _over_files(spark, path, read, "path string, element string, ok boolean, problem string")


#: Blocks up to this size stand in the header.
INLINE = 3072


def _pack(raw: bytes, item: int, codec: str | None, level: int | None, subblocks: int | None, checksum: str | None) -> tuple[bytes, dict[str, str]]:
    """(stored, attributes) of a block; what compression does not make smaller is stored plain."""
    packed, said = raw, {}
    if codec and raw:
        listed = None
        if subblocks and len(raw) > subblocks:
            made, listed = pack_subblocks(raw, codec, subblocks, level, item)
        else:
            made = compress(raw, codec, level, item)
        if len(made) < len(raw):
            packed = made
            said["compression"] = f"{codec}+sh:{len(raw)}:{item}" if item > 1 else f"{codec}:{len(raw)}"
            said |= {"subblocks": listed} if listed else {}
    if checksum:
        said["checksum"] = f"{checksum}:{hashlib.new(HASHES[checksum], packed, usedforsecurity=False).hexdigest()}"
    return packed, said


def _written(root: ET.Element) -> bytes:
    ET.register_namespace("", NAMESPACE)
    return b'<?xml version="1.0" encoding="UTF-8"?>' + ET.tostring(root, "utf-8")


def _laid_out(root: ET.Element, attached: list[tuple[ET.Element, bytes]]) -> bytes:
    """A monolithic file: the header's size depends on the positions that it states, so they are stated until they fit."""
    first = ALIGN
    while True:
        at = first
        for e, data in attached:
            e.set("location", f"attachment:{at}:{len(data)}")
            at += -(-len(data) // ALIGN) * ALIGN
        text = _written(root)
        if 16 + len(text) <= first:
            break
        first = -(-(16 + len(text)) // ALIGN) * ALIGN
    out = bytearray((SIGNATURE + struct.pack("<I", len(text)) + bytes(4) + text).ljust(first, b"\0"))
    for _, data in attached:
        out += bytes(-len(out) % ALIGN) + data
    return bytes(out)


def _divided(root: ET.Element, attached: list[tuple[ET.Element, bytes]], name: str) -> tuple[bytes, bytes]:
    """(header file, block file) of a distributed unit; blocks get random ids, the index is one node."""
    index, body = [], bytearray()
    first = -(-(32 + 40 * len(attached)) // ALIGN) * ALIGN
    for e, data in attached:
        number = 0
        while not number or any(number == x[0] for x in index):
            number = secrets.randbits(64)
        body += bytes(-len(body) % ALIGN)
        raw = e.get("compression", "").split(":")
        index.append((number, first + len(body), len(data), int(raw[1]) if len(raw) > 1 else 0))
        body += data
        e.set("location", f"path(@header_dir/{name}.xisb):{number:#x}")
    node = struct.pack("<IIQ", len(index), 0, 0) + b"".join(struct.pack("<QQQQQ", *x, 0) for x in index)
    return _written(root), (b"XISB0100" + bytes(8) + node).ljust(first, b"\0") + bytes(body)


def _tree(images_: list[dict], codec: str | None, level: int | None, subblocks: int | None, checksum: str | None) -> tuple[ET.Element, list[tuple[ET.Element, bytes]]]:
    q = lambda tag: f"{{{NAMESPACE}}}{tag}"
    root, attached, taken = ET.Element(q("xisf"), {"version": "1.0"}), [], set()
    for i, image in enumerate(images_):
        kind = np.dtype(KINDS[image["sample_format"]])
        c, h, w = image["samples"].shape
        name = stem = re.sub(r"^_+|_+$", "", re.sub(r"[^A-Za-z0-9_]+", "_", image.get("name") or "")) or f"image{i or ''}"
        name = stem = f"_{stem}" if stem[0].isdigit() else stem
        k = 1
        while name in taken:
            k, name = k + 1, f"{stem}_{k + 1}"
        taken.add(name)
        said = {"id": name, "geometry": f"{w}:{h}:{c}", "sampleFormat": image["sample_format"], "colorSpace": image.get("color_space") or ("RGB" if c >= 3 else "Gray")}
        if image["sample_format"].startswith("Float"):
            said["bounds"] = ":".join(f"{x:.17g}" for x in image.get("bounds") or (0, 1))
        packed, more = _pack(image["samples"].astype(kind).tobytes(), kind.itemsize, codec, level, subblocks, checksum)
        e = ET.SubElement(root, q("Image"), said | more)
        attached.append((e, packed))
        for n, v, t in image.get("keywords", []):
            ET.SubElement(e, q("FITSKeyword"), {"name": n, "value": v, "comment": t})
        for p in image.get("properties", []):
            x = ET.SubElement(e, q("Property"), {"id": p["id"], "type": p["type"]} | ({"comment": p["comment"]} if p.get("comment") else {}) | ({"format": p["format"]} if p.get("format") else {}))
            if not p.get("block"):
                x.set("value", p["value"] if isinstance(p["value"], str) else p["value"].decode())
                continue
            of = element_type(p["type"])
            x.attrib |= {"rows": str(p["rows"]), "columns": str(p["columns"])} if of and of[1] else {"length": str(p["rows"])} if p["type"] != "String" else {}
            data, more = _pack(p["value"], np.dtype(of[0]).itemsize if of else item_size(p["type"]), codec if len(p["value"]) > INLINE else None, level, subblocks, checksum)
            x.attrib |= more
            if len(data) <= INLINE:
                x.set("location", "inline:base64")
                x.text = base64.b64encode(data).decode()
            else:
                attached.append((x, data))
    return root, attached


def encode_all(images_: list[dict], codec: str | None = "zstd", level: int | None = None, subblocks: int | None = None, checksum: str | None = "sha-1") -> bytes:
    """A monolithic file of images (samples, sample_format, name, bounds, keywords, properties)."""
    return _laid_out(*_tree(images_, codec, level, subblocks, checksum))


def encode_unit(images_: list[dict], name: str, codec: str | None = "zstd", level: int | None = None, subblocks: int | None = None, checksum: str | None = "sha-1") -> tuple[bytes, bytes]:
    """(``name.xish``, ``name.xisb``) of a distributed unit."""
    return _divided(*_tree(images_, codec, level, subblocks, checksum), name)


def encode(samples: np.ndarray, sample_format: str, name: str = "image", keywords: list[tuple[str, str, str]] = (), properties: list[tuple[str, str, str]] = (), codec: str | None = "zstd", checksum: str = "sha-1") -> bytes:
    """A monolithic file of one image (channels, height, width)."""
    listed = [{"id": i, "type": t, "value": v} for i, t, v in properties]
    return encode_all([{"samples": samples, "sample_format": sample_format, "name": name, "keywords": keywords, "properties": listed}], codec, checksum=checksum)


def stored_as_requested(e: ET.Element, codec: str | None, shuffled: bool | None, subblocks: int | None, checksum: str | None) -> bool:
    """Whether a block may be taken over as it is; ``codec`` and ``checksum`` None ask for none, "keep" for any."""
    e = _holder(e)
    packed, *_ = e.get("compression", "").split(":")
    have = packed.removesuffix("+sh") or None
    if codec != "keep" and have != codec or checksum != "keep" and (e.get("checksum", "").partition(":")[0] or None) != checksum:
        return False
    if have and shuffled is not None and packed.endswith("+sh") != shuffled:
        return False
    return not have or subblocks is None or bool(subblocks) == bool(e.get("subblocks"))


def rewritten(uri: str, codec: str | None = "zstd", level: int | None = None, shuffle: bool = True, subblocks: int | None = None, checksum: str | None = "sha-1", unit: str | None = None) -> tuple[dict[str, bytes], dict[str, int]]:
    """(files, counters) of a unit stored anew: other codec, level, shuffling, subblocks or checksums, or divided into ``unit.xish`` and ``.xisb``.

    Only the blocks' attributes and places change in the header. A block that
    is stored as requested, or that compression does not make smaller, is
    taken over; a damaged one stops the rewrite.
    """
    if codec is not None and codec not in LEVELS:
        raise ValueError(f"unknown codec: {codec}")
    root = ET.fromstring(header_text(uri))
    attached, done = [], {"blocks": 0, "compressed": 0, "decompressed": 0, "kept": 0, "checksums": 0}
    for e in root.iter():
        kind = e.get("location", "").partition(":")[0]
        if not kind or kind in ("inline", "embedded"):
            continue
        done["blocks"] += 1
        data = stored(uri, e)
        if checked(e, data) is False:
            raise ValueError(f"checksum mismatch in {e.get('id') or _tag(e)}")
        of = element_type(e.get("type", ""))
        item = np.dtype(KINDS[e.get("sampleFormat")]).itemsize if e.get("sampleFormat") else np.dtype(of[0]).itemsize if of else item_size(e.get("type", ""))
        if level is None and stored_as_requested(e, codec, shuffle and item > 1 if codec else None, subblocks, checksum):
            done["kept"] += 1
            attached.append((e, data))
            continue
        own = e.get("checksum", "").partition(":")[0]
        raw = unpacked(e, data)
        packed, said = _pack(raw, item if shuffle else 1, codec, level, subblocks, (own if own in HASHES else None) if checksum == "keep" else checksum)
        done["decompressed"] += bool(e.get("compression")) and "compression" not in said
        done["compressed"] += "compression" in said
        done["checksums"] += "checksum" in said
        for name in ("compression", "subblocks", "checksum"):
            e.attrib.pop(name, None)
        e.attrib |= said
        attached.append((e, packed))
    if unit:
        head, body = _divided(root, attached, unit)
        return {f"{unit}.xish": head, f"{unit}.xisb": body}, done
    return {uri.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".xisf": _laid_out(root, attached)}, done


def rewrite(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(source, path, content, blocks, compressed, decompressed, kept, checksums) of every unit below ``path`` stored anew; each result is read back and compared.

    A task a unit; ``save`` puts the contents in place, block files before headers.
    """

    def read(uri: str) -> Iterator[tuple]:
        files, done = rewritten(uri, **options)
        if not options.get("unit"):
            compare(uri, next(iter(files.values())))
        for name, content in sorted(files.items()):  # .xisb before .xish
            yield uri, name, content, *done.values()

    return _over_files(spark, path, read, "source string, path string, content binary, blocks bigint, compressed bigint, decompressed bigint, kept bigint, checksums bigint")


def compare(uri: str, content: bytes) -> None:
    """Raises unless the blocks of a finished file hold, one by one, what those of its source do."""
    root = ET.fromstring(content[16 : 16 + struct.unpack("<I", content[8:12])[0]].rstrip(b"\0"))
    old = [e for e in ET.fromstring(header_text(uri)).iter() if e.get("location")]
    new = [e for e in root.iter() if e.get("location")]
    if len(old) != len(new):
        raise ValueError("another number of blocks was written")
    for a, b in zip(old, new, strict=True):
        if b.get("location").startswith("attachment"):
            position, size = map(int, b.get("location").split(":")[1:])
            data = content[position : position + size]
            if checked(b, data) is False or unpacked(b, data) != unpacked(a, stored(uri, a)):
                raise ValueError(f"block {a.get('id') or _tag(a)} reads back otherwise")


def files(band_rows: DataFrame, sample_format: str, codec: str | None = "zstd") -> DataFrame:
    """(path, content): a file for each path of ``band_rows(path, channel, y, values)``; one task a file."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("channel", "ascending"), ("y", "ascending")])
        channels = max(table["channel"].to_pylist()) + 1
        samples = table["values"].combine_chunks().flatten().to_numpy().reshape(channels, table.num_rows // channels, -1)
        return pa.table({"path": [table["path"][0].as_py()], "content": pa.array([encode(samples, sample_format, codec=codec)], pa.binary())})

    return band_rows.select("path", "channel", "y", F.col("values")).groupBy("path").applyInArrow(run, "path string, content binary")
