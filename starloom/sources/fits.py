"""FITS as Spark data sources: image headers, keyword cards, carried properties and bands of samples; and a writer.

Headers are read once, on the driver's plan or in a task a file; bands are read
by offset, so a task touches only its rows, or in a compressed image only the
tiles that meet them. Filters on path, image, channel and y choose what is read
at all. Values are doubles after ``bzero + bscale * v``; exact formats follow
from a pass over the data.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from starloom.sources import cards as cd
from starloom.sources import tiles
from starloom.sources.files import listing, place, read_range

BLOCK = 2880
ENDINGS = (".fits", ".fit", ".fts", ".fits.fz")
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Samples of a partition, about.
PIECE = 1 << 22


def parse_card(card: str) -> tuple[str, str, str]:
    """(name, value text, comment) of a card; commentary cards have their text as comment."""
    if card.startswith("HIERARCH ") and "=" in card:
        name, _, rest = card[9:].partition("=")
        name = name.strip()
    elif card[8:10] == "= " or card.startswith("CONTINUE  "):
        name, rest = card[:8].strip(), card[10:]
    else:
        return card[:8].strip(), "", card[8:].rstrip()
    rest = rest.lstrip()
    if m := re.match(r"'((?:[^']|'')*)'", rest):
        return name, f"'{m[1].rstrip() if m[1].strip() else m[1]}'", rest[m.end() :].partition("/")[2].strip()
    value, _, comment = rest.partition("/")
    return name, value.strip(), comment.strip()


def join_cards(cards: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """CONTINUE cards joined to the text before them that ends in ``&``."""
    out: list[tuple[str, str, str]] = []
    for name, value, comment in cards:
        if name == "CONTINUE" and out and out[-1][1].endswith("&'") and value.startswith("'"):
            last = out[-1]
            out[-1] = (last[0], last[1][:-2] + value[1:], (last[2] + " " + comment).strip())
        elif name or comment:
            out.append((name, value, comment))
    return out


def units(uri: str) -> Iterator[dict]:
    """Header facts of each header-data unit: cards, kind, offset and size of its data."""
    system, path = place(uri)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        at, number = 0, 0
        while at + BLOCK <= size:
            raw, cards, end = b"", [], False
            f.seek(at)
            while not end:
                block = f.read(BLOCK)
                if len(block) < BLOCK:
                    yield {"unit": number, "skipped": "the file ends inside a header", "cards": join_cards(cards)}
                    return
                raw += block
                for i in range(0, BLOCK, 80):
                    card = block[i : i + 80].decode("ascii", "replace")
                    if card[:8] == "END     ":
                        end = True
                        break
                    cards.append(parse_card(card))
            values = {n: v for n, v, _ in reversed(cards) if v}
            integer = lambda k, d=0, values=values: int(float(values.get(k, d)))
            axes = [integer(f"NAXIS{i + 1}") for i in range(integer("NAXIS"))]
            bits = integer("BITPIX", 8)
            count = int(np.prod(axes)) if axes else 0
            text = lambda k, values=values: values.get(k, "").strip("' ")
            data = (abs(bits) // 8) * max(1, integer("GCOUNT", 1)) * (count + integer("PCOUNT"))
            kind = "image" if number == 0 or text("XTENSION") == "IMAGE" else "other"
            start = at + len(raw)
            shown, depth, table = axes, bits, None
            if text("XTENSION") == "BINTABLE":
                table = {"values": values, "heap": start + integer("THEAP", (axes[0] * axes[1]) if len(axes) == 2 else 0), "heap_size": integer("PCOUNT")}
                if text("ZIMAGE") == "T":
                    kind, depth = "tiles", integer("ZBITPIX", 8)
                    shown = [integer(f"ZNAXIS{i + 1}") for i in range(integer("ZNAXIS"))]
            while len(shown) > 2 and shown[-1] == 1:
                shown = shown[:-1]
            sizes = int(np.prod(shown)) if shown else 0
            if kind == "other":
                skipped = text("XTENSION")
            elif kind == "tiles" and text("ZCMPTYPE") not in tiles.KNOWN:
                skipped = f"compression {text('ZCMPTYPE')} is not read"
            else:
                skipped = "" if 2 <= len(shown) <= 3 and sizes and depth in KINDS else "no image"
            if not skipped and start + data > size:
                skipped = "the file ends inside the data"
            number_of = lambda k, d, values=values: float(values[k].replace("D", "E")) if k in values else d
            yield {"unit": number, "skipped": skipped, "cards": join_cards(cards), "axes": shown, "bits": depth, "offset": start, "size": data, "at": at, "bzero": number_of("BZERO", 0.0), "bscale": number_of("BSCALE", 1.0), "name": text("EXTNAME"), "table": table, "tiled": kind == "tiles"}
            at = start + -(-data // BLOCK) * BLOCK
            number += 1


def images(uri: str) -> list[dict]:
    found = [u for u in units(uri) if not u["skipped"]]
    for i, u in enumerate(found):
        w, h, *c = u["axes"]
        u |= {"image": i, "width": w, "height": h, "channels": c[0] if c else 1, "bscale": u["bscale"] or 1.0}
    return found


def carried(uri: str) -> Iterator[tuple]:
    """(image, pos, id, type, block, rows, columns, value, comment, format) of carried-property tables.

    A table belongs to the image directly before it, that of the file (image
    -1) stands at the end; a table behind anything else belongs to nothing.
    """
    owner, image = None, -1
    for u in units(uri):
        if u["table"] and u["name"] in ("XISF_PROPERTIES", "XISF_METADATA") and not u["tiled"]:
            to = -1 if u["name"] == "XISF_METADATA" else owner
            if to is not None:
                for pos, row in enumerate(_property_rows(uri, u)):
                    yield to, pos, *row
            continue
        if u["skipped"]:
            owner = None
        else:
            image += 1
            owner = image


def _property_rows(uri: str, u: dict) -> Iterator[tuple]:
    values = u["table"]["values"]
    cols, width, count = tiles.columns(values), int(values["NAXIS1"]), int(values["NAXIS2"])
    if not {"ID", "TYPE", "VALUE"} <= set(cols):
        return
    body = read_range(uri, u["offset"], width * count)
    heap = read_range(uri, u["table"]["heap"], u["table"]["heap_size"]) if u["table"]["heap_size"] else b""
    for i in range(count):
        row = body[i * width : (i + 1) * width]
        get = lambda name, default=b"", row=row: tiles.cell(row, cols[name], heap).tobytes() if name in cols else default
        whole = lambda name, row=row: int(tiles.cell(row, cols[name], heap)[0]) if name in cols else 0
        text = lambda name: get(name).rstrip(b"\0 ").decode("utf-8", "replace")  # noqa: B023, E731
        yield text("ID"), text("TYPE"), get("BLOCK") == b"T", whole("ROWS"), whole("COLUMNS"), get("VALUE"), text("COMMENT"), text("FORMAT")


class _Piece(InputPartition):
    def __init__(self, path: str, image: int = -1, channel: int = 0, first: int = 0, count: int = 0, facts: dict | None = None):
        self.path, self.image, self.channel, self.first, self.count, self.facts = path, image, channel, first, count, facts


class _Pieces(InputPartition):
    """Pieces that are small together: one task reads many small images."""

    def __init__(self, pieces: list[_Piece]):
        self.pieces = pieces


def grouped(pieces: list[_Piece]) -> list[InputPartition]:
    out, size = [], PIECE
    for p in pieces:
        samples = p.count * p.facts["width"]
        if size + samples > PIECE or len(out[-1].pieces) >= 256:
            out.append(_Pieces([]))
            size = 0
        out[-1].pieces.append(p)
        size += samples
    return out


class _Wanted:
    """What filters leave of each column, as tests of single values; Spark applies the filters again."""

    TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
    COLUMNS = ("path", "image", "channel", "y")

    def __init__(self, filters: list[Filter]):
        self.tests = [(f.attribute[0], self.TESTS[type(f)], f.value) for f in filters if type(f) in self.TESTS and len(f.attribute) == 1 and f.attribute[0] in self.COLUMNS]

    def allows(self, **values: object) -> bool:
        return all(test(values[name], bound) for name, test, bound in self.tests if name in values)

    def rows(self, height: int) -> range:
        """The least run of rows that holds every wanted one."""
        kept = [y for y in range(height) if self.allows(y=y)] if any(n == "y" for n, _, _ in self.tests) else range(height)
        return range(kept[0], kept[-1] + 1) if kept else range(0)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.paths, self.table, self.wanted = listing(options["path"], ENDINGS), table, _Wanted([])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.wanted = _Wanted(filters)
        return filters

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in self.paths if self.wanted.allows(path=p)]
        if self.table != "bands":
            return [_Piece(p) for p in paths]
        out: list[_Piece] = []
        with ThreadPoolExecutor(32) as pool:
            for path, found in zip(paths, pool.map(images, paths), strict=True):
                for u in found:
                    if not self.wanted.allows(image=u["image"]):
                        continue
                    rows, wanted = max(1, PIECE // u["width"]), self.wanted.rows(u["height"])
                    facts = {k: u[k] for k in ("width", "height", "channels", "bits", "offset", "bzero", "bscale", "tiled", "table", "axes")}
                    out += [_Piece(path, u["image"], c, y, min(rows, wanted.stop - y), facts) for c in range(u["channels"]) if self.wanted.allows(channel=c) for y in range(wanted.start, wanted.stop, rows)]
        return grouped(out)

    def read(self, piece: _Piece | _Pieces) -> Iterator[tuple | pa.RecordBatch]:
        if isinstance(piece, _Pieces):
            for one in piece.pieces:
                yield from self.read(one)
        elif self.table == "images":
            for u in images(piece.path):
                yield piece.path, u["image"], u["name"], u["width"], u["height"], u["channels"], u["bits"], u["bzero"], u["bscale"], u["offset"]
        elif self.table == "keywords":
            for u in images(piece.path):
                for pos, (name, value, comment) in enumerate(u["cards"]):
                    yield piece.path, u["image"], pos, name, value, comment
        elif self.table == "properties":
            for row in carried(piece.path):
                yield piece.path, *row
        else:
            f = piece.facts
            rows = tiled_rows(piece) if f["tiled"] else plain_rows(piece)
            if (f["bzero"], f["bscale"]) != (0.0, 1.0):
                rows = f["bzero"] + f["bscale"] * rows
            step = max(1, (1 << 20) // f["width"])
            for at in range(0, len(rows), step):
                yield band_batch(piece.path, piece.image, piece.channel, piece.first + at, rows[at : at + step])


def band_batch(path: str, image: int, channel: int, first: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of samples as one Arrow batch, without a Python object a sample."""
    n, w = rows.shape
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(np.ascontiguousarray(rows, np.float64).reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, image, np.int32)), pa.array(np.full(n, channel, np.int32)), pa.array(np.arange(first, first + n)), values], ["path", "image", "channel", "y", "values"])


def plain_rows(piece: _Piece) -> np.ndarray:
    f, item = piece.facts, abs(piece.facts["bits"]) // 8
    raw = read_range(piece.path, f["offset"] + (piece.channel * f["height"] + piece.first) * f["width"] * item, piece.count * f["width"] * item)
    return np.frombuffer(raw, KINDS[f["bits"]]).reshape(piece.count, f["width"]).astype(np.float64)


def tiled_rows(piece: _Piece) -> np.ndarray:
    """The rows out of the tiles that meet them; the heap is read from the first to the last of these only if they lie together."""
    f, values = piece.facts, piece.facts["table"]["values"]
    width = int(values["NAXIS1"])
    body = read_range(piece.path, f["offset"], width * int(values["NAXIS2"]))
    heap = read_range(piece.path, f["table"]["heap"], f["table"]["heap_size"])
    axes, out = f["axes"], np.full((piece.count, f["width"]), np.nan)
    places = tiles.layout(values, axes)
    wanted = tiles.rows_of(values, axes, piece.first, piece.count, piece.channel)
    runs: list[list[int]] = []
    for t in wanted:
        if runs and runs[-1][1] == t:
            runs[-1][1] = t + 1
        else:
            runs.append([t, t + 1])
    for a, b in runs:
        for t, got in tiles.decode(values, body, heap, axes, f["bits"], a, b - a):
            x, y, *z = places[t]
            cube = got.reshape(len(z[0]) if z else 1, len(y), len(x))[piece.channel - z[0].start if z else 0]
            lo, hi = max(y.start, piece.first), min(y.stop, piece.first + piece.count)
            out[lo - piece.first : hi - piece.first, x.start : x.stop] = cube[lo - y.start : hi - y.start]
    return out


class _Source(DataSource):
    table, columns = "", ""

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self.table)


class FitsImages(_Source):
    table, columns = "images", "path string, image int, name string, width bigint, height bigint, channels int, bits int, bzero double, bscale double, offset bigint"

    @classmethod
    def name(cls) -> str:
        return "fits_images"


class FitsKeywords(_Source):
    table, columns = "keywords", "path string, image int, pos int, name string, value string, comment string"

    @classmethod
    def name(cls) -> str:
        return "fits_keywords"


class FitsBands(_Source):
    table, columns = "bands", "path string, image int, channel int, y bigint, values array<double>"

    @classmethod
    def name(cls) -> str:
        return "fits_bands"


class FitsProperties(_Source):
    table, columns = "properties", "path string, image int, pos int, id string, type string, block boolean, rows bigint, columns bigint, value binary, comment string, format string"

    @classmethod
    def name(cls) -> str:
        return "fits_properties"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FitsImages, FitsKeywords, FitsBands, FitsProperties):
        spark.dataSource.register(source)


def sample_formats(image_rows: DataFrame, band_rows: DataFrame) -> DataFrame:
    """(path, image, sample_format): integers are unsigned if scaled so or free of negatives, else floats; one pass over the data."""
    negative = band_rows.groupBy("path", "image").agg(F.bool_or(F.exists("values", lambda v: v < 0)).alias("negative"))
    rows = image_rows.join(negative, ["path", "image"], "left")
    bits, plain = F.col("bits"), (F.col("bzero") == 0) & (F.col("bscale") == 1)
    shifted = (F.col("bscale") == 1) & (((bits == 16) & (F.col("bzero") == 2.0**15)) | ((bits == 32) & (F.col("bzero") == 2.0**31)) | ((bits == 64) & (F.col("bzero") == 2.0**63)))
    unsigned = F.concat(F.lit("UInt"), bits.cast("string"))
    kind = F.when(bits == -32, "Float32").when(bits == -64, "Float64").when((bits == 8) & plain, "UInt8").when(shifted | (plain & ~F.col("negative")), unsigned).when(bits <= 16, "Float32").otherwise("Float64")
    return rows.select("path", "image", kind.alias("sample_format"))


# What each sample format is stored as: BITPIX, BZERO, numpy type.
STORED = {"UInt8": (8, 0, ">u1"), "UInt16": (16, 1 << 15, ">i2"), "UInt32": (32, 1 << 31, ">i4"), "UInt64": (64, 1 << 63, ">i8"), "Float32": (-32, 0, ">f4"), "Float64": (-64, 0, ">f8")}


def card(name: str, value: str, comment: str = "") -> bytes:
    return b"".join(cd.format_card(name, value, comment))


def stored_samples(samples: np.ndarray, sample_format: str) -> np.ndarray:
    """Samples as the file holds them; unsigned integers lose their upper half by a flipped sign bit."""
    bits, zero, kind = STORED[sample_format]
    if not zero:
        return samples.astype(kind)
    whole = samples.astype(f"u{bits // 8}")
    return (whole ^ whole.dtype.type(zero)).view(f"i{bits // 8}").astype(kind)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK)


def encode_image(samples: np.ndarray, sample_format: str, keywords: list[tuple[str, str, str]], primary: bool = True, name: str = "", tiled: bool = False, row_order: str = "TOP-DOWN") -> bytes:
    """One header-data unit of an image (channels, height, width). UInt64 stays plain: the tile codecs end at 32 bits."""
    bits, zero, _ = STORED[sample_format]
    data, (c, h, w) = stored_samples(samples, sample_format), samples.shape
    cards = [("SIMPLE", "T", "")] if primary else [("XTENSION", "'IMAGE   '", "")]
    if tiled and sample_format != "UInt64":
        body, cards = tiles.encode(data, bits)
    else:
        body = data.tobytes()
        cards += [("BITPIX", str(bits), ""), ("NAXIS", "3" if c > 1 else "2", ""), ("NAXIS1", str(w), ""), ("NAXIS2", str(h), "")]
        cards += [("NAXIS3", str(c), "")] if c > 1 else []
        cards += [("EXTEND", "T", "")] if primary else [("PCOUNT", "0", ""), ("GCOUNT", "1", "")]
    cards += [("BZERO", str(zero), ""), ("BSCALE", "1", "")] if zero else []
    cards += [("EXTNAME", cd.quoted(name), "")] if name else []
    cards += [("ROWORDER", cd.quoted(row_order), "")]
    return cd.header([*cards, *keywords]) + _padded(body)


def encode_properties(rows: list[dict], name: str = "XISF_PROPERTIES", version: int = 1) -> bytes:
    """The table of carried properties: id, type, block, rows, columns, value, comment, format; only ASCII ids and types fit."""
    rows = [r for r in rows if r["id"].isascii() and r["type"].isascii()]
    if not rows:
        return b""
    wide = [max(1, *(len(r[k]) for r in rows)) for k in ("id", "type")]
    heap, body, most = bytearray(), bytearray(), {"value": 0, "comment": 0, "format": 0}
    for r in rows:
        body += r["id"].encode().ljust(wide[0], b"\0") + r["type"].encode().ljust(wide[1], b"\0") + (b"T" if r["block"] else b"F") + struct.pack(">qq", r["rows"] or 0, r["columns"] or 0)
        for k in most:
            data = r[k] if isinstance(r[k], bytes) else (r[k] or "").encode()
            body += struct.pack(">ii", len(data), len(heap))
            heap += data
            most[k] = max(most[k], len(data))
    forms = [("ID", f"{wide[0]}A"), ("TYPE", f"{wide[1]}A"), ("BLOCK", "1L"), ("ROWS", "1K"), ("COLUMNS", "1K"), ("VALUE", f"1PB({most['value']})"), ("COMMENT", f"1PB({most['comment']})"), ("FORMAT", f"1PB({most['format']})")]
    cards = [("XTENSION", "'BINTABLE'", ""), ("BITPIX", "8", ""), ("NAXIS", "2", ""), ("NAXIS1", str(len(body) // len(rows)), ""), ("NAXIS2", str(len(rows)), ""), ("PCOUNT", str(len(heap)), ""), ("GCOUNT", "1", ""), ("TFIELDS", "8", "")]
    for i, (column, form) in enumerate(forms):
        cards += [(f"TTYPE{i + 1}", cd.quoted(column), ""), (f"TFORM{i + 1}", cd.quoted(form), "")]
    return cd.header([*cards, ("EXTNAME", cd.quoted(name), ""), ("EXTVER", str(version), "")]) + _padded(bytes(body + heap))


def encode(samples: np.ndarray, sample_format: str, keywords: list[tuple[str, str, str]]) -> bytes:
    """A FITS file of one image (channels, height, width)."""
    return encode_image(samples, sample_format, keywords)


def encode_all(images_: list[dict], tiled: bool = False) -> bytes:
    """A file of images (samples, sample_format, name, keywords, properties), the first one primary unless it is compressed."""
    out = []
    if tiled and images_ and images_[0]["sample_format"] != "UInt64":
        out.append(cd.header([("SIMPLE", "T", ""), ("BITPIX", "8", ""), ("NAXIS", "0", ""), ("EXTEND", "T", "")]))
    for i, image in enumerate(images_):
        out.append(encode_image(image["samples"], image["sample_format"], image.get("keywords", []), primary=not out, name=image.get("name", ""), tiled=tiled))
        out.append(encode_properties(image.get("properties", []), version=i + 1))
    return b"".join(out)


def _word_sum(data: bytes) -> int:
    words = np.frombuffer(data + bytes(-len(data) % 4), ">u4")
    total = int(words.sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def verify_units(uri: str) -> Iterator[tuple]:
    """(unit, ok, problem) of each header-data unit: its checksum cards, and whether compressed tiles can be read; ok is null where nothing could be checked."""
    system, path = place(uri)
    end = system.get_file_info(path).size
    try:
        for u in units(uri):
            values = {n: v for n, v, _ in u["cards"]}
            if "offset" not in u or u["offset"] + u["size"] > end:
                yield u["unit"], False, u["skipped"] or "the file ends inside the data"
                continue
            ok, problem = None, None
            data = read_range(uri, u["offset"], -(-u["size"] // BLOCK) * BLOCK)
            if "DATASUM" in values:
                ok = cd.unquoted(values["DATASUM"]) == str(_word_sum(data))
                problem = None if ok else "DATASUM differs"
            if ok is not False and "CHECKSUM" in values:
                ok = _word_sum(read_range(uri, u["at"], u["offset"] - u["at"]) + data) in (0, 0xFFFFFFFF)
                problem = None if ok else "CHECKSUM differs"
            if ok is not False and u["tiled"] and not u["skipped"]:
                try:
                    t = u["table"]
                    for _ in tiles.decode(t["values"], data, data[t["heap"] - u["offset"] :][: t["heap_size"]], u["axes"], u["bits"], 0, int(t["values"]["NAXIS2"])):
                        pass
                except Exception as error:  # damage is what this reports
                    ok, problem = False, str(error)
            yield u["unit"], ok, problem
    except Exception as error:
        yield -1, False, str(error)


def files(band_rows: DataFrame, sample_format: str, keywords: DataFrame | None = None) -> DataFrame:
    """(path, content): a file for each path of ``band_rows(path, channel, y, values)``; ``keywords(path, pos, name, value, comment)`` go along.

    An image is one file and so one task; files are many.
    """
    rows = band_rows.select("path", "channel", "y", "values", F.lit(None).cast("array<struct<name:string,value:string,comment:string>>").alias("cards"))
    if keywords is not None:
        listed = keywords.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "value", "comment"))).alias("k"))
        cards = F.transform("k", lambda k: F.struct(k["name"].alias("name"), k["value"].alias("value"), k["comment"].alias("comment")))
        rows = rows.unionByName(listed.select("path", F.lit(-1).alias("channel"), F.lit(-1).cast("bigint").alias("y"), F.lit(None).cast("array<double>").alias("values"), cards.alias("cards")))

    def run(table: pa.Table) -> pa.Table:
        extra = [k for cards in table["cards"].to_pylist() if cards for k in cards]
        table = table.filter(pa.array([c >= 0 for c in table["channel"].to_pylist()])).sort_by([("channel", "ascending"), ("y", "ascending")])
        channels = max(table["channel"].to_pylist()) + 1
        column = table["values"].combine_chunks()
        samples = column.flatten().to_numpy().reshape(channels, table.num_rows // channels, -1)
        return pa.table({"path": [table["path"][0].as_py()], "content": pa.array([encode(samples, sample_format, [(k["name"], k["value"] or "", k["comment"] or "") for k in extra])], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, "path string, content binary")
