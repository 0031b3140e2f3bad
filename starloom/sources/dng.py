"""DNG raw files: the first full-resolution mosaic or linear image of a TIFF tree, its chunks decoded and cropped."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from starloom.sources.files import place, read_range
from starloom.sources.fits import band_batch
from starloom.sources.xisf import _over_files

ENDINGS = (".dng",)
# Tags of the format that are read here.
TAGS = {"kind": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strips": 273, "spp": 277, "strip_rows": 278, "strip_sizes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tiles": 324, "tile_sizes": 325, "subs": 330, "format": 339, "cfa_dim": 33421, "cfa": 33422, "exif": 34665, "black": 50714, "linear": 50712, "active": 50829}
# Tag types: bytes and struct code.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
MOSAIC, LINEAR = 32803, 34892
DIRECTORIES = 256


def directories(uri: str) -> list[dict[int, list]]:
    """The tags of every directory, sub-directories among them; none is visited twice."""
    head = read_range(uri, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    system, path = place(uri)
    size = system.get_file_info(path).size
    todo, seen, out = [struct.unpack(order + "I", head[4:])[0]], set(), []
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        if len(out) >= DIRECTORIES or at + 2 > size:
            raise ValueError("the directories do not end, or leave the file")
        seen.add(at)
        count = struct.unpack(order + "H", read_range(uri, at, 2))[0]
        raw = read_range(uri, at + 2, 12 * count + 4)
        tags: dict[int, list] = {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", raw[12 * i : 12 * i + 8])
            if kind not in TYPES:
                continue
            width, code = TYPES[kind]
            held = raw[12 * i + 8 : 12 * i + 12] if n * width <= 4 else read_range(uri, struct.unpack(order + "I", raw[12 * i + 8 : 12 * i + 12])[0], n * width)
            if len(held) < n * width:
                raise ValueError("a tag points beyond the file")
            values = list(struct.unpack(f"{order}{n * len(code)}{code[0]}", held[: n * width]))
            if len(code) == 2:
                values = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)]
            tags[tag] = [b"".join(values)] if code == "c" else values
        out.append({"order": order} | tags)
        todo += [*tags.get(TAGS["subs"], []), struct.unpack(order + "I", raw[12 * count :].ljust(4, b"\0"))[0]]
    return out


def _one(tags: dict, name: str, default: int | None = None) -> int | None:
    return tags.get(TAGS[name], [default])[0]


def image(uri: str) -> dict:
    """Facts of the raw image; what is not read raises with its reason."""
    found = [t for t in directories(uri) if _one(t, "kind", 0) == 0 and _one(t, "photometric") in (MOSAIC, LINEAR)]
    if not found:
        raise ValueError("no raw image")
    t = found[0]
    spp, bits, compression, predictor = _one(t, "spp", 1), _one(t, "bits", 1), _one(t, "compression", 1), _one(t, "predictor", 1)
    if _one(t, "format", 1) != 1 or _one(t, "planar", 1) != 1 or compression not in (1, 7, 8):
        raise ValueError("this kind of raw data is not read")
    if not (bits <= 16 or bits in (24, 32)) or predictor not in (1, 2, 34892, 34893) or predictor != 1 and (compression != 8 or bits not in (8, 16, 32)):
        raise ValueError(f"{bits}-bit samples with predictor {predictor} are not read")
    w, h = _one(t, "width"), _one(t, "height")
    tiled = TAGS["tiles"] in t
    cw, ch = (_one(t, "tile_width"), _one(t, "tile_height")) if tiled else (w, _one(t, "strip_rows", h))
    places, sizes = (t[TAGS["tiles"]], t[TAGS["tile_sizes"]]) if tiled else (t[TAGS["strips"]], t[TAGS["strip_sizes"]])
    across, down = -(-w // cw), -(-h // ch)
    if len(places) < across * down or w * h * spp * bits // 8 > 100_000 * (sum(sizes) + 1):
        raise ValueError("the sizes cannot be right")
    top, left, bottom, right = t.get(TAGS["active"], [0, 0, h, w])
    pattern = "".join("RGB"[x] if x < 3 else "?" for x in t.get(TAGS["cfa"], []))
    cfa = "".join(pattern[(y + top) % 2 * 2 + (x + left) % 2] for y in range(2) for x in range(2)) if len(pattern) == 4 and _one(t, "photometric") == MOSAIC else None
    black = t.get(TAGS["black"], [])
    return {"order": t["order"], "width": w, "height": h, "spp": spp, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "cw": cw, "ch": ch, "across": across, "chunks": list(zip(places, sizes, strict=False)), "active": (top, left, bottom, right), "linear": t.get(TAGS["linear"]), "cfa": cfa,
            "black": sum(black) / len(black) if black else None, "format": "UInt32" if bits > 16 and TAGS["linear"] not in t else "UInt16"}


def _bits(data: bytes, bits: int, rows: int, per_row: int, order: str) -> np.ndarray:
    """Uncompressed samples; widths that are no whole bytes are packed from the highest bit, rows from a whole byte."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"{order}u{bits // 8}", rows * per_row).astype(np.int64)
    if bits == 24:
        b = np.frombuffer(data, np.uint8, rows * per_row * 3).reshape(-1, 3).astype(np.int64)
        return (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) if order == "<" else (b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2])
    line = -(-per_row * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    return (flat.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2).reshape(-1)


def lossless_jpeg(data: bytes) -> np.ndarray:
    """(height, width, components) of a lossless Huffman JPEG of one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("lossless JPEG: no start")
    at, tables, restart, frame = 2, {}, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("lossless JPEG: damaged")
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xC4:
            p = 0
            while p < len(body):
                counts = body[p + 1 : p + 17]
                tables[body[p] & 15] = _table(counts, body[p + 17 : p + 17 + sum(counts)])
                p += 17 + sum(counts)
        elif marker == 0xC3:
            precision, h, w, n = struct.unpack(">BHHB", body[:6])
            if not 2 <= precision <= 16 or not 1 <= n <= 4 or any(body[7 + 3 * i] != 0x11 for i in range(n)):
                raise ValueError("lossless JPEG: this frame is not read")
            frame = precision, h, w, [body[6 + 3 * i] for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("lossless JPEG: another kind of JPEG")
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("lossless JPEG: no frame")
    precision, h, w, names = frame
    n = len(names)
    if body[0] != n:
        raise ValueError("lossless JPEG: more than one scan")
    lookup = [tables[body[2 + 2 * i] >> 4] for i in range(n)]
    predictor, shift = body[1 + 2 * n], body[3 + 2 * n] & 15
    if not 1 <= predictor <= 7 or shift >= precision or restart % w:
        raise ValueError(f"lossless JPEG: predictor {predictor}")
    return _samples(data, at, h, w, n, lookup, predictor, 1 << (precision - shift - 1), restart // w) << shift


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, category) for each of 65536 next sixteen bits; length 0 where there is no code."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if symbols[k] > 16 or code >> length:
                raise ValueError("lossless JPEG: a table that cannot be")
            span = 1 << (16 - length)
            out[code << (16 - length) : (code << (16 - length)) + span] = [(length, symbols[k])] * span
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _samples(data: bytes, at: int, h: int, w: int, n: int, lookup: list, predictor: int, middle: int, restart_rows: int) -> np.ndarray:
    diff, held, count = np.empty((h, w * n), np.int64), 0, 0
    size = len(data)
    for y in range(h):
        if restart_rows and y and y % restart_rows == 0:
            held = count = 0
            while at + 1 < size and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
        row = []
        for x in range(w * n):
            while count < 32:  # fill; a stuffed zero goes, a marker is followed by zeros
                b = data[at] if at < size else 0
                if b == 0xFF:
                    if at + 1 < size and data[at + 1] == 0:
                        at += 2
                    else:
                        b = 0
                else:
                    at += 1
                held, count = (held << 8 | b) & 0xFFFFFFFFFF, count + 8
            length, s = lookup[x % n][held >> (count - 16) & 0xFFFF]
            if not length:
                raise ValueError("lossless JPEG: no such code")
            count -= length
            if s == 16:
                row.append(32768)
            elif s:
                count -= s
                v = held >> count & ((1 << s) - 1)
                row.append(v if v >> (s - 1) else v - (1 << s) + 1)
            else:
                row.append(0)
            if at > size + 8:
                raise ValueError("lossless JPEG: the data end too early")
        diff[y] = row
    d, out = diff.reshape(h, w, n), np.zeros((h, w, n), np.int64)
    for y in range(h):
        fresh = y == 0 or restart_rows and y % restart_rows == 0
        if fresh:
            out[y] = (np.cumsum(d[y], axis=0) + middle) & 0xFFFF
            continue
        up = out[y - 1]
        if predictor == 1:  # the first of a row comes from above
            out[y] = (np.cumsum(d[y], axis=0) + up[0]) & 0xFFFF
        elif predictor == 2:
            out[y] = (d[y] + up) & 0xFFFF
        elif predictor == 3:
            out[y, 0] = (d[y, 0] + up[0]) & 0xFFFF
            out[y, 1:] = (d[y, 1:] + up[:-1]) & 0xFFFF
        else:
            left = (d[y, 0] + up[0]) & 0xFFFF
            out[y, 0] = left
            for x in range(1, w):
                b, c = up[x], up[x - 1]
                p = left + b - c if predictor == 4 else left + ((b - c) >> 1) if predictor == 5 else b + ((left - c) >> 1) if predictor == 6 else (left + b) >> 1
                left = (d[y, x] + p) & 0xFFFF
                out[y, x] = left
    return out


def chunk(uri: str, f: dict, i: int) -> np.ndarray:
    """(rows, columns, samples a pixel) of a tile or strip."""
    data = read_range(uri, *f["chunks"][i])
    if len(data) < f["chunks"][i][1]:
        raise ValueError("the file ends inside the data")
    rows = f["ch"] if f["tiled"] else min(f["ch"], f["height"] - i * f["ch"])
    if f["compression"] == 7:
        got = lossless_jpeg(data).reshape(-1)
        if len(got) != rows * f["cw"] * f["spp"]:
            raise ValueError("a chunk has another size than its place")
    else:
        raw = zlib.decompress(data) if f["compression"] == 8 else data
        got = _bits(raw, f["bits"], rows, f["cw"] * f["spp"], f["order"])
    got = got.reshape(rows, f["cw"] * f["spp"])
    if f["predictor"] != 1:
        back = f["spp"] * {2: 1, 34892: 2, 34893: 4}[f["predictor"]]
        padded = np.pad(got, ((0, 0), (0, -got.shape[1] % back))).reshape(rows, -1, back)
        got = (np.cumsum(padded, axis=1) % (1 << f["bits"])).reshape(rows, -1)[:, : got.shape[1]]
    return got.reshape(rows, f["cw"], f["spp"])


def samples(uri: str, f: dict) -> np.ndarray:
    """(samples a pixel, height, width) of the active area, through the linearization table."""
    whole = np.zeros((f["height"] + f["ch"], f["across"] * f["cw"], f["spp"]), np.int64)
    for i in range(f["across"] * -(-f["height"] // f["ch"])):
        y, x = i // f["across"] * f["ch"], i % f["across"] * f["cw"]
        got = chunk(uri, f, i)
        whole[y : y + len(got), x : x + f["cw"]] = got
    top, left, bottom, right = f["active"]
    out = whole[top:bottom, left:right].transpose(2, 0, 1)
    if f["linear"]:
        table = np.array(f["linear"])
        out = table[np.minimum(out, len(table) - 1)]
    return out


def image_rows(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[tuple]:
        f = image(uri)
        top, left, bottom, right = f["active"]
        yield uri, 0, "", right - left, bottom - top, f["spp"], f["format"], f["cfa"], f["black"]

    return _over_files(spark, path, read, "path string, image int, name string, width bigint, height bigint, channels int, sample_format string, cfa string, black double", ENDINGS)


def bands(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[pa.RecordBatch]:
        planes = samples(uri, image(uri))
        step = max(1, (1 << 20) // planes.shape[2])
        for c in range(len(planes)):
            for y in range(0, planes.shape[1], step):
                yield band_batch(uri, 0, c, y, planes[c, y : y + step])

    return _over_files(spark, path, read, "path string, image int, channel int, y bigint, values array<double>", ENDINGS)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(path, element, ok, problem): a raw file has no checksums, so what can be decoded is unchecked (null)."""

    def read(uri: str) -> Iterator[tuple]:
        try:
            samples(uri, image(uri))
            yield uri, "raw image", None, None
        except Exception as error:  # damage is what this reports
            yield uri, "raw image", False, str(error)

    return _over_files(spark, path, read, "path string, element string, ok boolean, problem string", ENDINGS)
