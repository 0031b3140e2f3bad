"""TIFF pictures: chunky strips, Deflate, and the predictor that suits the sample format."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a strip, about.
STRIP = 1 << 18
KINDS = {"UInt8": ("<u1", 1), "UInt16": ("<u2", 1), "UInt32": ("<u4", 1), "UInt64": ("<u8", 1), "Float32": ("<f4", 3), "Float64": ("<f8", 3)}


def predicted(rows: np.ndarray, channels: int) -> tuple[int, bytes]:
    """(predictor, bytes) of rows of interleaved samples: differences for integers to 32 bits, byte planes and differences for floats."""
    if rows.dtype.kind == "f":
        planes = rows.astype(rows.dtype.newbyteorder(">")).view(np.uint8).reshape(len(rows), -1, rows.dtype.itemsize).transpose(0, 2, 1).reshape(len(rows), -1)
        out = planes.copy()
        out[:, channels:] -= planes[:, :-channels]
        return 3, out.tobytes()
    if rows.dtype.itemsize <= 4:
        out = rows.copy()
        out[:, channels:] -= rows[:, :-channels]
        return 2, out.tobytes()
    return 1, rows.tobytes()


def _page(samples: np.ndarray, sample_format: str, big: bool) -> tuple[list, list[bytes]]:
    """(tags, strips) of a page of (channels, height, width)."""
    kind, form = KINDS[sample_format]
    c, h, w = samples.shape
    rows = np.ascontiguousarray(samples.astype(kind).transpose(1, 2, 0).reshape(h, w * c))
    per = max(1, STRIP // max(1, rows.shape[1] * rows.dtype.itemsize))
    strips, predictor = [], 1
    for y in range(0, h, per):
        predictor, data = predicted(rows[y : y + per], c)
        strips.append(zlib.compress(data))
    colour = 2 if c >= 3 else 1
    extra = c - (3 if colour == 2 else 1)
    long = 16 if big else 4
    # Tags of the format: tag, type (3 short, 4 long, 16 long of eight bytes), values.
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * rows.dtype.itemsize] * c), (259, 3, [8]), (262, 3, [colour]), (273, long, [0] * len(strips)), (277, 3, [c]), (278, 4, [per]), (279, long, [len(s) for s in strips]), (284, 3, [1]), (317, 3, [predictor])]
    tags += [(338, 3, [0] * extra)] if extra else []
    return [*tags, (339, 3, [form] * c)], strips


def encode(samples: np.ndarray, sample_format: str) -> bytes:
    """A one-page file of (channels, height, width)."""
    return encode_pages([{"samples": samples, "sample_format": sample_format}])


def encode_pages(images: list[dict], big: bool | None = None) -> bytes:
    """A page an image (samples, sample_format), a page a plane where planes are neither gray nor colour; BigTIFF where 4 GiB could be passed."""
    planes = []
    for image in images:
        whole = image["samples"]
        planes += [(p, image["sample_format"]) for p in ([whole] if len(whole) in (1, 2, 3, 4) else whole[:, None])]
    if big is None:
        big = sum(p.size * np.dtype(KINDS[f][0]).itemsize for p, f in planes) > (1 << 32) - (1 << 24)
    sizes, word, entry = {3: 2, 4: 4, 16: 8}, "Q" if big else "I", 20 if big else 12
    codes = {3: "H", 4: "I", 16: "Q"}
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    for k, (samples, form) in enumerate(planes):
        tags, strips = _page(samples, form, big)
        start = len(out)
        at = start + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
        placed, offsets = {}, []
        for tag, kind, values in tags:
            size = len(values) * sizes[kind]
            if size > (8 if big else 4):
                placed[tag], at = at, at + size + size % 2
        for s in strips:
            offsets.append(at)
            at += len(s) + len(s) % 2
        body, tail = struct.pack("<Q" if big else "<H", len(tags)), b""
        for tag, kind, values in tags:
            packed = struct.pack(f"<{len(values)}{codes[kind]}", *(offsets if tag == 273 else values))
            body += struct.pack("<HH" + word, tag, kind, len(values))
            if tag in placed:
                body += struct.pack("<" + word, placed[tag])
                tail += packed + b"\0" * (len(packed) % 2)
            else:
                body += packed.ljust(8 if big else 4, b"\0")
        body += struct.pack("<" + word, at if k + 1 < len(planes) else 0)
        out += body + tail + b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return bytes(out)


def files(band_rows: DataFrame, sample_format: str) -> DataFrame:
    """(path, content) of ``band_rows(path, channel, y, values)``; one task a file."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("channel", "ascending"), ("y", "ascending")])
        channels = max(table["channel"].to_pylist()) + 1
        samples = table["values"].combine_chunks().flatten().to_numpy().reshape(channels, table.num_rows // channels, -1)
        return pa.table({"path": [table["path"][0].as_py()], "content": pa.array([encode(samples, sample_format)], pa.binary())})

    return band_rows.select("path", "channel", "y", "values").groupBy("path").applyInArrow(run, "path string, content binary")
