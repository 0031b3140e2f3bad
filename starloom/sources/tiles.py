"""Tile-compressed FITS images: binary tables whose rows are compressed pieces of an image."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator
from itertools import product

import numpy as np

from starloom.functions.codecs import dithered, plio_decode, rice_decode_many, rice_encode, shuffle, unshuffle

#: Bytes of a binary table's column types; P and Q are descriptors into the heap.
SIZES = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
READ = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
INTEGER = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: What of an image a tile table can be read with.
KNOWN = ("RICE_1", "RICE_ONE", "GZIP_1", "GZIP_2", "PLIO_1", "NOCOMPRESS")


def columns(values: dict[str, str]) -> dict[str, tuple[int, str, int, str]]:
    """name: (offset in the row, type, repeat, type behind a descriptor) of a table's columns."""
    out, at = {}, 0
    for i in range(1, int(values.get("TFIELDS", 0)) + 1):
        form = values.get(f"TFORM{i}", "").strip("' ")
        m = re.match(r"(\d*)([A-Z])([A-Z]?)", form)
        if not m or m[2] not in SIZES:
            raise ValueError(f"column type not read: {form}")
        repeat = int(m[1]) if m[1] else 1
        out[values.get(f"TTYPE{i}", f"COL{i}").strip("' ").upper()] = (at, m[2], repeat, m[3])
        at += -(-repeat // 8) if m[2] == "X" else repeat * SIZES[m[2]]
    return out


def cell(row: bytes, column: tuple[int, str, int, str], heap: bytes) -> np.ndarray:
    """A cell's values; of a descriptor, what it points at."""
    at, kind, repeat, inner = column
    if kind not in "PQ":
        size = repeat * SIZES[kind]
        return np.frombuffer(row[at : at + size], READ.get(kind, "u1"))
    count, offset = struct.unpack(">ii" if kind == "P" else ">qq", row[at : at + SIZES[kind]])
    size = count * SIZES[inner]
    if offset < 0 or count < 0 or offset + size > len(heap):
        raise ValueError("a descriptor points beyond the heap")
    return np.frombuffer(heap[offset : offset + size], READ.get(inner, "u1"))


def layout(values: dict[str, str], axes: list[int]) -> list[list[range]]:
    """Of each tile, in order, the range it covers on each axis."""
    sizes = [int(values.get(f"ZTILE{i + 1}", axes[0] if i == 0 else 1)) for i in range(len(axes))]
    per = [[range(a, min(a + s, n)) for a in range(0, n, s)] for n, s in zip(axes, sizes, strict=True)]
    return [list(reversed(t)) for t in product(*reversed(per))]


def decode(values: dict[str, str], table: bytes, heap: bytes, axes: list[int], bits: int, first: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tile, doubles) of the tiles ``first`` to ``first + count``; integers as stored, floats after their scale."""
    cols, width = columns(values), int(values["NAXIS1"])
    kind = values["ZCMPTYPE"].strip("' ")
    params = {values.get(f"ZNAME{i}", "").strip("' "): values.get(f"ZVAL{i}", "") for i in range(1, 10)}
    byte_pix, block = int(params.get("BYTEPIX", 4)), int(params.get("BLOCKSIZE", 32))
    method = values.get("ZQUANTIZ", "NO_DITHER").strip("' ")
    tiles = layout(values, axes)
    pending: list[tuple[int, int, bytes]] = []

    def number(row: bytes, name: str, default: float | None) -> float | None:
        if name in cols:
            return float(cell(row, cols[name], heap)[0])
        return float(values[name].replace("D", "E")) if name in values else default

    def finish(t: int, row: bytes, got: np.ndarray) -> tuple[int, np.ndarray]:
        blank = number(row, "ZBLANK", None)
        if bits > 0:
            return t, got.astype(np.float64)
        scale, zero = number(row, "ZSCALE", 1.0), number(row, "ZZERO", 0.0)
        return t, dithered(got.astype(np.float64), scale, zero, t, int(values.get("ZDITHER0", 1)), method, blank)

    waiting: list[bytes] = []

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        if pending:
            got = rice_decode_many([p[2] for p in pending], [p[1] for p in pending], 8 * byte_pix, block)
            for (t, _, _), g, row in zip(pending, got, waiting, strict=True):
                half = 1 << (8 * byte_pix - 1)
                yield finish(t, row, g if byte_pix == 1 else (g + half) % (2 * half) - half)
            pending.clear()
            waiting.clear()

    for t in range(first, first + count):
        row = table[t * width : (t + 1) * width]
        n = int(np.prod([len(r) for r in tiles[t]]))
        packed = cell(row, cols["COMPRESSED_DATA"], heap) if "COMPRESSED_DATA" in cols else np.empty(0, np.uint8)
        if len(packed) and kind in ("RICE_1", "RICE_ONE"):
            pending.append((t, n, packed.tobytes()))
            waiting.append(row)
            if len(pending) >= 1024:
                yield from flush()
            continue
        if len(packed) and kind == "PLIO_1":
            yield finish(t, row, plio_decode(packed.view(">i2") if packed.dtype.itemsize == 1 else packed, n))
            continue
        quantised = bits < 0 and ("ZSCALE" in cols or "ZSCALE" in values)
        if len(packed) and kind == "NOCOMPRESS":
            yield t, packed.view(INTEGER[bits]).astype(np.float64) if packed.dtype == np.uint8 else packed.astype(np.float64)
            continue
        if len(packed):
            raw = gzip.decompress(packed.tobytes())
            item = len(raw) // n
            if item * n != len(raw):
                raise ValueError("a tile has another size than its place")
            if kind == "GZIP_2":
                raw = unshuffle(raw, item)
            if quantised:
                yield finish(t, row, np.frombuffer(raw, INTEGER[8 * item]))
            else:
                yield t, np.frombuffer(raw, f">f{item}" if bits < 0 else INTEGER[8 * item]).astype(np.float64)
            continue
        for name in ("GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA"):
            if name in cols and len(rest := cell(row, cols[name], heap)):
                raw = gzip.decompress(rest.tobytes()) if name[0] == "G" else rest.tobytes()
                yield t, np.frombuffer(raw, INTEGER[bits] if len(raw) == n * abs(bits) // 8 else f">f{len(raw) // n}").astype(np.float64)
                break
        else:
            raise ValueError(f"tile {t} holds no data")
    yield from flush()


def rows_of(values: dict[str, str], axes: list[int], first: int, count: int, channel: int) -> list[int]:
    """The tiles that meet rows [first, first + count) of a channel."""
    out = []
    for t, spans in enumerate(layout(values, axes)):
        y = spans[1]
        if y.start < first + count and y.stop > first and (len(spans) < 3 or channel in spans[2]):
            out.append(t)
    return out


def encode(stored: np.ndarray, bits: int) -> tuple[bytes, list[tuple[str, str, str]]]:
    """(table and heap, cards) of an image (channels, height, width) as big-endian stored samples, a row a tile.

    Integers of 16 and 32 bits by Rice, bytes by GZIP_1, floats by GZIP_2, which
    loses nothing. A tile that Rice does not make smaller is kept as GZIP data.
    """
    c, h, w = stored.shape
    item = abs(bits) // 8
    kind = "RICE_1" if bits in (16, 32) else "GZIP_1" if bits == 8 else "GZIP_2"
    heap, rows, longest, longest_gzip = bytearray(), [], 0, 0
    for line in stored.reshape(c * h, w):
        raw = line.tobytes()
        data, spare = b"", b""
        if kind == "RICE_1":
            data = rice_encode(line.astype(np.int64), bits)
            if len(data) >= len(raw):
                data, spare = b"", gzip.compress(raw, mtime=0)
        else:
            data = gzip.compress(shuffle(raw, item) if kind == "GZIP_2" else raw, mtime=0)
        rows.append(struct.pack(">iiii", len(data), len(heap), len(spare), len(heap) + len(data)))
        heap += data + spare
        longest, longest_gzip = max(longest, len(data)), max(longest_gzip, len(spare))
    cards = [("XTENSION", "'BINTABLE'", ""), ("BITPIX", "8", ""), ("NAXIS", "2", ""), ("NAXIS1", "16", ""), ("NAXIS2", str(len(rows)), ""), ("PCOUNT", str(len(heap)), ""), ("GCOUNT", "1", ""), ("TFIELDS", "2", "")]
    cards += [("TTYPE1", "'COMPRESSED_DATA'", ""), ("TFORM1", f"'1PB({longest})'", ""), ("TTYPE2", "'GZIP_COMPRESSED_DATA'", ""), ("TFORM2", f"'1PB({longest_gzip})'", "")]
    cards += [("ZIMAGE", "T", ""), ("ZCMPTYPE", f"'{kind}'", ""), ("ZBITPIX", str(bits), ""), ("ZNAXIS", "3" if c > 1 else "2", ""), ("ZNAXIS1", str(w), ""), ("ZNAXIS2", str(h), "")]
    cards += [("ZNAXIS3", str(c), "")] if c > 1 else []
    cards += [("ZTILE1", str(w), ""), ("ZTILE2", "1", "")] + ([("ZTILE3", "1", "")] if c > 1 else [])
    if kind == "RICE_1":
        cards += [("ZNAME1", "'BLOCKSIZE'", ""), ("ZVAL1", "32", ""), ("ZNAME2", "'BYTEPIX'", ""), ("ZVAL2", str(item), "")]
    return b"".join(rows) + bytes(heap), cards
