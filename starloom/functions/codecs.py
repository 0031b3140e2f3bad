"""Byte codecs of image blocks: zlib, zstd, LZ4, subblocks, byte shuffling, Rice, PLIO, dithering; and their round trip as Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

PIECE = 1 << 20


def shuffle(data: bytes, item: int) -> bytes:
    """Byte planes one after the other; an incomplete last item stays in place."""
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(-1, item).T.tobytes() + data[n:]


def unshuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(item, -1).T.tobytes() + data[n:]


#: Level ranges of the codecs and the level taken where none is given; LZ4 without a level is the fast kind.
LEVELS = {"zlib": (1, 9, 6), "zstd": (1, 22, 3), "lz4": (0, 0, 0), "lz4hc": (1, 12, 9)}
#: A codec cannot make data more than so many times smaller: what claims more is damage.
EXPANSION = {"zlib": 1032, "lz4": 255, "lz4hc": 255, "zstd": 50_000}
#: The longest input of one LZ4 block.
LZ4_BLOCK = 0x7E000000


def check_level(codec: str, level: int | None) -> int:
    if codec not in LEVELS:
        raise ValueError(f"unknown codec: {codec}")
    low, high, usual = LEVELS[codec]
    if level is not None and not low <= level <= high:
        raise ValueError(f"{codec} has levels {low} to {high}")
    return usual if level is None else level


def compress(data: bytes, codec: str, level: int | None = None, item: int = 1) -> bytes:
    """``codec`` zlib, zstd, lz4 or lz4hc, after byte shuffling of items; zstd is fed in pieces of a mebibyte."""
    level = check_level(codec, level)
    if item > 1:
        data = shuffle(data, item)
    if codec == "zlib":
        return zlib.compress(data, level)
    if codec == "zstd":
        packer = zstandard.ZstdCompressor(level=level).compressobj(size=len(data))
        return b"".join(packer.compress(data[i : i + PIECE]) for i in range(0, len(data), PIECE)) + packer.flush()
    if len(data) > LZ4_BLOCK:
        raise ValueError("an LZ4 block holds at most 2 113 929 216 bytes")
    return pa.Codec("lz4_raw", compression_level=level or None).compress(data, asbytes=True)


def decompress(data: bytes, codec: str, size: int, item: int = 1) -> bytes:
    """The inverse; the result must have ``size`` bytes, and a size beyond what the codec can reach is refused unread."""
    check_level(codec, None)
    if size > EXPANSION[codec] * len(data) + 4096:
        raise ValueError(f"{len(data)} bytes cannot hold {size}")
    if codec == "zlib":
        unpack = zlib.decompressobj()
        out = unpack.decompress(data, size + 1)
    elif codec == "zstd":
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b""
    else:
        out = pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True) if size else b""
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return unshuffle(out, item) if item > 1 else out


def pack_subblocks(data: bytes, codec: str, size: int, level: int | None = None, item: int = 1) -> tuple[bytes, str]:
    """(stored, subblocks): shuffled as a whole, then compressed in pieces of ``size``; the text lists ``stored,raw`` of each."""
    if item > 1:
        data = shuffle(data, item)
    raw = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    made = [compress(x, codec, level) for x in raw]
    return b"".join(made), ":".join(f"{len(m)},{len(x)}" for m, x in zip(made, raw, strict=True))


def unpack_subblocks(data: bytes, codec: str, listed: str, size: int, item: int = 1) -> bytes:
    """The inverse of ``pack_subblocks``; the pieces must add up to both sizes."""
    sizes = [tuple(map(int, x.split(","))) for x in listed.split(":")]
    if sum(c for c, _ in sizes) != len(data) or sum(u for _, u in sizes) != size:
        raise ValueError("the subblocks do not add up to the block")
    out, at = [], 0
    for stored, raw in sizes:
        out.append(decompress(data[at : at + stored], codec, raw))
        at += stored
    whole = b"".join(out)
    return unshuffle(whole, item) if item > 1 else whole


# By sample bits: width of a block's split code, and the greatest split.
RICE = {8: (3, 6), 16: (4, 14), 32: (5, 25)}


def rice_encode(values: np.ndarray, bits: int = 16, block: int = 32) -> bytes:
    """Rice code of integers of 8, 16 or 32 bits: the first value, then a split and mapped differences for each block.

    All blocks at once: the places of all codes are a running sum of their lengths.
    """
    code_bits, top = RICE[bits]
    n = len(values)
    if not n:
        return b""
    half, full = 1 << (bits - 1), 1 << bits
    d = np.diff(np.concatenate([values[:1], values]).astype(np.int64))
    d = (d + half) % full - half
    code = np.where(d < 0, -2 * d - 1, 2 * d)
    starts = np.arange(0, n, block)
    count = np.minimum(block, n - starts)
    total = np.add.reduceat(code, starts)
    mean = np.maximum(0.0, (total - count // 2 - 1) / count).astype(np.int64) >> 1
    split = np.where(mean > 0, np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64) + 1, 0)
    raw, empty = split >= top, (split == 0) & (total == 0)
    head = np.where(raw, top + 1, np.where(empty, 0, split + 1))
    of = np.repeat(np.arange(len(starts)), count)
    low = np.where(raw, bits, split)[of]  # bits behind the unary part
    unary = np.where(raw[of], 0, (code >> np.where(raw, 0, split)[of]) + 1)
    length = np.where(empty[of], 0, low + unary)
    lead = np.zeros(n, np.int64)
    lead[starts] = code_bits
    end = bits + np.cumsum(length + lead)
    out = np.zeros(int(end[-1]), np.uint8)
    first = int(values[0]) & (full - 1)
    out[:bits] = [first >> (bits - 1 - i) & 1 for i in range(bits)]
    head_at = (end - length - lead)[starts]
    for i in range(code_bits):
        out[head_at + i] = head >> (code_bits - 1 - i) & 1
    told = length > 0
    marked = told & (unary > 0)
    out[(end - low - 1)[marked]] = 1
    for i in range(int(low[told].max(initial=0))):  # the i-th lowest bit of every code that has one
        has = told & (low > i)
        out[(end - 1 - i)[has]] = code[has] >> i & 1
    return np.packbits(out).tobytes()


def rice_decode(data: bytes, count: int, bits: int = 16, block: int = 32) -> np.ndarray:
    """``count`` unsigned integers from their Rice code."""
    return rice_decode_many([data], [count], bits, block)[0]


def rice_decode_many(streams: list[bytes], counts: list[int], bits: int = 16, block: int = 32) -> list[np.ndarray]:
    """Several streams in step: the i-th value of all of them is one array operation."""
    code_bits, top = RICE[bits]
    order = sorted(range(len(streams)), key=lambda i: -counts[i])
    out: list[np.ndarray] = [np.zeros(counts[i], np.int64) for i in range(len(streams))]
    order = [i for i in order if counts[i]]
    if not order:
        return out
    sizes = np.array([len(streams[i]) + 8 for i in order])
    data = np.frombuffer(b"".join(streams[i] + bytes(8) for i in order), np.uint8)
    ends = np.cumsum(sizes) * 8
    at = ends - sizes * 8
    ones = np.flatnonzero(np.unpackbits(data))
    wide = np.zeros(len(data) + 8, np.uint64)
    wide[: len(data)] = data

    def take(place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` bits (at most 32 each) from the bit ``place`` on."""
        byte = place >> 3
        word = np.zeros(len(place), np.uint64)
        for i in range(5):
            word = word << np.uint64(8) | wide[byte + i]
        shift = (40 - (place & 7) - n).astype(np.uint64)
        return (word >> shift & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    many = np.array([counts[i] for i in order])
    values = np.zeros((int(many[0]), len(order)), np.int64)
    last = take(at, np.full(len(order), bits))
    at = at + bits
    split = np.zeros(len(order), np.int64)
    for i in range(int(many[0])):
        live = int(np.searchsorted(-many, -i, "left")) if i else len(order)
        here = at[:live]
        if i % block == 0:
            split[:live] = take(here, np.full(live, code_bits)) - 1
            here = here + code_bits
        k = split[:live]
        plain = (k >= 0) & (k < top)
        next_one = ones[np.minimum(np.searchsorted(ones, here), len(ones) - 1)] if len(ones) else here
        if (plain & ((next_one < here) | (next_one >= ends[:live]))).any():
            raise ValueError("the Rice code ends too early")
        quotient = np.where(plain, next_one - here, 0)
        here = np.where(plain, next_one + 1, here)
        n = np.where(plain, k, np.where(k < 0, 0, bits))
        code = quotient << np.maximum(n, 0) | take(here, n)
        at[:live] = here + n
        if (at[:live] > ends[:live]).any():
            raise ValueError("the Rice code ends too early")
        last[:live] = (last[:live] + np.where(code & 1, -(code + 1) // 2, code // 2)) % (1 << bits)
        values[i, :live] = last[:live]
    for column, i in enumerate(order):
        out[i] = values[: counts[i], column]
    return out


def plio_decode(words: np.ndarray, count: int) -> np.ndarray:
    """Pixel mask line lists: 16-bit words of a four-bit instruction and a twelve-bit number."""
    out = np.zeros(count, np.int64)
    w = [int(x) for x in words]
    first, length = (3, w[2]) if w[2] > 0 else (w[1], (w[4] << 15) + w[3])
    x, value, i = 0, 1, first
    while i < length and x < count:
        kind, n = w[i] >> 12 & 15, w[i] & 4095
        i += 1
        if kind in (0, 4, 5):  # a run of zeros, of the value, or of zeros that ends in the value
            stop = min(x + n, count)
            if kind == 4:
                out[x:stop] = value
            elif kind == 5 and n and x + n <= count:
                out[stop - 1] = value
            x = stop
        elif kind == 1:
            value = (w[i] << 12) + n
            i += 1
        elif kind in (2, 3, 6, 7):
            value += n if kind in (2, 6) else -n
            if kind >= 6:
                out[x] = value
                x += 1
    return out


@cache
def dither_numbers() -> np.ndarray:
    """The 10 000 uniform numbers of subtractive dithering: Park and Miller's generator from 1."""
    seed, out = 1, np.empty(10_000)
    for i in range(10_000):
        seed = seed * 16807 % 2147483647
        out[i] = seed / 2147483647
    return out


def dithered(values: np.ndarray, scale: float, zero: float, tile: int, seed: int, method: str, blank: int | None) -> np.ndarray:
    """Floats of a tile's quantised integers; ``tile`` counts from 0. NO_DITHER and SUBTRACTIVE_DITHER_1 and _2."""
    if method == "NO_DITHER":
        out = values * scale + zero
    else:
        numbers = dither_numbers()
        start = (tile + seed - 1) % 10_000
        at, used, need = start, [], len(values)
        next_at = int(numbers[start] * 500)
        while need > 0:  # when the numbers end, the next start follows from the next number
            part = numbers[next_at : next_at + need]
            used.append(part)
            need -= len(part)
            at = (at + 1) % 10_000
            next_at = int(numbers[at] * 500)
        out = (values - np.concatenate(used or [np.empty(0)]) + 0.5) * scale + zero
        if method == "SUBTRACTIVE_DITHER_2":
            out = np.where(values == -2147483646, 0.0, out)
    return out if blank is None else np.where(values == blank, np.nan, out)


def round_trips(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, ..._ok, sha1) of ``blocks(doc_id, data)``: every codec's output decoded again and compared."""
    import hashlib

    names = ["doc_id", "n", "zlib_ok", "zstd_ok", "shuffle_ok", "rice_ok", "sha1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blobs = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            for at in range(0, len(blobs), 256):  # streams of a batch are decoded in step
                part = blobs[at : at + 256]
                heads = [np.frombuffer(x[: len(x) // 2 * 2], np.uint16) for x in part]
                again = rice_decode_many([rice_encode(h.astype(np.int64)) for h in heads], [len(h) for h in heads])
                rows = []
                for key, data, head, back in zip(keys[at : at + 256], part, heads, again, strict=True):
                    whole = [decompress(compress(data, c, item=i), c, len(data), i) for c, i in (("zlib", 1), ("zstd", 1), ("zstd", 4))]
                    rows.append((key, len(data), *(w == data for w in whole), np.array_equal(head, back), hashlib.sha1(whole[0], usedforsecurity=False).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    # Packing costs far more than moving: a table of fewer pieces than cores is dealt out first.
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    spread = blocks if blocks.rdd.getNumPartitions() >= cores else blocks.repartition(cores)
    return spread.mapInArrow(run, "doc_id bigint, n bigint, zlib_ok boolean, zstd_ok boolean, shuffle_ok boolean, rice_ok boolean, sha1 string")
