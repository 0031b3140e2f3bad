"""ASDF files: a YAML tree with binary blocks behind it; images, tree, blocks, and a writer.

The YAML reader covers what such trees hold: block and flow collections,
plain and quoted scalars by YAML 1.1 rules, literal and folded texts, tags,
anchors and aliases. An alias that is not known, and depth beyond a bound, are
errors.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from starloom.functions.codecs import compress, decompress
from starloom.sources.cards import format_double
from starloom.sources.files import place, read_range
from starloom.sources.fits import band_batch
from starloom.sources.xisf import _over_files

MAGIC = b"\xd3BLK"
DEPTH = 1000
# Array types of the format.
KINDS = {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float16": "f2", "float32": "f4", "float64": "f8"}
CODECS = {b"\0\0\0\0": None, b"zlib": "zlib", b"zstd": "zstd", b"lz4\0": "lz4"}


class Node:
    """A tree node: its tag and a str, a list of nodes or a list of (key, node) pairs; ``plain`` scalars are typed by their text."""

    __slots__ = ("plain", "tag", "value")

    def __init__(self, value: object, tag: str = "", plain: bool = False):
        self.value, self.tag, self.plain = value, tag, plain

    def get(self, key: str) -> Node | None:
        return next((v for k, v in self.value if k.value == key), None) if isinstance(self.value, list) and self.value and isinstance(self.value[0], tuple) else None

    def typed(self) -> object:
        return scalar(self.value) if self.plain and not self.tag else self.value


INT = re.compile(r"[-+]?(0b[01_]+|0[0-7_]+|0|[1-9][0-9_]*|0x[0-9a-fA-F_]+|[1-9][0-9_]*(:[0-5]?\d)+)")
FLOAT = re.compile(r"[-+]?([0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9][0-9_]*([eE][-+][0-9]+)?|[0-9][0-9_]*(:[0-5]?\d)+\.[0-9_]*|\.(inf|Inf|INF))|\.(nan|NaN|NAN)")


def scalar(text: str) -> object:
    """A plain scalar by YAML 1.1: null and truth words, integers of four bases and base 60, floats with a point."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("yes", "true", "on", "no", "false", "off") and text in (text.lower(), text.upper(), text.capitalize()):
        return text.lower() in ("yes", "true", "on")
    if INT.fullmatch(text):
        sign, t = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        if ":" in t:
            n = 0
            for part in t.split(":"):
                n = 60 * n + int(part)
            return sign * n
        base = {"0b": 2, "0x": 16}.get(t[:2])
        return sign * (int(t[2:], base) if base else int(t, 8 if t[0] == "0" and len(t) > 1 else 10))
    if FLOAT.fullmatch(text):
        t = text.replace("_", "").lower()
        if "inf" in t:
            return float("-inf" if t[0] == "-" else "inf")
        if "nan" in t:
            return float("nan")
        if ":" in t:
            n = 0.0
            for part in t.lstrip("+-").split(":"):
                n = 60 * n + float(part)
            return -n if t[0] == "-" else n
        return float(t)
    return text


class _Parser:
    """A reader of one document, by indentation."""

    def __init__(self, text: str):
        self.lines: list[tuple[int, str]] = []
        self.handles = {"!": "!", "!!": "tag:yaml.org,2002:"}
        self.anchors: dict[str, Node] = {}
        body, started = [], False
        for line in text.split("\n"):
            line = line.rstrip("\r")
            if line.startswith("%TAG"):
                _, handle, prefix = line.split()
                self.handles[handle] = prefix
            elif line.startswith(("%", "#ASDF")) and not started:
                continue
            elif line.startswith("---"):
                if started:
                    break
                started = True
                body.append(line[3:])
            elif line.startswith("..."):
                break
            else:
                started = started or bool(line.strip()) and not line.startswith("#")
                body.append(line)
        self.lines = [(len(x) - len(x.lstrip(" ")), x) for x in body]
        self.at = 0

    def skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at][1].strip() or self.lines[self.at][1].lstrip().startswith("#")):
            self.at += 1

    def document(self) -> Node:
        self.skip()
        return self.block(-1, 0) if self.at < len(self.lines) else Node("", plain=True)

    def props(self, text: str) -> tuple[str, str, str]:
        """(tag, anchor, rest)."""
        tag = anchor = ""
        while m := re.match(r"\s*(?:!<([^>]*)>|(!(?:[\w-]*!)?)([^\s,\[\]{}]*)|&([A-Za-z0-9_-]+))(?=\s|$|[,\[\]{}])", text):
            if m[4]:
                anchor = m[4]
            elif m[1] is not None:
                tag = m[1]
            else:
                if m[2] not in self.handles:
                    raise ValueError(f"unknown tag handle {m[2]}")
                tag = self.handles[m[2]] + re.sub("%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[3])
            text = text[m.end() :]
        return tag, anchor, text.strip()

    def keep(self, node: Node, tag: str, anchor: str) -> Node:
        node.tag = tag or node.tag
        if anchor:
            self.anchors[anchor] = node
        return node

    def alias(self, name: str) -> Node:
        if name not in self.anchors:
            raise ValueError(f"unknown alias {name}")
        return self.anchors[name]

    def block(self, parent: int, depth: int) -> Node:
        """The node at the present line, whose indentation is above ``parent``."""
        if depth > DEPTH:
            raise ValueError("the tree is too deep")
        indent, line = self.lines[self.at]
        return self.node(line.strip(), indent, parent, depth, indent)

    def node(self, text: str, indent: int, parent: int, depth: int, column: int) -> Node:
        """``text`` is what stands from ``column`` on in the present line."""
        tag, anchor, rest = self.props(text)
        if not rest or rest.startswith("#"):
            self.at += 1
            self.skip()
            if self.at < len(self.lines):
                below, line = self.lines[self.at]
                sequence = line.lstrip().startswith("- ") or line.strip() == "-"
                if below > parent or sequence and below == parent and parent >= 0:
                    return self.keep(self.block(below - 1 if sequence else parent, depth + 1), tag, anchor)
            return self.keep(Node("", plain=True), tag, anchor)
        if rest[0] == "*" and ":" not in rest:
            self.at += 1
            return self.alias(rest[1:].split()[0])
        if rest[0] in "|>" and re.match(r"[|>][-+0-9]*\s*(#.*)?$", rest):
            return self.keep(self.long_text(rest, parent), tag, anchor)
        if rest.startswith("- ") or rest == "-":
            return self.keep(self.sequence(column + len(text) - len(rest), depth), tag, anchor)
        if rest[0] in "[{\"'":
            end = self.flow_end(rest)
            if end is None or not rest[end:].lstrip().startswith(":"):
                joined = self.gather(rest)
                node, at = self.flow(joined, 0, depth)
                return self.keep(node, tag, anchor)
        if self.key(rest) is not None:
            at = column + len(text) - len(rest)
            if tag or anchor:
                inner, _, _ = self.props(text)
                return self.mapping(column, depth, text)
            return self.mapping(at, depth, rest)
        self.at += 1
        parts = [re.sub(r"\s+#.*$", "", rest)]
        while self.at < len(self.lines) and self.lines[self.at][1].strip() and self.lines[self.at][0] > parent and not self.lines[self.at][1].lstrip().startswith("#"):
            parts.append(re.sub(r"\s+#.*$", "", self.lines[self.at][1].strip()))
            self.at += 1
        return self.keep(Node(" ".join(parts), plain=True), tag, anchor)

    @staticmethod
    def key(text: str) -> int | None:
        """Where the colon of ``key: value`` stands."""
        if text[0] in "\"'":
            m = re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", text)
            return m.end() if m and re.match(r":(\s|$)", text[m.end() :]) else None
        m = re.search(r":(\s|$)", text)
        return m.start() if m and "#" not in text[: m.start()] else None

    def mapping(self, column: int, depth: int, first: str) -> Node:
        out: list[tuple[Node, Node]] = []
        text = first
        while True:
            tag, anchor, rest = self.props(text)
            colon = self.key(rest)
            if colon is None:
                raise ValueError(f"not a mapping entry: {text[:60]}")
            name = rest[:colon]
            key = self.keep(self.flow(name, 0, depth)[0] if name[0] in "\"'" else Node(name.strip(), plain=True), tag, anchor)
            out.append((key, self.node(rest[colon + 1 :].strip(), column, column, depth + 1, column + len(text) - len(rest) + colon + 1)))
            self.skip()
            if self.at >= len(self.lines) or self.lines[self.at][0] != column:
                return Node(out)
            text = self.lines[self.at][1].strip()
            if text.startswith("- "):
                return Node(out)

    def sequence(self, column: int, depth: int) -> Node:
        out: list[Node] = []
        while self.at < len(self.lines):
            indent, line = self.lines[self.at]
            here = line[column:] if len(line) > column else ""
            if not (here.startswith("- ") or here.rstrip() == "-") or out and indent != column:
                break
            rest = here[1:]
            inner = column + 1 + len(rest) - len(rest.lstrip())
            self.lines[self.at] = (inner, " " * inner + rest.strip())
            out.append(self.node(rest.strip(), inner, column, depth + 1, inner))
            self.skip()
        return Node(out)

    def long_text(self, mark: str, parent: int) -> Node:
        self.at += 1
        lines = []
        while self.at < len(self.lines) and (not self.lines[self.at][1].strip() or self.lines[self.at][0] > parent):
            lines.append(self.lines[self.at][1])
            self.at += 1
        indent = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        text = "\n".join(x[indent:] for x in lines)
        if mark[0] == ">":
            text = re.sub(r"(?<!\n)\n(?!\n)(?=\S)", " ", text)
        text = text.rstrip("\n")
        return Node(text if "-" in mark else text + "\n")

    def flow_end(self, text: str) -> int | None:
        try:
            return self.flow(text, 0, 0)[1]
        except (ValueError, IndexError):
            return None

    def gather(self, text: str) -> str:
        """The lines of a flow value, joined."""
        self.at += 1
        while self.flow_end(text) is None and self.at < len(self.lines):
            text += " " + self.lines[self.at][1].strip()
            self.at += 1
        return text

    def flow(self, text: str, at: int, depth: int) -> tuple[Node, int]:
        if depth > DEPTH:
            raise ValueError("the tree is too deep")
        while at < len(text) and text[at] in " \t":
            at += 1
        m = re.match(r"(?:(?:!<[^>]*>|![^\s,\[\]{}]*|&[A-Za-z0-9_-]+)\s+)+", text[at:])
        tag = anchor = ""
        if m:
            tag, anchor, _ = self.props(m[0])
            at += m.end()
        c = text[at]
        if c == "*":
            m = re.match(r"\*([A-Za-z0-9_-]+)", text[at:])
            return self.alias(m[1]), at + m.end()
        if c in "[{":
            out, at = [], at + 1
            while True:
                while text[at] in " \t,":
                    at += 1
                if text[at] in "]}":
                    return self.keep(Node(out), tag, anchor), at + 1
                node, at = self.flow(text, at, depth + 1)
                if c == "{":
                    while text[at] in " \t":
                        at += 1
                    if text[at] == ":":
                        value, at = self.flow(text, at + 1, depth + 1)
                    else:
                        value = Node("", plain=True)
                    out.append((node, value))
                else:
                    out.append(node)
        if c == '"':
            m = re.match(r'"((?:[^"\\]|\\.)*)"', text[at:])
            names = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}
            value = re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda x: chr(int(x[1][1:], 16)) if len(x[1]) > 1 else names.get(x[1], x[1]), m[1])
            return self.keep(Node(value), tag, anchor), at + m.end()
        if c == "'":
            m = re.match(r"'((?:[^']|'')*)'", text[at:])
            return self.keep(Node(m[1].replace("''", "'")), tag, anchor), at + m.end()
        m = re.match(r"(?:[^,\[\]{}:#]|:(?=\S)(?![,\[\]{}])|(?<=\S)#)+", text[at:])
        if not m:
            raise ValueError(f"not read: {text[at : at + 40]}")
        return self.keep(Node(m[0].strip(), plain=True), tag, anchor), at + m.end()


def parse(text: str) -> Node:
    return _Parser(text).document()


def as_json(node: Node, depth: int = 0) -> object:
    """The tree as plain JSON values: tagged nodes and mappings as objects of ``t`` and ``m``, floats that JSON lacks as text in ``f``."""
    if depth > DEPTH:
        raise ValueError("the tree is too deep")
    if isinstance(node.value, list):
        if node.value and isinstance(node.value[0], tuple):
            out: object = {"m": [[as_json(k, depth + 1), as_json(v, depth + 1)] for k, v in node.value]}
        else:
            out = [as_json(x, depth + 1) for x in node.value]
    else:
        out = node.typed()
        if isinstance(out, float):
            out = {"f": format_double(out)}
    if node.tag:
        out = {"t": node.tag} | (out if isinstance(out, dict) else {"v": out})
    return out


def tree_text(uri: str) -> str:
    at, out = 0, b""
    while True:
        piece = read_range(uri, at, 1 << 20)
        out += piece
        end = re.search(rb"\n\.\.\.\r?(\n|\Z)", out)
        if end:
            return out[: end.end()].decode("utf-8")
        if not piece:
            return out.split(MAGIC)[0].decode("utf-8")
        at += len(piece)


def blocks(uri: str) -> list[dict]:
    """Where each block lies and how it is stored; the last one may be open at its end."""
    system, path = place(uri)
    size, at, out = system.get_file_info(path).size, len(tree_text(uri).encode()), []
    start = read_range(uri, at, 4096).find(MAGIC)
    at = size if start < 0 else at + start
    while at + 6 <= size and read_range(uri, at, 4) == MAGIC:
        length = struct.unpack(">H", read_range(uri, at + 4, 2))[0]
        head = read_range(uri, at + 6, length)
        if len(head) < 48:
            raise ValueError("the file ends inside a block's header")
        flags, codec, allocated, used, raw = struct.unpack(">I4sQQQ", head[:32])
        begin = at + 6 + length
        if flags & 1:
            allocated = used = raw = size - begin
        if begin + used > size:
            raise ValueError("the file ends inside a block")
        out.append({"codec": codec, "offset": begin, "used": used, "raw": raw, "md5": head[32:48]})
        at = begin + allocated
    return out


def block(uri: str, b: dict) -> bytes:
    """A block's content; its MD5 may be that of the stored or of the decoded bytes."""
    data = read_range(uri, b["offset"], b["used"])
    if b["codec"] not in CODECS:
        raise ValueError(f"compression {b['codec'].decode('ascii', 'replace')} is not read")
    codec = CODECS[b["codec"]]
    if codec == "lz4":  # pieces, each behind its stored length and its raw length in front of the data
        parts, at = [], 0
        while at < len(data):
            n, raw = struct.unpack(">I", data[at : at + 4])[0], struct.unpack("<I", data[at + 4 : at + 8])[0]
            parts.append(decompress(data[at + 8 : at + 4 + n], "lz4", raw))
            at += 4 + n
        out = b"".join(parts)
        if len(out) != b["raw"]:
            raise ValueError("a block has another size than it says")
    else:
        out = decompress(data, codec, b["raw"]) if codec else data
    sums = {hashlib.md5(x, usedforsecurity=False).digest() for x in (data, out)}
    if b["md5"] != bytes(16) and b["md5"] not in sums:
        raise ValueError("checksum mismatch")
    return out


def arrays(uri: str) -> Iterator[tuple[str, Node]]:
    """(path, node) of the tree's arrays, each node once."""
    seen: set[int] = set()

    def walk(node: Node, path: str) -> Iterator[tuple[str, Node]]:
        if id(node) in seen or not isinstance(node.value, list):
            return
        seen.add(id(node))
        if "/core/ndarray-" in node.tag:
            yield path, node
        for i, x in enumerate(node.value):
            key, child = (str(x[0].value), x[1]) if isinstance(x, tuple) else (f"[{i}]", x)
            yield from walk(child, f"{path}{'' if key[0] == '[' or not path else '.'}{key}")

    yield from walk(parse(tree_text(uri)), "")


def images(uri: str) -> list[dict]:
    """Facts of the arrays that are images: two axes, or three as channels first, or last if that is what sizes say; leading axes of one drop."""
    out, known = [], blocks(uri)
    for name, node in arrays(uri):
        shape, kind, source = node.get("shape"), node.get("datatype"), node.get("source")
        if shape is None or kind is None or source is None or kind.value not in KINDS or node.get("mask"):
            continue
        axes = [scalar(x.value) for x in shape.value]
        number, offset = scalar(source.value), node.get("offset")
        if not isinstance(number, int) or not all(isinstance(a, int) and a > 0 for a in axes) or not -len(known) <= number < len(known):
            continue
        while len(axes) > 2 and axes[0] == 1:
            axes = axes[1:]
        if len(axes) not in (2, 3) or node.get("strides"):
            continue
        last = len(axes) == 3 and axes[2] <= 4 < axes[0] and "fits" not in name
        h, w, c = (axes[0], axes[1], axes[2]) if last else (axes[-2], axes[-1], axes[0] if len(axes) == 3 else 1)
        order = node.get("byteorder")
        out.append({"image": len(out), "name": name, "height": h, "width": w, "channels": c, "last": last, "kind": ("<" if order is not None and order.value == "little" else ">") + KINDS[kind.value], "block": known[number], "offset": scalar(offset.value) if offset else 0})
    return out


def samples(uri: str, facts: dict) -> np.ndarray:
    raw = block(uri, facts["block"])[facts["offset"] :]
    n = facts["height"] * facts["width"] * facts["channels"]
    flat = np.frombuffer(raw[: n * np.dtype(facts["kind"]).itemsize], facts["kind"])
    if len(flat) != n:
        raise ValueError("an array goes beyond its block")
    if facts["last"]:
        return flat.reshape(facts["height"], facts["width"], facts["channels"]).transpose(2, 0, 1)
    return flat.reshape(facts["channels"], facts["height"], facts["width"])


ENDINGS = (".asdf",)


def image_rows(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[tuple]:
        for f in images(uri):
            yield uri, f["image"], f["name"], f["width"], f["height"], f["channels"], f["kind"][1:]

    return _over_files(spark, path, read, "path string, image int, name string, width bigint, height bigint, channels int, kind string", ENDINGS)


def bands(spark: SparkSession, path: str) -> DataFrame:
    def read(uri: str) -> Iterator[pa.RecordBatch]:
        for f in images(uri):
            planes = samples(uri, f)
            step = max(1, (1 << 20) // f["width"])
            for c in range(f["channels"]):
                for y in range(0, f["height"], step):
                    yield band_batch(uri, f["image"], c, y, planes[c, y : y + step])

    return _over_files(spark, path, read, "path string, image int, channel int, y bigint, values array<double>", ENDINGS)


def trees(spark: SparkSession, path: str) -> DataFrame:
    """(path, yaml, json): the header as it stands, and as JSON with aliases expanded."""

    def read(uri: str) -> Iterator[tuple]:
        text = tree_text(uri)
        yield uri, text, json.dumps(as_json(parse(text)), ensure_ascii=False)

    return _over_files(spark, path, read, "path string, yaml string, json string", ENDINGS)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(path, element, ok, problem) of every block; ok is null where a block has no checksum."""

    def read(uri: str) -> Iterator[tuple]:
        try:
            found = blocks(uri)
            parse(tree_text(uri))
        except Exception as error:  # damage is what this reports
            yield uri, "header", False, str(error)
            return
        for i, b in enumerate(found):
            try:
                block(uri, b)
                yield uri, f"block {i}", None if b["md5"] == bytes(16) else True, None
            except Exception as error:
                yield uri, f"block {i}", False, str(error)

    return _over_files(spark, path, read, "path string, element string, ok boolean, problem string", ENDINGS)


def quoted(text: str) -> str:
    """A text as a YAML scalar: plain where that reads back as the same text."""
    if re.fullmatch(r"[A-Za-z_][\w .()/-]*[\w)]|[A-Za-z_]", text) and isinstance(scalar(text), str):
        return text
    return json.dumps(text, ensure_ascii=True)


def encode_all(images_: list[dict], codec: str | None = "zlib", level: int | None = None) -> bytes:
    """A file of images (samples, sample_format, name, keywords, properties) as header-data units in a ``fits`` list, properties in ``xisf``."""
    head, stored = ["#ASDF 1.0.0", "#ASDF_STANDARD 1.5.0", "%YAML 1.1", "%TAG ! tag:stsci.edu:asdf/", "--- !core/asdf-1.1.0", "fits: !fits/fits-1.0.0"], []
    kinds = {"UInt8": "uint8", "UInt16": "uint16", "UInt32": "uint32", "UInt64": "uint64", "Float32": "float32", "Float64": "float64"}
    for image in images_:
        kind = kinds[image["sample_format"]]
        c, h, w = image["samples"].shape
        data = image["samples"].astype("<" + KINDS[kind]).tobytes()
        cards = [*image.get("keywords", []), *([("EXTNAME", f"'{image['name']}'", "")] if image.get("name") else [])]
        head.append("- header:")
        head += [f"  - [{', '.join(quoted(x) for x in (n, v, t))}]" for n, v, t in cards] or ["  - []"]
        shape = f"[{c}, {h}, {w}]" if c > 1 else f"[{h}, {w}]"
        head += ["  data: !core/ndarray-1.0.0", f"    source: {len(stored)}", f"    datatype: {kind}", "    byteorder: little", f"    shape: {shape}"]
        stored.append(data)
    carried = [(i, p) for i, image in enumerate(images_) for p in image.get("properties", [])]
    if carried:
        head.append("xisf:")
        for i, p in carried:
            value = p["value"] if isinstance(p["value"], str) else p["value"].hex() if p.get("block") else p["value"].decode()
            head.append(f"- {{image: {i}, id: {quoted(p['id'])}, type: {quoted(p['type'])}, block: {'true' if p.get('block') else 'false'}, rows: {p.get('rows') or 0}, columns: {p.get('columns') or 0}, value: {json.dumps(value)}}}")
    out = bytearray(("\n".join(head) + "\n...\n").encode())
    for data in stored:
        packed = compress(data, codec, level) if codec else data
        named = codec if codec and len(packed) < len(data) else None
        packed = packed if named else data
        out += MAGIC + struct.pack(">HI4sQQQ", 48, 0, (named or "").encode().ljust(4, b"\0"), len(packed), len(packed), len(data)) + hashlib.md5(packed, usedforsecurity=False).digest() + packed
    index = [m for m in _starts(bytes(out), len(stored))]
    return bytes(out) + ("#ASDF BLOCK INDEX\n%YAML 1.1\n---\n" + "".join(f"- {x}\n" for x in index) + "...\n").encode()


def _starts(data: bytes, count: int) -> Iterator[int]:
    at = data.index(b"\n...\n") + 5
    for _ in range(count):
        yield at
        at += 54 + struct.unpack(">Q", data[at + 14 : at + 22])[0]
