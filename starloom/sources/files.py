"""Files behind any URI, on executors as on the driver; and finished files put in place whole."""

from __future__ import annotations

import atexit
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_range(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


def listing(uri: str, endings: tuple[str, ...]) -> list[str]:
    """The file itself, or a folder's files of those endings, sorted; hidden names are passed over.

    Several inputs stand one a line; patterns know only ``*`` and ``?``. What
    is mentioned twice counts once, at its first place.
    """
    out: dict[str, None] = {}
    for one in uri.split("\n"):
        system, path = place(one)
        head = one[: len(one) - len(path)]
        if ("*" in path or "?" in path) and system.get_file_info(path).type == fs.FileType.NotFound:
            out |= dict.fromkeys(head + x for x in _matching(system, path, endings))
            continue
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            out[one] = None
            continue
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        names = (x for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith(endings) and not any(p.startswith(".") for p in x.path[len(path) :].split("/")))
        out |= dict.fromkeys(sorted(head + x.path for x in names))
    return list(out)


def _matching(system: fs.FileSystem, pattern: str, endings: tuple[str, ...]) -> list[str]:
    """The files, and in matching folders the files of those endings; a leading dot must be given."""
    parts, found = pattern.split("/"), [""]
    for i, part in enumerate(parts):
        if "*" not in part and "?" not in part:
            found = [f"{f}/{part}" if i else part for f in found]
            continue
        test = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in part), re.S)
        inside = (x for f in found for x in system.get_file_info(fs.FileSelector(f or "/", allow_not_found=True)))
        found = [x.path for x in inside if test.fullmatch(x.base_name) and (x.base_name[0] != "." or part[0] == ".")]
    out = []
    for f in sorted(found):
        kind = system.get_file_info(f).type
        out += [f] if kind == fs.FileType.File else listing(f, endings) if kind == fs.FileType.Directory else []
    return out


def detect(uri: str) -> str | None:
    """fits, asdf, dng or xisf by the first bytes; None for anything else."""
    start = read_range(uri, 0, 1 << 16)
    if start.startswith(b"SIMPLE  ="):
        return "fits"
    if start.startswith(b"#ASDF"):
        return "asdf"
    if start[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if start[:2] == b"II" else ">"
        at = struct.unpack(order + "I", start[4:8])[0]
        count = struct.unpack(order + "H", read_range(uri, at, 2).ljust(2, b"\0"))[0]
        entries = read_range(uri, at + 2, 12 * count)
        tags = {struct.unpack(order + "H", entries[i : i + 2])[0] for i in range(0, len(entries) - 11, 12)}
        return "dng" if 50706 in tags else None
    return "xisf" if start[:8] == b"XISF0100" or re.search(rb"<(?:[A-Za-z_][\w.-]*:)?xisf[\s>/]", start) else None


def save(files: DataFrame, directory: str) -> DataFrame:
    """Writes ``files(path, content)`` below a directory, each under another name first; returns (path, bytes).

    A name that is renamed into place is complete, so a task that is run again
    only writes the same file once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = place(f"{directory}/{name}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(content)
                system.move(part, path)
                out.append((f"{directory}/{name}", len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes bigint")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; only where none is named and all is one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:/tmp/checkpoints/starloom-files"
    return found.rstrip("/")


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def close() -> None:
        system, path = place(folder)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)

    atexit.register(close)
    return folder
