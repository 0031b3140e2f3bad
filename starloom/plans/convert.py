"""The conversion plan: options in, files out; each step a DataFrame transformation in a fixed order.

Inputs are told apart by their first bytes, so a folder may hold any mixture.
The model is the same for all formats: ``images`` (one row an image), ``bands``
(one row a row of samples) and ``keywords``. Every image goes along, under its
own sample format and bounds; outputs keep the tree below the input folder.
"""

from __future__ import annotations

import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import pixels
from starloom.operators import images as im
from starloom.operators import metadata as md
from starloom.sources import asdf, dng, fits, png, tiff, xisf
from starloom.sources.files import detect, listing, save

#: Names of files that are looked for in folders.
ENDINGS = (*fits.ENDINGS, ".xisf", ".xish", ".asdf", ".dng")
FORMATS = ("fits", "xisf", "png", "tif", "asdf")
#: A channel's automatic stretch looks at this many samples at least, evenly spaced, and at all of a smaller one.
STRETCH_SAMPLES = 4 << 20
_BANDS = "path string, image int, channel int, y bigint, values array<double>"
_IMAGES = "path string, image int, name string, width bigint, height bigint, channels int, sample_format string, lower double, upper double, cfa string"


@dataclass(frozen=True)
class Options:
    """What to make: ``to`` fits, xisf, tif, png or asdf; ``stretch`` none, linked or unlinked; rows may be flipped.

    ``image`` picks one image (PNG: the first unless one is picked), else all
    go along. ``debayer`` turns mosaics into colours; ``bin``, ``scale`` and
    ``fit`` make pictures smaller. ``tiled`` compresses FITS, ``codec`` XISF
    and ASDF.
    """

    to: str
    sample_format: str | None = None
    stretch: str | None = None
    flip: bool = False
    codec: str | None = "zstd"
    image: int | None = None
    debayer: bool = False
    bin: int = 1
    scale: float = 1.0
    fit: int | None = None
    tiled: bool = False
    level: int | None = None
    subblocks: int | None = None
    checksum: str | None = "sha-1"
    bounds: tuple[float, float] | None = None

    def check(self) -> None:
        if self.to not in FORMATS:
            raise ValueError(f"unknown output format: {self.to}")
        if self.stretch not in (None, "linked", "unlinked"):
            raise ValueError(f"unknown stretch: {self.stretch}")
        if self.to == "png" and self.sample_format not in (None, "UInt8", "UInt16"):
            raise ValueError("PNG holds UInt8 or UInt16")
        if self.sample_format not in (None, *fits.STORED):
            raise ValueError(f"unknown sample format: {self.sample_format}")
        if self.bin < 1 or not 0 < self.scale <= 1 or self.fit is not None and self.fit < 1:
            raise ValueError("a picture is only made smaller")
        if self.codec is not None and self.codec not in xisf.LEVELS:
            raise ValueError(f"unknown codec: {self.codec}")


@dataclass(frozen=True)
class Collection:
    """The images of some files as tables; ``skipped`` lists what was no image file."""

    images: DataFrame
    bands: DataFrame
    keywords: DataFrame
    root: str
    skipped: tuple[str, ...] = ()


def open_files(spark: SparkSession, path: str) -> Collection:
    """The images below a file, folder, pattern or several of them (one a line), whatever their formats.

    First bytes are read by threads of the driver, headers and samples by tasks.
    """
    fits.register(spark)
    paths = listing(path, ENDINGS)
    with ThreadPoolExecutor(32) as pool:
        kinds = list(pool.map(detect, paths))
    by_kind = {k: "\n".join(p for p, x in zip(paths, kinds, strict=True) if x == k) for k in set(kinds)}
    found = [spark.createDataFrame([], _IMAGES)]
    bands = [spark.createDataFrame([], _BANDS)]
    words = [spark.createDataFrame([], "path string, image int, pos int, name string, value string, comment string")]
    none = F.lit(None)
    if "fits" in by_kind:
        own = spark.read.format("fits_bands").load(by_kind["fits"])
        facts = spark.read.format("fits_images").load(by_kind["fits"])
        words.append(spark.read.format("fits_keywords").load(by_kind["fits"]))
        pattern = words[-1].filter("name = 'BAYERPAT'").groupBy("path", "image").agg(F.first(md.fits_unquote(F.col("value"))).alias("cfa"))
        facts = facts.join(fits.sample_formats(facts, own), ["path", "image"]).join(pattern, ["path", "image"], "left")
        found.append(facts.select("path", "image", "name", "width", "height", "channels", "sample_format", none.cast("double").alias("lower"), none.cast("double").alias("upper"), "cfa"))
        bands.append(own)
    if "xisf" in by_kind:
        found.append(xisf.images(spark, by_kind["xisf"]).select("path", "image", F.col("id").alias("name"), "width", "height", "channels", "sample_format", "lower", "upper", "cfa"))
        bands.append(xisf.bands(spark, by_kind["xisf"]))
        words.append(_xisf_keywords(spark, by_kind["xisf"]))
    if "asdf" in by_kind:
        own = asdf.bands(spark, by_kind["asdf"])
        facts = asdf.image_rows(spark, by_kind["asdf"])
        found.append(facts.join(_signs(own), ["path", "image"]).select("path", "image", "name", "width", "height", "channels", _asdf_format(F.col("kind"), F.col("negative")).alias("sample_format"), none.cast("double").alias("lower"), none.cast("double").alias("upper"), none.cast("string").alias("cfa")))
        bands.append(own)
    if "dng" in by_kind:
        found.append(dng.image_rows(spark, by_kind["dng"]).select("path", "image", "name", "width", "height", "channels", "sample_format", none.cast("double").alias("lower"), none.cast("double").alias("upper"), "cfa"))
        bands.append(dng.bands(spark, by_kind["dng"]))
    return Collection(_all(found), _all(bands), _all(words), _root(path, paths), tuple(p for p, k in zip(paths, kinds, strict=True) if k is None))


def _root(path: str, paths: list[str]) -> str:
    """The folder below which outputs keep their tree: the one given, else what all inputs have in common."""
    if len(paths) == 1 or "\n" in path or re.search(r"[*?]", path):
        return os.path.commonprefix([p.rsplit("/", 1)[0] + "/" for p in paths]).rsplit("/", 1)[0] if paths else ""
    return path


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _signs(bands: DataFrame) -> DataFrame:
    return bands.groupBy("path", "image").agg(F.bool_or(F.exists("values", lambda v: v < 0)).alias("negative"))


def _asdf_format(kind: Column, negative: Column) -> Column:
    """Signed integers without negatives are unsigned; with them floats that hold them."""
    out = F.when(kind == "f2", "Float32").when(kind == "f4", "Float32").when(kind == "f8", "Float64")
    for bits in (8, 16, 32, 64):
        size = str(bits // 8)
        out = out.when((kind == f"u{size}") | (kind == f"i{size}") & ~negative, f"UInt{bits}").when(kind == f"i{size}", "Float32" if bits <= 16 else "Float64")
    return out


def _xisf_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Stored keywords, and behind them those that properties give where none of the name is stored."""
    stored = xisf.keywords(spark, path)
    key = F.struct("path", "image")
    props = xisf.properties(spark, path).filter("image >= 0").select(key.alias("k"), "id", "text")
    made = md.derive_keywords(props, stored.select(key.alias("k"), "name"), "k")
    made = made.select("k.path", "k.image", F.lit(1 << 20).alias("pos"), "name", "value", F.lit("").alias("comment"))
    return stored.unionByName(made)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Bands of the image files at ``path``."""
    return open_files(spark, path).bands


def image_bounds(images: DataFrame, bands: DataFrame, given: tuple[float, float] | None = None) -> DataFrame:
    """``images`` with bounds for every float image: its own, else those asked for, else what its finite samples suggest."""
    fine = F.filter("values", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    # In a row of samples first: what is shuffled are two numbers a row, merged before the shuffle.
    ends = bands.select("path", "image", F.array_min(fine).alias("a"), F.array_max(fine).alias("b"))
    ranges = ends.groupBy("path", "image").agg(F.coalesce(F.min("a"), F.lit(0.0)).alias("lower"), F.coalesce(F.max("b"), F.lit(0.0)).alias("upper"))
    open_ = images.filter(F.col("sample_format").startswith("Float") & F.col("lower").isNull()).select("path", "image")
    if given is None:
        found = im.float_bounds(ranges.join(open_, ["path", "image"], "left_semi")).select("path", "image", "bound_low", "bound_high")
    else:
        found = open_.select("path", "image", F.lit(float(given[0])).alias("bound_low"), F.lit(float(given[1])).alias("bound_high"))
    top = F.lit(1.0)
    for name, value in pixels.MAXIMA.items():
        top = F.when(F.col("sample_format") == name, float(value)).otherwise(top)
    return images.join(found, ["path", "image"], "left").withColumn("lower", F.coalesce("lower", "bound_low", F.lit(0.0))).withColumn("upper", F.coalesce("upper", "bound_high", top)).drop("bound_low", "bound_high")


def _per_format(source: Column, make) -> Column:
    """``make(format)`` for each row's own sample format."""
    out = None
    for name in fits.STORED:
        out = F.when(source == name, make(name)) if out is None else out.when(source == name, make(name))
    return out


def _normalised(v: Column) -> Column:
    lo, hi = F.col("lower"), F.col("upper")
    return F.when(hi > lo, (v - lo) * (1.0 / (hi - lo))).otherwise(v)


def _converted(source: Column, target: str | None) -> Column:
    def one(name: str) -> Column:
        to = target or name
        if name.startswith("Float") and to.startswith("UInt"):
            return F.transform("values", lambda v: pixels.convert(_normalised(v), "Float64", to))
        return F.transform("values", lambda v: pixels.convert(v, name, to))

    return _per_format(source, one)


def stretch_parameters(rows: DataFrame, linked: bool) -> DataFrame:
    """(path, image, channel, s, mid, h) from the medians of evenly spaced samples of the rows ``(..., width, height, lower, upper)``."""
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("width") * F.col("height") / F.lit(STRETCH_SAMPLES)))
    picked = F.filter("values", lambda v, i: (F.col("y") * F.col("width") + i) % step == 0)
    x = F.transform(picked, lambda v: _normalised(v).cast("float").cast("double"))
    v = rows.select("path", "image", "channel", F.explode(x).alias("x"))
    med = v.groupBy("path", "image", "channel").agg(F.median("x").alias("m"))
    dev = v.join(med, ["path", "image", "channel"])
    dev = dev.groupBy("path", "image", "channel", "m").agg((1.4826 * F.median(F.abs(F.col("x") - F.col("m")).cast("float").cast("double"))).alias("d"))
    if linked:
        dev = dev.select("path", "image", "channel").join(dev.groupBy("path", "image").agg(F.avg("m").alias("m"), F.avg("d").alias("d")), ["path", "image"])
    s, mid, h = pixels.stretch_params(F.col("m"), F.col("d"))
    return dev.select("path", "image", "channel", s.alias("s"), mid.alias("mid"), h.alias("h"))


def transformed(files: Collection, options: Options) -> tuple[DataFrame, DataFrame]:
    """(images, rows) after debayering, shrinking, stretching, conversion and flipping, in this order."""
    options.check()
    chosen = files.images if options.image is None and options.to != "png" else files.images.filter(F.col("image") == (options.image or 0))
    facts = image_bounds(chosen, files.bands, options.bounds)
    rows = files.bands.join(facts.select("path", "image", "width", "height", "channels", "sample_format", "lower", "upper", "cfa"), ["path", "image"])
    if options.debayer:
        mosaic = (F.col("channels") == 1) & F.col("cfa").rlike("^[RGB]{4}$") & F.col("cfa").contains("R") & F.col("cfa").contains("G") & F.col("cfa").contains("B") & (F.col("width") > 1) & (F.col("height") > 1)
        is_mosaic = F.coalesce(mosaic, F.lit(False))
        made = []
        for whole in (True, False):
            raw = rows.filter(is_mosaic & (~F.col("sample_format").startswith("Float") if whole else F.col("sample_format").startswith("Float")))
            keys = ["path", "image", "width", "height", "sample_format", "lower", "upper", "cfa"]
            colours = im.debayer_rows(raw, keys, F.col("cfa"), whole)
            planes = F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias("values")) for i, c in enumerate(("red", "green", "blue"))))
            made.append(colours.select(*keys, "y", F.inline(planes)).withColumn("channels", F.lit(3)))
        rows = _all([rows.filter(~is_mosaic), *made])
        facts = facts.withColumn("channels", F.when(is_mosaic, 3).otherwise(F.col("channels")))
    if options.bin > 1 or options.scale < 1 or options.fit:
        smaller = lambda n: _smaller(F.col(n), options)
        keys = ["path", "image", "channel", "channels", "sample_format", "lower", "upper", "cfa", "width", "height"]
        rows = im.downsample_rows(rows, keys, F.col("height"), F.col("width"), smaller("height"), smaller("width"))
        round_ = F.transform("values", lambda v: F.floor(v + 0.5).cast("double"))
        rows = rows.withColumn("values", F.when(F.col("sample_format").startswith("UInt"), round_).otherwise(F.col("values")))
        rows = rows.withColumn("width", smaller("width")).withColumn("height", smaller("height"))
        facts = facts.withColumn("width", smaller("width")).withColumn("height", smaller("height"))
    source = F.col("sample_format")
    if options.stretch:
        params = stretch_parameters(rows, options.stretch == "linked")
        shown = F.transform("values", lambda v: pixels.stretch(_normalised(v), F.col("s"), F.col("mid"), F.col("h"), F.lit(0.0), F.lit(1.0)))
        rows = rows.join(params, ["path", "image", "channel"]).withColumn("values", shown).drop("s", "mid", "h")
        rows = rows.withColumn("sample_format", F.lit("Float32")).withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(1.0))
        facts = facts.withColumn("sample_format", F.lit("Float32")).withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(1.0))
    target = options.sample_format
    if options.to == "png":
        kept = F.when(source.isin("UInt8", "UInt16") & F.lit(target is None), source).otherwise(target or "UInt8")
        rows = rows.withColumn("values", F.when(kept == "UInt16", _converted(source, "UInt16")).otherwise(_converted(source, "UInt8")))
        facts = facts.withColumn("sample_format", F.when(F.col("sample_format").isin("UInt8", "UInt16") & F.lit(target is None), F.col("sample_format")).otherwise(target or "UInt8"))
    else:
        rows = rows.withColumn("values", _converted(source, target))
        facts = facts.withColumn("sample_format", F.coalesce(F.lit(target), "sample_format"))
    if options.flip:
        rows = rows.withColumn("y", F.col("height") - 1 - F.col("y"))
    return facts, rows.select("path", "image", "channel", "y", "values")


def _smaller(n: Column, options: Options) -> Column:
    """Binned first, then scaled, then fitted; never enlarged, never 0."""
    out = F.greatest(F.lit(1).cast("bigint"), F.floor(n / F.lit(options.bin)))
    if options.scale < 1:
        out = F.least(out, F.greatest(F.lit(1).cast("bigint"), F.floor(out * options.scale + 0.5)))
    return F.least(out, F.lit(options.fit).cast("bigint")) if options.fit else out


def below(path: Column, root: str) -> Column:
    """The path from ``root`` on; the bare name of what does not lie below it."""
    rest = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/+", "") if root else path
    return F.when(rest == path, F.regexp_replace(path, "^.*/", "")).otherwise(rest)


def output_name(path: Column, root: str, to: str, tiled: bool = False) -> Column:
    """The path below the input folder with the format's own ending; of single files their name."""
    name = below(path, root)
    ending = {"fits": ".fits.fz" if tiled else ".fits"}.get(to, f".{to}")
    return F.concat(F.regexp_replace(name, r"(?i)(\.fits\.fz|\.[^./]*)$", ""), F.lit(ending))


def convert_files(files: Collection, options: Options) -> DataFrame:
    """(source, path, content): an output for each input file; a file is built by one task.

    Two inputs that differ only in their ending would give one output; the
    first by name does, and the others keep their whole name before the ending.
    """
    facts, rows = transformed(files, options)
    words = files.keywords.filter(~md.is_reserved(F.col("name")) & ~F.col("name").rlike("^(EXTNAME|HDUNAME|CONTINUE|LONGSTRN|Z[A-Z0-9]+|T(TYPE|FORM|FIELDS|HEAP)[0-9]*)$"))
    listed = words.groupBy("path", "image").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("comment", F.lit("")).alias("comment")))), lambda k: F.array(k["name"], k["value"], k["comment"]))).alias("words"))
    named = facts.select("path", output_name(F.col("path"), files.root, options.to, options.tiled).alias("out")).distinct()
    first = named.groupBy("out").agg(F.min("path").alias("first"))
    named = named.join(first, "out").select("path", F.when(F.col("path") == F.col("first"), F.col("out")).otherwise(F.concat(below(F.col("path"), files.root), F.regexp_extract("out", r"(\.fits\.fz|\.[^.]*)$", 1))).alias("out"))
    meta = facts.join(listed, ["path", "image"], "left").select("path", "image", F.lit(-1).alias("channel"), F.lit(-1).cast("bigint").alias("y"), F.lit(None).cast("array<double>").alias("values"), F.to_json(F.struct("name", "sample_format", "lower", "upper", "channels", "height", "width")).alias("facts"), "words")
    every = rows.withColumn("facts", F.lit(None).cast("string")).withColumn("words", F.lit(None).cast("string")).unionByName(meta).join(named, "path")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("image", "ascending"), ("channel", "ascending"), ("y", "ascending")])
        numbers, channels = table["image"].to_numpy(), table["channel"].to_numpy()
        made = []
        for n in np.unique(numbers):
            where = np.flatnonzero(numbers == n)
            part = table.slice(int(where[0]), len(where))
            own = json.loads(part["facts"][0].as_py())
            words = json.loads(part["words"][0].as_py() or "[]")
            count = int((channels[where] >= 0).sum())
            if count != own["channels"] * own["height"]:
                raise ValueError(f"{part['path'][0].as_py()}: image {n} has {count} of {own['channels'] * own['height']} rows")
            column = part.slice(len(where) - count)["values"].combine_chunks()
            samples = column.flatten().to_numpy().reshape(own["channels"], own["height"], own["width"])
            made.append({"samples": samples, "sample_format": own["sample_format"], "name": own.get("name") or "", "bounds": (own.get("lower", 0.0), own.get("upper", 1.0)), "keywords": [tuple(w) for w in words]})
        content = encoded(made, options)
        return pa.table({"source": [table["path"][0].as_py()], "path": [table["out"][0].as_py()], "content": pa.array([content], pa.large_binary() if len(content) > 1 << 31 else pa.binary())})

    return every.groupBy("path").applyInArrow(run, "source string, path string, content binary")


def encoded(images: list[dict], options: Options) -> bytes:
    if options.to == "fits":
        return fits.encode_all(images, options.tiled)
    if options.to == "xisf":
        return xisf.encode_all(images, options.codec, options.level, options.subblocks, options.checksum)
    if options.to == "asdf":
        return asdf.encode_all(images, options.codec if options.codec in ("zlib", "zstd") else None, options.level)
    if options.to == "tif":
        return tiff.encode_pages(images)
    first = images[0]
    planes = first["samples"][: len(first["samples"]) if len(first["samples"]) in (1, 2, 3, 4) else 1]
    return png.encode(planes.astype("u1" if first["sample_format"] == "UInt8" else "u2"))


def convert(bands: DataFrame, options: Options, lower: float = 0.0, upper: float = 1.0, source: str = "Float32") -> DataFrame:
    """(path, content) of all images of ``bands(path, image, channel, y, values)``, which have one format and bounds."""
    spark = bands.sparkSession
    options.check()
    facts = bands.groupBy("path", "image").agg(F.max(F.size("values")).cast("bigint").alias("width"), (F.max("y") + 1).cast("bigint").alias("height"), (F.max("channel") + 1).cast("int").alias("channels"))
    facts = facts.select("path", "image", F.lit("").alias("name"), "width", "height", "channels", F.lit(source).alias("sample_format"), F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper"), F.lit(None).cast("string").alias("cfa"))
    none = spark.createDataFrame([], "path string, image int, pos int, name string, value string, comment string")
    return convert_files(Collection(facts, bands, none, ""), options).select("path", "content")


def convert_to(spark: SparkSession, path: str, directory: str, options: Options) -> DataFrame:
    """Reads, converts and writes; (path, bytes) of what was written."""
    options.check()
    return save(convert_files(open_files(spark, path), options).select("path", "content"), directory)
