"""Queries that write files of the engine's formats into the shared folder and read them back, each with its SQL twin.

Vectors are 8x8 Float32 images, up to 4096 of a label in a file, so no file and
no task grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import images as im
from starloom.plans.convert import Collection, Options, convert_files, open_files
from starloom.sources import asdf, fits, xisf
from starloom.sources.files import detect, listing, save, workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
IMAGES_A_FILE = 4096

_PX = "px AS (SELECT vec_id AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"
_SAMPLES = f"WITH {_PX} SELECT CAST(image AS VARCHAR) AS name, CAST(y AS BIGINT) AS y, CAST(x AS INT) AS x, v FROM px"
_U16 = f"WITH {_PX} SELECT CAST(image AS VARCHAR) AS name, CAST(y AS BIGINT) AS y, CAST(x AS INT) AS x, CASE WHEN (v + 1e0) / 2e0 <= 0 THEN 0e0 WHEN (v + 1e0) / 2e0 > 1 THEN 65535e0 ELSE floor((v + 1e0) / 2e0 * 65535e0 + 0.5e0) END AS v FROM px"


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _collection(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> Collection:
    """The vectors as image files that are still to be written."""
    vectors = im.vectors_as_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    path = F.concat(F.lit("l"), F.col("channel").cast("string"), F.lit("/"), F.floor(F.col("image") / IMAGES_A_FILE).cast("string"), F.lit(".src"))
    own = vectors.select(path.alias("path"), F.pmod("image", F.lit(IMAGES_A_FILE)).cast("int").alias("image"), F.col("image").cast("string").alias("name"), "values")
    facts = own.select("path", "image", "name", F.lit(8).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height"), F.lit(1).alias("channels"), F.lit("Float32").alias("sample_format"), F.lit(-1.0).alias("lower"), F.lit(1.0).alias("upper"), F.lit(None).cast("string").alias("cfa"))
    rows = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda y: F.struct(y.alias("y"), F.slice("values", (y * 8 + 1).cast("int"), 8).alias("values")))
    bands = own.select("path", "image", F.lit(0).alias("channel"), F.inline(rows))
    if words is None:
        words = spark.createDataFrame([], "path string, image int, pos int, name string, value string, comment string")
    return Collection(facts, bands, words, "/none")


def _write(spark: SparkSession, files: Collection, options: Options, label: str) -> str:
    folder = workspace(spark, label)
    named = convert_files(files, options).select(F.concat(F.regexp_replace(F.regexp_replace("source", "/", "-"), r"\.src$", ""), F.regexp_extract("path", r"(\.fits\.fz|\.[^.]*)$", 1)).alias("path"), "content")
    save(named, folder).count()
    return folder


def _samples(images: DataFrame, bands: DataFrame) -> DataFrame:
    return bands.join(images.select("path", "image", "name"), ["path", "image"]).select("name", "y", F.posexplode("values").alias("x", "v"))


def _fits(spark: SparkSession, folder: str) -> DataFrame:
    fits.register(spark)
    return _samples(spark.read.format("fits_images").load(folder), spark.read.format("fits_bands").load(folder))


def _xisf(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(xisf.images(spark, folder).withColumn("name", F.regexp_replace("id", "^_", "")), xisf.bands(spark, folder))


@_query(_SAMPLES)
def fits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, _write(spark, _collection(spark, sf_dir), Options("fits"), "fits"))


@_query(_U16)
def tiled_fits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted to UInt16, compressed by Rice, and read out of the tiles."""
    return _fits(spark, _write(spark, _collection(spark, sf_dir), Options("fits", sample_format="UInt16", tiled=True), "tiles"))


@_query(f"SELECT * FROM ({_SAMPLES}) WHERE y BETWEEN 2 AND 3")
def fits_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the wanted rows are read: the filter reaches the source."""
    return _fits(spark, _write(spark, _collection(spark, sf_dir), Options("fits"), "rows")).filter("y between 2 and 3")


@_query(_SAMPLES)
def xisf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xisf(spark, _write(spark, _collection(spark, sf_dir), Options("xisf"), "xisf"))


@_query(_SAMPLES)
def xisf_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored with zlib, then anew with LZ4, subblocks and other checksums."""
    folder, other = _write(spark, _collection(spark, sf_dir), Options("xisf", codec="zlib"), "xisf"), workspace(spark, "rewritten")
    save(xisf.rewrite(spark, folder, codec="lz4", subblocks=100, checksum="sha-256").select("path", "content"), other).count()
    return _xisf(spark, other)


@_query(_U16)
def asdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, _collection(spark, sf_dir), Options("asdf", sample_format="UInt16", codec="zlib"), "asdf")
    images = asdf.image_rows(spark, folder)
    order = asdf.bands(spark, folder).join(images.select("path", "image"), ["path", "image"])
    names = _asdf_names(spark, folder)
    return order.join(names, ["path", "image"]).select("name", "y", F.posexplode("values").alias("x", "v"))


def _asdf_names(spark: SparkSession, folder: str) -> DataFrame:
    """The EXTNAME of each image's header list, in order."""
    tree = asdf.trees(spark, folder).select("path", F.regexp_extract_all("yaml", F.lit(r"\[EXTNAME, \"'(\d+)'\", \"\"\]"), F.lit(1)).alias("n"))
    return tree.select("path", F.posexplode("n").alias("image", "name"))


@_query(_SAMPLES)
def mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three formats in one folder, told apart by their first bytes and read as one collection."""
    every, folder = _collection(spark, sf_dir), workspace(spark, "mixed")
    for k, (to, options) in enumerate((("fits", Options("fits")), ("fits", Options("fits", tiled=True)), ("xisf", Options("xisf")))):
        mine = F.pmod(F.col("name").cast("bigint"), F.lit(3)) == k
        part = Collection(every.images.filter(mine), every.bands, every.keywords, every.root)
        named = convert_files(part, options).select(F.concat(F.lit(f"{to}{k}/"), F.regexp_replace("source", r"/|\.src$", "-"), F.lit(f".{to}")).alias("path"), "content")
        save(named, folder).count()
    got = open_files(spark, folder)
    return _samples(got.images.withColumn("name", F.regexp_replace("name", "^_", "")), got.bands)


@_query("SELECT CASE vec_id % 3 WHEN 0 THEN 'fits' WHEN 1 THEN 'xisf' ELSE 'asdf' END AS format, count(DISTINCT label || '/' || vec_id // 4096) AS files FROM embeddings GROUP BY 1")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, folder = _collection(spark, sf_dir), workspace(spark, "formats")
    for k, to in enumerate(("fits", "xisf", "asdf")):
        mine = F.pmod(F.col("name").cast("bigint"), F.lit(3)) == k
        part = Collection(every.images.filter(mine), every.bands, every.keywords, every.root)
        save(convert_files(part, Options(to)).select(F.concat(F.lit(f"{k}-"), F.regexp_replace("source", r"/|\.src$", "-"), F.lit(".fits")).alias("path"), "content"), folder).count()
    found = spark.createDataFrame([(p,) for p in listing(folder, (".fits",))], "path string")

    def told(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([detect(p) for p in batch.column(0).to_pylist()], pa.string())], ["format"])

    return found.repartition(8).mapInArrow(told, "format string").groupBy("format").agg(F.count("*").alias("files"))


@_query("SELECT CAST(vec_id AS VARCHAR) AS name, k, CASE k WHEN 'LABEL' THEN CAST(label AS VARCHAR) WHEN 'NOTE' THEN repeat('it''s ' || vec_id || ' ', 20) END AS value FROM embeddings, (VALUES ('LABEL'), ('NOTE')) AS t(k)")
def keywords_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts too long for a card, written as FITS cards and read from them."""
    plain = _collection(spark, sf_dir)
    text = F.concat(F.lit("it's "), F.col("name"), F.lit(" "))
    label = F.regexp_extract("path", "^l([0-9-]+)/", 1)
    words = F.array(F.struct(F.lit(0).alias("pos"), F.lit("LABEL").alias("name"), label.alias("value")), F.struct(F.lit(1).alias("pos"), F.lit("NOTE").alias("name"), F.concat(F.lit("'"), F.replace(F.repeat(text, 20), F.lit("'"), F.lit("''")), F.lit("|'")).alias("value")))
    listed = plain.images.select("path", "image", F.inline(words)).withColumn("comment", F.lit(""))
    folder = _write(spark, Collection(plain.images, plain.bands, listed, plain.root), Options("fits"), "words")
    fits.register(spark)
    read = spark.read.format("fits_keywords").load(folder).filter("name in ('LABEL', 'NOTE')")
    value = F.regexp_replace(F.replace(F.regexp_replace("value", "^'|'$", ""), F.lit("''"), F.lit("'")), r"\|$", "")
    names = spark.read.format("fits_images").load(folder).select("path", "image", F.col("name").alias("own"))
    return read.join(names, ["path", "image"]).select(F.col("own").alias("name"), F.col("name").alias("k"), value.alias("value"))


@_query("SELECT 'l' || label || '-' || vec_id // 4096 AS file, count(*) AS verified, CAST(0 AS BIGINT) AS unchecked, CAST(0 AS BIGINT) AS problems, 'OK' AS verdict FROM embeddings GROUP BY 1")
def verify_xisf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import metadata as md

    folder = _write(spark, _collection(spark, sf_dir), Options("xisf", checksum="sha-512"), "verified")
    reports = xisf.verify(spark, folder).select(F.regexp_extract("path", r"([^/]*)\.xisf$", 1).alias("file"), "ok")
    return md.verdict(reports, "file")


@_query("SELECT CAST(vec_id AS VARCHAR) AS name, count(*) AS n, min(CAST(embedding[1] AS DOUBLE)) AS first FROM embeddings GROUP BY vec_id")
def xisf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block an image, each where the header says: its first sample is read at its place."""
    folder = _write(spark, _collection(spark, sf_dir), Options("xisf", codec=None), "blocks")
    listed = xisf.blocks(spark, folder).select("path", F.regexp_replace("element", "^_", "").alias("name"), "position")

    def first(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from starloom.sources.files import read_range

        for batch in batches:
            got = [float(np.frombuffer(read_range(p, at, 4), "<f4")[0]) for p, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got)], ["name", "first"])

    return listed.mapInArrow(first, "name string, first double").groupBy("name").agg(F.count("*").alias("n"), F.min("first").alias("first"))
