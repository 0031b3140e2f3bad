"""The registered queries of the image engine, each with its SQL twin.

Tables stand in for image collections: vectors are 8x8 images, their label the
channel group; other tables serve as sample streams, keyword lists and blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.functions import pixels
from starloom.operators import images as im
from starloom.operators import metadata as md
from starloom.plans import file_queries

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: One row a sample of the vector images, in SQL.
_PX = "px AS (SELECT vec_id AS image, label AS channel, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | file_queries.SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.vectors_as_images(_table(spark, sf_dir, "embeddings"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.samples(_images(spark, sf_dir), "image", "channel")


def _whole(cells: DataFrame) -> DataFrame:
    """Samples as whole numbers 0 to 2000."""
    return cells.withColumn("v", F.floor((F.col("v") + 1) * 1000).cast("bigint"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images' rows of whole samples, without a shuffle: (image, y, values)."""
    whole = F.transform("values", lambda v: F.floor((v + 1) * 1000).cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.alias("y"), F.slice("v", y * 8 + 1, 8).alias("values")))
    return _images(spark, sf_dir).select("image", whole.alias("v")).select("image", F.inline(rows))


_WHOLE = f"{_PX}, q AS (SELECT image, channel, y, x, CAST(floor((v + 1) * 1000) AS BIGINT) AS v FROM px)"

# --- statistics and stretches -------------------------------------------------------------

_STATS = f"""
WITH {_PX}, n AS (SELECT image, channel, CAST(CAST((v + 0.5e0) * 1.0e0 AS FLOAT) AS DOUBLE) AS x FROM px),
m AS (SELECT image, channel, median(x) AS m FROM n GROUP BY ALL),
d AS (SELECT m.image, m.channel, m.m, 1.4826e0 * median(CAST(CAST(abs(x - m) AS FLOAT) AS DOUBLE)) AS d FROM n JOIN m USING (image) GROUP BY ALL)"""
_PARAMS = """SELECT {key},
  CASE WHEN m > 0.5e0 OR d = 0 THEN 0e0 ELSE greatest(0e0, m - 2.8e0 * d) END AS shadows,
  CASE WHEN m <= 0.5e0 OR d = 0 THEN 1e0 ELSE least(1e0, m + 2.8e0 * d) END AS highlights, m FROM {src}"""
_MTF = "CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 WHEN {m} = 0.5e0 THEN {x} ELSE ({m} - 1) * {x} / ((2 * {m} - 1) * {x} - {m}) END"
_MID = f"CASE WHEN m <= 0.5e0 THEN CASE WHEN m > shadows THEN {_MTF.format(m='0.25e0', x='(m - shadows)')} ELSE 0.5e0 END ELSE 1 - ({_MTF.format(m='0.25e0', x='(highlights - m)')}) END"


@_query(f"{_STATS}, p AS ({_PARAMS.format(key='image', src='d')}) SELECT image, shadows, {_MID} AS midtones, highlights FROM p")
def auto_stf_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.auto_stretch(_images(spark, sf_dir), ["image"], -0.5, 0.5)


@_query(f"{_STATS}, l AS (SELECT channel, avg(m) AS m, avg(d) AS d FROM d GROUP BY channel), p AS ({_PARAMS.format(key='channel', src='l')}) SELECT channel, round(shadows, 9) AS shadows, round({_MID}, 9) AS midtones, round(highlights, 9) AS highlights FROM p")
def auto_stf_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = im.auto_stretch(_images(spark, sf_dir), ["image"], -0.5, 0.5, linked_by="channel")
    return p.select("channel", *(F.round(c, 9).alias(c) for c in ("shadows", "midtones", "highlights")))


_X = "CASE WHEN v + 0.5e0 <= 0 THEN 0e0 WHEN v + 0.5e0 > 1 THEN 1e0 ELSE v + 0.5e0 END"


@_query(f"WITH {_PX}, c AS (SELECT image, y, x, (({_X}) - 0.2e0) / (0.9e0 - 0.2e0) AS t FROM px) SELECT image, y, x, round({_MTF.format(m='0.3e0', x='t')}, 6) AS v FROM c")
def apply_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pixels.stretch(F.col("v") + 0.5, F.lit(0.2), F.lit(0.3), F.lit(0.9), F.lit(0.0), F.lit(1.0))
    return _samples(spark, sf_dir).select("image", "y", "x", F.round(v, 6).alias("v"))


def _convert_sql(top: str) -> str:
    t = "((v - -1e0) / 2e0)"
    return f"WITH {_PX} SELECT image, y, x, CASE WHEN {t} <= 0 THEN 0e0 WHEN {t} > 1 THEN {top} ELSE floor({t} * {top} + 0.5e0) END AS v FROM px"


@_query(_convert_sql("255e0"))
def convert_f32_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("image", "y", "x", pixels.convert(F.col("v"), "Float32", "UInt8", -1.0, 1.0).alias("v"))


@_query(_convert_sql("65535e0"))
def convert_f32_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("image", "y", "x", pixels.convert(F.col("v"), "Float32", "UInt16", -1.0, 1.0).alias("v"))


@_query("SELECT * FROM (VALUES (1, 0e0), (2, 255e0), (3, 0e0), (4, 128e0)) AS t(k, v)")
def convert_nan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 5).select(F.col("id").cast("int").alias("k"), F.element_at(F.array(F.lit(float("nan")), F.lit(2.0), F.lit(-1.0), F.lit(0.5)), F.col("id").cast("int")).alias("v"))
    return rows.select("k", pixels.convert(F.col("v"), "Float32", "UInt8").alias("v"))


@_query("SELECT p_partkey, CAST(p_size * 257 AS DOUBLE) AS u16, CAST(p_size AS DOUBLE) * (1e0 / 255e0) AS f64 FROM part")
def convert_int_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", pixels.convert(F.col("p_size"), "UInt8", "UInt16").alias("u16"), pixels.convert(F.col("p_size"), "UInt8", "Float64").alias("f64"))


@_query("SELECT p_partkey, least(255e0, floor(CAST(p_size * 1000 AS DOUBLE) * (255e0 / 65535e0) + 0.5e0)) AS u8 FROM part")
def convert_int_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", pixels.convert(F.col("p_size") * 1000, "UInt16", "UInt8").alias("u8"))


@_query(f"WITH {_PX} SELECT image, y, x, (v - -1e0) * (1e0 / 3e0) AS v FROM px")
def normalise_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("image", "y", "x", pixels.normalise(F.col("v"), -1.0, 2.0).alias("v"))


@_query(f"WITH {_PX} SELECT channel, min(v) AS lower, max(v) AS upper, false AS non_finite FROM px GROUP BY channel")
def float_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.finite_range(_samples(spark, sf_dir), "channel")


@_query(f"WITH {_PX} SELECT image, bool_or(v < 0) AS negative FROM px GROUP BY image")
def any_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("image", F.exists("values", lambda v: v < 0).alias("negative"))


@_query("""WITH r AS (SELECT l_shipmode AS k, min(v) AS lower, max(v) AS upper FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice AS v FROM lineitem) GROUP BY 1)
SELECT k, lower, upper, false AS non_finite, CASE WHEN lower >= 0 AND upper <= 65535 THEN 0e0 ELSE lower END AS bound_low,
CASE WHEN lower >= 0 AND upper <= 1 THEN 1e0 WHEN lower >= 0 AND upper <= 65535 THEN 65535e0 WHEN upper > lower THEN upper ELSE lower + 1 END AS bound_high FROM r""")
def auto_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_extendedprice").alias("v"))
    return im.float_bounds(im.finite_range(rows, "k"))


@_query("SELECT label AS channel, count(*) AS n, median(CAST(embedding[1] AS DOUBLE)) AS med FROM embeddings GROUP BY label")
def channel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.median(F.get("values", F.lit(0))).alias("med"))


# --- geometry -----------------------------------------------------------------------------


@_query(f"WITH {_PX} SELECT image, CAST(7 - y AS INT) AS y, CAST(x AS INT) AS x, v FROM px")
def flip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.flip_rows(_samples(spark, sf_dir), F.lit(8)).select("image", "y", "x", "v")


@_query(f"WITH {_PX} SELECT image, channel, y, x, v FROM px WHERE channel BETWEEN 2 AND 4")
def channel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.samples(_images(spark, sf_dir).filter("channel between 2 and 4"), "image", "channel")


@_query(f"WITH {_PX} SELECT image, channel, y, x, v FROM px WHERE image = 7")
def image_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.samples(_images(spark, sf_dir).filter("image = 7"), "image", "channel")


@_query(f"WITH {_PX} SELECT image, y, x, v FROM px WHERE y BETWEEN 2 AND 5")
def band_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(spark, sf_dir).select("image", F.slice("values", 17, 32).alias("values"), "width")
    return im.samples(rows, "image").withColumn("y", F.col("y") + 2)


def _area(n: int) -> str:
    return f"""WITH {_WHOLE}, s AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, least((i + 1) * {n}, (j + 1) * 8) - greatest(i * {n}, j * 8) AS w FROM (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, {n})) AS j) ),
c AS (SELECT * FROM s WHERE w > 0)
SELECT image, a.j AS y, b.j AS x, round(CAST(sum(v * a.w * b.w) AS DOUBLE) / CAST(sum(a.w * b.w) AS DOUBLE), 9) AS v FROM q JOIN c AS a ON a.i = q.y JOIN c AS b ON b.i = q.x GROUP BY ALL"""


def _smaller(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    small = im.downsample_rows(_rows(spark, sf_dir), ["image"], F.lit(8), F.lit(8), F.lit(n), F.lit(n))
    cells = small.select("image", F.col("y").cast("int").alias("y"), F.posexplode("values").alias("x", "v"))
    return cells.withColumn("v", F.round("v", 9))


@_query(_area(4))
def bin2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smaller(spark, sf_dir, pixels.smaller_size(8, bin_=2))


@_query(_area(3))
def resize_8_to_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smaller(spark, sf_dir, pixels.smaller_size(8, fit=3))


@_query(f"""WITH {_WHOLE}, c AS (SELECT image, y, x, v, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END AS colour FROM q),
o AS (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
t AS (SELECT image, y + dy AS y, x + dx AS x, v, colour, dy = 0 AND dx = 0 AS own FROM c, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)
SELECT image, y, x, colour, CAST(coalesce(max(CASE WHEN own THEN v END), (sum(v) + count(*) // 2) // count(*)) AS BIGINT) AS v FROM t GROUP BY image, y, x, colour""")
def debayer_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = im.debayer_rows(_rows(spark, sf_dir), ["image"])
    planes = F.array(*(F.struct(F.lit(c).alias("colour"), F.col(n).alias("values")) for c, n in (("R", "red"), ("G", "green"), ("B", "blue"))))
    planes = made.select("image", "y", F.inline(planes))
    return planes.select("image", "y", "colour", F.posexplode("values").alias("x", "v")).withColumn("v", F.col("v").cast("bigint"))


@_query(f"WITH {_PX} SELECT image, y, x, v FROM px WHERE (y * 8 + x) % 5 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).filter("(y * 8 + x) % 5 = 0").select("image", "y", "x", "v")


# --- codecs' relational parts -------------------------------------------------------------


def _in_order():
    return W.partitionBy("image").orderBy("y", "x")


@_query(f"WITH {_WHOLE}, d AS (SELECT image, y, x, v - lag(v, 1, 0) OVER (PARTITION BY image ORDER BY y, x) AS d FROM q) SELECT image, y, x, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS code FROM d")
def lag_diff_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole(_samples(spark, sf_dir)).withColumn("d", F.col("v") - F.lag("v", 1, 0).over(_in_order()))
    return rows.select("image", "y", "x", F.when(F.col("d") < 0, -2 * F.col("d") - 1).otherwise(2 * F.col("d")).alias("code"))


@_query(f"WITH {_WHOLE} SELECT image, y, x, v FROM q")
def prefix_sum_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole(_samples(spark, sf_dir)).withColumn("d", F.col("v") - F.lag("v", 1, 0).over(_in_order()))
    return rows.select("image", "y", "x", F.sum("d").over(_in_order().rowsBetween(W.unboundedPreceding, 0)).alias("v"))


@_query("SELECT o_orderkey, (k % 4) * 4 + k // 4 AS place, substr(o_orderpriority || '                ', k + 1, 1) AS byte FROM (SELECT *, unnest(range(0, 16)) AS k FROM orders)")
def byte_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.split(F.rpad("o_orderpriority", 16, " "), "")).alias("k", "byte"))
    return rows.select("o_orderkey", (F.col("k") % 4 * 4 + F.floor(F.col("k") / 4)).cast("bigint").alias("place"), "byte")


@_query("SELECT p_partkey, p_brand, CAST(coalesce(sum(CAST(ceil(p_size * 100 / 4096e0) AS BIGINT) * 4096) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4096 AS BIGINT) AS position FROM part")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.aligned_offsets(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_partkey", F.col("p_size") * 100, 4096, 4096).select("p_partkey", "p_brand", "position")


@_query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@_query("SELECT doc_id, strlen(text) AS n, true AS zlib_ok, true AS zstd_ok, true AS shuffle_ok, true AS rice_ok, sha1(text) AS sha1 FROM documents")
def codec_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.functions import codecs

    return codecs.round_trips(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")))


@_query("""WITH b AS (SELECT doc_id, rpad(left(regexp_replace(text, '[^ -~]', '?', 'g'), 400), 400, ' ') AS t FROM documents),
w AS (SELECT doc_id, ascii(substr(t, 4 * k + 1, 1)) * 16777216 + ascii(substr(t, 4 * k + 2, 1)) * 65536 + ascii(substr(t, 4 * k + 3, 1)) * 256 + ascii(substr(t, 4 * k + 4, 1)) AS word FROM (SELECT *, unnest(range(0, 100)) AS k FROM b)),
s AS (SELECT doc_id, CAST(sum(word) AS BIGINT) AS s FROM w GROUP BY doc_id), f AS (SELECT doc_id, s % 4294967296 + s // 4294967296 AS s FROM s)
SELECT doc_id, s % 4294967296 + s // 4294967296 AS checksum FROM f""")
def fits_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.rpad(F.substring(F.regexp_replace("text", "[^ -~]", "?"), 1, 400), 400, " ")
    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.conv(F.hex(F.substring(text, k * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + w).alias("s"))
    for _ in range(2):
        rows = rows.withColumn("s", F.expr("s % 4294967296 + s div 4294967296"))
    return rows.select("doc_id", F.col("s").alias("checksum"))


@_query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, rpad(h, CAST((length(h) + 7) // 8 * 8 AS INT), '0') AS h FROM h),
w AS (SELECT doc_id, list_sum(list_transform(regexp_extract_all(h, '.{8}'), lambda x: CAST('0x' || x AS BIGINT))) AS s FROM p),
f AS (SELECT doc_id, coalesce(s, 0) % 4294967296 + coalesce(s, 0) // 4294967296 AS s FROM w)
SELECT doc_id, CAST(s % 4294967296 + s // 4294967296 AS BIGINT) AS checksum FROM f""")
def fits_checksum_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of all UTF-8 bytes, the last word padded with zeros; ``fits_checksum`` sums the first 400 characters."""
    rows = _table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.hex(F.col("text").cast("binary")).alias("h"))
    words = F.regexp_extract_all(F.concat("h", F.expr("repeat('0', pmod(-length(h), 8))")), F.lit(".{8}"), F.lit(0))
    rows = rows.select("doc_id", F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.conv(w, 16, 10).cast("bigint")).alias("s"))
    for _ in range(2):
        rows = rows.withColumn("s", F.expr("s % 4294967296 + s div 4294967296"))
    return rows.select("doc_id", F.col("s").alias("checksum"))


# --- keywords, properties, lookups ----------------------------------------------------------


@_query("SELECT doc_id, base64(encode(substr(regexp_replace(text, '[^ -~]', '?', 'g'), 1, 30))) AS b64 FROM documents")
def base64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.base64(F.substring(F.regexp_replace("text", "[^ -~]", "?"), 1, 30).cast("binary")).alias("b64"))


@_query("SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def base64_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text, in one line whatever the session's chunking; ``base64_text`` encodes the first 30 characters."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "").alias("b64"))


@_query("SELECT doc_id, true AS valid, regexp_matches(text, '^[\\x20-\\x7E\\x09\\x0A\\x0D]*$') AS ascii_text FROM documents")
def utf8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8("text").alias("valid"), F.rlike("text", F.lit(r"\A[\x20-\x7E\x09\x0A\x0D]*\z")).alias("ascii_text"))


@_query("SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9_]+', '_', 'g') AS id FROM part")
def identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", md.identifier(F.col("p_brand"), F.concat(F.lit("image"), F.col("p_partkey").cast("string"))).alias("id"))


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_PROPS = "p AS (SELECT c_custkey AS k, 'Observation:Object:Name' AS id, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'Instrument:Filter:Name', 'n' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'Instrument:Other', 'x' FROM customer)"


@_query(f"WITH {_PROPS}, r AS (SELECT k, CASE id WHEN 'Observation:Object:Name' THEN 'OBJECT' ELSE 'FILTER' END AS name, '''' || rpad(text, CAST(greatest(8, length(text)) AS INT), ' ') || '''' AS value FROM p WHERE id <> 'Instrument:Other') SELECT * FROM r WHERE NOT (name = 'FILTER' AND k % 2 = 0)")
def derive_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    listed = F.array(F.struct(F.lit("Observation:Object:Name").alias("id"), F.col("c_name").alias("text")), F.struct(F.lit("Instrument:Filter:Name").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("text")), F.struct(F.lit("Instrument:Other").alias("id"), F.lit("x").alias("text")))
    props = c.select(F.col("c_custkey").alias("k"), F.inline(listed))
    have = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("FILTER").alias("name"))
    return md.derive_keywords(props, have, "k")


@_query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_type AS value, ['NAXIS1', 'simple', 'OBJECT', 'NAXISX', 'BZERO'][p_partkey % 5 + 1] AS name FROM part) WHERE upper(name) NOT IN ('NAXIS1', 'SIMPLE', 'BZERO')")
def reserved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("NAXIS1", "simple", "OBJECT", "NAXISX", "BZERO")))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"), F.col("p_type").alias("value"))
    return rows.filter(~md.is_reserved(F.col("name")))


@_query("SELECT c_custkey, coalesce(n.n_name, r.r_name) AS name FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_nationkey % 2 = 0 LEFT JOIN region r ON r.r_regionkey = c_nationkey % 5")
def coalesce_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = c.join(n.filter("n_nationkey % 2 = 0"), c.c_nationkey == n.n_nationkey, "left").join(r, F.expr("r_regionkey = c_nationkey % 5"), "left")
    return both.select("c_custkey", F.coalesce("n_name", "r_name").alias("name"))


@_query("SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.expr("p_partkey = l_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@_query("SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def id_lookup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.expr("p_partkey = l_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@_query("SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ON l_partkey = p_partkey")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey").join(_table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_partkey"), F.expr("l_partkey = p_partkey"), "left_anti")


@_query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def stale_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@_query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def stale_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("SELECT event_id, user_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS owner FROM events")
def asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_id", 1, -1).over(w).alias("owner"))


@_query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS signup FROM events")
def asof_last_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("signup"))


@_query("SELECT conv_id, sha1(string_agg(text, '' ORDER BY turn)) AS digest, count(*) AS cards FROM conversations GROUP BY conv_id")
def continue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    n = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return n.select("conv_id", F.sha1(F.array_join("p.text", "")).alias("digest"), F.size("p").cast("bigint").alias("cards"))


@_query("SELECT source, CAST(count_if(quality = 1) AS BIGINT) AS verified, CAST(count_if(quality IS NULL) AS BIGINT) AS unchecked, CAST(count_if(quality = 0) AS BIGINT) AS problems, CASE WHEN count_if(quality = 0) > 0 THEN 'FAILED' WHEN count_if(quality IS NULL) > 0 OR count_if(quality = 1) = 0 THEN 'NOT FULLY CHECKED' ELSE 'OK' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return md.verdict(rows.select("source", (F.col("quality") == 1).alias("ok")), "source")


@_query("SELECT CAST(count_if(event_type <> 'error' AND event_type <> 'view') AS BIGINT) AS done, CAST(count_if(event_type = 'view') AS BIGINT) AS passed_over, CAST(count_if(event_type = 'error') AS BIGINT) AS failed, CASE WHEN count_if(event_type = 'error') > 0 THEN 1 ELSE 0 END AS exit_code FROM events")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = _table(spark, sf_dir, "events"), F.col("event_type")
    out = e.agg(F.count_if((kind != "error") & (kind != "view")).alias("done"), F.count_if(kind == "view").alias("passed_over"), F.count_if(kind == "error").alias("failed"))
    return out.withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


@_query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem GROUP BY 1")
def least_squares_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 1).alias("intercept"))


@_query("SELECT l_returnflag, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS rms, round(max(sqrt(l_tax * l_tax + l_discount * l_discount)), 9) AS worst FROM lineitem GROUP BY 1")
def rms_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_tax") - F.col("l_discount")
    worst = F.sqrt(F.col("l_tax") * F.col("l_tax") + F.col("l_discount") * F.col("l_discount"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sqrt(F.avg(d * d)), 6).alias("rms"), F.round(F.max(worst), 9).alias("worst"))


@_query("""WITH i AS (SELECT p_brand AS k, p_partkey * 10 AS a, p_partkey * 10 + p_size * 8 AS b FROM part),
m AS (SELECT k, a, b, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i)
SELECT k, CAST(sum(greatest(0, b - greatest(a, coalesce(e, a)))) AS BIGINT) AS covered FROM m GROUP BY k""")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), (F.col("p_partkey") * 10).alias("a"), (F.col("p_partkey") * 10 + F.col("p_size") * 8).alias("b"))
    return md.covered_length(rows, "k", "a", "b")


@_query("""SELECT p_brand AS k, sha1('8x8 top-down' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10)) AS digest
FROM (SELECT p_brand, upper('ctype' || p_partkey) || '=' || p_type AS line FROM part) GROUP BY 1""")
def wcs_style_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.concat(F.lit("ctype"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("value"))
    return md.entry_digest(rows, "k", F.col("name"), F.col("value"), F.lit("8x8 top-down"))


@_query("SELECT page_id, url FROM pages WHERE url LIKE 'http://%.example.com/__/%'")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").filter(md.glob_match(F.col("url"), "http://*.example.com/??/*")).select("page_id", "url")


@_query("SELECT doc_id, source FROM documents WHERE source <> 'src1'")
def dir_passover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source").filter("source <> 'src1'")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@_query("SELECT coalesce(a.r, b.r) AS place, a.d IS NOT DISTINCT FROM b.d AS same FROM (SELECT doc_id AS r, md5(text) AS d FROM documents) a FULL JOIN (SELECT doc_id + 1 AS r, md5(text) AS d FROM documents) b ON a.r = b.r")
def read_back_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.md5("text").alias("a"))
    return d.join(d.select((F.col("place") + 1).alias("place"), F.col("a").alias("b")), "place", "full").select("place", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@_query("SELECT c_custkey AS k, id, text FROM (SELECT c_custkey, 'a' AS id, 'new' AS text FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'a', 'old' FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'b', c_name FROM customer)")
def property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    made = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("a").alias("id"), F.lit("new").alias("text"))
    kept = c.select(F.col("c_custkey").alias("k"), F.inline(F.array(F.struct(F.lit("a").alias("id"), F.lit("old").alias("text")), F.struct(F.lit("b").alias("id"), F.col("c_name").alias("text")))))
    return kept.join(made, ["k", "id"], "left_anti").unionByName(made)


@_query(f"WITH {_WHOLE}, w AS (SELECT image, y, v FROM q) SELECT image, CAST(y AS INT) AS y, CAST(sum(v) AS BIGINT) AS total FROM w GROUP BY ALL")
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = im.bands(_whole(_samples(spark, sf_dir)), "image")
    return rows.select("image", "y", F.aggregate("values", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


_CARD_VALUES = ["'text'", "T", "12", "-3.5D2", "(1.0, 2)", "1 2"]


@_query("SELECT p_partkey, [%s][CAST(p_partkey %% 6 AS INT) + 1] AS kind, CASE p_partkey %% 6 WHEN 2 THEN 12e0 WHEN 3 THEN -350e0 ELSE 0e0 END AS number FROM part" % ", ".join(f"'{k}'" for k in ("text", "logical", "integer", "real", "complex", "raw")))
def keyword_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, _CARD_VALUES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", value.alias("v"))
    return rows.select("p_partkey", md.keyword_kind(F.col("v")).alias("kind"), F.coalesce(md.keyword_number(F.col("v")), F.lit(0.0)).alias("number"))


@_query("SELECT o_orderkey, CASE WHEN o_custkey * 7 > 255 THEN 'out of range' ELSE 'fine' END AS uint8, CASE WHEN o_custkey * 7 > 32767 THEN 'out of range' ELSE 'fine' END AS int16, 'neither true nor false' AS flag FROM orders")
def property_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.col("o_custkey") * 7).cast("string")
    problem = lambda kind: F.coalesce(md.property_problem(F.lit(kind), text), F.lit("fine"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", problem("UInt8").alias("uint8"), problem("Int16").alias("int16"), problem("Boolean").alias("flag"))


@_query("""WITH RECURSIVE i AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
f AS (SELECT p_brand, p_partkey, r, CASE WHEN p_size <= 500 THEN p_size ELSE 0 END AS used, p_size <= 500 AS kept FROM i WHERE r = 1
UNION ALL SELECT i.p_brand, i.p_partkey, i.r, f.used + CASE WHEN f.used + i.p_size <= 500 THEN i.p_size ELSE 0 END, f.used + i.p_size <= 500 FROM f JOIN i ON i.p_brand = f.p_brand AND i.r = f.r + 1)
SELECT p_brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM f WHERE kept GROUP BY p_brand""")
def memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = md.within_budget(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_size", 500)
    return kept.select("p_brand", F.size("kept").cast("bigint").alias("n"), F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@_query("SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 'RGGB' ELSE 'GBRG' END AS pattern FROM embeddings")
def pattern_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", md.flip_pattern(F.lit("RGGB"), 2, 2, F.col("vec_id")).alias("pattern"))


@_query("""SELECT c_custkey, name, CASE name WHEN 'CRPIX2' THEN CAST(CAST(101 - c_custkey % 50 AS DECIMAL(18,3)) AS VARCHAR) WHEN 'CD1_2' THEN '-' || c_nationkey WHEN 'CD2_2' THEN CAST(c_nationkey AS VARCHAR) ELSE '1' END AS value
FROM customer, (VALUES ('CRPIX2'), ('CD1_2'), ('CD2_2'), ('CDELT2')) AS t(name)""")
def wcs_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, nation = _table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string")
    made = [("CRPIX2", (F.col("c_custkey") % 50).cast("string")), ("CD1_2", nation), ("CD2_2", F.concat(F.lit("-"), nation)), ("CDELT2", F.lit("1"))]
    cards = c.select("c_custkey", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in made))))
    turned = md.flip_wcs(cards, "c_custkey", F.lit(100))
    return turned.withColumn("value", F.when(F.col("name") == "CRPIX2", F.col("value").cast("decimal(18,3)").cast("string")).otherwise(F.col("value")))


@_query("SELECT c_custkey, c_mktsegment, 'x' || CASE WHEN r = 1 THEN '' ELSE '_' || r END AS id FROM (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("g"), F.lit("x").alias("name"))
    return md.unique_identifiers(rows, "g", "c_custkey", "name").select("c_custkey", F.split("g", "/")[0].alias("c_mktsegment"), "id")
