"""Keywords, properties, lookups, offsets and reports as DataFrame operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Keywords that describe a file's own storage and are not carried over.
RESERVED = "SIMPLE BITPIX NAXIS EXTEND BZERO BSCALE END XTENSION PCOUNT GCOUNT ROWORDER BLANK CHECKSUM DATASUM".split()
# Properties that become keywords: property, keyword, numeric, scale.
DERIVED = [
    ("Observation:Object:Name", "OBJECT", False, 1.0),
    ("Instrument:ExposureTime", "EXPTIME", True, 1.0),
    ("Instrument:Telescope:Name", "TELESCOP", False, 1.0),
    ("Instrument:Camera:Name", "INSTRUME", False, 1.0),
    ("Instrument:Filter:Name", "FILTER", False, 1.0),
    ("Instrument:Sensor:Temperature", "CCD-TEMP", True, 1.0),
    ("Instrument:Sensor:XPixelSize", "XPIXSZ", True, 1.0),
    ("Instrument:Sensor:YPixelSize", "YPIXSZ", True, 1.0),
    ("Instrument:Telescope:FocalLength", "FOCALLEN", True, 1000.0),
    ("Instrument:Telescope:Aperture", "APTDIA", True, 1000.0),
]


def is_reserved(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return n.isin(*RESERVED) | n.rlike("^NAXIS[0-9]+$")


def fits_string(text: Column) -> Column:
    """A quoted card value: quotes doubled, padded to eight characters."""
    return F.concat(F.lit("'"), F.rpad(F.replace(text, F.lit("'"), F.lit("''")), F.greatest(F.length(F.replace(text, F.lit("'"), F.lit("''"))), F.lit(8)), F.lit(" ")), F.lit("'"))


def fits_unquote(value: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(value), "^'|'$", ""), "''", "'")
    return F.when(F.trim(value).startswith("'"), F.rtrim(inner)).otherwise(F.trim(value))


def derive_keywords(properties: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """(key, name, value) made from ``properties(key, id, text)`` where ``keywords(key, name)`` has none of that name.

    Numbers are scaled; the start of an observation becomes DATE-OBS if it is a
    point in time at no offset.
    """
    spark = properties.sparkSession
    rules = spark.createDataFrame([*DERIVED, ("Observation:Time:Start", "DATE-OBS", False, 1.0)], "id string, name string, numeric boolean, scale double")  # eleven rows
    made = properties.join(F.broadcast(rules), "id").filter("trim(text) <> ''")
    number = F.col("text").try_cast("double")
    date = F.regexp_extract(F.trim("text"), r"^([+-]?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?)(Z|[+-]00(:?00)?)?$", 1)
    text = F.when(F.col("name") != "DATE-OBS", F.trim("text")).otherwise(F.nullif(date, F.lit("")))
    value = F.when(F.col("numeric"), (number * F.col("scale")).cast("string")).otherwise(fits_string(text))
    return made.select(key, "name", value.alias("value")).filter("value is not null").join(keywords.select(key, "name"), [key, "name"], "left_anti")


def identifier(text: Column, fallback: Column) -> Column:
    """Letters, digits and underscores only; no leading digit; never empty."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(s == "", fallback).when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def glob_match(text: Column, pattern: str) -> Column:
    """Only ``*`` and ``?`` are special."""
    special = set("\\.^$|()[]{}+")
    body = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in special else c for c in pattern)
    return text.rlike(f"(?s)^{body}$")


def joined_text(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Continued texts of a key joined in order."""
    parts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("p"))
    return parts.select(key, F.array_join(F.col(f"p.{text}"), "").alias(text))


def aligned_offsets(rows: DataFrame, key: str, order: str, size: Column, start: int, align: int) -> DataFrame:
    """Positions of blocks laid out one after the other, each at a multiple of ``align``."""
    room = (F.ceil(size / F.lit(align)) * align).cast("bigint")
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("position", (F.coalesce(F.sum(room).over(before), F.lit(0)) + start).cast("bigint"))


def covered_length(intervals: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Length of the union of a key's intervals."""
    w = W.partitionBy(key).orderBy(begin, end).rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(begin), F.coalesce(F.max(end).over(w), F.col(begin))))
    return intervals.withColumn("_new", fresh).groupBy(key).agg(F.sum("_new").cast("bigint").alias("covered"))


def verdict(reports: DataFrame, key: str) -> DataFrame:
    """Counts and the verdict of ``reports(key, ok)``: null is not checked, false a problem."""
    counts = reports.groupBy(key).agg(F.count_if("ok").alias("verified"), F.count_if(F.col("ok").isNull()).alias("unchecked"), F.count_if(~F.col("ok")).alias("problems"))
    return counts.withColumn("verdict", F.when(F.col("problems") > 0, "FAILED").when((F.col("unchecked") > 0) | (F.col("verified") == 0), "NOT FULLY CHECKED").otherwise("OK"))


def entry_digest(entries: DataFrame, key: str, name: str, value: str, head: Column) -> DataFrame:
    """SHA-1 over a head line and the sorted ``NAME=value`` lines of a key."""
    lines = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.concat(F.upper(F.trim(name)), F.lit("="), F.trim(value)))).alias("l"))
    return lines.select(key, F.sha1(F.concat(head, F.lit("\n"), F.array_join("l", "\n"), F.lit("\n")).cast("binary")).alias("digest"))


def keyword_kind(value: Column) -> Column:
    """What a card's value text is: text, logical, integer, real, complex or raw."""
    v = F.trim(value)
    real = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([EeDd][+-]?[0-9]+)?"
    return (
        F.when(v.startswith("'"), "text")
        .when(v.isin("T", "F"), "logical")
        .when(v.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(v.rlike(f"^{real}$"), "real")
        .when(v.rlike(rf"^\(\s*{real}\s*,\s*{real}\s*\)$"), "complex")
        .otherwise("raw")
    )


def keyword_number(value: Column) -> Column:
    """The number of a card's value text, a D exponent read as E; null if it is none."""
    return F.when(keyword_kind(value).isin("integer", "real"), F.translate(F.trim(value), "Dd", "EE").try_cast("double"))


#: Least and greatest value of each integer property type.
INTEGERS = {f"{u}Int{b}": (0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64) for u in ("", "U")}


def property_problem(kind: Column, text: Column) -> Column:
    """Why a scalar property's text is not of its type; null if it is."""
    t, out = F.trim(text), None
    number = t.rlike(r"^[+-]?[0-9]+$")
    for name, (low, high) in INTEGERS.items():
        whole = F.when(F.length(t) <= 30, t).try_cast("decimal(38,0)")
        bad = F.when(~number, "not an integer").when(whole.isNull() | ~whole.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), "out of range")
        out = F.when(kind == name, bad) if out is None else out.when(kind == name, bad)
    out = out.when(kind == "Boolean", F.when(~t.isin("true", "false"), "neither true nor false"))
    real = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)?$")
    size = F.abs(t.try_cast("double"))
    out = out.when(kind.isin("Float32", "Float64"), F.when(~real, "not a number").when((size == float("inf")) | ((kind == "Float32") & (size >= 3.4028235677973366e38)), "out of range"))
    return out.when(kind == "String", F.lit(None)).otherwise("unknown type")


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, kept): places of the items that fit, in order; an item that does not fit is passed over and uses nothing up."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("s")))).alias("l"))
    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(listed.schema["l"].dataType.elementType["o"].dataType.simpleString().join(("array<", ">"))).alias("kept"))
    fold = F.aggregate("l", none, lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["kept"], F.array(x["o"])).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return listed.select(key, fold.alias("kept"))


def flip_pattern(pattern: Column, width: int, height: int, image_height: Column) -> Column:
    """A colour filter pattern as seen from the other end of the image's rows."""
    rows = [F.substring(pattern, F.pmod(F.pmod(image_height - 1, F.lit(height)) + height - j, F.lit(height)).cast("int") * width + 1, F.lit(width)) for j in range(height)]
    return F.concat(*rows)


def row_number_text(x: Column) -> Column:
    """A pixel position as text: nine decimals at most, one at least."""
    return F.round(x, 9).cast("string")


def flip_wcs(cards: DataFrame, key: str, height: Column) -> DataFrame:
    """``cards(key, name, value)`` of solutions for rows in the other order; alternates A to Z each by themselves.

    The reference row is counted from the other end, and one that is missing is
    row 0 and comes in; the second column of the CD or PC matrix, or where there
    is neither CDELT2, changes sign in its text; so do the distortion terms of
    x with odd powers of y and those of y with even ones. A zero changes its
    sign like any other number.
    """
    n = F.upper(F.trim("name"))
    base, alternate = F.regexp_replace(n, "(?<=[0-9])[A-Z]$", ""), F.regexp_extract(n, "(?<=[0-9])([A-Z])$", 1)
    rows = cards.withColumn("_n", n).withColumn("_base", base).withColumn("_alt", alternate)
    own = F.col("_base").rlike("^(CD|PC)[1-9]_[1-9]$|^PC00[12]00[12]$")
    has = rows.groupBy(key, "_alt").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("_has"), F.coalesce(F.bool_or(F.col("_base") == "CRPIX2"), F.lit(False)).alias("_row"), F.coalesce(F.bool_or(F.col("_base") == "CTYPE1"), F.lit(False)).alias("_type"), F.max(height).alias("_height"))
    rows = rows.join(has.select(key, "_alt", "_has"), [key, "_alt"])
    text = F.trim("value")
    plain = F.translate(text, "Dd", "EE").try_cast("double")
    negated = F.when(text.startswith("-"), F.substring(text, 2, 100)).otherwise(F.concat(F.lit("-"), F.regexp_replace(text, r"^\+", "")))
    power = F.regexp_extract(F.col("_n"), r"^[AB]P?_[0-9]+_([0-9]+)$", 1).try_cast("int")
    distorted = power.isNotNull() & ((F.pmod(power, F.lit(2)) == 1) != F.col("_n").startswith("B"))
    turned = F.when(F.col("_base").rlike("^(CD|PC)[12]_2$|^PC00[12]002$") | ((F.col("_base") == "CDELT2") & ~F.col("_has")) | distorted, negated)
    moved = F.when(F.col("_base") == "CRPIX2", row_number_text(height + 1 - plain))
    out = rows.select(key, "name", F.coalesce(F.when(plain.isNotNull(), F.coalesce(moved, turned)), F.col("value")).alias("value"))
    missing = has.filter(~F.col("_row") & F.col("_type")).select(key, F.concat(F.lit("CRPIX2"), F.col("_alt")).alias("name"), row_number_text((F.col("_height") + 1).cast("double")).alias("value"))
    return out.unionByName(missing)


# Properties that describe how an image was stored, not what it shows.
STORAGE = ("XISF:CreationTime", "XISF:CreatorApplication", "XISF:CreatorModule", "XISF:CreatorOS", "XISF:BlockAlignmentSize", "XISF:MaxInlineBlockSize", "XISF:CompressionCodecs", "XISF:CompressionLevel")


def carried_properties(properties: DataFrame) -> DataFrame:
    """``properties(id, type, block, problem...)`` that go along into another format: no storage facts, nothing unread."""
    return properties.filter(~F.col("id").isin(*STORAGE) & F.col("problem").isNull())


def resolved_pattern(cfa: Column, bayer: Column, x_offset: Column, y_offset: Column) -> Column:
    """A 2x2 mosaic pattern: the image's own, else the keyword's, shifted by its offsets; null if it has not all three colours."""
    dx, dy = (F.pmod(F.coalesce(o.cast("int"), F.lit(0)), F.lit(2)) for o in (x_offset, y_offset))
    moved = F.concat(*(F.substring(bayer, ((F.pmod(dy + y, F.lit(2)) * 2 + F.pmod(dx + x, F.lit(2))) + 1).cast("int"), F.lit(1)) for y in (0, 1) for x in (0, 1)))
    found = F.coalesce(cfa, F.when(bayer.rlike("^[RGB]{4}$"), moved))
    return F.when(found.rlike("^[RGB]{4}$") & found.contains("R") & found.contains("G") & found.contains("B"), found)


def unique_identifiers(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, order, id) with ids made different in order: x, x_2, x_3, whichever is not taken yet.

    Only names of one stem (a name less its trailing numbers) can meet. A stem
    under which a key has a single name is numbered by rank, which costs a sort;
    only stems with several names, where x_2 may be taken already, go through an
    ordered pass. Rows that tie in ``order`` are numbered in any order; a null
    name stays null.
    """
    stem = F.regexp_replace(name, r"(_[0-9]+)+$", "")
    own = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(name).alias("n"), stem.alias("s"))
    mixed = own.groupBy("k", "s").agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a <> b").select(F.col("k").alias("mk"), F.col("s").alias("ms"))
    meets = F.col("k").eqNullSafe(F.col("mk")) & (F.col("s") == F.col("ms"))
    rank = F.row_number().over(W.partitionBy("k", "n").orderBy("o"))
    plain = own.join(mixed, meets, "left_anti").withColumn("r", rank).select("k", "o", F.when(F.col("r") == 1, F.col("n")).otherwise(F.concat("n", F.lit("_"), F.col("r").cast("string"))).alias("id"))
    several = own.join(mixed, meets, "left_semi")
    schema = plain.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("o")
        taken: set[str] = set()
        tried: dict[str, int] = {}  # numbers below this are taken: each is tried once a name
        ids = []
        for n in table["n"].to_pylist():
            found, k = n, tried.get(n, 1)
            while found in taken or k > 1:
                found = n if k == 1 else f"{n}_{k}"
                if found not in taken:
                    break
                k += 1
            tried[n] = k + 1
            taken.add(found)
            ids.append(found)
        return pa.table({"k": table["k"], "o": table["o"], "id": pa.array(ids, pa.string())})

    made = plain.unionByName(several.groupBy("k", "s").applyInArrow(run, schema))
    return made.select(F.col("k").alias(key), F.col("o").alias(order), "id")
