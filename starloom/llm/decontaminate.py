"""Finds test items inside documents: size-partitioned MinHash containment search, then exact containment.

An item's sketch is its bottom hashes: of n distinct shingles the
``n - ceil(n * percent / 100) + 1`` least. A document that holds enough of an
item misses fewer than that, so it holds one of the sketch at least: no item is
lost, whatever its length. Items are partitioned by the power of two above n. A
partition has a bound that none of its sketches passes, about a quarter of all
hashes for long items, and a least number of shingles that a document needs to
hold one of its items; a document's own sketch is what lies under the bounds of
the partitions it can hold. Documents whose sketch meets an item's are verified
on the exact shingles. All of it is built-in functions.

Arrays are exploded with their empty rows kept: else the optimizer's own filter
on the array's size would compute every array twice, and inside its lambdas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import SPACE, Workspace, small

WIDTH, PERCENT = 5, 80


def words(text: F.Column) -> F.Column:
    """Words of the text in lower case."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def shingles(w: F.Column, width: int) -> F.Column:
    """All runs of ``width`` words, as text; fewer words are one run, none are none."""
    n = F.size(w) - width + 1
    return (
        F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(n < 1, F.array(F.array_join(w, " ")))
        .otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))))
    )


def word_hashes(w: F.Column) -> F.Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _hashes(v: F.Column, width: int) -> F.Column:
    """64-bit hashes of ``shingles``, from the words' own hashes; fewer words as a shingle of that width."""
    n = F.size(v) - width + 1
    out = F.when(F.size(v) == 0, F.array().cast("array<bigint>"))
    for few in range(1, width):
        out = out.when(F.size(v) == few, F.array(F.xxhash64(*(F.get(v, F.lit(k)) for k in range(few)))))
    return out.otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(width)))))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, th, item, n_shingles, n_found) of each document that holds at least ``percent`` of an item's distinct shingles.

    th is the document text's xxhash64; rows equal in id and text are one
    document, as are items equal in id and text. Null or wordless texts hold
    nothing and are held nowhere; an item of fewer words than ``width`` is one
    shingle. Null ids are ids. Empty tables give no rows.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    own = items.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_text)).alias("ih"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    own = own.select("*", F.least(F.size("w"), F.lit(width)).alias("k"))
    listed = own.select("item", "ih", "k", F.explode(F.array_distinct(shingles(F.col("w"), width))).alias("s"), F.size(F.array_distinct(shingles(F.col("w"), width))).alias("n")).distinct()
    items_of = ws.save(listed, "items")
    sketch = F.expr(f"slice(h, 1, size(h) - cast(ceil(size(h) * {percent} / 100) as int) + 1)")
    sketched = own.select("item", "ih", "k", F.sort_array(F.array_distinct(_hashes(word_hashes(F.col("w")), width))).alias("h"))
    sketched = ws.save(sketched.select("k", F.size("h").alias("n"), sketch.alias("h")), "sketches")
    wanted = ws.save(sketched.select(F.explode("h").alias("h")).distinct(), "hashes")
    part = F.ceil(F.log2(F.col("n").cast("double"))).alias("part")
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    parts = sketched.groupBy("k", part).agg(F.max(F.element_at("h", -1)).alias("bound"), F.min(need).alias("need")).collect()  # one row a power of two and short length

    text = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), words(F.col(text_col)).alias("w"))
    # Items shorter than a shingle are looked for at their own length, in the same pass.
    lengths = sorted({r["k"] for r in parts} - {width})
    bounds = {k: _bound(F.size("w") - k + 1, [r for r in parts if r["k"] == k]) for k in [width, *lengths]}
    hashed = text.select("id", "th", word_hashes(F.col("w")).alias("v"), *(b.alias(f"b{k}") for k, b in bounds.items()))
    held = [_under(_hashes(F.col("v"), k), F.col(f"b{k}")) for k in bounds]
    found = hashed.select("id", "th", (F.flatten(F.array(*held)) if lengths else held[0]).alias("m"))
    hit = found.select("id", "th", F.explode_outer("m").alias("h")).join(small(wanted), "h").select("id", "th").distinct()
    hit = ws.save(hit, "candidates")

    n_hit = small(hit.select(F.col("id").alias("hid"), F.col("th").alias("hth")))
    full = text.join(n_hit, text["id"].eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).select("id", "th", "w")
    every = F.flatten(F.array(*(F.when((F.size("w") >= k) | (k == width), shingles(F.col("w"), k)).otherwise(F.array().cast("array<string>")) for k in [width, *lengths])))
    place = full.select("id", "th", F.explode_outer(every).alias("s"))
    matched = place.join(small(items_of), "s").groupBy("id", "th", "item", "ih").agg(F.first("n").alias("n_shingles"), F.count_distinct("s").alias("n_found"))
    matched = matched.filter(100 * F.col("n_found") >= percent * F.col("n_shingles"))
    best = F.max(F.struct(F.col("n_found") / F.col("n_shingles"), F.col("n_shingles").cast("bigint").alias("n"), F.col("n_found").cast("bigint").alias("f"))).alias("b")
    return matched.groupBy(F.col("id").alias(id_col), "th", F.col("item").alias(item_col)).agg(best).select(id_col, "th", item_col, F.col("b.n").alias("n_shingles"), F.col("b.f").alias("n_found"))


def _bound(n: F.Column, parts: list) -> F.Column:
    """The greatest bound of the partitions whose need a text of ``n`` shingles meets; null if there is none."""
    return F.greatest(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), *(F.when(n >= r["need"], F.lit(r["bound"])) for r in parts))


def _under(hashes: F.Column, bound: F.Column) -> F.Column:
    return F.filter(F.when(bound.isNotNull(), hashes).otherwise(F.array().cast("array<bigint>")), lambda h: h <= bound)
