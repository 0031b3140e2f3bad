"""The relational model of images and its transformations.

``bands``: one row a row of samples: (key..., y, values). ``samples``: one row a
sample: (key..., y, x, v). Transformations keep the key columns they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.functions import pixels


def vectors_as_images(vectors: DataFrame, width: int = 8) -> DataFrame:
    """(image, channel, values) of the vector table: each vector one square Float32 image, its label the channel group."""
    return vectors.select(F.col("vec_id").alias("image"), F.col("label").alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("values"), F.lit(width).alias("width"))


def samples(images: DataFrame, *keys: str) -> DataFrame:
    """One row a sample of whole images (key..., width, values)."""
    cells = images.select(*keys, "width", F.posexplode("values").alias("pos", "v"))
    return cells.select(*keys, F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), "v")


def bands(cells: DataFrame, *keys: str) -> DataFrame:
    """Rows of samples from single ones."""
    rows = cells.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("r"))
    return rows.select(*keys, "y", F.col("r.v").alias("values"))


def flip_rows(cells: DataFrame, height: Column) -> DataFrame:
    return cells.withColumn("y", (height - 1 - F.col("y")).cast("int"))


def downsample(cells: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int], whole: bool = False) -> DataFrame:
    """Area-weighted mean of the samples each output sample covers, by exact integer shares.

    Non-finite samples do not count; where none counts the result is NaN. Whole
    results are rounded half up. Sizes are (height, width).
    """
    (h, w), (th, tw) = size, to

    def spans(pos: str, n: int, m: int) -> Column:
        i = F.col(pos).cast("bigint")
        first, last = F.floor(i * m / F.lit(n)).cast("bigint"), F.floor(((i + 1) * m - 1) / F.lit(n)).cast("bigint")
        return F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("to"), (F.least((i + 1) * m, (j + 1) * n) - F.greatest(i * m, j * n)).alias("w")))

    fine = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    across = cells.select(*keys, fine.alias("v"), spans("y", h, th).alias("sy"), F.explode(spans("x", w, tw)).alias("sx"))
    both = across.select(*keys, "v", "sx", F.explode("sy").alias("sy"))
    weight = F.when(F.col("v").isNotNull(), F.col("sx.w") * F.col("sy.w"))
    mean = F.coalesce(F.sum(F.col("v") * weight) / F.sum(weight), F.lit(float("nan")))
    out = both.groupBy(*keys, F.col("sy.to").cast("int").alias("y"), F.col("sx.to").cast("int").alias("x")).agg(mean.alias("v"))
    return out.withColumn("v", F.floor(F.col("v") + 0.5).cast("double")) if whole else out


def debayer(cells: DataFrame, keys: list[str], size: tuple[int, int], pattern: str = "RGGB") -> DataFrame:
    """(key..., y, x, colour, v): bilinear colours of a 2x2 mosaic of whole samples.

    A sample keeps its own colour; another is the mean, rounded half up, of the
    samples of that colour among its eight neighbours inside the image.
    """
    h, w = size
    own = F.element_at(F.split(F.lit(",".join(pattern)), ","), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"))
    coloured = cells.select(*keys, "y", "x", F.col("v").cast("bigint").alias("v"), own.alias("colour"))
    near = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = coloured.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), "v", "colour", F.explode(near).alias("d"))
    spread = spread.select(*keys, (F.col("sy") + F.col("d.dy")).alias("y"), (F.col("sx") + F.col("d.dx")).alias("x"), "v", "colour", ((F.col("d.dy") == 0) & (F.col("d.dx") == 0)).alias("own")).filter(f"y between 0 and {h - 1} and x between 0 and {w - 1}")
    sums = spread.groupBy(*keys, "y", "x", "colour").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("kept"), F.sum("v").alias("s"), F.count("*").alias("n"))
    mean = F.expr("s div n + (pmod(s, n) + n div 2) div n")
    return sums.select(*keys, "y", "x", "colour", F.coalesce("kept", mean).cast("bigint").alias("v"))


def finite_range(cells: DataFrame, *keys: str) -> DataFrame:
    """Least and greatest finite sample (0 and 0 if none) and whether any was not finite."""
    fine = ~F.isnan("v") & (F.abs("v") < F.lit(float("inf")))
    return cells.groupBy(*keys).agg(F.coalesce(F.min(F.when(fine, F.col("v"))), F.lit(0.0)).alias("lower"), F.coalesce(F.max(F.when(fine, F.col("v"))), F.lit(0.0)).alias("upper"), F.bool_or(~fine).alias("non_finite"))


def float_bounds(ranges: DataFrame) -> DataFrame:
    """Display bounds from a finite range: [0, 1] or [0, 65535] if the data lie in it, else their own, at least 1 wide where flat."""
    lo, hi = F.col("lower"), F.col("upper")
    unit, short = (lo >= 0) & (hi <= 1), (lo >= 0) & (hi <= 65535)
    return ranges.withColumn("bound_low", F.when(unit | short, 0.0).otherwise(lo)).withColumn("bound_high", F.when(unit, 1.0).when(short, 65535.0).when(hi > lo, hi).otherwise(lo + 1))


def auto_stretch(images: DataFrame, keys: list[str], lower: float, upper: float, linked_by: str | None = None, most: int = 4 << 20) -> DataFrame:
    """(key..., shadows, midtones, highlights): from the median and the median deviation of Float32 samples.

    Each image is an array, so its statistics need no shuffle; linked ones average
    medians and deviations over ``linked_by``. Of images beyond ``2 * most``
    samples every k-th counts, as the display stretch is defined.
    """
    step = F.greatest(F.lit(1), F.floor(F.size("values") / F.lit(most)).cast("int"))
    x = F.transform(F.filter("values", lambda v, i: i % step == 0), lambda v: pixels.normalise(v, lower, upper).cast("float").cast("double"))
    kept = [*keys, *([linked_by] if linked_by else [])]
    one = images.select(*kept, x.alias("x")).select(*kept, "x", pixels.array_median(F.col("x")).alias("m"))
    dev = F.transform("x", lambda v: F.abs(v - F.col("m")).cast("float").cast("double"))
    stats = one.select(*kept, "m", dev.alias("a")).select(*kept, "m", (1.4826 * pixels.array_median(F.col("a"))).alias("d"))
    if linked_by:
        stats = stats.groupBy(linked_by).agg(F.avg("m").alias("m"), F.avg("d").alias("d"))
        kept = [linked_by]
    s, mid, h = pixels.stretch_params(F.col("m"), F.col("d"))
    return stats.select(*kept, s.alias("shadows"), mid.alias("midtones"), h.alias("highlights"))


def debayer_rows(rows: DataFrame, keys: list[str], pattern: Column | str = "RGGB", whole: bool = True) -> DataFrame:
    """(key..., y, red, green, blue): bilinear colours of the rows ``(key..., y, values)`` of a 2x2 mosaic.

    A sample keeps its own colour; another is the mean of the samples of that
    colour among its eight neighbours inside the image, exact and rounded half
    up where samples are whole, over finite ones (NaN if none is) where not. A
    row needs only the rows above and below it: samples are never single rows.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    order = W.partitionBy(*keys).orderBy("y")
    near = rows.select(*keys, "y", "values", F.lag("values").over(order).alias("up"), F.lead("values").over(order).alias("down"), pattern.alias("_pattern"))
    width = F.size("values")

    def colour(c: str) -> Column:
        at = lambda dy, x: F.substring(F.col("_pattern"), F.pmod(F.col("y") + dy, F.lit(2)).cast("int") * 2 + F.pmod(x, F.lit(2)).cast("int") + 1, F.lit(1)) == c

        def one(x: Column) -> Column:
            terms = []
            for dy, source in ((-1, "up"), (0, "values"), (1, "down")):
                for dx in (-1, 0, 1):
                    if dy or dx:
                        v = F.get(F.col(source), x + dx)
                        good = at(dy, x + dx) & v.isNotNull()
                        terms.append(F.when(good if whole else good & ~F.isnan(v) & (F.abs(v) < float("inf")), v))
            n = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
            total = sum((F.coalesce(t.cast("bigint" if whole else "double"), F.lit(0)) for t in terms), F.lit(0))
            if whole:  # half up: the sum over n, plus a half, downward
                mean = F.floor((2 * total + n) / (2 * n)).cast("double")
            else:
                mean = F.when(n > 0, total / n).otherwise(F.lit(float("nan")))
            return F.when(at(0, x), F.get("values", x).cast("double")).otherwise(mean)

        return F.transform(F.sequence(F.lit(0), width - 1), one)

    return near.select(*keys, "y", *(colour(c).alias(n) for c, n in (("R", "red"), ("G", "green"), ("B", "blue"))))


def downsample_rows(rows: DataFrame, keys: list[str], height: Column, width: Column, to_height: Column, to_width: Column) -> DataFrame:
    """(key..., y, values) of area-weighted means, by exact integer shares; rows that are not finite do not count.

    Each row shrinks across by itself; what is shuffled is one partial sum for
    each output sample and input row, added up before the shuffle.
    """
    own = rows.select(*keys, F.col("y").cast("bigint").alias("y"), "values", height.cast("bigint").alias("h"), width.cast("bigint").alias("w"), to_height.cast("bigint").alias("th"), to_width.cast("bigint").alias("tw"))
    h, w, th, tw = (F.col(c) for c in ("h", "w", "th", "tw"))

    def across(j: Column) -> Column:
        first, last = F.floor(j * w / tw), F.floor(((j + 1) * w - 1) / tw)
        part = F.transform(F.sequence(first, last), lambda i: F.struct(F.get("values", i.cast("int")).cast("double").alias("v"), (F.least((i + 1) * tw, (j + 1) * w) - F.greatest(i * tw, j * w)).cast("double").alias("a")))
        fine = F.filter(part, lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]) & (F.abs(p["v"]) < float("inf")))
        return F.struct(F.aggregate(fine, F.lit(0.0), lambda s, p: s + p["v"] * p["a"]).alias("s"), F.aggregate(fine, F.lit(0.0), lambda s, p: s + p["a"]).alias("a"))

    narrow = own.select(*keys, "y", "h", "th", F.transform(F.sequence(F.lit(0).cast("bigint"), tw - 1), across).alias("c"))
    spans = F.transform(F.sequence(F.floor(F.col("y") * th / h), F.floor(((F.col("y") + 1) * th - 1) / h)), lambda j: F.struct(j.alias("to"), (F.least((F.col("y") + 1) * th, (j + 1) * h) - F.greatest(F.col("y") * th, j * h)).alias("b")))
    cells = narrow.select(*keys, "c", F.explode(spans).alias("o")).select(*keys, F.col("o.to").alias("y"), F.col("o.b").alias("b"), F.posexplode("c").alias("x", "p"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("p.s") * F.col("b")), F.sum(F.col("p.a") * F.col("b"))), F.lit(float("nan")))
    out = cells.groupBy(*keys, "y", "x").agg(mean.alias("v"))
    return bands(out, *keys)
