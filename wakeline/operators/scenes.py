"""Scenes as tables of pixels: validity, tiles and their selection, augmentation, combined statistics, rules and problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.hashing import stable_unit
from .quantiles import quantiles
from .sampling import first_values
from .stencils import box_means, medians


def invalid(channels: list[Column], nodata: Column | None = None, header: Column | None = None) -> Column:
    """Whether any channel is missing, not finite or the no-data value; a header's value goes before the file's."""
    unset = F.coalesce(*[x for x in (header, nodata) if x is not None]) if nodata is not None or header is not None else F.lit(None).cast("double")
    odd = [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | F.coalesce(c == unset, F.lit(False)) for c in channels]
    out = odd[0]
    for o in odd[1:]:
        out = out | o
    return out


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Whole tiles of size x size of each scene (scene, row_i, col_i, value, oil, invalid): scene, row, col, pixels, oil and invalid shares, mean of the values.

    An invalid pixel is never oil; the ragged edge by the scene's own extent is left out.
    """
    whole = lambda c: (F.floor((F.max(c) + 1) / size) * size).alias(f"_{c}")
    p = pixels.join(pixels.groupBy("scene").agg(whole("row_i"), whole("col_i")), "scene").filter("row_i < _row_i and col_i < _col_i")
    at = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    n = F.count(F.lit(1))
    return p.groupBy("scene", at("row_i").alias("row"), at("col_i").alias("col")).agg(n.alias("pixels"), (F.count_if(F.col("oil") & ~F.col("invalid")) / n).alias("oil_share"), (F.count_if("invalid") / n).alias("invalid_share"), F.avg("value").alias("mean"))


def choose(found: DataFrame, most: int, negatives: float, least_oil: float, most_invalid: float, seed: int) -> DataFrame:
    """The tiles that a scene contributes: those with most oil, and a bounded number without any.

    Of ``most`` tiles a share of 1 / (1 + negatives) may hold oil.  For each of them
    ``negatives`` clean ones are drawn, in hash order, from the darkest twice as many.
    """
    use = found.filter(F.col("invalid_share") < most_invalid)
    cap = max(1, round(most / (1 + negatives)))
    w = Window.partitionBy("scene")
    pos = use.filter(F.col("oil_share") >= least_oil).withColumn("_n", F.row_number().over(w.orderBy(F.desc("oil_share"), "row", "col"))).filter(F.col("_n") <= cap)
    want = pos.groupBy("scene").agg(F.count(F.lit(1)).alias("_p")).select("scene", F.least(F.bround(F.col("_p") * F.lit(float(negatives))), F.greatest(F.lit(0), F.lit(most) - F.col("_p"))).cast("long").alias("_want"))
    neg = use.filter("oil_share = 0").join(want, "scene").withColumn("_n", F.row_number().over(w.orderBy("mean", "row", "col"))).filter(F.col("_n") <= 2 * F.col("_want"))
    key = F.concat_ws("/", "scene", "row", "col")
    neg = neg.withColumn("_n", F.row_number().over(w.orderBy(stable_unit(key, seed), "row", "col"))).filter(F.col("_n") <= F.col("_want"))
    out = lambda df, kind: df.select(*found.columns, F.lit(kind).alias("kind"))
    return out(pos, "oil").unionByName(out(neg, "clean"))


def turned(pixels: DataFrame, size: int, how: str) -> DataFrame:
    """Pixels of square tiles (row_i, col_i from 0) flipped or turned; image and label move together since they are columns of one row."""
    r, c, last = F.col("row_i"), F.col("col_i"), size - 1
    place = {"flip_rows": (last - r, c), "flip_cols": (r, last - c), "quarter": (last - c, r), "half": (last - r, last - c), "three_quarters": (c, last - r)}[how]
    return pixels.withColumns({"row_i": place[0].cast("int"), "col_i": place[1].cast("int")})


# Band positions of the orders that an operator may declare.
ORDERS = {"vh,vv": (1, 0), "vv,vh": (0, 1)}


def bands(names: Column, declared: Column, count: Column) -> Column:
    """struct(vv, vh, basis): band positions by the header's names, else by the declared order, else as usually supplied (VH, VV); null with too few bands."""
    pos = lambda pol: F.array_position(F.transform(names, lambda n: F.upper(n).rlike(f"(^|[^A-Z0-9]){pol}([^A-Z0-9]|$)")), True) - 1
    vv, vh = pos("VV"), pos("VH")
    row = lambda a, b, basis: F.struct(F.lit(a).cast("int").alias("vv") if isinstance(a, int) else a.cast("int").alias("vv"), F.lit(b).cast("int").alias("vh") if isinstance(b, int) else b.cast("int").alias("vh"), F.lit(basis).alias("basis"))
    out = F.when((vv >= 0) & (vv < count) & (vh >= 0) & (vh < count), row(vv, vh, "header"))
    for order, (a, b) in ORDERS.items():
        out = out.when((F.lower(F.trim(declared)) == order) & (count >= 2), row(a, b, "declared"))
    return out.when(declared.isNull() & (count >= 2), row(1, 0, "assumed"))


def combined(stats: DataFrame, *keys: str) -> DataFrame:
    """Statistics of parts brought together: least of lo, greatest of hi, sums of counts, mean of the parts' means (each part counts once)."""
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("valid").alias("valid"), F.sum("zeros").alias("zeros"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("mean").alias("mean"))


def separation(pixels: DataFrame, *keys: str) -> DataFrame:
    """Mean value over oil and over the rest, and their difference; null where a class is missing."""
    v = lambda cond: F.avg(F.when(cond & ~F.col("invalid"), F.col("value")))
    return pixels.groupBy(*keys).agg(v(F.col("oil")).alias("oil_mean"), v(~F.col("oil")).alias("sea_mean")).withColumn("difference", F.col("oil_mean") - F.col("sea_mean"))


def bounds(scenes: DataFrame, *keys: str) -> DataFrame:
    return scenes.groupBy(*keys).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def stretched(pixels: DataFrame, key: str = "scene", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds grey (0 to 255): values between two percentiles of the valid pixels of a scene; invalid ones are 0, and a flat scene is all 0."""
    q = quantiles(pixels.filter("not invalid"), "value", [low, high], key).withColumnRenamed("q", "_q")
    p = pixels.join(q, key, "left")
    share = F.try_divide(F.col("value") - F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0])
    return p.withColumn("grey", F.when(F.col("invalid") | share.isNull(), 0).otherwise(F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) + 0.5)).cast("int")).drop("_q")


def tile_origins(extent: Column, tile: int, step: int) -> Column:
    """Starts of tiles that cover an extent; the last is pulled back to fit, and a small extent has one at 0."""
    return F.when(extent <= tile, F.array(F.lit(0).cast("int"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), extent.cast("int") - 1, F.lit(step)), lambda s: F.least(s, (extent - tile).cast("int")))))


def ground_spacing_m(corners: list[tuple[Column, Column]], width: Column, height: Column) -> Column:
    """Metres a pixel from four corners (upper left, upper right, lower right, lower left): the mean over both directions."""
    (ul, ur, lr, ll) = corners
    side = lambda a, b: haversine_km(a[0], a[1], b[0], b[1]) * 1000
    across, down = (side(ul, ur) + side(ll, lr)) / 2 / width, (side(ul, ll) + side(ur, lr)) / 2 / height
    return (across + down) / 2


def problems(scenes: DataFrame, rules: list[tuple[str, str, Column, Column]], key: str = "scene") -> DataFrame:
    """A row for each rule (severity, kind, condition, message) that a scene breaks; a condition that is null is not broken."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), m.alias("message"))) for s, k, cond, m in rules]))
    return scenes.select(key, F.explode(found).alias("p")).select(key, "p.severity", "p.kind", "p.message")


def listed(found: DataFrame, most: int = 100, key: str = "scene") -> DataFrame:
    """kind, severity, n, first: how often each kind occurs, and its first scenes (at most so many: a report).

    The first scenes of a kind are brought together in two steps, so no task meets all rows of a frequent kind.
    """
    by = ["kind", "severity"]
    least = first_values(found.select(*by, key), key, most, *by)
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(least, by).select(*by, "n", F.col(key).alias("first"))


def dark(pixels: DataFrame, reach: int, contrast: float, despeckle: int = 0) -> DataFrame:
    """Adds contrast (how far a pixel lies below its surroundings) and dark (at least ``contrast``).

    With ``despeckle`` (3 or 5) values are medians of so many cells before.
    """
    p = medians(pixels, despeckle) if despeckle else pixels.withColumn("median", F.col("value"))
    p = box_means(p, reach, "median").withColumn("contrast", F.col("box_mean") - F.col("median"))
    return p.withColumn("dark", F.coalesce(~F.col("invalid") & (F.col("contrast") >= contrast), F.lit(False))).drop("box_mean", "median")


def write_by_split(tiles_: DataFrame, path: str) -> None:
    """Tiles as a table with a folder for each split."""
    tiles_.write.partitionBy("split").parquet(path)
