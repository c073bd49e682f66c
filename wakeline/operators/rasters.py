"""Rasters as tables of pixels or tiles: statistics, pooling, areas, shapes, overlaps, grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, free, table
from . import blocks
from .blocks import smoothed
from .graph import components
from .quantiles import quantiles
from .stencils import gradients

M_PER_DEG = math.pi / 180 * 6_371_008.8


def band_stats(pixels: DataFrame, *keys: str) -> DataFrame:
    """Raw and valid statistics of each band; percentiles are exact and no task holds a large band's values."""
    shares = {"p005": 0.005, "p01": 0.01, "p50": 0.5, "p99": 0.99, "p995": 0.995}
    v = F.when(~F.col("invalid"), F.col("value"))
    p = pixels.withColumn("v", v)
    out = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.count_if(F.col("value") == 0).alias("zeros"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    q = quantiles(p, "v", list(shares.values()), *keys)
    same = [out[k].eqNullSafe(q[k]) for k in keys]
    return (out.join(q, same) if keys else out.crossJoin(F.broadcast(q))).select(*[out[k] for k in keys], "n", "valid", "zeros", "lo", "hi", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(shares)])


def norm_stats(pixels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Mean and deviation from sums (single pass, combinable), and two exact percentiles to clip at."""
    p = pixels.filter("not invalid")
    s = p.agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("value").alias("n"))
    mean = F.col("s") / F.col("n")
    out = s.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))
    q = quantiles(p, "value", [low, high]).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return out.join(F.broadcast(q), F.lit(True), "left")  # one row each


def standardise(x: Column, lo: float, hi: float, mean: float, std: float) -> Column:
    """Clip, then standardise; nothing becomes 0."""
    return F.coalesce((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - mean) / max(std, 1e-6), F.lit(0.0))


def pool(pixels: DataFrame, factor: int, how: str) -> DataFrame:
    """Mean or max over blocks; the ragged edge, by the raster's own extent, is trimmed."""
    whole = lambda c: (F.floor((F.max(c) + 1) / factor) * factor).alias(f"_{c}")
    inside = pixels.crossJoin(F.broadcast(pixels.agg(whole("row_i"), whole("col_i")))).filter("row_i < _row_i and col_i < _col_i")
    agg = F.avg("value") if how == "mean" else F.max("value")
    return inside.groupBy(F.floor(F.col("row_i") / factor).cast("int").alias("r"), F.floor(F.col("col_i") / factor).cast("int").alias("c")).agg(agg.alias("value"))


def pixel_area_m2(row: Column, lat0: float, step_deg: float) -> Column:
    """Area of a north-up pixel by the latitude of its centre."""
    return F.pow(F.lit(step_deg * M_PER_DEG), 2) * F.cos(F.radians(lat0 - (row + 0.5) * step_deg))


def mask_area_km2(pixels: DataFrame, lat0: float, step_deg: float) -> DataFrame:
    by_row = pixels.filter("oil and not invalid").groupBy("row_i").agg(F.count(F.lit(1)).alias("n"))
    return by_row.agg((F.sum(F.col("n") * pixel_area_m2(F.col("row_i"), lat0, step_deg)) / 1e6).alias("area_km2"))


def shape(points: DataFrame, *keys: str) -> DataFrame:
    """Principal axis of points (x, y) per key: orientation in degrees, length and width (full extents along the axes)."""
    m = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    m = m.withColumn("theta", 0.5 * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")))
    j = points.join(m, list(keys)) if keys else points.crossJoin(F.broadcast(m))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    j = j.withColumn("u", dx * F.cos("theta") + dy * F.sin("theta")).withColumn("w", dy * F.cos("theta") - dx * F.sin("theta"))
    return j.groupBy(*keys).agg(F.degrees(F.first("theta")).alias("orientation"), (F.max("u") - F.min("u")).alias("length"), (F.max("w") - F.min("w")).alias("width"), F.count(F.lit(1)).alias("n"))


def attribute_overlap(patches: DataFrame, slicks: DataFrame) -> DataFrame:
    """For each patch (patch, row_i, col_i) the slick with most shared pixels (ties: least id) and the shared share."""
    size = patches.groupBy("patch").agg(F.count(F.lit(1)).alias("size"))
    n = patches.join(slicks, ["row_i", "col_i"]).groupBy("patch", "slick").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("patch").agg(F.max_by(F.struct("slick", "n"), F.struct("n", -F.col("slick"))).alias("b"))
    return size.join(best, "patch", "left").select("patch", F.col("b.slick").alias("slick"), (F.coalesce("b.n", F.lit(0)) / F.col("size")).alias("share"))


def bilinear(queries: DataFrame, grid: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Value at (x, y) from the four cells around; missing cells drop out and weights are renormalised, 0 with none."""
    q = queries.withColumn("fx", (F.col("x") - x0) / step).withColumn("fy", (F.col("y") - y0) / step).withColumn("ix", F.floor("fx")).withColumn("iy", F.floor("fy"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    q = q.select("qid", "fx", "fy", "ix", "iy", corner.alias("k"))
    part = lambda f, i, k: F.when(k == 1, f - i).otherwise(1 - (f - i))
    q = q.withColumn("w", part(F.col("fx"), F.col("ix"), F.col("k.a")) * part(F.col("fy"), F.col("iy"), F.col("k.b"))).withColumn("gi", (F.col("ix") + F.col("k.a")).cast("int")).withColumn("gj", (F.col("iy") + F.col("k.b")).cast("int"))
    j = q.join(grid.filter("value is not null"), ["gi", "gj"], "left").withColumn("wv", F.when(F.col("value").isNotNull(), F.col("w")))
    return j.groupBy("qid").agg(F.coalesce(F.try_divide(F.sum(F.col("wv") * F.col("value")), F.sum("wv")), F.lit(0.0)).alias("value"))


def shoelace(vertices: DataFrame, ring: str) -> DataFrame:
    """Signed area (positive: counter-clockwise) and perimeter of closed rings of vertices (ring, n, x, y)."""
    from pyspark.sql import Window

    w = Window.partitionBy(ring).orderBy("n")
    first = F.first("x").over(w), F.first("y").over(w)
    e = vertices.withColumn("x2", F.coalesce(F.lead("x").over(w), first[0])).withColumn("y2", F.coalesce(F.lead("y").over(w), first[1]))
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return e.groupBy(ring).agg((F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter"))


def neighbours(mask: DataFrame, how: str) -> DataFrame:
    """3 x 3 erosion or dilation of a mask table (scene, row_i, col_i): joins on shifted cells, cells outside count as clear."""
    spread = mask.select("scene", F.explode(F.sequence(F.col("row_i") - 1, F.col("row_i") + 1)).alias("row_i"), "col_i").select("scene", "row_i", F.explode(F.sequence(F.col("col_i") - 1, F.col("col_i") + 1)).alias("col_i"))
    n = spread.groupBy("scene", "row_i", "col_i").agg(F.count(F.lit(1)).alias("n"))
    return (n.filter("n = 9") if how == "erode" else n).select("scene", "row_i", "col_i")


def connected_regions(mask: DataFrame) -> DataFrame:
    """8-connected regions of each scene's mask (scene, row_i, col_i): adds region, the same number for all cells of a region.

    Cells are joined to parts inside blocks; only parts that meet across the border of a
    block are links of graph.components, so a scene of any size is shared by all tasks
    and the rounds see few rows.
    """
    cells = table(blocks.parts(mask))
    half = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    rim = cells.filter("border").select("scene", "row_i", "col_i", "part")
    asked = rim.select("scene", F.col("part").alias("a"), F.explode(half).alias("k"), "row_i", "col_i").select("scene", "a", (F.col("row_i") + F.col("k.a")).alias("row_i"), (F.col("col_i") + F.col("k.b")).alias("col_i"))
    links = asked.join(rim.withColumnRenamed("part", "b"), ["scene", "row_i", "col_i"]).filter("a <> b").select("a", "b")
    labels = components(links)
    return cells.join(labels, F.col("part") == F.col("node"), "left").select("scene", "row_i", "col_i", F.coalesce("root", "part").alias("region"))


def hull(points: DataFrame) -> DataFrame:
    """Convex hull vertices (grp, n, x, y), counter-clockwise from the least x (of equals the least y).

    Rounds over all groups at once: of the points outside an edge the farthest becomes a
    vertex and the edge becomes two; points inside the new edges are left out.  What a
    round passes on is one extreme point an edge, found with map-side combination, and
    ties go to the least point, so points on an edge are no vertices.
    """
    p = F.struct("x", "y")
    pts = points.select("grp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    ends = cut(pts.groupBy("grp").agg(F.min(p).alias("a"), F.max(p).alias("b")))
    found = [ends.select("grp", F.lit(0).alias("side"), "a.x", "a.y"), ends.filter("a <> b").select("grp", F.lit(0).alias("side"), "b.x", "b.y")]
    # the lower edge runs from the first to the last point, the upper one back; what lies to the right of an edge is outside
    edges = ends.filter("a <> b").select("grp", F.explode(F.array(F.struct("a", "b", F.lit(0).alias("side")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("side")))).alias("e"))
    right = lambda a, b, q: (q("x") - a("x")) * (b("y") - a("y")) - (q("y") - a("y")) * (b("x") - a("x"))
    of = lambda c: lambda k: F.col(f"{c}.{k}")
    left = pts.distinct().select("grp", p.alias("p")).join(edges, "grp").select("grp", "p", "e.a", "e.b", "e.side", right(of("e.a"), of("e.b"), of("p")).alias("out")).filter("out > 0")
    left = cut(left)
    while left.limit(1).count():
        top = left.groupBy("grp", "side", "a", "b").agg(F.max_by("p", F.struct("out", -F.col("p.x"), -F.col("p.y"))).alias("q"))
        top = cut(top)
        found.append(top.select("grp", "side", "q.x", "q.y"))
        two = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("q").alias("v")), F.struct(F.col("q").alias("u"), F.col("b").alias("v"))))
        more = left.drop("out").join(top, ["grp", "side", "a", "b"]).select("grp", "side", "p", two.alias("e"))
        left = cut(more.select("grp", "side", "p", F.col("e.u").alias("a"), F.col("e.v").alias("b"), right(of("e.u"), of("e.v"), of("p")).alias("out")).filter("out > 0"))
    vertices = reduce(DataFrame.unionByName, found)
    lowest = F.col("side") == 0
    order = Window.partitionBy("grp").orderBy("side", F.when(lowest, F.col("x")).otherwise(-F.col("x")), F.when(lowest, F.col("y")).otherwise(-F.col("y")))
    return vertices.withColumn("n", F.row_number().over(order) - 1).select("grp", "n", "x", "y")


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the cells of a disc."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def morph(mask: DataFrame, how: str, offsets: list[tuple[int, int]], *keys: str) -> DataFrame:
    """Erosion, dilation, opening or closing of a mask table (keys, row_i, col_i) by a set of offsets; cells outside count as clear.

    Each cell is spread over the offsets and counted: an equi-aggregation, whatever the raster's size.
    """
    keys = keys or ("scene",)
    if how in ("open", "close"):
        first, then = ("erode", "dilate") if how == "open" else ("dilate", "erode")
        return morph(morph(mask, first, offsets, *keys), then, offsets, *keys)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    at = mask.select(*keys, "row_i", "col_i", near.alias("k")).select(*keys, (F.col("row_i") + F.col("k.a")).cast("int").alias("row_i"), (F.col("col_i") + F.col("k.b")).cast("int").alias("col_i"))
    n = at.groupBy(*keys, "row_i", "col_i").agg(F.count(F.lit(1)).alias("n"))
    return (n.filter(F.col("n") == len(offsets)) if how == "erode" else n).select(*keys, "row_i", "col_i")


def dark_regions(pixels: DataFrame, sigma: float, k: float, open_radius: int, close_radius: int, min_area: int, most: int) -> DataFrame:
    """scene, region (1 for the largest), row_i, col_i: regions darker than their scene's mean by k deviations after smoothing, cleaned, of some size; at most so many a scene (a report)."""
    p = table(smoothed(pixels, sigma).filter("not invalid").select("scene", "row_i", "col_i", "smooth"))
    limit = p.groupBy("scene").agg((F.avg("smooth") - k * F.stddev_pop("smooth")).alias("limit"))
    mask = p.join(limit, "scene").filter(F.col("smooth") <= F.col("limit")).select("scene", "row_i", "col_i")
    for how, radius in (("open", open_radius), ("close", close_radius)):
        mask = morph(mask, how, disc(radius)) if radius else mask
    cells = table(connected_regions(mask))
    free(p)
    size = cells.groupBy("scene", "region").agg(F.count(F.lit(1)).alias("area"), F.min(F.struct("row_i", "col_i")).alias("first")).filter(F.col("area") >= min_area)
    w = Window.partitionBy("scene").orderBy(F.desc("area"), "first")
    size = size.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("scene", "region", "place")
    return cells.join(size, ["scene", "region"]).select("scene", F.col("place").alias("region"), "row_i", "col_i")


def solidity(regions: DataFrame) -> DataFrame:
    """scene, region, solidity: the share of the convex hull around a region's cells that they fill; only the ends of its rows can be hull corners."""
    rows = regions.groupBy("scene", "region", "row_i").agg(F.min("col_i").alias("c0"), (F.max("col_i") + 1).alias("c1"), F.count(F.lit(1)).alias("n"))
    grp = F.to_json(F.struct("scene", "region"))
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("x"), (F.col("row_i") + k).alias("y")) for c in ("c0", "c1") for k in (0, 1)]))
    around = shoelace(hull(rows.select(grp.alias("grp"), ends.alias("p")).select("grp", "p.x", "p.y")), "grp")
    area = rows.groupBy("scene", "region").agg(F.sum("n").alias("cells")).withColumn("grp", grp)
    return area.join(around, "grp").select("scene", "region", (F.col("cells") / F.col("area")).alias("solidity"))


def edge_sharpness(pixels: DataFrame, regions: DataFrame, around: DataFrame, sigma: float, width: int = 1) -> DataFrame:
    """scene, region, edge_sharpness: the mean gradient of the smoothed values across a region's edge over that of its surroundings (0 where those are flat)."""
    steep = cut(gradients(smoothed(pixels, sigma), "smooth").select("scene", "row_i", "col_i", "gradient"))
    at = ["scene", "region", "row_i", "col_i"]
    band = morph(regions, "dilate", disc(width), "scene", "region").join(morph(regions, "erode", disc(width), "scene", "region"), at, "left_anti")
    mean = lambda cells, name: cells.join(steep, ["scene", "row_i", "col_i"]).groupBy("scene", "region").agg(F.avg("gradient").alias(name))
    both = mean(band, "edge").join(mean(around.select(*at), "sea"), ["scene", "region"], "left")
    return both.select("scene", "region", F.when(F.col("sea") > 1e-6, F.col("edge") / F.col("sea")).otherwise(0.0).alias("edge_sharpness"))


def region_features(pixels: DataFrame, regions: DataFrame, reach: int, sigma: float = 1.0) -> DataFrame:
    """scene, region, area, darkness_z, darkness_p10_z, texture_ratio, edge_sharpness, compactness, solidity, elongation: a region against the valid pixels around it.

    All are unchanged by a gain and an offset of the values.  Cells of other regions are not surroundings.
    """
    regions = cut(regions)
    inside = regions.join(pixels.filter("not invalid"), ["scene", "row_i", "col_i"])
    around = morph(regions, "dilate", disc(reach), "scene", "region").join(regions.select("scene", "row_i", "col_i").distinct(), ["scene", "row_i", "col_i"], "left_anti").join(pixels.filter("not invalid"), ["scene", "row_i", "col_i"])
    around = cut(around)
    sharp = edge_sharpness(pixels, regions, around, sigma)
    ring = around.groupBy("scene", "region").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    own = inside.groupBy("scene", "region").agg(F.count(F.lit(1)).alias("area"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.1)).alias("p10"))
    sides = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sides]))
    next_ = regions.select("scene", "region", "row_i", "col_i", step.alias("k")).select("scene", "region", (F.col("row_i") + F.col("k.a")).alias("row_i"), (F.col("col_i") + F.col("k.b")).alias("col_i"))
    edge = next_.join(regions, ["scene", "region", "row_i", "col_i"], "left_anti").groupBy("scene", "region").agg(F.count(F.lit(1)).alias("edge"))
    form = shape(regions.select("scene", "region", F.col("col_i").cast("double").alias("x"), F.col("row_i").cast("double").alias("y")), "scene", "region").select("scene", "region", F.try_divide(F.col("length") + 1, F.col("width") + 1).alias("elongation"))
    j = own.join(ring, ["scene", "region"], "left").join(edge, ["scene", "region"]).join(form, ["scene", "region"]).join(sharp, ["scene", "region"]).join(solidity(regions), ["scene", "region"])
    z = lambda c: F.try_divide(F.col(c) - F.col("m"), F.col("s"))
    return j.select("scene", "region", "area", z("mean").alias("darkness_z"), z("p10").alias("darkness_p10_z"), F.try_divide("std", "s").alias("texture_ratio"), "edge_sharpness", (4 * math.pi * F.col("area") / (F.col("edge") * F.col("edge"))).alias("compactness"), "solidity", "elongation")


def box_cells(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, row_i, col_i: the cells of boxes (x0, y0, x1, y1; half-open, in cells), each once; boxes without area have none."""
    whole = lambda lo, hi: F.sequence(F.ceil(F.col(lo)).cast("int"), F.ceil(F.col(hi)).cast("int") - 1)
    some = boxes.filter("ceil(x1) > ceil(x0) and ceil(y1) > ceil(y0)")
    return some.select(*keys, F.explode(whole("y0", "y1")).alias("row_i"), whole("x0", "x1").alias("cols")).select(*keys, "row_i", F.explode("cols").alias("col_i")).distinct()


def alarms(regions: DataFrame, patches: DataFrame, min_area: int) -> DataFrame:
    """scene, largest, alarm for every patch: whether it holds a region of at least so many cells."""
    size = regions.groupBy("scene", "region").agg(F.count(F.lit(1)).alias("n")).groupBy("scene").agg(F.max("n").alias("largest"))
    return patches.select("scene").distinct().join(size, "scene", "left").select("scene", F.coalesce("largest", F.lit(0)).alias("largest")).withColumn("alarm", F.col("largest") >= min_area)
