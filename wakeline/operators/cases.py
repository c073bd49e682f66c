"""Case documents and listings: keys, names, sections, look-ups with fallbacks, and what leaves the engine as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_key(scene: Column, detector: Column, particles: Column, seed: Column, horizon_h: Column, uploads: dict[str, Column], acquired: Column, order: Column) -> Column:
    """The identity of a request; parts that are null are left out.  ``uploads``: a letter for each kind and the file's path."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", horizon_h.cast("double")), "0+$", ""), r"\.$", "")
    return F.concat_ws(
        ":", scene, detector, particles.cast("string"), seed.cast("string"), F.when(horizon_h.isNotNull(), F.concat(F.lit("h"), plain)),
        *[F.when(p.isNotNull(), F.concat(F.lit(k), stem(p))) for k, p in uploads.items()], F.concat(F.lit("t"), acquired), F.concat(F.lit("b"), order),
    )


def content_id(content: Column, kind: Column, n: int = 16) -> Column:
    """kind-<leading hex digits of the content's SHA-256>: equal content has one id."""
    return F.concat_ws("-", kind, F.substring(F.sha2(content, 256), 1, n))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def name_parts(path: Column) -> Column:
    """struct(folder, stem, suffix) of a path; a leading dot is no suffix."""
    file = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(file, r"(?<=.)(\.[^.]+)$", 1))
    return F.struct(F.nullif(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit("")).alias("folder"), F.regexp_replace(file, r"(?<=.)\.[^.]+$", "").alias("stem"), F.nullif(suffix, F.lit("")).alias("suffix"))


def coordinates(lat: Column, lon: Column) -> Column:
    """``55.242 N, 4.058 E``."""
    one = lambda x, plus, minus: F.concat(F.format_string("%.3f ", F.round(F.abs(x), 3)), F.when(x >= 0, plus).otherwise(minus))
    return F.when(lat.isNull() | lon.isNull(), "unknown").otherwise(F.concat_ws(", ", one(lat, "N", "S"), one(lon, "E", "W")))


def abridged(items: Column, most: int = 8) -> Column:
    """A list of texts, its middle replaced by how many are left out."""
    half, n = most // 2, F.size(items)
    return F.when(n <= most, items).otherwise(F.concat(F.slice(items, 1, half), F.array(F.concat(F.lit("... "), (n - most).cast("string"), F.lit(" more ..."))), F.slice(items, -half, half)))


def nested(document: Column, path: str, default: str) -> Column:
    """A field of a JSON document by its path, or the default where any step is missing or null."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def allowed(address: Column, entries: list[str]) -> Column:
    """Whether an address is listed in full, or its domain is (``@domain``); without entries every address is."""
    low = [e.lower() for e in entries]
    if not low:
        return F.lit(True)
    hit = F.lower(address).isin([e for e in low if not e.startswith("@")]) if any(not e.startswith("@") for e in low) else F.lit(False)
    return reduce(lambda a, e: a | F.lower(address).endswith(e), [e for e in low if e.startswith("@")], hit)


def with_fallback(rows: DataFrame, other: DataFrame, key: str, spellings: list[str], out: str, last: Column) -> DataFrame:
    """rows left joined with other on key; ``out`` is the first spelling of the column that has a value, else ``last``."""
    o = other.select(key, *[F.col(c).alias(f"_{c}") for c in spellings])
    return rows.join(o, key, "left").withColumn(out, F.coalesce(*[F.col(f"_{c}") for c in spellings], last)).drop(*[f"_{c}" for c in spellings])


def listing(scenes: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """scenes with a flag has_<name> for each other table that holds the key (repeats there do not matter)."""
    for name, df in others.items():
        scenes = scenes.join(df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return scenes


def picked(listed: DataFrame, key: str, *ranks: Column) -> DataFrame:
    """One row: the first by the ranks (greatest first, nulls last), then by key: the best that exists, else the next best."""
    order = F.struct(*[F.coalesce(r.cast("double"), F.lit(float("-inf"))) for r in ranks])
    return listed.groupBy(order.alias("_o")).agg(F.min(key).alias(key)).agg(F.max_by(key, "_o").alias(key))


def by_verdict(regions: DataFrame, case: str, most: int = 6) -> DataFrame:
    """The regions of each case that need a look first: rejected, uncertain, unscreened, accepted, larger ones first (at most so many: a report)."""
    order = F.when(F.col("verdict") == "rejected", 0).when(F.col("verdict") == "uncertain", 1).when(F.col("verdict") == "accepted", 3).otherwise(2)
    w = Window.partitionBy(case).orderBy(order, F.desc("area"), "region")
    return regions.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def component_tally(regions: DataFrame, case: str) -> DataFrame:
    """Regions of each case by verdict; one without a verdict is unscreened."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("accepted", "uncertain", "rejected")}
    return regions.groupBy(case).agg(F.count(F.lit(1)).alias("regions"), *[c.alias(v) for v, c in n.items()], F.count_if(F.col("verdict").isNull()).alias("unscreened"))


def distinct_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, values: the distinct values in order (few a key: classes, codes), nulls left out."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias("values"))


def side_by_side(one: DataFrame, two: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Two metric tables (key, value) merged: both values, which of them there are, and the difference."""
    a, b = one.select(key, F.col("value").alias(names[0])), two.select(key, F.col("value").alias(names[1]))
    both = F.when(F.col(names[0]).isNull(), f"no {names[0]}").when(F.col(names[1]).isNull(), f"no {names[1]}").otherwise("both")
    return a.join(b, key, "full").withColumn("basis", both).withColumn("difference", F.col(names[1]) - F.col(names[0]))


def provenance(cases: DataFrame, case: str, slots: list[str], default: str) -> DataFrame:
    """A row for each case and input slot: the file and whether the operator gave it, else the default."""
    row = [F.struct(F.lit(s).alias("slot"), F.coalesce(F.col(s), F.lit(default)).alias("file"), F.when(F.col(s).isNull(), "dataset").otherwise("operator").alias("origin")) for s in slots]
    return cases.select(case, F.explode(F.array(*row)).alias("p")).select(case, "p.*")


def limits(conditions: list[tuple[Column | None, str, str]]) -> Column:
    """Sentences of what a result does not say: each as it is, or its replacement where the condition holds."""
    return F.array(*[F.lit(text) if cond is None else F.when(F.coalesce(cond, F.lit(False)), other).otherwise(F.lit(text)) for cond, text, other in conditions])


def stage_times(events: DataFrame, job: str) -> DataFrame:
    """job, stage, seconds: from each stage's start to the next one's, the last to the end of the job (rows: job, stage, t_us in order, the last named end)."""
    w = Window.partitionBy(job).orderBy("t_us", "pos")
    return events.withColumn("seconds", (F.lead("t_us").over(w) - F.col("t_us")) / 1e6).filter("seconds is not null").select(job, "stage", "seconds")


def map_entry(rows: DataFrame, key: str, entries: str, wanted: Column) -> DataFrame:
    """key and the value of a map column under a wanted name, null if it has none."""
    return rows.select(key, F.try_element_at(F.col(entries), wanted).alias("value"))


def lean(cases: DataFrame, heavy: list[str]) -> DataFrame:
    """A case table without its heavy sections; their sizes stay."""
    return cases.select(*[c for c in cases.columns if c not in heavy], *[F.coalesce(F.length(F.to_json(c)), F.lit(0)).alias(f"{c}_bytes") for c in heavy])


def write_documents(cases: DataFrame, path: str) -> None:
    """One JSON document a line; a reader sees all of it or nothing (Spark's commit)."""
    cases.write.option("ignoreNullFields", False).json(path)


def cell(value: Column) -> Column:
    """A CSV cell: null is empty, quotes only where a comma, a quote or a line break needs them."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(*values: Column) -> Column:
    return F.concat_ws(",", *[cell(v) for v in values])


def feature(geometry: str, coordinates_: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates_.alias("coordinates")).alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")), {"ignoreNullFields": "false"})
