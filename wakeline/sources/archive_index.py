"""Tab-delimited archive indexes: a comment block, a verbose header, one row for each object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """One row an object; ``columns`` maps a new name to a part of the header's title.

    Rows begin after the line that ends the comment block (``*/``), if there is one, and
    the header; short rows are padded with nulls.  Every file has the same header.
    """
    # the comment block is found by its end: its own lines may hold tabs
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("f"))
    ends = lines.filter(F.col("value").contains("*/")).groupBy("f").agg(F.min("n").alias("end"))
    body = lines.join(F.broadcast(ends), "f", "left").filter((F.coalesce("end", F.lit(-1)) < F.col("n")) & (F.trim("value") != ""))
    first = body.groupBy("f").agg(F.min_by("value", "n").alias("head"), F.min("n").alias("at"))
    heads = first.select("head").distinct().limit(2).collect()  # one row a file in first, at most two here
    if not heads:
        raise ValueError("no header found")
    if len(heads) > 1:
        raise ValueError("the files of the folder have different headers")
    head = heads[0].head
    titles = head.split("\t")
    at = {}
    for name, part in columns.items():
        found = [i for i, t in enumerate(titles) if part in t]
        if not found:
            raise ValueError(f"no column title holds {part!r}")
        at[name] = found[0]
    cells = F.split("value", "\t")
    rows = body.join(F.broadcast(first.select("f", "at")), "f").filter((F.col("n") > F.col("at")) & F.col("value").contains("\t"))
    return rows.select(*[F.nullif(F.trim(F.get(cells, i)), F.lit("")).alias(n) for n, i in at.items()])


def by_image(objects: DataFrame, key: str, box: list[str]) -> DataFrame:
    """One row an image with its boxes; boxes without area are dropped."""
    b = F.struct(*[F.col(c).try_cast("double").alias(c) for c in box])
    x0, y0, x1, y1 = (F.col(c).try_cast("double") for c in box)
    return objects.groupBy(key).agg(F.collect_list(F.when((x1 > x0) & (y1 > y0), b)).alias("boxes"), F.count(F.lit(1)).alias("objects"))
