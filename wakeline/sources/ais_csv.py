"""Vessel reports as delimited files: checked scans, bounded scans, streams, and a sink that round-trips."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import within_box, within_window
from ..operators.reports import RAW_COLUMNS, check_header

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


#: Threads that look at first lines.
READERS = 16


def first_lines(spark: SparkSession, path: str, most: int = 1) -> list[list[str]]:
    """The first lines of each file of a path, of which only the first bytes are read."""
    sc = spark.sparkContext
    conf, top = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    codecs = sc._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def files(where):
        for f in fs.globStatus(where) or []:
            if f.isDirectory():
                yield from (x for k in fs.listStatus(f.getPath()) if k.getPath().getName()[0] not in "._" for x in files(k.getPath()))
            elif f.getLen():
                yield f.getPath()

    def head(file):
        codec, stream = codecs.getCodec(file), fs.open(file)
        reader = sc._jvm.java.io.BufferedReader(sc._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"), 4096)
        try:
            out = []
            while len(out) < most and (line := reader.readLine()) is not None:
                out.append(line)
            return out
        finally:
            reader.close()

    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(head, files(top)))


def check_headers(spark: SparkSession, path: str) -> None:
    """Raise unless every file begins with the 17 columns in order."""
    heads = {h[0].lstrip("\ufeff") for h in first_lines(spark, path) if h}
    for head in heads or {""}:
        check_header(head.split(",") if head else [])


def read(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The 17 text columns and ``pos``, the place of a row in its file.

    The header of every file is checked by name and order from its first bytes; the scan
    itself never infers a schema.  ``limit`` bounds the rows examined, not those kept:
    the scan stops after so many.
    """
    check_headers(spark, path)
    raw = spark.read.schema(SCHEMA).options(**_OPTIONS).csv(path)
    return (raw if limit is None else raw.limit(limit)).withColumn("pos", F.monotonically_increasing_id())


_OPTIONS = {"header": True, "enforceSchema": True, "escape": '"'}


def _bounded(raw: DataFrame, box: tuple | None, window: tuple[str | None, str | None]) -> DataFrame:
    keep = F.lit(True)
    if box is not None:
        keep = within_box(F.col("LON"), F.col("LAT"), *box)
    return raw.filter(keep & within_window(F.col("BaseDateTime"), *window))


def _bounded_schema() -> T.StructType:
    """Positions as numbers, so that bounds can be compared while a line is parsed."""
    return T.StructType([T.StructField(c, T.DoubleType() if c in ("LAT", "LON") else T.StringType()) for c in RAW_COLUMNS])


def scan(spark: SparkSession, path: str, box: tuple | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows inside a closed box (west, south, east, north) and a half-open window of times as the files write them.

    Bounds are filters of the scan itself: a line outside them is given up as soon as
    its position or time is parsed.  LAT and LON are numbers here, and positions that
    are none lie in no box.
    """
    check_headers(spark, path)
    return _bounded(spark.read.schema(_bounded_schema()).options(**_OPTIONS).csv(path), box, (start, end))


def stream(spark: SparkSession, path: str, files: int = 16, box: tuple | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same rows as a stream of the files that arrive in a folder, at most so many in a batch.

    Without bounds these are all rows with text columns, as ``parse`` takes them (pos is
    null).  The headers of files that are there at the start are checked.
    """
    check_headers(spark, path)
    bounded = box is not None or start is not None or end is not None
    raw = spark.readStream.schema(_bounded_schema() if bounded else SCHEMA).options(**_OPTIONS).option("maxFilesPerTrigger", files).csv(path)
    return _bounded(raw, box, (start, end)) if bounded else raw.withColumn("pos", F.lit(None).cast("long"))


def write(reports: DataFrame, path: str) -> None:
    """Parsed reports in time order; values that are null become the format's own sentinels."""
    fixed = lambda c, d: F.format_string(f"%.{d}f", F.col(c))
    none = lambda c, d, unset: F.coalesce(fixed(c, d), F.lit(unset))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = reports.orderBy("t_us", "mmsi").select(
        F.col("mmsi").alias("MMSI"), F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"), fixed("lat", 5).alias("LAT"), fixed("lon", 5).alias("LON"),
        none("sog", 1, "102.3").alias("SOG"), none("cog", 1, "360.0").alias("COG"), none("heading", 1, "511.0").alias("Heading"), F.substring(blank("name"), 1, 32).alias("VesselName"), blank("imo").alias("IMO"),
        F.substring(blank("call_sign"), 1, 8).alias("CallSign"), blank("type_code").alias("VesselType"), blank("status_code").alias("Status"), blank("length_m").alias("Length"), blank("width_m").alias("Width"),
        blank("draft_m").alias("Draft"), blank("cargo_code").alias("Cargo"), blank("transceiver").alias("TransceiverClass"),
    )
    out.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
