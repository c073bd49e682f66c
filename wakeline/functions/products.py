"""Names of radar products and the headers that carry them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a product's name, and what its polarisation code holds.
PRODUCT = r"(S1[AB])_([A-Z0-9]{2})_([A-Z]{3})([FHM])_([0-9])([SA])([SD][VH])_([0-9]{8}T[0-9]{6})_([0-9]{8}T[0-9]{6})_([0-9]{6})_([0-9A-F]{6})_([0-9A-F]{4})"
FIELDS = ["mission", "mode", "product_type", "resolution", "level", "class", "polarisation", "start", "stop", "orbit", "data_take", "check"]
POLARISATIONS = {"SV": ["VV"], "SH": ["HH"], "DV": ["VV", "VH"], "DH": ["HH", "HV"]}


def product_id(name: Column) -> Column:
    """struct of the parts of a product's name, wherever it stands in the text; all null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(name, PRODUCT, i), F.lit(""))
    time = lambda i: F.unix_micros(F.try_to_timestamp(part(i), F.lit("yyyyMMdd'T'HHmmss")))
    known = F.create_map(*[x for k, v in POLARISATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of = {"start": time(8), "stop": time(9), "orbit": part(10).try_cast("int")}
    return F.struct(*[of.get(n, part(i + 1)).alias(n) for i, n in enumerate(FIELDS)], F.try_element_at(known, part(7)).alias("bands"), part(0).alias("group_key"))


def subset(name: Column) -> tuple[Column, Column]:
    """The number of a subset and the name of the product it was cut from (``subset_N_of_<name>``), else null and the name itself."""
    form = r"^subset_([0-9]+)_of_(.+)$"
    n = F.nullif(F.regexp_extract(name, form, 1), F.lit("")).try_cast("int")
    return n, F.when(n.isNull(), name).otherwise(F.regexp_extract(name, form, 2))


def field(document: Column, tag: str) -> Column:
    """The text of the first element of a name in an XML document, also a document that is cut off after it."""
    found = F.regexp_extract(document, rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1)
    return F.nullif(F.trim(found), F.lit(""))


def header(document: Column) -> Column:
    """struct of what a case needs of a product's XML header: name, size, band names in order, no-data value (if it is used), subset and product."""
    number = lambda tag, kind: field(document, tag).try_cast(kind)
    bands = F.regexp_extract_all(document, F.lit(r"<BAND_NAME(?:\s[^>]*)?>([^<]*)</BAND_NAME>"), F.lit(1))
    used = F.lower(field(document, "NO_DATA_VALUE_USED")).isin("true", "1")
    n, product = subset(field(document, "DATASET_NAME"))
    return F.struct(field(document, "DATASET_NAME").alias("name"), number("NCOLS", "int").alias("cols"), number("NROWS", "int").alias("rows"), F.transform(bands, lambda b: F.trim(b)).alias("bands"), F.when(used, number("NO_DATA_VALUE", "double")).alias("nodata"), n.alias("subset"), product_id(product)["group_key"].alias("group_key"))


#: What a complete header document holds of use: dimensions, and each band with its name and unit.
DOCUMENT = "Raster_Dimensions struct<NCOLS: int, NROWS: int, NBANDS: int>, Image_Interpretation struct<Spectral_Band_Info: array<struct<BAND_INDEX: int, BAND_NAME: string, PHYSICAL_UNIT: string>>>"


def document(text: Column) -> Column:
    """struct(cols, rows, bands array<struct(i, name, unit)>) of a complete header document, bands by index; fields are null where it is no such document."""
    d = F.from_xml(text, DOCUMENT)
    bands = F.transform(d["Image_Interpretation"]["Spectral_Band_Info"], lambda b: F.struct(b["BAND_INDEX"].alias("i"), b["BAND_NAME"].alias("name"), b["PHYSICAL_UNIT"].alias("unit")))
    return F.struct(d["Raster_Dimensions"]["NCOLS"].alias("cols"), d["Raster_Dimensions"]["NROWS"].alias("rows"), F.array_sort(bands).alias("bands"))
