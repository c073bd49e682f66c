"""Coded values of vessel reports, as column expressions built from fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ship-and-cargo code table, version 2018: inclusive ranges.
GROUPS = {
    "Not Available": [(0, 0)],
    "Other": [(1, 20), (23, 29), (33, 34), (38, 51), (53, 59), (90, 99)],
    "Tug Tow": [(21, 22), (31, 32), (52, 52)],
    "Fishing": [(30, 30)],
    "Military": [(35, 35)],
    "Pleasure Craft/Sailing": [(36, 37)],
    "Passenger": [(60, 69)],
    "Cargo": [(70, 79)],
    "Tanker": [(80, 89)],
}
# Relevance of a group as a source of oil.
RELEVANCE = {"Tanker": 1.0, "Cargo": 0.5, "Tug Tow": 0.4, "Fishing": 0.25, "Passenger": 0.2, "Military": 0.2, "Pleasure Craft/Sailing": 0.1, "Other": 0.3, "Not Available": 0.3}
RELEVANCE_UNKNOWN = 0.3
# Fixed values of the 4-bit navigational status field (ITU-R M.1371).
NAV_STATUS = [
    "under way using engine", "at anchor", "not under command", "restricted manoeuvrability", "constrained by draught", "moored", "aground", "engaged in fishing", "under way sailing",
    "reserved (high-speed craft)", "reserved (wing in ground)", "towing astern", "pushing ahead or towing alongside", "reserved", "AIS-SART, MOB or EPIRB active", "undefined",
]


def vessel_group(code: Column) -> Column:
    """Group of a code; null for null and for codes that the table does not define."""
    out = F.lit(None).cast("string")
    for name, ranges in GROUPS.items():
        for lo, hi in ranges:
            out = F.when(code.between(lo, hi), name).otherwise(out)
    return out


def relevance(group: Column, code: Column) -> Column:
    """Relevance of a vessel type; an undefined code and a missing one have their own values."""
    out = F.when(code.isNull(), RELEVANCE["Not Available"]).otherwise(RELEVANCE_UNKNOWN)
    for name, value in RELEVANCE.items():
        out = F.when(group == name, value).otherwise(out)
    return out


def nav_status(code: Column) -> Column:
    out = F.when(code.isNotNull(), F.concat(F.lit("unrecognised status "), code.cast("string")))
    for i, name in enumerate(NAV_STATUS):
        out = F.when(code == i, name).otherwise(out)
    return out
