"""Named sea regions: the first of an ordered list of boxes that holds a position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, west, south, east, north), in the order in which they are tried.
REGIONS = [
    ("Gulf of Suez", 32.2, 27.2, 34.2, 30.2), ("Suez Canal approaches", 32.0, 30.2, 33.2, 32.0), ("Nile Delta shelf", 29.0, 30.8, 33.0, 33.2),
    ("Aegean Sea", 23.0, 35.8, 27.6, 40.0), ("Aegean Sea", 23.0, 40.0, 26.3, 41.2), ("Eastern Mediterranean", 25.0, 31.0, 36.5, 37.0),
    ("Adriatic Sea", 12.0, 42.0, 20.0, 45.9), ("Central Mediterranean", 10.0, 30.0, 25.0, 42.0), ("Western Mediterranean", -6.0, 34.0, 10.0, 44.5),
    ("Gulf of Cadiz", -9.6, 34.8, -6.0, 37.4), ("Persian Gulf", 47.5, 23.5, 57.0, 30.5), ("Gulf of Oman", 56.5, 22.0, 62.0, 26.5),
    ("Red Sea", 32.0, 12.0, 44.0, 27.5), ("Arabian Sea", 55.0, 5.0, 78.0, 25.0), ("Bay of Bengal", 78.0, 5.0, 95.0, 23.0),
    ("Straits of Florida", -82.4, 22.6, -78.5, 25.6), ("Gulf of Mexico", -98.0, 18.0, -80.5, 31.0), ("Caribbean Sea", -88.0, 8.0, -59.0, 22.5),
    ("Irish Sea", -6.6, 51.3, -2.7, 55.2), ("North Sea", -4.5, 51.0, 9.5, 61.5), ("Baltic Sea", 9.5, 53.5, 30.5, 66.0),
    ("English Channel", -6.0, 48.5, 2.5, 51.2), ("Bay of Biscay", -10.5, 43.0, -1.0, 48.6), ("Norwegian Sea", -5.0, 61.5, 20.0, 71.0),
    ("Sea of Marmara", 26.0, 40.2, 30.0, 41.2), ("Black Sea", 27.0, 40.5, 42.0, 47.5), ("Caspian Sea", 46.5, 36.0, 55.0, 47.5),
    ("Gulf of Guinea", -5.0, -6.0, 12.0, 6.5), ("Angolan shelf", 8.0, -18.0, 14.2, -5.5), ("Java Sea", 105.0, -8.0, 118.0, -2.0),
    ("South China Sea", 105.0, -3.2, 122.0, 23.5), ("East China Sea", 117.0, 23.5, 131.0, 33.5), ("Sea of Japan", 127.0, 33.5, 142.0, 52.0),
    ("Yellow Sea", 117.0, 33.5, 127.0, 41.0), ("Gulf of Thailand", 99.0, 5.0, 105.0, 14.0), ("Strait of Malacca", 96.0, -1.0, 105.0, 7.0),
    ("Gulf of Alaska", -160.0, 52.0, -132.0, 62.0), ("California coast", -126.0, 30.0, -116.0, 42.0), ("Brazilian shelf", -50.0, -34.0, -34.0, -1.0),
    ("Patagonian shelf", -70.0, -56.0, -52.0, -36.0), ("Gulf of Aden", 43.0, 10.0, 52.0, 15.5), ("Mozambique Channel", 33.0, -26.0, 49.0, -10.0),
    ("Great Australian Bight", 115.0, -40.0, 140.0, -30.0),
]
BASINS = [
    ("Arctic Ocean", -180.0, 66.5, 180.0, 90.0), ("Southern Ocean", -180.0, -90.0, 180.0, -60.0), ("Mediterranean Sea", -6.0, 30.0, 37.0, 47.0),
    ("Indian Ocean", 20.0, -60.0, 120.0, 30.0), ("Pacific Ocean", 120.0, -60.0, 180.0, 66.5), ("Pacific Ocean", -180.0, 25.0, -105.0, 66.5),
    ("Pacific Ocean", -180.0, 5.0, -86.0, 25.0), ("Pacific Ocean", -180.0, -60.0, -70.0, 5.0), ("Atlantic Ocean", -100.0, -60.0, 20.0, 66.5),
]
BY_HEMISPHERE = {"Atlantic Ocean", "Indian Ocean", "Pacific Ocean"}


def cases(lat: str = "lat", lon: str = "lon") -> str:
    """The lookup as one SQL CASE: no join, boxes tried in order."""
    arms = [f"WHEN {lat} IS NULL OR {lon} IS NULL OR NOT ({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180) THEN 'Unknown region'"]
    for name, w, s, e, n in REGIONS + BASINS:
        label = f"CASE WHEN {lat} >= 0 THEN 'North {name}' ELSE 'South {name}' END" if name in BY_HEMISPHERE else f"'{name}'"
        arms.append(f"WHEN {lon} BETWEEN {w} AND {e} AND {lat} BETWEEN {s} AND {n} THEN {label}")
    return "CASE " + " ".join(arms) + " ELSE 'Unclassified waters' END"


def region_label(lat: str = "lat", lon: str = "lon") -> Column:
    return F.expr(cases(lat, lon))
