"""Free-text locations to coordinates, and distances.

The gazetteer is a bounded dimension (148 localities), held as literal maps in the plan:
a lookup is row-local, without a join or a shuffle.
"""

from __future__ import annotations

import csv
import math
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import B0, B1, col, collapse, js_trim, normalise_name

EARTH_RADIUS_KM = 6371.0088
# Fixed values
STATES = ("VIC", "NSW", "QLD", "WA", "SA", "TAS", "ACT", "NT")
STATE_NAMES = (("victoria", "VIC"), ("new south wales", "NSW"), ("queensland", "QLD"))
ALIASES = {
    "melbourne vic": "Melbourne", "melbourne cbd": "Melbourne", "cbd & inner suburbs": "Melbourne", "melbourne city": "Melbourne",
    "greater melbourne": "Melbourne", "melbourne, australia": "Melbourne", "western suburbs": "Sunshine", "melbourne western suburbs": "Sunshine",
    "northern suburbs": "Preston", "eastern suburbs": "Box Hill", "south eastern suburbs": "Dandenong", "bayside & south eastern suburbs": "Moorabbin",
    "geelong & great ocean road": "Geelong", "st albans vic": "St Albans",
}
GAZETTEER = Path(__file__).resolve().parent.parent / "sources" / "gazetteer.csv"


@lru_cache(maxsize=1)
def places() -> tuple[tuple[str, tuple[str, ...], float, float, str], ...]:
    with GAZETTEER.open() as f:
        return tuple((r["name"], tuple(r["postcodes"].split()), float(r["lat"]), float(r["lng"]), r["state"]) for r in csv.DictReader(f))


def gazetteer(spark: SparkSession) -> DataFrame:
    rows = [(i, n, list(p), a, b, s) for i, (n, p, a, b, s) in enumerate(places())]
    return spark.createDataFrame(rows, "ordinal int, name string, postcodes array<string>, lat double, lng double, state string")


@lru_cache(maxsize=1)
def indexes() -> tuple[dict, dict, dict]:
    """By name, postcode and alias; the first entry wins."""
    by_name: dict[str, tuple] = {}
    by_code: dict[str, tuple] = {}
    for name, codes, lat, lng, state in places():
        place = (name, state, lat, lng)
        by_name.setdefault(name.lower(), place)
        for code in codes:
            by_code.setdefault(code, place)
    return by_name, by_code, {k: by_name[v.lower()] for k, v in ALIASES.items()}


def _lookup(index: dict[str, tuple], key: Column) -> Column:
    """The place of a key as text, null if there is none.  The map is one folded literal,
    so the plan stays small."""
    table = "\n".join(f"{k}\t{'|'.join(map(str, p))}" for k, p in index.items())
    return F.try_element_at(F.str_to_map(F.lit(table), F.lit("\n"), F.lit("\t")), key)


def _place(text: Column) -> Column:
    part = lambda i: F.split_part(text, F.lit("|"), F.lit(i))
    return F.struct(part(1).alias("name"), part(2).alias("state"), part(3).cast("double").alias("lat"), part(4).cast("double").alias("lng"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def haversine(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The same for plain numbers."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.sin(math.radians(lng2 - lng1) / 2) ** 2 * math.cos(a) * math.cos(b)
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(h))


_STATE = f"(?i){B0}({'|'.join(STATES)}){B1}"


def strip_state_and_postcode(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"{B0}\d{{4}}{B1}", ""), _STATE, "")


def first_segment(raw: Column) -> Column:
    return F.nullif(js_trim(strip_state_and_postcode(F.element_at(F.split(raw, r"[,/|]"), 1))), F.lit(""))


def extract_state(raw: str | Column) -> Column:
    c = col(raw)
    found = F.when(c.rlike(_STATE), F.upper(F.regexp_extract(c, _STATE, 1)))
    for name, state in STATE_NAMES:
        found = F.coalesce(found, F.when(c.rlike(f"(?i){B0}{name}{B1}"), F.lit(state)))
    return found


def has_local_signal(raw: str | Column) -> Column:
    """Whether a location names a state, the country or a lone four-digit number."""
    c = col(raw)
    return F.coalesce(extract_state(c).isNotNull() | c.rlike(f"(?i){B0}australia") | c.rlike(r"(?<!\d)\d{4}(?!\d)"), F.lit(False))


def resolve_location(raw: str | Column, lat: str | Column, lng: str | Column) -> Column:
    """struct(suburb, state, lat, lng, method): given coordinates, else the first
    four-digit postcode, else the first segment that names a locality, else an alias."""
    c, lat, lng = col(raw), col(lat), col(lng)
    given = F.nullif(c, F.lit(""))
    by_name, by_code, alias = indexes()
    names = F.filter(F.transform(F.split(given, r"[,/|]"), lambda s: normalise_name(strip_state_and_postcode(s))), lambda s: s != "")
    code = _lookup(by_code, F.regexp_extract(given, rf"{B0}(\d{{4}}){B1}", 1))
    first = lambda index: F.get(F.filter(F.transform(names, lambda s: _lookup(index, s)), lambda p: p.isNotNull()), F.lit(0))
    named = first(by_name)
    other = F.coalesce(_lookup(alias, normalise_name(given)), first(alias))

    def out(suburb: Column, state: Column, a: Column, b: Column, method: str) -> Column:
        return F.struct(suburb.alias("suburb"), state.alias("state"), a.cast("double").alias("lat"), b.cast("double").alias("lng"), F.lit(method).alias("method"))

    def found(text: Column, method: str) -> Column:
        p = _place(text)
        return out(p["name"], p["state"], p["lat"], p["lng"], method)

    none = F.lit(None)
    return (
        F.when(lat.isNotNull() & lng.isNotNull(), out(first_segment(given), extract_state(given), lat, lng, "coordinates"))
        .when(code.isNotNull(), found(code, "postcode"))
        .when(named.isNotNull(), found(named, "suburb"))
        .when(other.isNotNull(), found(other, "alias"))
        .otherwise(out(first_segment(given), extract_state(given), none, none, "unresolved"))
    )


def distance_from(lat: float, lng: float, to_lat: Column, to_lng: Column) -> Column:
    """Kilometres at two decimals, null if the place isn't known."""
    return F.round(haversine_km(F.lit(lat), F.lit(lng), to_lat, to_lng), 2)


def location_query(c: Column) -> Column:
    """A centre label as provider search text: no postcode, state or comma."""
    return collapse(F.replace(strip_state_and_postcode(c), F.lit(","), F.lit(" ")))
