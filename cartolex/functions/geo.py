"""Distances, grids and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L

EARTH_M = 6_371_000.0
#: Metres of a degree of latitude and of longitude, for boxes around a point.
LAT_M, LON_M = 111_000.0, 82_000.0


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine metres, not rounded."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def inside(box: tuple[float, float, float, float], lat: Column, lon: Column) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def walk_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), rounded(metres / 80))


def prominence(reviews: Column, source: Column, closed: Column) -> Column:
    """log10 of reviews, a little more for rated sources; closed places last."""
    own = F.log10(F.coalesce(reviews, F.lit(0)) + 1.0) + F.when(source == "google", 0.01).otherwise(0.0)
    return F.when(closed == 1, -1.0).otherwise(own)


def suspect_cell(lat: Column, lon: Column) -> Column:
    """A cell of about 250 m."""
    return F.concat_ws(":", rounded(lat * 400).cast("string"), rounded(lon * 260).cast("string"))


def tile_key(lat: Column, lon: Column) -> Column:
    """The south-west corner of the tile of a point, two decimals each; null outside the grid."""
    row = F.floor((lat - L.TILE_ORIGIN[0]) / L.TILE_STEP + 1e-9)
    col = F.floor((lon - L.TILE_ORIGIN[1]) / L.TILE_STEP + 1e-9)
    there = row.between(0, L.TILE_ROWS - 1) & col.between(0, L.TILE_COLUMNS - 1)
    return F.when(there, F.format_string("%.2f,%.2f", L.TILE_ORIGIN[0] + row * L.TILE_STEP, L.TILE_ORIGIN[1] + col * L.TILE_STEP))


def cid(place_id: Column) -> Column:
    """The unsigned number in the second half of ``0x..:0x..`` as text; null otherwise."""
    tail = F.regexp_extract(place_id, r"(?i)^0x[0-9a-f]+:0x([0-9a-f]{1,16})$", 1)
    return F.when(tail != "", F.conv(tail, 16, 10))


def cid_link(place_id: Column) -> Column:
    return F.concat(F.lit("https://maps.google.com/?cid="), cid(place_id))


def area_link(lat: Column, lon: Column) -> Column:
    return F.format_string("https://maps.google.com/?q=%.3f,%.3f", lat, lon)


def coords_link(lat: Column, lon: Column) -> Column:
    return F.format_string("https://maps.google.com/?q=%.5f,%.5f", lat, lon)


def landmark_link(place_url: Column, place_id: Column, lat: Column, lon: Column) -> Column:
    """An allowed place URL, else the id's link, else the coordinates'."""
    return F.coalesce(F.when(allowed_link(place_url), place_url), cid_link(place_id), coords_link(lat, lon))


def link_coords(url: Column) -> Column:
    """struct(lat, lon) from ``!3d..!4d..``, else ``@lat,lon``, else ``q=lat,lon``; null parts where none is."""
    number = r"(-?\d+(?:\.\d+)?)"
    take = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(url, p, i), F.lit("")).cast("double") for p in (f"!3d{number}!4d{number}", f"@{number},{number}", f"[?&]q={number},{number}")])
    return F.struct(take(1).alias("lat"), take(2).alias("lon"))


def allowed_link(url: Column) -> Column:
    """A link that may be shown: a map host, no search, and a ``q=`` that is a pair of coordinates."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))
    # fixed values: hosts of maps
    mapped = host.isin("maps.google.com", "www.google.com", "google.com", "maps.app.goo.gl", "goo.gl", "www.openstreetmap.org", "openstreetmap.org")
    search = url.rlike(r"(?i)/search|[?&]query=|[?&]api=1")
    q = F.regexp_extract(url, r"[?&]q=([^&#]*)", 1)
    return F.coalesce(mapped & ~search & ((q == "") | F.coalesce(F.try_url_decode(q), q).rlike(r"^-?\d+(?:\.\d+)?,\s*-?\d+(?:\.\d+)?$")), F.lit(False))


def pin_may_move(from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column, most: float = 300.0) -> Column:
    """A row without a pin takes any; another only within ``most`` metres."""
    return from_lat.isNull() | from_lon.isNull() | (distance_m(from_lat, from_lon, to_lat, to_lon) <= most)
