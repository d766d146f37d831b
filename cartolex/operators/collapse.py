"""Radius search with one row for each place: an ordered fold over the candidates of a centre."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.geo import EARTH_M
from cartolex.functions.text import identity_tokens, norm_type, type_rank
from cartolex.operators.identity import countries_in, has_qualifier, is_embassy
from cartolex.operators.spatial import not_junk, radius_join

_OUT = "rn int, poi_id bigint, poi_name string, poi_type string, rank int, distance_m bigint"


def metres(a: float, b: float, c: float, d: float) -> float:
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(h))


def agreement(a: tuple, b: tuple) -> tuple[int, int]:
    """Metres within which two names agree, and those where exactly one of the rows carries an id; 0: not at all.

    A name is what the plan has computed for it: tokens, qual, embassy, countries."""
    (ta, qa, ea, ca), (tb, qb, eb, cb) = a, b
    if not ta or not tb:
        return 0, 0
    small, large = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
    within = 120 if ta == tb else 0
    if qa == qb:
        if ea and eb and ca & cb:
            return 200, 200
        if not within and small <= large and any(len(t) >= 4 for t in small) and not all(t.isdigit() for t in large - small):
            return 0, 40
    return within, within


def _merge(keep: dict, other: dict, lat: float, lon: float) -> None:
    """The other row becomes part of the kept one."""
    cyr = lambda r: any("Ѐ" <= c <= "ӿ" for c in r["name"])
    if cyr(other) and not cyr(keep):
        keep["name"] = other["name"]
    if other["rank"] > keep["rank"]:
        keep["type"], keep["rank"], keep["stop"] = other["type"], other["rank"], other["stop"]
    if keep["source"] != "google" and other["source"] == "google":
        keep["p_lat"], keep["p_lon"] = other["p_lat"], other["p_lon"]
    if not keep["place_id"] and other["place_id"]:
        keep["place_id"], keep["source"] = other["place_id"], other["source"]
    if keep["review_count"] is None:
        keep["review_count"] = other["review_count"]
    keep["distance"] = metres(lat, lon, keep["p_lat"], keep["p_lon"])


#: Pairs of names whose agreement a task remembers.
REMEMBERED = 1 << 18


def nearest_places(centres: DataFrame, pois: DataFrame, metres_: float = 2000.0, limit: int = 10, id_: str = "property_id") -> DataFrame:
    """As the plain radius search, after rows of one place have become one: candidates in order of distance and name, each
    joining the first place before it that it agrees with.

    Centres at one point are one search. Candidates come sorted and one after the other, so that a task holds the merged places
    of one centre and no list of candidates.
    """
    tokens = F.array_distinct(identity_tokens(F.col("name")))
    facts = pois.where(not_junk(F.col("type"))).select(
        "poi_id", "name", "type", "p_lat", "p_lon", "source", "place_id", "review_count", "closed", type_rank(F.col("type")).alias("rank"), norm_type(F.col("type")).isin(*L.TRANSIT_TYPES).alias("stop"), tokens.alias("tokens"),
        has_qualifier(F.col("name")).alias("qual"), is_embassy(F.col("name")).alias("embassy"), countries_in(tokens).alias("countries"),
    )
    fields = ["poi_id", "name", "type", "p_lat", "p_lon", "source", "place_id", "review_count", "closed", "rank", "stop", "distance"]
    known = ["tokens", "qual", "embassy", "countries"]
    near = radius_join(centres.select("lat", "lon").distinct(), facts, metres_).select("lat", "lon", *fields, *known)
    around = near.repartition("lat", "lon").sortWithinPartitions("lat", "lon", "distance", "name", "poi_id")
    names = ["lat", "lon", "rn", "poi_id", "poi_name", "poi_type", "rank", "distance_m"]
    prom = lambda p: -1.0 if p["closed"] == 1 else math.log10((p["review_count"] or 0) + 1) + (0.01 if p["source"] == "google" else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple] = {}  # of the names of one centre's candidates
        agree: dict[tuple[str, str], tuple[int, int]] = {}
        places: list[dict] = []
        like: dict[str, list[int]] = {}  # places whose name may agree with a name, in order
        held: dict[str, int] = {}  # the first place of an id
        centre, out = None, []

        def settle() -> None:
            for n, p in enumerate(sorted(places, key=lambda p: (p["stop"], -p["rank"], p["distance"], -prom(p), p["name"], p["poi_id"]))[:limit]):
                out.append((*centre, n + 1, p["poi_id"], p["name"], p["type"], p["rank"], math.floor(p["distance"] + 0.5)))

        def agreed(a: str, b: str) -> tuple[int, int]:
            within = agree.get((a, b))
            if within is None:
                if len(agree) >= REMEMBERED:
                    agree.clear()
                within = agree[a, b] = agreement(words[a], words[b])
            return within

        def first(r: dict) -> int | None:
            name = r["name"]
            if name not in like:
                like[name] = [i for i, p in enumerate(places) if max(agreed(p["name"], name))]
            owner = held.get(r["place_id"]) if r["place_id"] else None
            for i in like[name]:
                if owner is not None and i >= owner:
                    break
                p = places[i]
                within = agreed(p["name"], name)[bool(p["place_id"]) != bool(r["place_id"])]
                if within and metres(p["p_lat"], p["p_lon"], r["p_lat"], r["p_lon"]) <= within:
                    return i
            return owner

        def join(r: dict) -> None:
            i = first(r)
            if i is None:
                i = len(places)
                places.append(r)
                for name, some in like.items():
                    if max(agreed(r["name"], name)):
                        some.append(i)
            else:
                called = places[i]["name"]
                _merge(places[i], r, *centre)
                if places[i]["name"] != called:
                    like.clear()
            if places[i]["place_id"]:
                held[places[i]["place_id"]] = min(i, held.get(places[i]["place_id"], i))

        def flush() -> pa.RecordBatch:
            kinds = [pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            cols = zip(*out, strict=True) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(2 + len(fields))]
            for i, (lat, lon, *row) in enumerate(zip(*cols, strict=True)):
                if (lat, lon) != centre:
                    settle()
                    centre, places = (lat, lon), []
                    words.clear()
                    like.clear()
                    held.clear()
                r = dict(zip(fields, row, strict=True))
                if r["name"] not in words:
                    t, q, e, c = (batch.column(2 + len(fields) + k)[i].as_py() for k in range(len(known)))
                    words[r["name"]] = frozenset(t), q, e, frozenset(c)
                join(r)
            yield flush()
            out.clear()
        settle()
        yield flush()

    best = around.mapInArrow(run, f"lat double, lon double, {_OUT}")
    return centres.select(id_, F.col("lat").cast("double"), F.col("lon").cast("double")).join(best, ["lat", "lon"]).drop("lat", "lon")
