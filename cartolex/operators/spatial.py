"""Radius joins by grid cells, ranked searches and nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.geo import EARTH_M, LAT_M, LON_M, distance_m, prominence, rounded
from cartolex.functions.text import is_complex_name, norm_type, type_rank
from cartolex.tables import cut


def radius_join(left: DataFrame, right: DataFrame, metres: float, lat: str = "lat", lon: str = "lon", point: tuple[str, str] = ("p_lat", "p_lon"), on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose points are at most ``metres`` apart, with ``distance``; ``right`` has its point in columns ``point``.

    Both sides meet on grid cells as wide as the radius: the left row goes to nine cells, the right row to one, so that the
    join is an equi-join whatever the sizes, and no pair appears twice. Rows without a point match nothing. ``on``: columns that
    are equal too.
    """
    step_lat, step_lon = metres / LAT_M, metres / LON_M
    cell = lambda a, b: (F.floor(a / step_lat).alias("_cx"), F.floor(b / step_lon).alias("_cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    l = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select("*", around.alias("_d"), *cell(F.col(lat), F.col(lon)))
    l = l.withColumn("_cx", F.col("_cx") + F.col("_d.x")).withColumn("_cy", F.col("_cy") + F.col("_d.y")).drop("_d")
    r = right.where(F.col(point[0]).isNotNull() & F.col(point[1]).isNotNull()).select("*", *cell(F.col(point[0]), F.col(point[1])))
    d = distance_m(F.col(lat), F.col(lon), F.col(point[0]), F.col(point[1]))
    near = (F.abs(F.col(lat) - F.col(point[0])) <= step_lat) & (F.abs(F.col(lon) - F.col(point[1])) <= step_lon)
    return l.join(r, [*on, "_cx", "_cy"]).where(near).withColumn("distance", d).where(F.col("distance") <= metres).drop("_cx", "_cy")


def sphere_join(left: DataFrame, right: DataFrame, metres: float, on: list[str], lat: str = "lat", lon: str = "lon", wide: float = 2.0) -> DataFrame:
    """All pairs of equal columns ``on`` whose points are at most ``metres`` apart, wherever on the globe, with ``distance``; ``right``
    has its point in p_lat, p_lon.

    They meet in cells of space, ``wide`` radii across (2 at least): the right row in its own, the left row in those that its
    radius touches, eight at most and hardly more than one where cells are wide.
    """
    r = metres * (1 + 1e-6) + 0.01
    w = r * max(wide, 2.0)
    level = lambda a: EARTH_M * F.cos(F.radians(F.col(a)))
    space = lambda a, o: (level(a) * F.cos(F.radians(F.col(o))), level(a) * F.sin(F.radians(F.col(o))), EARTH_M * F.sin(F.radians(F.col(a))))
    cells = [f"_cell{i}" for i in range(3)]
    l = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    for name, x in zip(cells, space(lat, lon), strict=True):
        l = l.withColumn(name, F.explode(F.array_distinct(F.array(F.floor((x - r) / w), F.floor((x + r) / w)))))
    there = right.where(F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull()).withColumns({n: F.floor(x / w) for n, x in zip(cells, space("p_lat", "p_lon"), strict=True)})
    d = distance_m(F.col(lat), F.col(lon), F.col("p_lat"), F.col("p_lon"))
    return l.join(there, [*on, *cells]).withColumn("distance", d).where(F.col("distance") <= metres).drop(*cells)


def not_junk(kind: Column) -> Column:
    return ~norm_type(kind).isin(*L.JUNK_TYPES)


def nearest_pois(centres: DataFrame, pois: DataFrame, metres: float = 2000.0, limit: int = 10, id_: str = "property_id", by_name: bool = False) -> DataFrame:
    """The ``limit`` best places around each centre: stops last, then rank, distance, prominence, name, id. ``by_name``: of the
    places of one name the best alone.

    ``centres``: id_, lat, lon. ``pois``: poi_id, name, type, p_lat, p_lon, source, review_count, closed. Rows of one point come
    in the same order around every centre, so its first ``limit`` are all that count, and centres at one point are one search.
    Where one place is asked for, rows that differ in their id alone are one before they are ranked.
    """
    there = pois.where(not_junk(F.col("type")) & F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull())
    if limit == 1:
        there = there.groupBy("name", "type", "p_lat", "p_lon", "source", "review_count", "closed").agg(F.min("poi_id").alias("poi_id"))
    there = there.select("poi_id", "name", "type", "p_lat", "p_lon", type_rank(F.col("type")).alias("rank"), norm_type(F.col("type")).isin(*L.TRANSIT_TYPES).alias("_stop"), prominence(F.col("review_count"), F.col("source"), F.col("closed")).alias("_prom"))

    def first(df: DataFrame, at: list[str], *order: str | Column) -> DataFrame:
        row = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        df = df.withColumn("rn", row(*at, "name")).where("rn = 1") if by_name else df
        return df.withColumn("rn", row(*at)).where(F.col("rn") <= limit)

    there = first(there, ["p_lat", "p_lon"], "_stop", F.desc("rank"), F.desc("_prom"), "name", "poi_id").drop("rn")
    near = radius_join(centres.select("lat", "lon").distinct(), there, metres)
    best = first(near, ["lat", "lon"], "_stop", F.desc("rank"), "distance", F.desc("_prom"), "name", "poi_id")
    best = centres.select(id_, "lat", "lon").join(best, ["lat", "lon"])
    return best.select(id_, "rn", "poi_id", F.col("name").alias("poi_name"), F.col("type").alias("poi_type"), "rank", rounded(F.col("distance")).cast("long").alias("distance_m"))


#: Parts of a radius that are searched before the whole: most rows find their nearest in the first.
RINGS = (1 / 16, 1 / 4)


def reach(lat: Column, metres: float) -> Column:
    """Metres within which a point at ``lat`` has nothing outside of its box of ``metres``."""
    high = F.radians(F.least(F.abs(lat) + metres / LAT_M, F.lit(90.0)))
    across = F.cos(F.radians(lat)) * F.cos(high) * math.sin(math.radians(metres / LON_M / 2)) ** 2
    along = EARTH_M * math.radians(metres / LAT_M)
    return F.least(F.lit(along), 2 * EARTH_M * F.asin(F.sqrt(F.greatest(across, F.lit(0.0))))) * (1 - 1e-9)


def nearest_one(left: DataFrame, right: DataFrame, metres: float, id_: str, columns: list[str], *order: Column) -> DataFrame:
    """Each left row's first right row by ``order``, then distance and ``poi_id``; a row without one keeps nulls.

    Distinct points of the left meet distinct points of the right, of which each stands for its first row. Without ``order``
    they are searched in rings: a row that lies within ``reach`` of a smaller box is the nearest, only the rest goes on.
    """
    first = F.struct(*order, "poi_id")
    there = right.where(F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull())
    there = there.groupBy("p_lat", "p_lon").agg(F.min_by(F.struct(F.struct(*order, F.lit(0)).alias("_o"), F.col("poi_id").alias("_i"), F.struct(*columns).alias("_r")), first).alias("_p"))
    todo = left.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    best = None
    for part in (*(RINGS if not order else ()), 1):
        got = radius_join(todo, there, metres * part).groupBy("lat", "lon").agg(F.min_by(F.struct("_p._r", "distance"), F.struct("_p._o", "distance", "_p._i")).alias("b"))
        if part < 1:
            tried = todo.join(got, ["lat", "lon"], "left").withColumn("_done", F.coalesce(F.col("b.distance") <= reach(F.col("lat"), metres * part), F.lit(False)))
            got, todo = tried.where("_done").select("lat", "lon", "b"), tried.where("not _done").select("lat", "lon")
        best = got if best is None else best.unionByName(got)
    return left.select(id_, "lat", "lon").join(best, ["lat", "lon"], "left").select(id_, *[F.col(f"b._r.{c}").alias(c) for c in columns], rounded(F.col("b.distance")).cast("long").alias("distance_m"))


def nearest_of(asked: DataFrame, there: DataFrame, on: str, d: Column, *order: str | Column) -> DataFrame:
    """The nearest row that each distinct asked row meets on a column: asked's columns and ``b``, the first struct by ``order`` of
    those at the least distance ``d``. Pairs are run through twice, once for the distance alone, so that none is sorted."""
    least = asked.join(there, on).groupBy(*asked.columns).agg(F.min(d).alias("_least"))
    return least.join(there, on).where(d == F.col("_least")).groupBy(*asked.columns).agg(F.min(F.struct(*order)).alias("b"))


#: Metres around a centre that are searched one after the other for the nearest point of a name, before all of them are.
GROWING_M = (60.0, 500.0, 4000.0)


def nearest_named(asked: DataFrame, there: DataFrame, on: str, lat: str, lon: str, *order: str | Column) -> DataFrame:
    """``nearest_of`` by points: distinct asked rows (on, lat, lon) and ``b``, the struct of ``distance`` and ``order`` of the nearest of
    ``there`` (on, p_lat, p_lon). A ring is searched for those alone that had nothing in the one before; without a centre all
    points are as far (0)."""
    best, todo = None, asked
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in asked.columns]
    for metres in GROWING_M:
        got = sphere_join(todo, there, metres, [on], lat, lon).groupBy(*asked.columns).agg(F.min(F.struct("distance", *order)).alias("b"))
        tried = cut(todo.alias("l").join(got.alias("r"), same, "left").select(*[f"l.{c}" for c in asked.columns], "r.b"), "ring")
        got, todo = tried.where("b is not null"), tried.where("b is null").drop("b")
        best = got if best is None else best.unionByName(got)
    d = F.coalesce(distance_m(F.col(lat), F.col(lon), F.col("p_lat"), F.col("p_lon")), F.lit(0.0))
    last = todo.join(there, on).groupBy(*asked.columns).agg(F.min(F.struct(d.alias("distance"), *order)).alias("b"))
    return best.unionByName(last)


def area_at(points: DataFrame, areas: DataFrame, id_: str = "property_id", metres: float = 2500.0) -> DataFrame:
    """The nearest area within reach. ``areas``: poi_id, name, p_lat, p_lon."""
    return nearest_one(points, areas, metres, id_, ["poi_id", "name"])


def enclosing_complex(shops: DataFrame, complexes: DataFrame, id_: str = "shop_id", metres: float = 250.0) -> DataFrame:
    """The complex that a shop stands in: those that are named so first, then the nearest by whole metres."""
    named = complexes.withColumn("_unnamed", (~is_complex_name(F.col("name"))).cast("int"))
    return nearest_one(shops, named, metres, id_, ["poi_id", "name"], F.col("_unnamed"))
