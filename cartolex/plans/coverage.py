"""Work planning: tiles and categories still to scan, streets still to learn, and what that may cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.geo import tile_key
from cartolex.functions.text import house_number, street_key
from cartolex.tables import running

#: How a class is asked for.
CATEGORY_NAMES = {"place_of_worship": "church", "townhall": "town hall", "theatre": "theater", "cinema": "movie theater", "fuel": "gas station", "atm": "ATM"}


def tiles(spark: SparkSession) -> DataFrame:
    """All tiles of the grid: tile_key, lat, lon (centre)."""
    n = L.TILE_ROWS * L.TILE_COLUMNS
    grid = spark.range(n).select(F.floor(F.col("id") / L.TILE_COLUMNS).alias("r"), (F.col("id") % L.TILE_COLUMNS).alias("c"))
    lat, lon = L.TILE_ORIGIN[0] + F.col("r") * L.TILE_STEP, L.TILE_ORIGIN[1] + F.col("c") * L.TILE_STEP
    return grid.select(F.format_string("%.2f,%.2f", lat, lon).alias("tile_key"), (lat + L.TILE_STEP / 2).alias("lat"), (lon + L.TILE_STEP / 2).alias("lon"))


def uncovered_pairs(spark: SparkSession, categories: list[str], scans: DataFrame) -> DataFrame:
    """Tiles times categories without those in the ledger (tile_key, category). The grid has a fixed size."""
    wanted = tiles(spark).select("tile_key", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    return wanted.join(scans.select("tile_key", "category").distinct(), ["tile_key", "category"], "left_anti")


def seed_scans(pois: DataFrame) -> DataFrame:
    """The ledger that known places imply: tile_key, category, n. Places off the grid seed nothing."""
    return pois.select(tile_key(F.col("p_lat"), F.col("p_lon")).alias("tile_key"), F.col("type").alias("category")).where("tile_key is not null").groupBy("tile_key", "category").agg(F.count("*").alias("n"))


def record_scans(ledger: DataFrame, scans: DataFrame) -> DataFrame:
    """Adds scans (tile_key, category, at) to a ledger (tile_key, category, scans, last_scan): counts add, the latest stays."""
    new = scans.groupBy("tile_key", "category").agg(F.count("*").alias("scans"), F.max("at").alias("last_scan"))
    return ledger.select("tile_key", "category", "scans", "last_scan").unionByName(new).groupBy("tile_key", "category").agg(F.sum("scans").alias("scans"), F.max("last_scan").alias("last_scan"))


def coverage_plan(spark: SparkSession, categories: list[str], scans: DataFrame) -> DataFrame:
    """One row: total, scanned, uncovered_pairs, uncovered_tiles."""
    total = L.TILE_ROWS * L.TILE_COLUMNS * len(categories)
    return uncovered_pairs(spark, categories, scans).agg(F.lit(total).cast("long").alias("total"), (F.lit(total) - F.count("*")).alias("scanned"), F.count("*").alias("uncovered_pairs"), F.count_distinct("tile_key").alias("uncovered_tiles"))


def street_part(c):
    """An address without its number, case kept."""
    c = F.regexp_replace(c, r"(?iu)(?:^|\s)бр\.?\s*\d+(?:[/\-\s]\d+)*\s*$", "")
    return F.trim(F.regexp_replace(c, r"(?iu)\s+\d(?:[\s.\-/0-9а-яa-z]*[0-9а-яa-z])?\s*$", ""))


def census(streets: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates by street key with their class.

    ``streets``: text, origin (map, feed or osm), seq (order of arrival). ``known``: key, numbered (rows with a number that
    the map has). Gives key, display (a map's spelling first, else the first), origins, numbers (of the feed, most frequent
    first, then by value), map_numbers, class: unknown, thin (fewer than two numbers and the feed has some) or known.
    """
    s = streets.select(street_part(F.trim("text")).alias("name"), "origin", "seq", house_number(F.col("text")).alias("num")).where(F.length("name") >= 3)
    s = s.withColumn("key", street_key(F.col("name"))).where(F.length("key") >= 3)
    by_number = s.where("origin = 'feed' and num <> ''").groupBy("key", "num").agg(F.count("*").alias("n"))
    value = F.coalesce(F.nullif(F.regexp_extract("num", r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(2**53 - 1))
    numbers = by_number.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), value.alias("v"), "num"))), lambda x: x["num"]).alias("numbers"))
    # the latest map spelling, else the first of all
    order = F.struct(F.when(F.col("origin") == "map", 0).otherwise(1), F.when(F.col("origin") == "map", -F.col("seq")).otherwise(F.col("seq")))
    head = s.groupBy("key").agg(F.min_by("name", order).alias("display"), F.array_sort(F.collect_set("origin")).alias("origins"))
    j = head.join(numbers, "key", "left").join(known.select("key", "numbered"), "key", "left")
    j = j.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>")))
    kind = F.when(F.col("numbered").isNull(), "unknown").when((F.col("numbered") < 2) & (F.size("numbers") > 0), "thin").otherwise("known")
    return j.select("key", "display", "origins", F.when(kind == "thin", F.col("numbers")).otherwise(F.array().cast("array<string>")).alias("numbers"), F.coalesce("numbered", F.lit(0)).cast("long").alias("map_numbers"), kind.alias("class"))


def census_projection(classified: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("class") == k)
    thin = F.sum(F.when(F.col("class") == "thin", F.size("numbers")).otherwise(0)).cast("long")
    return classified.agg(n("known").alias("known"), n("thin").alias("thin"), thin.alias("thin_numbers"), n("unknown").alias("unknown"), (thin + n("unknown")).alias("searches"))


def teach_plan(classified: DataFrame, cap: int | None = None) -> DataFrame:
    """Streets to learn in order: unknown ones, then thin ones, those of the feed first in each, by name; with a cap a thin
    street takes as many of its numbers as the budget has left. Gives pos, key, street, class, numbers."""
    todo = classified.where("class <> 'known'")
    fed = F.arrays_overlap("origins", F.array(F.lit("feed"), F.lit("osm")))
    rank = F.when(F.col("class") == "unknown", 0).otherwise(1000) + F.when(fed, 0).otherwise(500)
    cost = F.when(F.col("class") == "unknown", 1).otherwise(F.size("numbers"))
    # no task sees the whole list
    o = running(todo.withColumn("rank", rank).withColumn("cost", cost), ["rank", "display", "key"], "cost")
    o = o.withColumn("pos", F.col("pos").cast("int")).withColumn("spent", F.col("spent") - F.col("cost"))
    if cap is not None:
        o = o.where(F.col("spent") < cap).withColumn("numbers", F.slice("numbers", 1, F.greatest(F.lit(0), F.lit(cap) - F.col("spent")).cast("int")))
    return o.select("pos", "key", F.col("display").alias("street"), "class", "numbers")


def spend_gate(asked: DataFrame) -> DataFrame:
    """go, budget and basis for each request: estimated, live, probe_ok, keys, floor.

    A probe's live figure counts when it worked, else a nominal 250 for each key; the floor stays untouched.
    """
    budget = F.when(F.col("probe_ok"), F.col("live")).otherwise(F.col("keys") * 250)
    basis = F.when(F.col("probe_ok"), "live").otherwise("nominal")
    return asked.withColumn("budget", budget).withColumn("basis", basis).withColumn("go", F.col("estimated") <= F.col("budget") - F.col("floor"))


def verify_map(pois: DataFrame, open_pairs: DataFrame, least: int = 1000, searches_left: int = 0, budget_floor: int = 0) -> DataFrame:
    """One row: pois, duplicate_ids, outside, open_pairs, violations (array), warnings (array)."""
    from cartolex.functions.geo import inside

    counts = pois.agg(F.count("*").alias("pois"), F.count_if(~inside(L.CITY_BOX, F.col("p_lat"), F.col("p_lon"))).alias("outside"))
    dup = pois.where("place_id is not null").groupBy("place_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.count_if(F.col("n") > 1), F.lit(0)).alias("duplicate_ids"))
    one = counts.join(F.broadcast(dup)).join(F.broadcast(open_pairs.agg(F.count("*").alias("open_pairs"))))  # one row each
    may = searches_left > budget_floor
    open_ = F.when(F.col("open_pairs") > 0, "coverage open")
    violations = F.array_compact(F.array(F.when(F.col("pois") < least, "too few places"), F.when(F.col("duplicate_ids") > 0, "duplicate place ids"), open_ if may else F.lit(None).cast("string")))
    warnings = F.array_compact(F.array(F.when(F.col("outside") > 0, "places outside the box"), F.lit(None).cast("string") if may else open_))
    return one.select("pois", "duplicate_ids", "outside", "open_pairs", F.array_join(violations, "; ").alias("violations"), F.array_join(warnings, "; ").alias("warnings"))
