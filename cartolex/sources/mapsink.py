"""The map's sink: upserted tables, published as versions that readers see whole or not at all."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.script import clean_name
from cartolex.functions.text import street_key

#: Columns that a later row of a place overwrites, and those that stay as its first row has them.
LATEST = ["name", "type", "lat", "lon", "source", "review_count", "rating", "types", "closed"]
FIRST = ["plus_code", "phone", "website", "price_level"]
POI_COLUMNS = ["name", "type", "lat", "lon", "source", "place_url", "place_id", "review_count", "rating", "plus_code", "phone", "website", "price_level", "closed", "types"]


class StaleVersion(RuntimeError):
    """Another version was published since the one that this one was made from."""


def upserted_pois(rows: DataFrame) -> DataFrame:
    """One row for each place id, in the order of ``seq``: names, types, points and counts are the last row's, the link the last that
    there is, codes and contacts the first row's. Rows without an id all stay; names are cleaned.

    ``rows``: POI_COLUMNS and seq; absent columns count as null, an absent source as osm."""
    for c in [c for c in POI_COLUMNS if c not in rows.columns]:
        rows = rows.withColumn(c, F.lit(None).cast("double" if c == "rating" else "int" if c in ("review_count", "closed") else "string"))
    rows = rows.withColumn("name", clean_name(F.col("name"))).withColumn("source", F.coalesce("source", F.lit("osm"))).withColumn("closed", F.coalesce("closed", F.lit(0)))
    known = rows.where("place_id is not null").groupBy("place_id").agg(
        F.max_by(F.struct(*LATEST), "seq").alias("l"), F.min_by(F.struct(*FIRST), "seq").alias("f"), F.max_by("place_url", F.when(F.col("place_url").isNotNull(), F.col("seq"))).alias("place_url")
    )
    known = known.select("place_id", "place_url", "l.*", "f.*")
    return rows.where("place_id is null").select(*POI_COLUMNS).unionByName(known.select(*POI_COLUMNS))


def keyed_addresses(rows: DataFrame) -> DataFrame:
    """Addresses with cleaned streets and their keys: street, housenumber, lat, lon, key, source."""
    street = clean_name(F.col("street"))
    source = F.coalesce("source", F.lit("")) if "source" in rows.columns else F.lit("")
    return rows.select(street.alias("street"), F.coalesce("housenumber", F.lit("")).alias("housenumber"), "lat", "lon", source.alias("source")).withColumn("key", street_key(F.col("street"))).select("street", "housenumber", "lat", "lon", "key", "source")


def rebuilt_pois(fresh: DataFrame, before: DataFrame | None) -> DataFrame:
    """A fresh extract (POI_COLUMNS or some of them) with what the version before knows of places with an id behind it."""
    rows = fresh.withColumn("seq", F.lit(0))
    if before is not None:
        rows = rows.unionByName(before.where("place_id is not null").withColumn("seq", F.lit(1)), allowMissingColumns=True)
    return upserted_pois(rows)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Published versions and their folders, oldest first. A version whose entry is not fully written is none yet."""
    fs, at = _fs(spark, f"{path}/_versions")
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                found.append((int(name), text.strip()))
    return sorted(found)


def publish(tables: dict[str, DataFrame], path: str, base: int) -> int:
    """Writes tables beside all earlier versions and makes them version ``base`` + 1 by one entry that can be made only once.

    ``base``: the version that they were made from, 0 for none. Where another one has taken that number the files go and
    StaleVersion is raised. Readers look up the last entry, so they see all tables of a version, or those of the one before."""
    path = path.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/v-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    fs, entry = _fs(spark, f"{path}/_versions/{base + 1:012d}")
    last = versions(spark, path)
    try:
        if (last[-1][0] if last else 0) != base:
            raise StaleVersion(f"version {base} is not the last one")
        try:
            out = fs.create(entry, False)  # fails where the entry is there
        except Exception as e:
            raise StaleVersion(f"version {base + 1} is there") from e
    except StaleVersion:
        drop(spark, folder)
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return base + 1


def drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        fs, at = _fs(spark, folder)
        fs.delete(at, True)


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the last version, or of a given one."""
    found = dict(versions(spark, path.rstrip("/")))
    if not found:
        raise FileNotFoundError(f"no version under {path}")
    return spark.read.parquet(f"{found[max(found) if version is None else version]}/{name}")


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes the files of all but the last ``keep`` versions; their entries stay, so that no number is given twice."""
    old = versions(spark, path.rstrip("/"))[: -max(1, keep)]
    for _, folder in old:
        drop(spark, folder)
    return [n for n, _ in old]
