"""Payloads of place searches to rows, and how rows are merged into the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.geo import pin_may_move

PAYLOAD = (
    "title string, type string, gps_coordinates struct<latitude:double,longitude:double>, data_id string, data_cid string, reviews double, review_count double, rating double, plus_code string, "
    "phone string, website string, price string, price_level string, permanently_closed boolean, business_status string, types array<string>"
)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def capture_pois(payloads: DataFrame, column: str = "payload", fallback: str = "place") -> DataFrame:
    """One row for each payload that has a name of two characters and a point; other columns of ``payloads`` stay.

    Text that is no JSON gives no row. An id comes from data_id, else from the two halves of data_cid.
    """
    p = payloads.withColumn("_r", F.from_json(column, PAYLOAD))
    name = F.trim("_r.title")
    number = F.when(F.col("_r.data_cid").rlike(r"^\d{1,20}$"), F.lower(F.conv("_r.data_cid", 10, 16)))
    high = F.when(F.length(number) > 8, F.expr("substring(_hex, 1, length(_hex) - 8)")).otherwise("0")
    p = p.withColumn("_hex", number)
    low = F.regexp_replace(F.expr("right(_hex, 8)"), "^0+(?=.)", "")
    pid = F.coalesce(_text(F.col("_r.data_id")), F.when(F.col("_hex").isNotNull(), F.concat(F.lit("0x"), F.when(F.length("_hex") > 8, F.expr("substring(_hex, 1, length(_hex) - 8)")).otherwise("0"), F.lit(":0x"), low)))
    closed = F.coalesce(F.col("_r.permanently_closed"), F.lit(False)) | F.coalesce(F.col("_r.business_status").rlike("(?i)closed"), F.lit(False))
    r = p.where((F.length(name) >= 2) & F.col("_r.gps_coordinates.latitude").isNotNull() & F.col("_r.gps_coordinates.longitude").isNotNull())
    return r.select(
        *[c for c in payloads.columns if c != column],
        name.alias("name"),
        F.coalesce(_text(F.col("_r.type")), F.lit(fallback)).alias("type"),
        F.col("_r.gps_coordinates.latitude").alias("lat"),
        F.col("_r.gps_coordinates.longitude").alias("lon"),
        pid.alias("place_id"),
        F.floor(F.coalesce("_r.reviews", "_r.review_count") + 0.5).cast("int").alias("review_count"),
        F.col("_r.rating").alias("rating"),
        _text(F.col("_r.plus_code")).alias("plus_code"),
        _text(F.col("_r.phone")).alias("phone"),
        _text(F.col("_r.website")).alias("website"),
        F.coalesce(_text(F.col("_r.price")), _text(F.col("_r.price_level"))).alias("price_level"),
        closed.cast("int").alias("closed"),
        F.when(F.size("_r.types") > 0, F.to_json("_r.types")).alias("types"),
        F.lit("google").alias("source"),
    )


def capture_upsert(pois: DataFrame, captured: DataFrame, most_m: float = 300.0) -> DataFrame:
    """Rows of the map after captures: new ids are inserted; known ones fill empty fields and move their pin only within reach.

    Both: place_id, name, p_lat, p_lon, phone. Of captures with one id the first by name counts. Gives place_id, name, p_lat,
    p_lon, phone, change (none, filled, moved, inserted).
    """
    c = captured.where("place_id is not null").groupBy("place_id").agg(F.min_by(F.struct("name", "p_lat", "p_lon", "phone"), F.struct("name", "p_lat", "p_lon")).alias("c"))
    j = pois.where("place_id is not null").select("place_id", F.struct("name", "p_lat", "p_lon", "phone").alias("o")).join(c, "place_id", "full_outer")
    moves = pin_may_move(F.col("o.p_lat"), F.col("o.p_lon"), F.col("c.p_lat"), F.col("c.p_lon"), most_m) & F.col("c").isNotNull() & ((F.col("o.p_lat") != F.col("c.p_lat")) | (F.col("o.p_lon") != F.col("c.p_lon")) | F.col("o.p_lat").isNull())
    fills = (F.coalesce("o.phone", F.lit("")) == "") & (F.coalesce("c.phone", F.lit("")) != "")
    change = F.when(F.col("o").isNull(), "inserted").when(F.coalesce(moves, F.lit(False)), "moved").when(fills, "filled").otherwise("none")
    j = j.withColumn("change", change)
    pin = lambda k: F.when(F.col("change").isin("inserted", "moved"), F.col(f"c.{k}")).otherwise(F.col(f"o.{k}"))
    return j.select("place_id", F.coalesce("o.name", "c.name").alias("name"), pin("p_lat").alias("p_lat"), pin("p_lon").alias("p_lon"), F.coalesce(F.nullif("o.phone", F.lit("")), "c.phone").alias("phone"), "change")
