"""Maps and tables as files: tolerant scans, reviewed variants, carry-through, backups, restores and stamps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.classes import map_type
from cartolex.functions.text import canonical_word_key
from cartolex.operators.identity import place_upsert

VARIANTS = "variants array<struct<word:string,canonical:string,reviewed:boolean>>"
#: Keys of one part of a stamp: a part is as large whatever the table.
STAMP_KEYS = 65_536


def tolerant(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The asked columns with their types; one that the table lacks is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def read_variants(raw: DataFrame, column: str = "json") -> DataFrame:
    """word, canonical of the reviewed pairs of JSON texts; of a word that comes twice the smallest canonical."""
    pairs = raw.select(F.explode(F.from_json(column, VARIANTS)["variants"]).alias("v")).where("v.reviewed and v.word is not null and v.canonical is not null")
    return pairs.groupBy(F.lower("v.word").alias("word")).agg(F.min(F.lower("v.canonical")).alias("canonical"))


def variant_keys(words: DataFrame, variants: DataFrame) -> DataFrame:
    """Adds ``key`` to words (word): the canonical key of the reviewed spelling, else of the word. The variants are a reviewed
    list, some hundred rows, sent only while Spark's own limit allows."""
    j = words.withColumn("_w", F.lower("word")).join(variants.select(F.col("word").alias("_w"), "canonical"), "_w", "left")
    return j.select(*words.columns, canonical_word_key(F.coalesce("canonical", "word")).alias("key"))


def first_by_name(scraped: DataFrame) -> DataFrame:
    """One row for each name (case and white space aside), the first in the order of ``seq``: key, name, type (mapped), seq."""
    key = F.regexp_replace(F.lower("name"), r"\s+", " ")
    one = scraped.groupBy(key.alias("key")).agg(F.min_by(F.struct("name", "type", "seq"), "seq").alias("r"))
    return one.select("key", "r.name", map_type(F.col("r.type")).alias("type"), "r.seq")


def carry_through(old: DataFrame, new: DataFrame) -> DataFrame:
    """A rebuilt map: new rows, and old rows with an id, upserted by id with the new ones last; new rows without an id stay.

    Both: place_id, seq and the columns of ``place_upsert``."""
    rows = old.where("place_id is not null").withColumn("_order", F.struct(F.lit(0).alias("a"), F.col("seq").alias("b"))).unionByName(new.withColumn("_order", F.struct(F.lit(1).alias("a"), F.col("seq").alias("b"))))
    return place_upsert(rows, "_order")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, booleans as 0 and 1, structures as JSON; nulls stay."""

    def text(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "boolean":
            c = c.cast("int")
        return (F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string")).alias(name)

    return df.select(*[text(c) for c in df.columns])


def backup(df: DataFrame, path: str) -> str:
    """Writes the text mirror of a table as JSON lines to a new folder below ``path`` and gives that folder."""
    at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    as_text(df).write.option("ignoreNullFields", "false").json(at)
    return at


def restore(spark: SparkSession, path: str, schema: str, target: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The rows of a backup in their types; with a target, its rows of other keys beside them (restored rows win)."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    shape = _parse_datatype_string(schema)
    raw = spark.read.schema(StructType([type(f)(f.name, _parse_datatype_string("string")) for f in shape])).json(path)

    def typed(f) -> Column:
        c = F.col(f.name)
        if f.dataType.typeName() in ("struct", "array", "map"):
            return F.from_json(c, f.dataType).alias(f.name)
        return (c == "1" if f.dataType.typeName() == "boolean" else c.cast(f.dataType)).alias(f.name)

    rows = raw.select(*[typed(f) for f in shape])
    return rows if target is None else target.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)


def stamp(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """n rows and a SHA-256 of their texts in the order of an integer key: n, digest. Each part has a digest of its own first."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    parts = df.groupBy(F.floor(F.col(key) / STAMP_KEYS).alias("p")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))).alias("rows"))
    digests = parts.select("p", "n", F.sha2(F.array_join("rows.l", "\n"), 256).alias("d"))
    return digests.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("p", "d")))["d"], "\n"), 256).alias("digest"))


def without_url(pois: DataFrame, most: int) -> DataFrame:
    """Rows whose place has no URL yet, by name, the first ``most``: a worklist."""
    return pois.where("place_id is not null and coalesce(place_url, '') = ''").orderBy("name", "poi_id").limit(most).select("poi_id", "name")
