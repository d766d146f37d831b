"""Places by name: contained words, categories, and a cascade of looser passes over a batch of needles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.classes import is_property_word, word_forms
from cartolex.functions.geo import distance_m
from cartolex.functions.text import ascii_lower, canonical_word_key, edit_within_one, identity_key, norm_type, phonetic_keys, spell_latin, to_cyrillic, to_latin
from cartolex.operators.spatial import nearest_named, sphere_join
from cartolex.tables import cut


def fold(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")


def place_category(name: Column) -> Column:
    """The class of the first word that names one; null where none does."""
    words = F.filter(F.split(F.regexp_replace(to_latin(name), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    exact = F.create_map(*[F.lit(x) for kv in L.CATEGORY_WORDS.items() for x in kv])
    stem = lambda w: F.coalesce(*[F.when(w.startswith(s), F.lit(c)) for s, c in L.CATEGORY_STEMS])
    return F.get(F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(exact, w), stem(w))), lambda x: x.isNotNull()), F.lit(0))


def is_shop(name: Column, kind: Column) -> Column:
    return F.get(F.split(fold(name), " "), F.lit(0)).isin(*L.SHOP_FIRST_WORDS) | norm_type(kind).isin(*L.SHOP_TYPES)


def word_hit(hay: Column, needle: Column) -> Column:
    """The needle (3 characters or more) starts at a word; it ends at one too, or has 4."""
    tail = F.when(F.length(needle) >= 4, "").otherwise(r"(?![\p{L}\p{N}])")
    return (F.length(needle) >= 3) & F.regexp_like(hay, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), needle, F.lit(r"\E"), tail))


def opener_off(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?iu)^(?:кај|спроти|как)\s+", ""))


#: Letters by which a needle meets the names that hold it: its first ones, three at most.
START = 3


def starts(c: Column) -> Column:
    """Every run of one to START letters of a text: wherever a needle stands in it, the needle's start is one of them."""
    n = F.length(c)

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))

    return F.array_distinct(F.concat(*map(runs, range(1, START + 1))))


def holders(needles: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of a needle (needle_id, which, t) and a distinct name (name, which, hay) that holds it: needle_id, name. They meet
    on the needle's start and are then compared; a needle without letters holds nothing."""
    asked = needles.where(F.length("t") >= 1).withColumn("_s", F.substring("t", 1, START))
    offered = names.withColumn("_s", F.explode(starts(F.col("hay"))))
    return asked.join(offered, ["which", "_s"]).where(F.col("hay").contains(F.col("t"))).select("needle_id", "name").distinct()


def find_pois_like(needles: DataFrame, pois: DataFrame, most_m: float = 900.0) -> DataFrame:
    """Places whose name holds the needle (ASCII case aside) within reach of its centre: needle_id, poi_id, distance_m."""
    n = needles.select("needle_id", ascii_lower(F.col("text")).alias("t"), "center_lat", "center_lon")
    names = pois.select("name").distinct().select("name", F.lit(0).alias("which"), ascii_lower(F.col("name")).alias("hay"))
    hit = holders(n.select("needle_id", F.lit(0).alias("which"), "t"), names)
    j = hit.join(n, "needle_id").join(pois.select("poi_id", "name", "p_lat", "p_lon"), "name")
    d = distance_m(F.col("center_lat"), F.col("center_lon"), F.col("p_lat"), F.col("p_lon"))
    return j.withColumn("d", d).where(F.col("d") <= most_m).select("needle_id", "poi_id", F.floor(F.col("d") + 0.5).alias("distance_m"))


def find_pois_by_name(needles: DataFrame, names: DataFrame, limit: int = 8) -> DataFrame:
    """For each needle the shortest names that hold it in either script, venues before shops: needle_id, rn, name.

    ``names``: distinct name, type."""
    clean = needles.select("needle_id", opener_off(F.col("text")).alias("t")).where(F.length("t") >= 2)
    f = fold(F.col("t"))
    n = clean.select("needle_id", f.alias("f")).withColumn("c", F.when(F.col("f").rlike("[Ѐ-ӿ]"), F.col("f")).otherwise(fold(to_cyrillic(F.col("f"))))).withColumn("l", fold(spell_latin(F.col("c"))))
    form = lambda which, t: F.struct(F.lit(which).alias("which"), t.alias("t"))
    asked = n.select("needle_id", F.explode(F.array(form("low", F.col("f")), form("low", F.col("c")), form("lat", F.col("f")), form("lat", F.when(F.length("l") >= 3, F.col("l")).otherwise("")))).alias("x")).select("needle_id", "x.*").distinct()
    every = names.select("name").distinct()
    hay = every.select("name", F.explode(F.array(F.struct(F.lit("low").alias("which"), fold(F.col("name")).alias("hay")), F.struct(F.lit("lat").alias("which"), fold(spell_latin(F.col("name"))).alias("hay")))).alias("x")).select("name", "x.*")
    kinds = names.select("name", is_shop(F.col("name"), F.col("type")).alias("shop")).distinct()
    j = holders(asked, hay).join(kinds, "name").withColumn("_venue", F.max(~F.col("shop")).over(Window.partitionBy("needle_id"))).where("not _venue or not shop")
    rn = F.row_number().over(Window.partitionBy("needle_id").orderBy(F.length("name"), "name"))
    return j.select("needle_id", "name").distinct().withColumn("rn", rn).where(F.col("rn") <= limit).select("needle_id", "rn", "name")


def poi_features(names: DataFrame) -> DataFrame:
    """What a lookup needs of each distinct name, computed once: name, low, lat, phon, ident, canon, cat."""
    words = F.filter(F.split(fold(F.col("name")), " "), lambda w: w != "")
    return names.select("name", fold(F.col("name")).alias("low"), fold(spell_latin(F.col("name"))).alias("lat"), phonetic_keys(F.col("name")).alias("phon"), identity_key(F.col("name")).alias("ident"), F.transform(words, canonical_word_key).alias("canon"), place_category(F.col("name")).alias("cat"))


def shortened(word: Column) -> Column:
    """A word of 5 letters or more and all that is left of it without one letter: two words up to one typo apart share one."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n >= 5, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def find_poi_by_name(needles: DataFrame, names: DataFrame) -> DataFrame:
    """The best name for each needle by the first pass that has one: needle_id, pass, name.

    Passes: 1 the same identity key, 2 word-aligned hit, 3 all phonetic words, 4 all canonical words, 5 words up to one typo
    (5 letters or more, same first letter). Candidates of another category than the needle's are left out. Within a pass the
    shortest name, then the smaller one. Needles of fewer than 3 characters, and those that name a kind of flat, find nothing.
    Each pass meets the names on words or on words less a letter; the passes' candidates come together once.
    """
    h = poi_features(names)
    t = needles.select("needle_id", opener_off(F.col("text")).alias("name")).where((F.length("name") >= 3) & ~is_property_word(F.col("name")))
    n = poi_features(t.select("name").distinct()).join(t, "name").select("needle_id", *[F.col(c).alias(f"n_{c}") for c in ("low", "lat", "phon", "ident", "canon", "cat")])
    same = F.col("n_cat").isNull() | F.col("cat").isNull() | (F.col("n_cat") == F.col("cat"))
    pick = lambda j, number: j.where(same).select("needle_id", F.lit(number).alias("pass"), "name")
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")

    found = pick(n.where("n_ident <> ''").join(h, n["n_ident"] == h["ident"]), 1)
    # a word-aligned hit shares the needle's first word or begins one: names by the first one, two and three letters of each
    # word, needles by as many of their first word as it has, three at most
    heads = lambda w: F.array(*[F.substring(w, 1, k) for k in (1, 2, 3)])
    by_lat = h.withColumn("g", F.explode(F.array_distinct(F.flatten(F.transform(words("lat"), heads)))))
    hits = n.withColumn("g", F.substring(F.get(F.split("n_lat", " "), F.lit(0)), 1, 3)).join(by_lat, "g").where(word_hit(F.col("low"), F.col("n_low")) | word_hit(F.col("lat"), F.col("n_lat")))
    found = found.unionByName(pick(hits, 2))
    for number, col in ((3, "phon"), (4, "canon")):
        j = n.where(F.size(f"n_{col}") > 0).withColumn("w", F.get(F.col(f"n_{col}"), F.lit(0))).join(h.withColumn("w", F.explode(F.array_distinct(col))), "w").where(F.size(F.array_except(f"n_{col}", col)) == 0)
        found = found.unionByName(pick(j, number))
    # the first word of a needle has a word up to a typo apart in every name of this pass
    q = n.withColumn("q", words("n_lat")).where(F.size("q") > 0).withColumn("g", F.explode(shortened(F.get("q", F.lit(0)))))
    r = h.withColumn("r", words("lat")).withColumn("g", F.explode(F.array_distinct(F.flatten(F.transform("r", shortened)))))
    near = F.forall("q", lambda a: F.exists("r", lambda b: (a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & edit_within_one(a, b))))
    found = found.unionByName(pick(q.join(r, "g").where(near), 5))
    best = found.groupBy("needle_id").agg(F.min(F.struct("pass", F.length("name").alias("l"), "name")).alias("b"))
    return best.select("needle_id", "b.pass", "b.name")


def find_anchors(words: DataFrame, pois: DataFrame, most_m: float = 900.0) -> DataFrame:
    """A place word near a centre: word_id, form, name, poi_id, distance_m. ``words``: word_id, word, lat, lon.

    The word's forms in their order; the first whose best name has a row within reach counts, with its nearest row. Distinct
    words at distinct centres meet the distinct points of a name in cells."""
    here = ["word", "lat", "lon"]
    spoken = words.select("word").distinct().select("word", F.posexplode(word_forms(F.col("word"))).alias("pos", "form"))
    asked = spoken.select("form").distinct()
    best = find_poi_by_name(asked.select(F.col("form").alias("needle_id"), F.col("form").alias("text")), pois.select("name").distinct()).select(F.col("needle_id").alias("form"), "name")
    at = pois.groupBy("name", "p_lat", "p_lon").agg(F.min("poi_id").alias("poi_id"))
    meant = spoken.join(best, "form").join(at, "name")
    j = sphere_join(words.select(*here).distinct(), meant, most_m + 1, ["word"]).withColumnRenamed("distance", "d").where(F.floor(F.col("d") + 0.5) <= most_m)
    one = j.groupBy(*here).agg(F.min(F.struct("pos", "d", "poi_id", "form", "name")).alias("b"))
    return words.select("word_id", *here).join(one, here).select("word_id", "b.form", "b.name", "b.poi_id", F.floor(F.col("b.d") + 0.5).alias("distance_m"))


def settlements_named(needles: DataFrame, areas: DataFrame) -> DataFrame:
    """The area whose name has all phonetic words of a needle: needle_id, poi_id, name. ``needles``: needle_id, text, center_lat,
    center_lon (null: none). ``areas``: poi_id, name, p_lat, p_lon. The fewest further words first, then a name that is the
    needle's words and no more, then the nearest, then the shortest.

    Distinct texts meet distinct names on the needle's first word; which names are the best of a text does not hang on its
    centre, and only their distinct points are sought, in rings around distinct centres."""
    n = needles.select("text").distinct().select("text", phonetic_keys(F.col("text")).alias("q")).where(F.size("q") > 0).withColumn("w", F.get("q", F.lit(0)))
    a = areas.select("name").distinct().select("name", phonetic_keys(F.col("name")).alias("r")).withColumn("w", F.explode(F.array_distinct("r")))
    j = n.join(a, "w").where(F.size(F.array_except("q", "r")) == 0)
    fit = F.struct(F.size(F.array_except("r", "q")).alias("a"), F.when(F.col("q") == F.col("r"), 0).otherwise(1).alias("b"))
    named = j.withColumn("_rank", F.rank().over(Window.partitionBy("text").orderBy(fit))).where("_rank = 1").select("text", "name")
    at = areas.groupBy("name", "p_lat", "p_lon").agg(F.min("poi_id").alias("poi_id"))
    here = ["text", "center_lat", "center_lon"]
    asked, there = cut(needles.select(*here).distinct(), "asked"), cut(named.join(at, "name").withColumn("l", F.length("name")), "areas")
    best = nearest_named(asked, there, "text", "center_lat", "center_lon", "l", "name", "poi_id").select(*[F.col(c).alias(f"_{c}") for c in here], "b")
    return needles.join(best, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in here]).select("needle_id", "b.poi_id", "b.name")
