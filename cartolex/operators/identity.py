"""One place, many rows: name agreement, suspect pairs, merges, twins and identity repair."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.geo import distance_m, rounded, suspect_cell
from cartolex.functions.text import identity_tokens, once, semantic_key
from cartolex.operators.spatial import radius_join, sphere_join
from cartolex.tables import cut, dealt

#: Metres within which names of one token set, of a contained one, or two embassies of a country agree.
TOKEN_M, SUBSET_M, EMBASSY_M = 120.0, 40.0, 200.0
SAME_NAME_M, TWIN_M = 100, 3.0
#: Rounds that settle any component that fits a cluster.
STAR_ROUNDS = 60


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def countries_in(tokens: Column) -> Column:
    """Countries among tokens, with their other words."""

    def named(found: Column) -> Column:
        more = [F.when(F.arrays_overlap(found, _words([k, *v])), _words([k, *v])).otherwise(F.array().cast("array<string>")) for k, v in L.COUNTRY_ALIASES.items()]
        return F.array_distinct(F.concat(found, *more))

    # bound once, since the tokens' own expression is long
    return once(F.array_intersect(tokens, _words(L.COUNTRIES)), named)


def is_embassy(name: Column) -> Column:
    return semantic_key(name).rlike(f"(?i){L.EMBASSY}") | F.lower(name).rlike(f"(?i){L.EMBASSY}")


def has_qualifier(name: Column) -> Column:
    return F.array_join(identity_tokens(name), " ").rlike(f"(?i){L.IDENTITY_QUALIFIERS}") | name.rlike(f"(?i){L.IDENTITY_QUALIFIERS}")


def name_traits(name: Column) -> Column:
    """What names are compared by, as one struct; null names have null parts."""
    tokens = F.array_distinct(identity_tokens(name))
    return F.struct(tokens.alias("tokens"), has_qualifier(name).alias("qualified"), is_embassy(name).alias("embassy"), countries_in(tokens).alias("countries"))


def traits_of(*names: DataFrame) -> DataFrame:
    """name, traits: of each distinct name in the one column of the tables. The names are dealt out first, since a small file is one
    task and a name's traits cost far more than its bytes; the table is written, so that no comparison works them out again."""
    every = functools.reduce(DataFrame.unionByName, [n.toDF("name") for n in names]).where("name is not null").distinct()
    return cut(dealt(every, "name").select("name", name_traits(F.col("name")).alias("traits")), "traits")


def tier_of(a: Column, b: Column, metres: Column, id_a: Column, id_b: Column) -> Column:
    """``same_place_tier`` of two names' traits."""
    ta, tb = a["tokens"], b["tokens"]
    a_in_b, b_in_a = F.size(F.array_except(ta, tb)) == 0, F.size(F.array_except(tb, ta)) == 0
    smaller = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb)
    added = F.when(F.size(ta) <= F.size(tb), F.array_except(tb, ta)).otherwise(F.array_except(ta, tb))
    digits_only = (F.size(added) > 0) & F.forall(added, lambda t: t.rlike(r"^\d+$"))
    distinctive = F.exists(smaller, lambda t: F.length(t) >= 4)
    qualified = a["qualified"] == b["qualified"]
    subset = (a_in_b | b_in_a) & distinctive & (id_a != id_b) & qualified & ~digits_only & (metres <= SUBSET_M)
    embassy = a["embassy"] & b["embassy"] & qualified & F.arrays_overlap(a["countries"], b["countries"]) & (metres <= EMBASSY_M)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), "none").when(a_in_b & b_in_a & (metres <= TOKEN_M), "token").when(subset, "subset").when(embassy, "embassy").otherwise("none")


def same_place_tier(a: Column, b: Column, metres: Column, id_a: Column, id_b: Column) -> Column:
    """token, subset, embassy or none: how two names at a distance are the same place. ``id_*``: the row carries an id."""
    return tier_of(name_traits(a), name_traits(b), metres, id_a, id_b)


# --- suspects


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def core_name(c: Column) -> Column:
    return F.array_join(F.filter(name_tokens(c), lambda w: ~w.isin(*L.DESCRIPTORS)), "")


def suspect_pairs(pois: DataFrame) -> DataFrame:
    """Pairs (a_id < b_id) of one grid cell that may be one place: kind, distance_m; equal names of a cell row once.

    ``pois``: poi_id, name, p_lat, p_lon, place_id, phone.
    """
    base = pois.select("poi_id", "name", "p_lat", "p_lon", "place_id", "phone", plain_name(F.col("name")).alias("plain"), suspect_cell(F.col("p_lat"), F.col("p_lon")).alias("cell"))
    side = lambda p: base.select("cell", *[F.col(c).alias(f"{p}_{c}") for c in base.columns if c != "cell"])
    pairs = side("a").join(side("b"), "cell").where("a_poi_id < b_poi_id")
    pairs = pairs.withColumn("distance_m", rounded(distance_m(F.col("a_p_lat"), F.col("a_p_lon"), F.col("b_p_lat"), F.col("b_p_lon"))).cast("long"))
    same = F.col("a_plain") == F.col("b_plain")
    kind = (
        F.when((F.col("a_place_id") == F.col("b_place_id")) & ~same, "same-place_id-different-name")
        .when(same & (F.col("distance_m") > 50), "same-name-drifted")
        .when((F.col("a_phone") == F.col("b_phone")) & (F.col("a_phone") != "") & ~same & (F.col("distance_m") > 50), "same-phone")
        .when((F.col("a_place_id") != F.col("b_place_id")) & (F.col("distance_m") < 30) & (F.col("a_plain").contains(F.col("b_plain")) | F.col("b_plain").contains(F.col("a_plain"))), "dual-identified-near")
    )
    pairs = pairs.withColumn("kind", kind).where("kind is not null")
    lat = lambda p: rounded(F.col(f"{p}_p_lat") * 400)
    seen = Window.partitionBy(F.least("a_name", "b_name"), F.greatest("a_name", "b_name"), lat("a"), lat("b")).orderBy("a_poi_id", "b_poi_id")
    return pairs.withColumn("_n", F.row_number().over(seen)).where("_n = 1").select(F.col("a_poi_id").alias("a_id"), F.col("b_poi_id").alias("b_id"), F.col("a_name"), F.col("b_name"), "kind", "distance_m")


def survivor_key(reviews: Column, place_id: Column, name: Column, poi_id: Column) -> Column:
    """The row with the largest key survives."""
    descriptors = F.size(F.filter(name_tokens(name), lambda w: w.isin(*L.DESCRIPTORS)))
    return F.struct(F.coalesce(reviews, F.lit(0)).alias("r"), F.when(place_id.isNull(), 0).otherwise(1).alias("p"), (-descriptors).alias("d"), F.length(name).alias("l"), (-poi_id).alias("i"))


def merge_decisions(pairs: DataFrame, pois: DataFrame) -> DataFrame:
    """For each suspect pair: merge, survivor_id, dropped_id, rule."""
    facts = pois.select("poi_id", "type", survivor_key(F.col("review_count"), F.col("place_id"), F.col("name"), F.col("poi_id")).alias("key"))
    j = pairs.join(facts.select(F.col("poi_id").alias("a_id"), F.col("type").alias("a_type"), F.col("key").alias("a_key")), "a_id").join(facts.select(F.col("poi_id").alias("b_id"), F.col("type").alias("b_type"), F.col("key").alias("b_key")), "b_id")
    mall = lambda p: F.col(f"{p}_name").rlike(f"(?iu){L.MALL_ANCHOR}") | F.replace(F.col(f"{p}_type"), F.lit("_"), F.lit(" ")).rlike(f"(?iu){L.MALL_ANCHOR}")
    pa, pb = plain_name(F.col("a_name")), plain_name(F.col("b_name"))
    a_holds, b_holds = mall("a") & (F.length(pa) >= 4) & pb.contains(pa) & (pa != pb), mall("b") & (F.length(pb) >= 4) & pa.contains(pb) & (pa != pb)
    core = core_name(F.col("a_name"))
    rule = (
        F.when(F.col("kind") == "same-phone", "phone").when(F.col("kind") == "same-place_id-different-name", "place_id").when(a_holds, "inside-a").when(b_holds, "inside-b")
        .when(F.col("kind") == "same-name-drifted", F.when(F.col("distance_m") <= SAME_NAME_M, "same-name").otherwise("review-far"))
        .when((core != "") & (core == core_name(F.col("b_name"))), "core-name").otherwise("review-names")
    )
    a_wins = F.when(F.col("rule") == "inside-a", True).when(F.col("rule") == "inside-b", False).otherwise(F.col("a_key") > F.col("b_key"))
    j = j.withColumn("rule", rule).withColumn("_a", a_wins)
    return j.select("a_id", "b_id", "kind", "distance_m", "rule", (~F.col("rule").startswith("review")).alias("merge"), F.when(F.col("_a"), F.col("a_id")).otherwise(F.col("b_id")).alias("survivor_id"), F.when(F.col("_a"), F.col("b_id")).otherwise(F.col("a_id")).alias("dropped_id"))


def label_components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge (a, b) reaches, the smallest itself included.

    Rounds of two steps: every id links its larger neighbours to the smallest id that it sees, then its smaller ones; a path
    of n ids settles in about log n rounds. Each round is written, so lineage is cut and an id with many edges is summed
    before it moves. More than STAR_ROUNDS rounds raise an error.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = edges.where("a <> b").select(high, low).distinct().checkpoint()
    mark = None
    for _ in range(STAR_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        moved = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {STAR_ROUNDS} rounds")


def merge_components(pois: DataFrame) -> DataFrame:
    """survivor_id, n_dropped, dropped (ids, comma-joined) of each component of merging pairs."""
    decided = merge_decisions(suspect_pairs(pois), pois).where("merge")
    labels = label_components(decided.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    keyed = labels.join(pois.select(F.col("poi_id").alias("id"), survivor_key(F.col("review_count"), F.col("place_id"), F.col("name"), F.col("poi_id")).alias("key")), "id")
    best = keyed.groupBy("label").agg(F.max_by("id", "key").alias("survivor_id"), F.array_sort(F.collect_set("id")).alias("ids"))
    dropped = F.filter("ids", lambda i: i != F.col("survivor_id"))
    return best.select("survivor_id", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(F.transform(dropped, lambda i: i.cast("string")), ",").alias("dropped"))


# --- duplicates and twins


def duplicate_place_ids(pois: DataFrame) -> DataFrame:
    return pois.where("place_id is not null").groupBy("place_id").agg(F.count("*").alias("n"), F.min("poi_id").alias("keep")).where("n > 1")


def dedupe_by_identity(pois: DataFrame) -> DataFrame:
    """The oldest row of each (source, place_id); rows without an id stay."""
    first = Window.partitionBy("source", "place_id").orderBy("poi_id")
    ranked = pois.where("place_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return ranked.unionByName(pois.where("place_id is null"))


def place_upsert(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each place_id: the last one's name, type, point, source, reviews, closed; the last URL that is known; the
    first phone. ``rows``: place_id, seq, name, type, p_lat, p_lon, source, review_count, closed, place_url, phone."""
    last = F.max_by(F.struct("name", "type", "p_lat", "p_lon", "source", "review_count", "closed"), order)
    url = F.max_by("place_url", F.when(F.col("place_url").isNotNull(), F.col(order)))
    got = rows.where("place_id is not null").groupBy("place_id").agg(last.alias("l"), url.alias("place_url"), F.min_by("phone", order).alias("phone"), F.count("*").alias("n"))
    return got.select("place_id", "l.*", "place_url", "phone", "n")


def geometry_twins(legacy: DataFrame, elements: DataFrame, metres: float = TWIN_M) -> DataFrame:
    """For each legacy row with exactly one element of its name and type within reach: adopt (the legacy row has no id),
    drop (equal ids or the element has none) or conflict. Both: poi_id, name, type, p_lat, p_lon, place_id."""
    # rows of one name, type and point see the same elements, and elements of one are many at once
    here = ["name", "type", "lat", "lon"]
    l = legacy.select(F.col("poi_id").alias("legacy_id"), "name", "type", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.col("place_id").alias("lp"))
    plain = cut(dealt(legacy.select("name").unionByName(elements.select("name")).distinct(), "name").select("name", plain_name(F.col("name")).alias("n")), "plain")
    alone = elements.join(plain, "name").groupBy("n", F.col("type").alias("t"), "p_lat", "p_lon").agg(F.count("*").alias("_c"), F.min(F.struct("poi_id", "place_id")).alias("_e"))
    near = sphere_join(l.select(*here).distinct().join(plain, "name").withColumn("t", F.col("type")), alone, metres, ["n", "t"], wide=16.0)
    one = near.groupBy(*here).agg(F.sum("_c").alias("c"), F.min("_e").alias("_e")).where("c = 1").select(*here, F.col("_e.poi_id").alias("element_id"), F.col("_e.place_id").alias("ep"))
    one = l.join(one, here)
    fate = F.when(F.col("lp").isNotNull() & F.col("ep").isNull(), "adopted").when(F.col("lp").isNull() | (F.col("lp") == F.col("ep")), "dropped").otherwise("conflict")
    return one.select("legacy_id", "element_id", fate.alias("fate"))


def strip_blind_fusions(pois: DataFrame) -> DataFrame:
    """OSM rows with an id whose anchor (the oldest other row of that id) does not agree by name: their ids go.

    ``pois``: poi_id, name, p_lat, p_lon, source, place_id. Gives poi_id, anchor_id, tier, stripped.
    """
    anchors = pois.where("source = 'google' and place_id is not null").groupBy("place_id").agg(F.min_by(F.struct("poi_id", "name", "p_lat", "p_lon"), "poi_id").alias("a"))
    j = pois.where("source = 'osm' and place_id is not null").join(anchors, "place_id")
    d = distance_m(F.col("p_lat"), F.col("p_lon"), F.col("a.p_lat"), F.col("a.p_lon"))
    tier = same_place_tier(F.col("name"), F.col("a.name"), d, F.lit(False), F.lit(False))
    return j.select("poi_id", F.col("a.poi_id").alias("anchor_id"), tier.alias("tier"), (tier == "none").alias("stripped"))


def identity_heal(osm: DataFrame, anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gives each OSM row its nearest anchor that no earlier row took: (osm_id, anchor_id).

    ``candidates``: osm_id, anchor_id, distance of all pairs that agree.
    """
    pairs = candidates.select(F.col("osm_id").alias("o"), F.col("anchor_id").alias("a"), "distance").checkpoint()
    return heal_alike(pairs.select(F.col("o").alias("osm_id"), "o").distinct(), pairs.select(F.col("a").alias("anchor_id"), "a").distinct(), pairs)


def heal_places(osm: DataFrame, anchors: DataFrame, metres: float = TOKEN_M) -> DataFrame:
    """The same from the rows: osm_id, name, lat, lon and anchor_id, anchor_name, p_lat, p_lon (which have ids) that agree within
    ``metres``. Rows of one name and point agree with the same rows: each such set is compared once, by its smallest id."""
    o = osm.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("name", "lat", "lon").agg(F.min("osm_id").alias("o"))
    a = anchors.where(F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull()).groupBy("anchor_name", "p_lat", "p_lon").agg(F.min("anchor_id").alias("a"))
    traits = traits_of(o.select("name"), a.select("anchor_name"))
    pairs = agreeing(o.join(traits, "name"), a.join(traits.toDF("anchor_name", "anchor_traits"), "anchor_name"), metres).checkpoint()
    return heal_alike(osm.join(o, ["name", "lat", "lon"]).select("osm_id", "o"), anchors.join(a, ["anchor_name", "p_lat", "p_lon"]).select("anchor_id", "a"), pairs)


def agreeing(o: DataFrame, a: DataFrame, metres: float) -> DataFrame:
    """o, a, distance of the rows (o, traits, lat, lon) and anchors (a, anchor_traits, p_lat, p_lon) within ``metres`` that ``tier_of`` finds
    to be one place. Only what can agree meets in a cell: names of one token set, names by a word of the lesser where one
    contains the other, embassies by a country; names that have nothing in common are not compared, however dense places are."""
    t, u = F.col("traits"), F.col("anchor_traits")
    whole = lambda c: F.array_join(F.array_sort(c["tokens"]), " ")
    # a word that stands for a contained name: its longest, which has 4 letters if any has
    word = lambda c: F.array_max(F.transform(c["tokens"], lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    missions = lambda c: F.when(c["embassy"], c["countries"])

    def met(within: float, left: Column, right: Column, more: Column | bool) -> DataFrame:
        near = radius_join(o.withColumn("_k", left).where("_k is not null"), a.withColumn("_k", right).where("_k is not null"), min(metres, within), on=("_k",))
        near = near if more is True else near.where(more)
        return near.where(tier_of(t, u, F.col("distance"), F.lit(False), F.lit(True)) != "none").select("o", "a", "distance")

    fewer, own = F.size(t["tokens"]) < F.size(u["tokens"]), lambda c: F.when(F.length(word(c)) >= 4, word(c))
    found = met(TOKEN_M, whole(t), whole(u), True).unionByName(met(SUBSET_M, own(t), F.explode(u["tokens"]), fewer))
    found = found.unionByName(met(SUBSET_M, F.explode(t["tokens"]), own(u), F.size(t["tokens"]) > F.size(u["tokens"])))
    return found.unionByName(met(EMBASSY_M, F.explode(missions(t)), F.explode(missions(u)), True)).distinct()


def heal_alike(osm: DataFrame, anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nearest free anchor of each row (osm_id, o), where rows of one ``o``, and anchors (anchor_id, a) of one ``a``, are as far
    from all others: (osm_id, anchor_id). ``pairs``: o, a, distance; it is read more than once.

    Sets that reach each other through pairs are one conflict; each is settled in one task, row after row in the order of ids.
    Of a set of anchors the smallest free one goes first, so a row looks at sets, not at their anchors. A conflict is as large
    as the places of agreeing names within reach of each other.
    """
    o_kind, a_kind = osm.schema["osm_id"].dataType.simpleString(), anchors.schema["anchor_id"].dataType.simpleString()
    # both ends as one kind of node; a set's label is the smallest node that it reaches
    node = lambda c, of: F.concat(F.lit(of), F.col(c).cast("string"))
    labels = label_components(pairs.select(node("o", "o").alias("a"), node("a", "a").alias("b")))
    columns = {"label": "string", "osm_id": o_kind, "o": o_kind, "anchor_id": a_kind, "a": a_kind, "distance": "double"}
    every = [
        df.join(labels, node(c, c) == F.col("id")).select(*[(F.col(x) if x in ("label", *df.columns) else F.lit(None)).cast(t).alias(x) for x, t in columns.items()])
        for df, c in ((osm, "o"), (anchors, "a"), (pairs, "o"))
    ]

    def settle(conflict):
        rows, free, reach = [], {}, {}
        for _, i, o, j, a, d in zip(*(conflict[c].to_pylist() for c in columns), strict=True):
            if i is not None:
                rows.append((i, o))
            elif j is not None:
                free.setdefault(a, []).append(j)
            else:
                reach.setdefault(o, {}).setdefault(d, []).append(a)
        for some in free.values():
            some.sort(reverse=True)
        reach = {o: [sets for _, sets in sorted(by.items(), reverse=True)] for o, by in reach.items()}
        won = {}
        for i, o in sorted(rows):
            sets = reach[o]  # the nearest last; what is used up stays so
            while sets and i not in won:
                sets[-1] = [a for a in sets[-1] if free.get(a)]
                if sets[-1]:
                    won[i] = free[min(sets[-1], key=lambda a: free[a][-1])].pop()
                else:
                    sets.pop()
        return pa.table({"osm_id": pa.array(won.keys(), conflict.schema.field("osm_id").type), "anchor_id": pa.array(won.values(), conflict.schema.field("anchor_id").type)})

    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("label").applyInArrow(settle, f"osm_id {o_kind}, anchor_id {a_kind}")
