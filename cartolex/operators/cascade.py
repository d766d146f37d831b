"""Places by a client's words, whole: one table of candidates of all passes, ordered, with alternatives tried in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import forms
from cartolex.functions import lexicon as L
from cartolex.functions.classes import is_property_word, market_form
from cartolex.functions.geo import distance_m
from cartolex.functions.text import canonical_word_key, edit_within_one, identity_key, norm_type, phonetic_keys, spell_latin, to_cyrillic, to_latin, type_rank
from cartolex.operators.lookup import holders, is_shop, opener_off, place_category, shortened, word_hit
from cartolex.operators.spatial import GROWING_M, nearest_named, sphere_join
from cartolex.tables import cut

# Kinds of rows that step aside for the place that they belong to, or are never one.
SERVICE_POINTS = ["atm", "bank", "bureau_de_change", "money_transfer", "currency_exchange"]
RESIDENTIAL = ["residential", "housing complex", "apartment", "apartment complex", "condominium complex", "dormitory"]
SETTLEMENTS = ["suburb", "neighbourhood", "neighborhood", "quarter", "hamlet", "village", "locality"]
LISTINGS = ["holiday apartment", "apartment hotel", "apartment hotel listing", "lodging", "guest house"]
PART_WORDS = ["food", "court", "apteka", "аптека", "parking", "паркинг", "booth", "store", "shop", "outlet", "office", "канцеларија", "entrance", "влез", "kasa", "каса", "restoran", "ресторан", "kafic", "кафич"]
# Words that ask for a stop, for a tenant, for a mall; kinds of rows that are only buildings.
ASKS_STOP = r"(?iu)автобус|трамвај|bus(?![A-Za-z0-9_])|tram(?![A-Za-z0-9_])|станица|stanica|stop(?![A-Za-z0-9_])"
ASKS_TENANT = r"(?iu)маркет|market|супермаркет|supermarket|продавниц|prodavnic|аптек|aptek|pharmac|бутик|butik|boutique|кафе|kafe|cafe|пекар|pekar|bakery"
MALL_WORDS = ["tc", "тц", "mol", "мол", "mall"]
BUILDINGS = r"residential|apartment|^yes$|^place$|building|^house$|construction|garage"
#: Metres within which a place makes a stop step aside, where the client has a centre.
LOCAL_M = 1000.0
#: Letters from which a needle is long enough for guesses.
GUESSED_FROM = 5
#: Columns of a candidate: ``ask`` is what it was found for, ``k`` what comes before distance in the pass's order.
FOUND = ["ask", "pass", "k", "name", "type"]
PASSES = ("words", "short", "tokens", "phonetic", "typo", "variant", "shop")


def bare(word: Column) -> Column:
    return F.regexp_replace(to_latin(word), "[^a-z0-9]", "")


def sounds(c: Column) -> Column:
    """What each word of a text sounds like; numbers, and words without a sound of their own, stand as they are."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"^\d+$"), w).otherwise(F.coalesce(F.get(phonetic_keys(w), F.lit(0)), F.lower(w))))


def place_features(rows: DataFrame) -> DataFrame:
    """What the passes need of each distinct (name, type), computed once."""
    name, kind = F.col("name"), norm_type(F.col("type"))
    low = F.lower(name)
    typed = F.filter(F.split(name, r"[^0-9\p{L}]+"), lambda w: F.length(w) >= 3)
    phon = phonetic_keys(name)
    return rows.select("name", "type").distinct().select(
        "name", "type", low.alias("low"), spell_latin(low).alias("spelled"), forms.lookup_tokens(name).alias("tokens"), phon.alias("phon"), F.transform(phon, canonical_word_key).alias("canon"),
        typed.alias("typed"), F.transform(typed, canonical_word_key).alias("typed_keys"), F.transform(typed, bare).alias("typed_bare"), sounds(name).alias("sounds"), identity_key(name).alias("ident"), place_category(name).alias("cat"), type_rank(F.col("type")).alias("rank"),
        F.coalesce(is_shop(name, F.col("type")), F.lit(False)).alias("shop"), kind.isin(*L.TRANSIT_TYPES).alias("stop"), kind.isin(*SERVICE_POINTS).alias("service"),
        kind.isin(*RESIDENTIAL).alias("home"), kind.isin(*SETTLEMENTS).alias("area"), kind.rlike(BUILDINGS).alias("building"),
    )


def ask_features(asks: DataFrame) -> DataFrame:
    """The same of each ask (ask, text, c_lat, c_lon): its words after the rewrites; asks that name no place are gone."""
    opened = F.trim(F.regexp_replace("text", r"(?iu)^(?:кај штипски|кај скопски|кај|спроти|как)\s+", ""))
    t = asks.withColumn("clean", opened).where(F.length("clean") >= 2)
    none = forms.only_service(F.col("clean")) | is_property_word(F.col("clean")) | (F.col("c_lat").isNull() & forms.too_generic(F.col("clean"), place_category(F.col("clean"))))
    t = t.where(~none).withColumn("clean", F.coalesce(forms.embassy_name(F.col("clean")), forms.official_name(F.col("clean")), F.col("clean")))
    n = F.lower("clean")
    t = t.withColumn("n", n).withColumn("n_cyr", F.when(n.rlike("[Ѐ-ӿ]"), n).otherwise(to_cyrillic(n))).withColumn("n_lat", spell_latin(F.col("n_cyr")))
    typed = F.filter(F.split("clean", r"[^0-9\p{L}]+"), lambda w: F.length(w) >= 3)
    phon = phonetic_keys(F.col("clean"))
    own = lambda words: F.exists(words, lambda w: ~w.isin(*L.WORDS, *L.STOP_WORDS))
    return t.select(
        "ask", "text", "c_lat", "c_lon", "clean", "n", "n_cyr", "n_lat", spell_latin(n).alias("n_sp"), F.split("clean", r"\s+").alias("words"), place_category(F.col("clean")).alias("a_cat"),
        F.when(forms.names_something(F.col("clean")), forms.lookup_tokens(F.col("clean"))).alias("a_tokens"), F.when(own(phon), phon).alias("a_phon"),
        F.transform(phon, canonical_word_key).alias("a_canon"), typed.alias("a_typed"), F.transform(typed, canonical_word_key).alias("a_typed_keys"), F.transform(typed, bare).alias("a_typed_bare"),
        sounds(F.col("clean")).alias("a_sounds"), forms.lookup_tokens(F.col("clean")).alias("a_all"),
    ).withColumn("a_canon", F.when(own(F.col("a_canon")), F.col("a_canon")))


def by_rarest(asks: DataFrame, keys: Column, index: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pairs (ask, name) that share the rarest of the ask's keys: asks with a key that no name has come with none.

    ``index``: key, name and columns ``extra``, which asks have too. Whatever key many names have, an ask meets the names by
    another one if it has any.
    """
    on = [*(extra or []), "key"]
    freq = index.groupBy(*on).agg(F.count("*").alias("_n"))
    each = asks.select("ask", *(extra or []), F.size(keys).alias("_size"), F.explode(F.array_distinct(keys)).alias("key"))
    each = each.join(freq, on).groupBy("ask", *(extra or []), "_size").agg(F.count("*").alias("_found"), F.min_by("key", F.struct("_n", "key")).alias("key"))
    return each.where("_found = _size").join(index, on).select("ask", *(extra or []), "name").distinct()


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def aligned_hits(a: DataFrame, f: DataFrame) -> DataFrame:
    """Pairs (ask, name) where a spelling of the needle begins at a word of the name; it ends at one too, or has 4 letters.

    A needle of several words has all but its last whole in the name and meets it by the rarest of these; one of a single word
    meets the names' words by what they begin with."""
    form = lambda which, t: F.struct(F.lit(which).alias("which"), F.col(t).alias("t"))
    asked = a.select("ask", F.explode(F.array(form("low", "n"), form("low", "n_cyr"), form("lat", "n"), form("lat", "n_lat"))).alias("x")).select("ask", "x.*").distinct().where(F.length("t") >= 3)
    asked = asked.withColumn("w", words_of(F.col("t")))
    hay = f.select("name", "low", "spelled").distinct()
    hay = hay.select("name", F.explode(F.array(F.struct(F.lit("low").alias("which"), F.col("low").alias("hay")), F.struct(F.lit("lat").alias("which"), F.col("spelled").alias("hay")))).alias("x")).select("name", "x.*")
    word = hay.select("name", "which", F.explode(F.array_distinct(words_of(F.col("hay")))).alias("key"))
    begun = word.select("name", "which", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key")).distinct()
    many = by_rarest(asked.where(F.size("w") > 1).select(F.struct("ask", "t").alias("ask"), "which", "w"), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))), word, ["which"]).select("ask.ask", "ask.t", "which", "name")
    one = asked.where(F.size("w") == 1).select("ask", "t", "which", F.get("w", F.lit(0)).alias("key")).join(begun, ["which", "key"]).select("ask", "t", "which", "name")
    pairs = many.unionByName(one).join(hay, ["name", "which"]).where(word_hit(F.col("hay"), F.col("t")))
    return pairs.select("ask", "name").distinct()


def same_class(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a_cat").isNull() | F.col("cat").isNull() | (F.col("a_cat") == F.col("cat")))


def told(asks: DataFrame) -> DataFrame:
    """The asks (ask, text, c_lat, c_lon) with ``say``: the text and whether it has a centre, all that the names it means hang on but
    for stops and slips. Passes run over distinct says, which need no more columns than asks."""
    return cut(asks.select("ask", "text", "c_lat", "c_lon", F.to_json(F.struct("text", F.col("c_lat").isNull().alias("free"))).alias("say")), "told")


def says_of(asked: DataFrame) -> DataFrame:
    """Each say once, in the form of an ask."""
    some = lambda c: F.when(F.col("c_lat").isNotNull(), 0.0).alias(c)
    return asked.select(F.col("say").alias("ask"), "text", some("c_lat"), some("c_lon")).distinct()


def points_named(top: DataFrame, points: DataFrame) -> DataFrame:
    """Points of the names that each say means (ask, name, type): say and the columns of ``points``. Files of few different texts are
    far smaller than their rows, so that their size must not decide what is broadcast."""
    there = points.withColumnsRenamed({"name": "_name", "type": "_type"})
    meant = top.select(F.col("ask").alias("say"), "name", "type").distinct()
    return meant.hint("merge").join(there, (F.col("name") == F.col("_name")) & F.col("type").eqNullSafe(F.col("_type"))).drop("_name", "_type")


def nearest_rows(top: DataFrame, asked: DataFrame, points: DataFrame) -> DataFrame:
    """Of the rows that an ask's say means the nearest, or the one of the shortest name without a centre; then length, name, type, id.

    ``top``: ask (a say), name, type. ``asked``: ask, say, c_lat, c_lon. ``points``: name, type, p_lat, p_lon, poi_id, n. Of a say's rows
    at one point only the first can count; the points are searched in growing rings around the centres."""
    row = F.struct(F.length("name").alias("l"), "name", F.coalesce("type", F.lit("")).alias("t"), "poi_id", "type", "p_lat", "p_lon")
    there = cut(points_named(top, points).groupBy("say", "p_lat", "p_lon").agg(F.min(row).alias("r")), "there")
    best = nearest_named(asked.select("ask", "say", "c_lat", "c_lon"), there.hint("merge"), "say", "c_lat", "c_lon", "r")
    d = F.when(F.col("c_lat").isNull(), F.col("b.r.l").cast("double")).otherwise(F.col("b.distance"))
    return best.select("ask", "say", d.alias("d"), *[f"b.r.{c}" for c in ("name", "type", "poi_id", "p_lat", "p_lon")])


def pruned(hits: DataFrame, asked: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hits that are left where each kind of row steps aside if another is there: shops for places, stops for places (with a
    centre only for one within LOCAL_M), service points, homes. ``dropped``: shops of says that have nothing else.

    The kinds that a say's hits have are at most eight; they say what stays, for all of its hits. Where it hangs on a place
    within LOCAL_M, the asks with one go on with a say of their own: their table comes second."""
    kinds = F.struct("stop", "service", "home")
    places = hits.where("not shop")
    seen = places.groupBy("ask").agg(F.collect_set(kinds).alias("all"), F.first(F.col("c_lat").isNull()).alias("free"), F.first(F.col("clean").rlike(ASKS_STOP)).alias("asks_stop"))
    split = ~F.col("free") & ~F.col("asks_stop") & F.exists("all", lambda k: k["stop"]) & F.exists("all", lambda k: ~k["stop"])
    seen = cut(seen.withColumn("split", split), "kinds")
    torn = seen.where("split").select("ask")
    there = cut(points_named(places.where("not stop").join(torn, "ask", "left_semi"), points).select("say", "p_lat", "p_lon").distinct(), "local").hint("merge")
    todo, near = asked.join(torn.withColumnRenamed("ask", "say"), "say", "left_semi").select("ask", "say", "c_lat", "c_lon"), None
    for metres in (*[m for m in GROWING_M if m < LOCAL_M], LOCAL_M):
        got = cut(sphere_join(todo, there, metres, ["say"], "c_lat", "c_lon").select("ask").distinct(), "near")
        near, todo = got if near is None else near.unionByName(got), todo.join(got, "ask", "left_anti")
    own = F.concat(F.lit("near "), F.col("say"))
    asked = cut(asked.join(near.withColumn("_near", F.lit(True)), "ask", "left").withColumn("say", F.when(F.col("_near"), own).otherwise(F.col("say"))).drop("_near"), "told")

    less = lambda c, keep: F.when(F.exists(c, keep), F.filter(c, keep)).otherwise(c)
    each = seen.withColumn("near", F.explode(F.when(F.col("split"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    left = F.when(~F.col("asks_stop") & (F.col("free") | F.col("near")), less(F.col("all"), lambda k: ~k["stop"])).otherwise(F.col("all"))
    left = less(less(left, lambda k: ~k["service"]), lambda k: ~k["home"])
    kept = hits.join(each.select("ask", "near", left.alias("_left")), "ask", "left").withColumn("ask", F.when(F.col("near"), F.concat(F.lit("near "), "ask")).otherwise(F.col("ask")))
    kept = kept.where(F.col("_left").isNull() | (~F.col("shop") & F.array_contains("_left", kinds))).withColumn("dropped", F.col("_left").isNull())
    return cut(kept.drop("_left", "near"), "left"), asked


def whole_name(said: Column, name: Column) -> Column:
    """0 where a name is the needle's words and no more, word for word by sound."""
    return F.when((F.size(said) > 0) & (said == name), 0).otherwise(1)


def ranked(rows: DataFrame) -> DataFrame:
    """Order of the hits: parts of a venue last, then equal, named in brackets, beginning and holding names, whole names, areas, and
    without a centre the rank of what the name begins with. Where malls hold the needle, lesser rows that hold it go."""
    n, cyr, sp = F.col("n"), F.col("n_cyr"), F.col("n_sp")
    bracket = lambda t: F.regexp_like(F.col("name"), F.concat(F.lit(r"(?iu)[（(]\s*\Q"), t, F.lit(r"\E\s*[)）]")))
    equal = (F.col("low") == n) | (F.col("low") == cyr) | (F.col("spelled") == sp)
    begins = F.col("low").startswith(n) | F.col("low").startswith(cyr) | F.col("spelled").startswith(sp)
    rows = rows.withColumn("mr", F.when(equal, 0).when(bracket(n) | bracket(cyr), 1).when(begins, 2).otherwise(3))
    part = F.exists("tokens", lambda w: w.isin(*PART_WORDS) & ~F.array_contains("a_all", w))
    mall = F.col("rank") >= L.TYPE_RANKS["mall"]
    rows = rows.withColumn("_mall", F.max((F.col("mr") == 3) & mall).over(Window.partitionBy("ask", "pass"))).where(F.col("clean").rlike(ASKS_TENANT) | ~F.col("_mall") | (F.col("mr") != 3) | mall)
    wn = whole_name(F.col("a_sounds"), F.col("sounds"))
    key = [part.cast("int"), F.col("mr"), wn, F.when((wn == 0) & F.col("area"), 0).otherwise(1), F.when(F.col("c_lat").isNull() & (F.col("mr") == 2), -F.col("rank")).otherwise(0)]
    return rows.withColumn("k", F.array(*[c.cast("int") for c in key]))


def near_words(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Two words up to a slip apart, both of 5 letters or more with the same first letter; x and y: their bare Latin letters."""
    slip = (F.length(x) >= 5) & (F.length(y) >= 5) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & edit_within_one(x, y)
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (x != "") & (y != "") & ((x == y) | slip)


def assigned() -> Column:
    """Whether each word in turn takes a word of the name that no earlier one has: the first of the same key, else the first
    up to a slip away."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(True).alias("ok"))
    places = F.sequence(F.lit(0), F.greatest(F.size("typed") - 1, F.lit(0)))

    def step(state: Column, i: Column) -> Column:
        free = lambda p: (p < F.size("typed")) & ~F.array_contains(state["used"], p)
        same = F.get(F.filter(places, lambda p: free(p) & (F.get("typed_keys", p) == F.get("a_typed_keys", i))), F.lit(0))
        slip = F.get(F.filter(places, lambda p: free(p) & near_words(F.get("a_typed", i), F.get("typed", p), F.get("a_typed_bare", i), F.get("typed_bare", p))), F.lit(0))
        at = F.when(state["ok"], F.coalesce(same, slip))
        return F.struct(F.concat(state["used"], F.array_compact(F.array(at))).alias("used"), at.isNotNull().alias("ok"))

    return F.aggregate(F.sequence(F.lit(0), F.size("a_typed") - 1), start, step, lambda s: s["ok"])


def typo_candidates(a: DataFrame, f: DataFrame) -> DataFrame:
    """Candidates of the pass that forgives a slip in each word: ask, name, type and the number of the name's words.

    The longest word of the needle meets the names' words on its key, or on what is left of it without a letter."""
    marks = lambda key, word: F.concat(F.array(F.concat(F.lit("k:"), key)), F.transform(shortened(word), lambda s: F.concat(F.lit("w:"), s)))
    longest = F.array_max(F.transform("a_typed", lambda x, i: F.struct(F.length(x).alias("l"), i.alias("i"))))["i"]
    asked = a.where(F.size("a_typed") > 0).withColumn("g", F.explode(marks(F.get("a_typed_keys", longest), F.get("a_typed_bare", longest))))
    index = f.where(F.size("typed") > 0).select("name", F.explode(F.arrays_zip("typed_keys", "typed_bare")).alias("x")).distinct()
    index = index.select("name", F.explode(marks(F.col("x.typed_keys"), F.col("x.typed_bare"))).alias("g")).distinct()
    pairs = asked.join(index, "g").select("ask", "name").distinct().join(a, "ask").join(f.where("not shop"), "name")
    return same_class(pairs).where(assigned()).withColumn("k", F.array(F.size("typed")))


def ranked_lookup(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """The place whose name holds a needle at a word, after each kind has stepped aside, by the seven keys of its order:
    needle_id, name, type, poi_id. Needles that only shops hold find none here."""
    asked, f, points = told(asks_of(needles)), cut(place_features(rows), "features"), points_of(rows)
    a = cut(ask_features(says_of(asked)), "asks")
    hits = cut(same_class(aligned_hits(a, f).join(a, "ask").join(f, "name")), "hits")
    left, asked = pruned(hits, asked, points)
    best = nearest_rows(foremost(ranked(left.where("not dropped").withColumn("pass", F.lit(1))).select(*FOUND)), asked, points)
    return answered(needles, best.select("ask", "name", "type", "poi_id")).select("needle_id", "name", "type", "poi_id")


def candidates(a: DataFrame, f: DataFrame, asked: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of all passes in one table: ask (a say), pass (its number), k (what comes before distance in its order), name,
    type; and the asks with their says."""
    some = FOUND
    full = lambda pairs: same_class(pairs.join(a, "ask").join(f, "name"))
    left, asked = pruned(cut(full(aligned_hits(a, f)), "hits"), asked, points)
    words = ranked(left.where("not dropped").withColumn("pass", F.lit(1))).select(*some)
    shops = left.where("dropped").withColumn("pass", F.lit(7)).withColumn("k", F.array(F.length("name"))).select(*some)
    # later passes are for asks that the first has nothing for
    a = a.join(left.where("not dropped").select("ask").distinct(), "ask", "left_anti")

    # first and last two words of longer needles, as they stand and in the other script, in this order
    two = lambda x: F.lower(F.array_join(x, " "))
    pair = F.filter(F.array(two(F.slice("words", 1, 2)), two(F.slice("words", -2, 2))), lambda s: F.length(s) >= 3)
    spelled = F.concat(pair, F.transform(pair, lambda s: F.when(s.rlike("[\u0400-\u04ff]"), s).otherwise(to_cyrillic(s))))
    short = a.where(F.size("words") > 2).select("ask", F.posexplode(spelled).alias("turn", "t"))
    names = f.select("name", F.explode(F.array_distinct(F.array("low", "spelled"))).alias("hay"), F.lit("s").alias("which")).distinct()
    held = holders(short.select(F.struct("ask", "turn").alias("needle_id"), F.lit("s").alias("which"), "t"), names).select("needle_id.ask", "needle_id.turn", "name")
    held = full(held)
    turn = held.groupBy("ask").agg(F.min("turn").alias("turn"))
    found = words.unionByName(shops).unionByName(ranked(held.join(turn, ["ask", "turn"]).withColumn("pass", F.lit(2))).select(*some))

    def contained(number: int, want: str, have: str, k: list[Column], when: Column) -> DataFrame:
        places = f.where("not shop")
        pairs = by_rarest(a.where(when & (F.size(want) > 0)), F.col(want), places.select("name", F.explode(have).alias("key")).distinct())
        rows = same_class(pairs.join(a, "ask").join(places, "name")).where(F.size(F.array_except(want, have)) == 0)
        return rows.withColumn("pass", F.lit(number)).withColumn("k", F.array(*[c.cast("int") for c in k])).select(*some)

    long = F.length("clean") >= GUESSED_FROM
    extra = lambda have, want: F.size(have) - F.size(F.array_distinct(want))
    found = found.unionByName(contained(3, "a_tokens", "tokens", [extra("tokens", "a_tokens"), -F.col("rank")], F.forall("a_tokens", lambda w: F.length(w) >= 3)))
    tower = F.when(F.arrays_overlap(words_of(F.lower("clean")), F.array(*map(F.lit, MALL_WORDS))) & F.col("building"), 1).otherwise(0)
    phonetic = [tower, extra("phon", "a_phon"), whole_name(F.col("a_sounds"), F.col("sounds")), F.when(F.col("area"), 0).otherwise(1)]
    found = found.unionByName(contained(4, "a_phon", "phon", phonetic, long))
    found = found.unionByName(typo_candidates(a.where(long), f).withColumn("pass", F.lit(5)).select(*some))
    return cut(found.unionByName(contained(6, "a_canon", "canon", [extra("phon", "a_canon")], long)), "candidates"), asked


def foremost(found: DataFrame) -> DataFrame:
    """Of each ask the candidates of its first pass that come first there, whatever their distance."""
    top = found.groupBy("ask").agg(F.min(F.struct("pass", "k")).alias("_top"))
    return found.join(top, "ask").where((F.col("pass") == F.col("_top.pass")) & (F.col("k") == F.col("_top.k"))).drop("_top")


def points_of(rows: DataFrame) -> DataFrame:
    """Distinct points of each name and type: their first row and how many they have."""
    return cut(rows.groupBy("name", "type", "p_lat", "p_lon").agg(F.min("poi_id").alias("poi_id"), F.count("*").alias("n")), "points")


def asks_of(needles: DataFrame) -> DataFrame:
    """Distinct texts and centres: ask, text, c_lat, c_lon."""
    return needles.select("text", "c_lat", "c_lon").distinct().withColumn("ask", F.to_json(F.struct("text", "c_lat", "c_lon")))


def answered(needles: DataFrame, best: DataFrame) -> DataFrame:
    return needles.withColumn("ask", F.to_json(F.struct("text", "c_lat", "c_lon"))).join(best, "ask")


def undecided(found: DataFrame, asked: DataFrame, points: DataFrame) -> DataFrame:
    """Asks whose two first rows in the pass that forgives slips have as many words and are different places: ask. Only says whose
    first candidates are different places can have such asks."""
    top = cut(foremost(found).select("ask", "name", "type").distinct().withColumn("ident", identity_key(F.col("name"))), "alike")
    torn = cut(top.groupBy("ask").agg(F.count_distinct("ident").alias("_n")).where("_n > 1").select(F.col("ask").alias("say")), "torn")
    idents = top.select(F.col("ask").alias("say"), "name", "ident").distinct()
    meant = points_named(top.join(torn.withColumnRenamed("say", "ask"), "ask", "left_semi"), points).join(idents, ["say", "name"])
    # a point's further rows stand right behind its first; the first two of a point are all that can count there
    row = F.struct(F.length("name").alias("l"), "name", F.coalesce("type", F.lit("")).alias("t"), "poi_id", "copy")
    meant = meant.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(2))))).withColumn("r", row)
    two = lambda df, *by: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]))).where("_rn <= 2")
    there = cut(two(meant, "say", "p_lat", "p_lon", ["r"]).select("say", "p_lat", "p_lon", "r", "ident"), "there").hint("merge")
    todo, out = asked.join(torn, "say", "left_semi").select("ask", "say", "c_lat", "c_lon"), None
    for metres in (*GROWING_M, None):
        if metres:
            pairs = sphere_join(todo, there, metres, ["say"], "c_lat", "c_lon")
        else:
            pairs = todo.join(there, "say").withColumn("distance", F.coalesce(distance_m(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon")), F.lit(0.0)))
        got = two(pairs, "ask", ["distance", "r"]).groupBy("ask").agg(F.count("*").alias("n"), F.count_distinct("ident").alias("idents"))
        got = cut(got.where("n = 2") if metres else got, "two")
        out, todo = got if out is None else out.unionByName(got), todo.join(got, "ask", "left_anti")
    return out.where("idents > 1").select("ask")


def lookup_rows(asks: DataFrame, rows: DataFrame, f: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """The one row for each ask (ask, text, c_lat, c_lon) that its words mean: ask, pass, name, type, poi_id, p_lat, p_lon, d.

    ``rows``: poi_id, name, type, p_lat, p_lon; ``f``, ``points``: their features and points, where there are some. Asks without one
    are missing. Passes, each for asks that none before has: names that hold the needle at a word, that hold two of its words, that
    have all of its words in both languages' form, by sound, up to a slip each, by consonants; last the shops that stepped aside.
    Two different places as near by slips are none.
    """
    f, points = cut(place_features(rows), "features") if f is None else f, points_of(rows) if points is None else points
    asked = told(asks)
    found, asked = candidates(cut(ask_features(says_of(asked)), "asks"), f, asked, points)
    sure = found.groupBy("ask").agg(F.min("pass").alias("_first"))
    slips = cut(found.join(sure.where("_first = 5"), "ask").drop("_first"), "slips")
    # asks that slips leave undecided go on with a say of their own, which has the later passes alone
    own = lambda c: F.concat(F.lit("unsure "), F.col(c))
    unsure = undecided(slips.where(F.col("pass") == 5), asked, points).withColumn("_unsure", F.lit(True))
    asked = cut(asked.join(unsure, "ask", "left").withColumn("say", F.when(F.col("_unsure"), own("say")).otherwise(F.col("say"))).drop("_unsure"), "told")
    top = cut(foremost(found.unionByName(slips.where(F.col("pass") != 5).withColumn("ask", own("ask")))), "foremost")
    best = nearest_rows(top, asked, points)
    return best.join(top.select(F.col("ask").alias("say"), "pass").distinct(), "say").select("ask", "pass", "name", "type", "poi_id", "p_lat", "p_lon", "d")


def areas_named(asks: DataFrame, f: DataFrame, points: DataFrame) -> DataFrame:
    """The settlement or city whose name has every word of an ask, where the words say nothing else: columns of ``lookup_rows``.
    ``f``, ``points``: features and points of the rows."""
    asked = told(asks)
    f = f.where(F.col("area") | (norm_type(F.col("type")) == "city"))
    a = cut(says_of(asked).withColumn("want", phonetic_keys(F.col("text"))).where((F.size("want") > 0) & (F.size("want") == F.size(forms.lookup_tokens(F.col("text"))))), "wanted")
    pairs = by_rarest(a, F.col("want"), f.select("name", F.explode("phon").alias("key")).distinct())
    j = pairs.join(a, "ask").join(f, "name").where(F.size(F.array_except("want", "phon")) == 0)
    j = j.withColumn("pass", F.lit(0)).withColumn("k", F.array(F.size("phon") - F.size("want"), whole_name(sounds(F.col("text")), F.col("sounds"))))
    return nearest_rows(foremost(j.select(*FOUND)), asked, points).select("ask", F.lit(0).alias("pass"), "name", "type", "poi_id", "p_lat", "p_lon", "d")


def resolve_places(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """What each needle names: needle_id, turn, pass, name, type, poi_id, distance_m (null without a centre).

    ``needles``: needle_id, text, c_lat, c_lon (null: none). ``rows``: poi_id, name, type, p_lat, p_lon. A needle of words that
    only ask names nothing. An area that is named by all words comes before all else (turn 0); then the words themselves (1); a
    shopping centre's other name where they found nothing or a stop (2), and the stop after that (3); a filed place's second
    name (4), and other forms of a school's (from 5). Listings of flats are never found, and no stop by another name. Equal
    needles at one centre are looked up once, and so are alternatives that they share.
    """
    asks = cut(asks_of(needles), "asks")
    texts = cut(asks.select("text").distinct().where(~forms.only_grammar(F.col("text"))), "texts")
    asks = asks.join(texts, "text", "left_semi")
    f, points = cut(place_features(rows), "features"), points_of(rows)
    opened = opener_off(F.col("text"))
    second = F.coalesce(*[F.when(forms.official_name(opened) == k, F.array(*map(F.lit, v))) for k, v in forms.SECOND_NAMES.items()], F.array().cast("array<string>"))
    one = lambda turn, t: F.struct(F.lit(turn).alias("turn"), t.alias("alt"))
    other = F.when(~F.col("text").rlike(ASKS_STOP), market_form(F.col("text")))
    tries = F.concat(F.array(one(1, F.col("text")), one(2, other)), F.transform(second, lambda t: one(4, t)), F.transform(forms.school_forms(F.col("text")), lambda t, i: F.struct((i + 5).alias("turn"), t.alias("alt"))))
    tries = cut(texts.select("text", F.explode(tries).alias("x")).select("text", "x.*").where("alt is not null"), "alternatives")
    tries = asks.join(tries, "text").select("ask", "c_lat", "c_lon", "turn", "alt")
    tries = cut(tries.withColumn("alone", F.to_json(F.struct("alt", "c_lat", "c_lon"))), "tries")
    said = tries.select(F.col("alone").alias("ask"), F.col("alt").alias("text"), "c_lat", "c_lon").distinct()
    hits = tries.select("ask", "turn", "alone").join(lookup_rows(said, rows, f, points).withColumnRenamed("ask", "alone"), "alone").drop("alone")
    kind = norm_type(F.col("type"))
    stop = kind.isin(*L.TRANSIT_TYPES)
    asked_stop = F.get_json_object("ask", "$.text").rlike(ASKS_STOP)
    # what the words found is a stop: the other name of a shopping centre goes first
    hits = hits.where(~kind.isin(*LISTINGS) & (~F.col("turn").isin(2, 4) | ~stop)).withColumn("turn", F.when((F.col("turn") == 1) & stop & ~asked_stop, 3).otherwise(F.col("turn")))
    hits = hits.unionByName(areas_named(asks, f, points).withColumn("turn", F.lit(0)))
    best = hits.groupBy("ask").agg(F.min(F.struct("turn", "pass", "name", "type", "poi_id", "d")).alias("b"))
    far = F.when(F.col("c_lat").isNotNull(), F.floor(F.col("b.d") + 0.5).cast("long"))
    return answered(needles, best).select("needle_id", "b.turn", "b.pass", "b.name", "b.type", "b.poi_id", far.alias("distance_m"))


def typo_lookup(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """The place that each needle means if every word may have a slip: needle_id, name, poi_id. Names with the fewest words first,
    then the nearest, or the shortest without a centre; two different places that stand first alike are a miss."""
    opened = opener_off(F.col("text"))
    asked, points = told(asks_of(needles)), points_of(rows)
    a = says_of(asked).where(~forms.too_generic(opened, place_category(opened))).withColumn("clean", F.trim("text"))
    typed = F.filter(F.split("clean", r"[^0-9\p{L}]+"), lambda w: F.length(w) >= 3)
    a = a.select("ask", "c_lat", "c_lon", place_category(F.col("clean")).alias("a_cat"), typed.alias("a_typed"), F.transform(typed, canonical_word_key).alias("a_typed_keys"), F.transform(typed, bare).alias("a_typed_bare"))
    found = cut(typo_candidates(cut(a, "asks"), cut(place_features(rows), "features")).withColumn("pass", F.lit(5)).select(*FOUND), "slips")
    asked = asked.join(undecided(found, asked, points), "ask", "left_anti")
    best = nearest_rows(foremost(found), asked, points)
    return answered(needles, best.select("ask", "name", "poi_id")).select("needle_id", "name", "poi_id")


def token_set_lookup(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """The place that has all of a needle's words, in whatever order and language: needle_id, name, poi_id.

    Names with the fewest further words first, then by the rank of their type, then the nearest, or the shortest."""
    asked = told(asks_of(needles))
    f = cut(place_features(rows).where("not shop"), "features")
    a = cut(ask_features(says_of(asked)), "asks").where(F.forall("a_tokens", lambda w: F.length(w) >= 3) & (F.size("a_tokens") > 0))
    pairs = by_rarest(a, F.col("a_tokens"), f.select("name", F.explode("tokens").alias("key")).distinct())
    j = same_class(pairs.join(a, "ask").join(f, "name")).where(F.size(F.array_except("a_tokens", "tokens")) == 0)
    j = j.withColumn("pass", F.lit(3)).withColumn("k", F.array(F.size("tokens") - F.size("a_tokens"), -F.col("rank")))
    best = nearest_rows(foremost(j.select(*FOUND)), asked, points_of(rows))
    return answered(needles, best.select("ask", "name", "poi_id")).select("needle_id", "name", "poi_id")
