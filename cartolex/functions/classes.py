"""Classes of scraped types and names, guards of what may be shown, and other spellings of a place word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.text import norm_type, type_rank


def map_type(raw: Column) -> Column:
    """The class of a scraped type: its own entry, else the first entry that it holds, else other; null counts as empty."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    exact = F.create_map(*[F.lit(x) for kv in L.SCRAPED_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(exact, low), *[F.when(low.contains(k), F.lit(v)) for k, v in L.SCRAPED_TYPES.items()], F.lit("other"))


def scrape_category(kind: Column) -> Column:
    """The search that a stored type belongs to; null and empty types belong to none."""
    t = F.replace(F.lower(F.trim(kind)), F.lit("_"), F.lit(" "))
    table = F.create_map(*[F.lit(x) for kv in L.SCRAPE_CATEGORIES.items() for x in kv])
    return F.when(kind != "", F.coalesce(F.try_element_at(table, t), t))


def name_class(name: Column) -> Column:
    """One of five classes by what a name holds, the first that fits; else other."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(f"(?u){p}"), F.lit(c)) for c, p in L.NAME_CLASSES.items()], F.lit("other"))


def is_street_name(c: Column) -> Column:
    return c.rlike(f"(?iu)(?<![А-Яа-яA-Za-z])(?:{L.STREET_WORDS})(?![А-Яа-яA-Za-z])")


def is_time(c: Column) -> Column:
    """Time said as a place; borders of words are those of ASCII letters and digits."""
    latin, cyrillic = "|".join(L.MONTHS), "|".join(L.TIME_WORDS)
    return c.rlike(rf"(?iu)пред\s+\d|(?<=[A-Za-z0-9_])(?:{cyrillic})|(?<![A-Za-z0-9_])(?:{latin})")


def is_property_word(c: Column) -> Column:
    """Names a kind of flat, not a place."""
    return c.rlike(rf"(?iu)(?<!\p{{L}})(?:{'|'.join(L.PROPERTY_WORDS)})(?!\p{{L}})")


def may_be_shown(name: Column) -> Column:
    """A landmark that is neither a street nor a time."""
    return name.isNotNull() & ~is_street_name(name) & ~is_time(name)


def cache_key(location: Column, address: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat(F.coalesce(location, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))), r"\s+", " ")


def search_link(query: Column) -> Column:
    """A map search for a text, percent-encoded as browsers do."""
    kept = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), kept.items(), F.url_encode(query)))


def can_serve(tier: Column, geo_source: Column) -> Column:
    """Whether a cached landmark may be shown: not of low confidence, and one of the map only around a trusted centre."""
    from cartolex.operators.landmarks import center_trusted

    trusted = F.coalesce(center_trusted(geo_source), F.lit(False))
    return F.coalesce(F.when(tier.isin("", "osm_low_confidence"), False).when(tier == "osm_poi", trusted).otherwise(tier.isNotNull()), F.lit(False))


def first_landmark_problem(name: Column, kind: Column, distance: Column, most_m: float = 200.0) -> Column:
    """Why the first of a list may not be claimed: unmeasured, far, shop or unranked; null where it may."""
    from cartolex.operators.lookup import is_shop

    measured = distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) < float("inf"))
    shop, rank = F.coalesce(is_shop(name, kind), F.lit(False)), type_rank(F.coalesce(kind, F.lit("")))
    return F.when(~measured, "unmeasured").when(distance > most_m, "far").when(shop, "shop").when(rank == 0, "unranked")


def word_forms(word: Column) -> Column:
    """The forms of a place word worth a lookup, most faithful first: itself, its ch readings, then each without its article.

    Words of fewer than 3 letters have none; a stem keeps 4 letters or more, and of the endings that a form has the first in
    the list comes off."""
    base = F.trim(F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}\s]", ""))
    forms = F.array_distinct(F.array(base, F.regexp_replace(base, "c(?=[ei])", "ch"), F.regexp_replace(base, "ц(?=[еи])", "ч")))
    stems = F.transform(forms, lambda w: F.coalesce(*[F.when(w.endswith(s) & (F.length(w) - len(s) >= 4), F.left(w, F.length(w) - len(s))) for s in L.DEFINITE_ENDINGS]))
    return F.when(F.length(base) >= 3, F.array_distinct(F.concat(forms, F.filter(stems, lambda s: s.isNotNull())))).otherwise(F.array().cast("array<string>"))


def market_form(name: Column) -> Column:
    """The other way to write a shopping centre's name; null where it is written in neither."""
    n = F.trim(name)
    short, long = F.regexp_extract(n, r"(?iu)^(?:т\.?\s?ц\.?|tc)\s+(.+)$", 1), F.regexp_extract(n, r"(?iu)^(?:трговски(?:от)?\s+центар(?:от)?|trgovski(?:ot)?\s+centar)\s+(.+)$", 1)
    return F.when(short != "", F.concat(F.lit("Трговски центар "), short)).when(long != "", F.concat(F.lit("ТЦ "), long))


def without_article(word: Column) -> Column:
    """A word without its definite article, where 4 letters or more are left."""
    low = F.lower(word)
    cut = F.when(low.rlike("иот$"), 3).when(low.rlike("[аеиоу](?:то|та|те)$") | low.rlike(r"[^аеиоу\s]от$"), 2).otherwise(0)
    return F.when(F.length(word) - cut >= 4, F.left(word, F.length(word) - cut)).otherwise(word)


def ranked_class(kind: Column) -> Column:
    """A type that no rank is known for: public, paid (a class that sells lessons) or null."""
    t = norm_type(kind)
    return F.when((type_rank(kind) == 0) & t.rlike(L.PUBLIC_ROOTS), F.when(t.rlike(L.PAID_SCHOOLS), "paid").otherwise("public"))
