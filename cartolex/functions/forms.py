"""What a client's words for a place may mean: words that name none, other spellings, token sets, covering names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.classes import without_article
from cartolex.functions.text import _lookup, canonical_word_key, identity_tokens, spell_latin, to_cyrillic, to_latin

# Words that ask, and name no place; Latin, as both scripts fold to it.
GRAMMAR_WORDS = [
    "ima", "imal", "imala", "imale", "imame", "imate", "imaat", "nema", "nemase", "nemate", "da", "ne", "li", "e", "se", "i", "a", "ili", "sto",
    "kade", "kde", "koj", "koja", "koe", "koi", "kolku", "kako", "zosto", "moze", "mozam", "mozete", "mozat", "mora", "moram", "morate", "bi", "ke",
    "znam", "znaete", "sum", "si", "sme", "ste", "sakam", "sakate", "baram", "treba",
]
# Words of renting and buying.
SERVICE_NOUNS = [
    "iznajmuvanje", "iznajmuvam", "iznajmi", "kirie", "kirija", "kirendisuvanje", "prodazba", "prodavam", "prodaden", "kupuvanje", "kupuvam",
]
# Everyday words that are no place when they stand alone.
GENERIC_WORDS = [
    "sajt", "sajtot", "sajtovi", "stranica", "stranicata", "stranata", "oglas", "oglasot", "oglasite", "agencija", "agencijata",
    "stan", "stanot", "stanovi", "stanche", "stance", "kukja", "kuka", "kukjata", "kukata", "kuki", "garsonjera", "garsonjerata", "lokal", "lokalot",
    "deloven", "plac", "placot", "dukjan", "dukan", "mesto", "grad", "iznajmuvanje", "iznajmuvam", "iznajmi", "kirie", "kirendisuvanje", "prodazba",
    "prodavam", "prodaden", "kupuvanje", "kupuvam", "apartman", "apartmani", "apartmanot", "apartmanite", "apartment", "apartments", "dupleks", "kotek",
    "vila", "vili", "garaza", "garazhi", "garazi", "garazata", "magacin", "magacinot", "kancelarija", "kancelarijata", "zemjiste", "zemjisteto",
    "nedviznost", "nedviznosta", "imov", "imot", "imotot", "soba", "sobi", "cena", "cenata", "evra", "evro", "denari", "kirija", "mesecno", "drug",
    "drugi", "drugiot", "druta", "druga", "drugata", "drugo", "drugoto", "drugite", "ostanato", "ostanatoto", "ostanati", "ostanatiot", "ostanata",
    "ostanatata", "sekoj", "sekoja", "sekoe", "site", "nekoj", "nekoja", "nekoe", "nekoi", "bilo", "koj", "koja", "koe", "koi", "shto", "sto", "ova",
    "ovoj", "ovaa", "toa", "toj", "taa", "isti", "istiot", "ista", "istata", "isto", "istoto", "prv", "prva", "prvo", "vtor", "vtora", "vtoro", "tret",
    "treta", "treto", "eden", "edna", "edno", "dva", "dve", "tri", "cetiri",
]
# Class words that are names all the same, and prepositions that may come first.
CLASS_NAMES = ["sobranie", "assembly", "skupstina"]
PREPOSITIONS = ["za", "na", "vo", "do", "od", "kaj", "spor", "sproti", "kak", "kon", "so", "pri"]
# What comes before a name and is no part of it.
FILLER = r"(?iu)^(?:pa|па|epa|епа|abe|абе|aj|ај|ama|ама|well)\s+"
OPENER = r"(?iu)^(?:kaj|кај|vo|во|na|на|do|до|okolu|околу|blizu|близу|kon|кон|sproti|спроти|nasproti|наспроти|niz|низ|od|од)\s+"
# Stems of kinds of schools, with the form that a name has.
SCHOOL_STEMS = [
    ("медицинск", "медицинско"), ("хемиск", "хемиско"), ("економск", "економско"), ("угостителск", "угостителско"), ("музичк", "музичко"),
    ("балетск", "балетско"), ("градежн", "градежно"), ("земјоделск", "земјоделско"), ("шумарск", "шумарско"), ("правн", "правно"),
    ("текстилн", "текстилно"), ("прехранбен", "прехранбено"), ("сообраќајн", "сообраќајно"), ("машинск", "машинско"),
    ("електротехничк", "електротехничко"), ("геодетск", "геодетско"), ("спортск", "спортско"), ("математичк", "математичко"),
    ("филолошк", "филолошко"), ("уметничк", "уметничко"),
]
SCHOOL_NOUNS = ["училиште", "гимназија"]
# Stems of the words for a country's embassy.
EMBASSY_OF = [
    ("црногорск", "Montenegro"), ("бугарск", "Bulgaria"), ("српск", "Serbia"), ("грчк", "Greece"), ("албанск", "Albania"), ("турск", "Turkey"),
    ("германск", "Germany"), ("француск", "France"), ("италијанск", "Italy"), ("американск", "United States"), ("холандск", "Netherlands"),
    ("британск", "United Kingdom"), ("австриск", "Austria"), ("швајцарск", "Switzerland"), ("шведск", "Sweden"), ("руск", "Russia"),
    ("романск", "Romania"), ("хрватск", "Croatia"), ("словенечк", "Slovenia"), ("полск", "Poland"), ("чешк", "Czechia"), ("словачк", "Slovakia"),
    ("украинск", "Ukraine"), ("шпанск", "Spain"), ("кинеск", "China"), ("јапонск", "Japan"),
]
# What people call a place, and the name that it is filed under.
OFFICIAL_NAMES = [
    (r"(?<![\p{L}\p{N}])(?:стара(?:та)?\s+)?(?:воена(?:та)?\s+болница|voena(?:ta)?\s+bolnica)(?![\p{L}\p{N}])", "ГОБ 8-ми Септември"),
    (r"(?<![\p{L}\p{N}])(?:државна(?:та)?|дрзавна(?:та)?)(?:\s+болниц(?:а|ата|и|у))?(?![\p{L}\p{N}])", "Клинички центар"),
    (r"(?<![\p{L}\p{N}])drzavna(?:ta)?(?:\s+bolnic(?:a|i|u))?(?![\p{L}\p{N}])", "Клинички центар"),
    (r"(?<![\p{L}\p{N}])(?:градска(?:та)?|gradska(?:ta)?)(?:\s+(?:болниц(?:а|ата|и|у)|bolnic(?:a|ata|i|u)))?(?!\s*(?:кафеан|кафан|меан|пивниц|библиотек|книжар|аптек|управа|општин|галериј|сцена|плажа|базен|стадион)\p{L})(?![\p{L}\p{N}])", "Градска болница"),
    (r"(?<![\p{L}\p{N}])(?:економско(?:то)?|ekonomsko(?:to)?)(?:\s+(?:училиште|училиштето|сколо|школо|uciliste|ucilisteto|skolo|shkolo|school))?(?![\p{L}\p{N}])", "СЕПУГС"),
]
# A second name of a filed one.
SECOND_NAMES = {"ГОБ 8-ми Септември": ["Болница 8ми Септември"]}


def _own_words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _alone(c: Column) -> Column:
    """The words of a needle in Latin, without a preposition at its head."""
    words = F.transform(_own_words(F.lower(c)), to_latin)
    return F.when(F.get(words, F.lit(0)).isin(*PREPOSITIONS), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)


def _one_of(words: Column, table: list[str]) -> Column:
    return F.coalesce((F.size(words) == 1) & F.get(words, F.lit(0)).isin(*table), F.lit(False))


def strip_definite(word: Column) -> Column:
    """A word in Latin without its article; of the endings that it has, the first that leaves 4 letters comes off."""
    latin = spell_latin(word)
    return F.coalesce(*[F.when(latin.endswith(s) & (F.length(latin) - len(s) >= 4), F.left(latin, F.length(latin) - len(s))) for s in ("ot", "ov", "ta", "to", "te", "iot")], latin)


def only_grammar(c: Column) -> Column:
    """Every word asks, joins or points; so do no words at all."""
    table = [*GRAMMAR_WORDS, *L.STOP_WORDS]
    return F.coalesce(F.forall(_own_words(F.lower(c)), lambda w: to_latin(w).isin(*table) | strip_definite(w).isin(*table)), F.lit(True))


def only_service(c: Column) -> Column:
    return _one_of(_alone(c), SERVICE_NOUNS)


def too_generic(c: Column, category: Column) -> Column:
    """One everyday word, or one word that says no more than what kind of place it is; ``category``: of the text."""
    words = _alone(c)
    return _one_of(words, GENERIC_WORDS) | ((F.size(words) == 1) & ~_one_of(words, CLASS_NAMES) & category.isNotNull())


def opener_stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, FILLER, ""), OPENER, ""))


def lexicon_form(word: Column) -> Column:
    """The word that stands for a Latin word in both languages, also behind an article; else itself."""
    return _lookup(L.WORDS, word, _lookup(L.WORDS, strip_definite(word), word))


def lookup_tokens(c: Column) -> Column:
    """The distinct words of a name in both languages' one form, kinds of places kept, in order."""
    t = F.trim(F.regexp_replace(F.regexp_replace(spell_latin(c), r"[^a-z0-9\s]", " "), r"\s+", " "))
    for a, b in L.PHRASES:
        t = F.replace(t, F.lit(a), F.lit(b))
    words = F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lexicon_form)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*L.STOP_WORDS)))


def names_something(c: Column) -> Column:
    """Holds a word of its own: one that is left without the noise of names, and one that no lexicon knows."""
    bare = F.array_join(F.transform(F.split(c, r"\s+"), strip_definite), " ")
    known = [*L.WORDS, *L.STOP_WORDS]
    letters = F.filter(F.split(F.regexp_replace(spell_latin(c), r"[^a-z\s]", " "), r"\s+"), lambda w: w != "")
    return (F.size(identity_tokens(bare)) > 0) & F.exists(letters, lambda w: ~w.isin(*known) & ~strip_definite(w).isin(*known))


def official_name(c: Column) -> Column:
    """The name that a place is filed under; null where people call it by that name."""
    return F.coalesce(*[F.when(c.rlike(f"(?iu){pattern}"), name) for pattern, name in OFFICIAL_NAMES])


def embassy_name(c: Column) -> Column:
    """The filed name of a country's embassy, asked for by the country's adjective; else null."""
    country = F.regexp_replace(to_cyrillic(F.regexp_extract(c, r"(?iu)(\S+)\s+(?:амбасад|ambasad)[ауau]", 1)), "(?:ата|ите|те|та|от|ов|а|и)$", "")
    return F.coalesce(*[F.when(country == stem, f"Embassy of {name}") for stem, name in EMBASSY_OF])


def school_forms(c: Column) -> Column:
    """Other ways to ask for a school, most faithful first: without articles, then with the noun that is left out."""
    base = F.trim(c)
    bare = F.array_join(F.transform(F.split(base, r"\s+"), without_article), " ")
    words = F.split(bare, r"\s+")
    last = F.lower(to_cyrillic(F.element_at(words, -1)))
    stem = F.coalesce(*[F.when(last.startswith(s), full) for s, full in SCHOOL_STEMS])
    head = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    whole = [f(noun) for noun in SCHOOL_NOUNS for f in (lambda n: F.concat_ws(" ", head, stem, F.lit(n)), lambda n: F.concat_ws(" ", stem, F.lit(n)))]
    more = F.when(stem.isNotNull(), F.array(*[F.trim(w) for w in whole], stem)).otherwise(F.array().cast("array<string>"))
    forms = F.filter(F.concat(F.array(bare), more), lambda f: (F.length(f) >= 4) & (F.lower(f) != F.lower(base)))
    # the first of those that differ in case alone
    seen = F.transform(forms, F.lower)
    first = F.filter(F.transform(forms, lambda f, i: F.when(F.array_position(seen, F.lower(f)) == i + 1, f)), lambda f: f.isNotNull())
    return F.when(F.length(base) >= 4, first).otherwise(F.array().cast("array<string>"))


def _folded(c: Column) -> Column:
    return F.transform(_own_words(F.lower(to_cyrillic(c))), lambda w: F.when(w.rlike(r"^\d+$"), w).otherwise(canonical_word_key(w)))


def covers(said: Column, name: Column) -> Column:
    """Whether a name covers a client's words: it has them all, and opens with one, or its last part behind a dash, colon or
    bracket has them all and opens with one."""
    want, have = _folded(opener_stripped(said)), _folded(name)
    parts = F.split(name, r"\s*[-–—:(]\s*|\s+\(\s*")
    tail = _folded(F.regexp_replace(F.element_at(parts, -1), r"\)+$", ""))
    within = lambda words: (F.size(words) > 0) & (F.size(F.array_except(want, words)) == 0) & F.array_contains(want, F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    return F.coalesce((F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0) & (within(have) | ((F.size(parts) > 1) & within(tail))), F.lit(False))
