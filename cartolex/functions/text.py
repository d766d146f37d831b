"""Text keys as column expressions, and the same as DuckDB SQL for the comparison queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L

_PLAIN_FROM, _PLAIN_TO = L.letters(L.MARKED)
_MATCHED_FROM, _MATCHED_TO = L.letters(L.MATCHED)
_SPELLED_FROM, _SPELLED_TO = L.letters(L.SPELLED)
_CYRILLIC_FROM, _CYRILLIC_TO = L.letters(L.TO_CYRILLIC)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def fold_marks(c: Column, digraphs: bool = True) -> Column:
    """Latin letters without marks, case kept; with ``digraphs`` č is ch and so on."""
    if digraphs:
        pairs = [*L.DIGRAPHS.items(), *((a.upper(), b.capitalize()) for a, b in L.DIGRAPHS.items())]
        c = _replaced(c, pairs)
    upper = [(a.upper(), b.upper()) for a, b in zip(_PLAIN_FROM, _PLAIN_TO, strict=True) if len(a.upper()) == 1 and a.upper() not in "IY"]
    return F.translate(c, _PLAIN_FROM + "".join(a for a, _ in upper), _PLAIN_TO + "".join(b for _, b in upper))


def to_latin(c: Column) -> Column:
    """Lower case, marks folded, Cyrillic letters as the Latin ones that clients type."""
    plain = F.translate(F.lower(c), _PLAIN_FROM + _MATCHED_FROM, _PLAIN_TO + _MATCHED_TO)
    return _replaced(plain, L.groups(L.MATCHED))


def to_cyrillic(c: Column) -> Column:
    low = _replaced(fold_marks(F.lower(c)), L.groups(L.TO_CYRILLIC))
    return F.translate(low, _CYRILLIC_FROM, _CYRILLIC_TO)


def spell_latin(c: Column) -> Column:
    """Lower case, Cyrillic letters spelled out (ч is ch)."""
    return F.translate(_replaced(fold_marks(F.lower(c)), L.groups(L.SPELLED)), _SPELLED_FROM, _SPELLED_TO)


def norm_type(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), F.lit(""))


def _lookup(table: dict, key: Column, default: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, key), default)


def canonical_type(c: Column) -> Column:
    t = norm_type(c)
    return _lookup(L.TYPE_ALIASES, t, t)


def type_rank(c: Column) -> Column:
    """The best rank among the parts of a type; unknown and null types have 0."""
    ranks = {t: L.TYPE_RANKS.get(L.TYPE_ALIASES.get(t, t), 0) for t in (*L.TYPE_RANKS, *L.TYPE_ALIASES)}
    t, part = norm_type(c), lambda p: _lookup(ranks, norm_type(p), F.lit(0))
    return F.when(F.contains(t, F.lit(";")), F.array_max(F.transform(F.split(t, ";"), part))).otherwise(part(t))


# What comes before a street's name, before a number and behind both.
_STREET_PREFIX = r"(?iu)^(?:ул\.?|улица|бул\.?|булевар|пат|street|st\.?|boulevard|blvd|ave\.?|avenue)\s+"
_NUMBER_WORD = r"(?siu)^(.*?)(?:^|\s)бр\.?\s*"
_TRAILING = r"(?iu)\s+\d(?:[\s.\-/0-9а-яa-z]*[0-9а-яa-z])?\s*$"
# Fixed value.
#: The first house number; borders of words are those of ASCII letters and digits.
HOUSE_NUMBER = r"(?i)(?<![A-Za-z0-9_])(\d+(?:[a-z](?![A-Za-z0-9_])|[а-яА-Я](?=[A-Za-z0-9_])|(?![A-Za-z0-9_])))"


def normalize_street(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), _STREET_PREFIX, "")
    s = F.regexp_replace(s, _NUMBER_WORD, "$1 ")
    s = F.regexp_replace(s, _TRAILING, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[.,]", " "), r"\s+", " "))


def street_key(c: Column) -> Column:
    return to_latin(normalize_street(c))


def house_number(c: Column) -> Column:
    return F.regexp_extract(c, HOUSE_NUMBER, 1)


def house_value(c: Column) -> Column:
    """The leading number, half more where a single letter is all that follows; else null."""
    whole = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(whole != "", whole.cast("double") + F.when(c.rlike(r"(?iu)^\d+[a-zа-я]$"), 0.5).otherwise(0.0))


def norm_name(c: Column) -> Column:
    return F.regexp_replace(spell_latin(c), r"[^a-z0-9]", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def phonetic_keys(c: Column) -> Column:
    """Distinct folded words of three letters or more, and numbers."""
    words = _words(F.trim(F.regexp_replace(F.regexp_replace(to_latin(c), r"[^a-z0-9\s]", " "), r"\s+", " ")))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) | w.rlike(r"^\d+$"))
    return F.array_distinct(F.transform(kept, lambda w: _replaced(w, L.PHONETIC_FOLDS)))


def sound_key(c: Column) -> Column:
    """The consonants of a word, one letter for one sound, then its digits; 8 characters at most."""
    plain = F.regexp_replace(to_latin(c), r"[^a-z0-9]", "")
    digits = F.regexp_replace(plain, r"[^0-9]", "")
    w = F.regexp_replace(_replaced(F.regexp_replace(plain, r"[0-9]", ""), L.SOUND_FOLDS), r"([a-z])\1+", "$1")
    w = F.replace(F.regexp_replace(w, r"c(?=[ei])", "s"), F.lit("c"), F.lit("k"))
    w = F.regexp_replace(F.regexp_replace(w, r"(?<=.)j", ""), r"[aeiouwyh]", "")
    return F.when(F.regexp_replace(plain, r"[0-9]", "") == "", digits).otherwise(F.substring(F.concat(w, digits), 1, 8))


def canonical_word_key(c: Column) -> Column:
    """The sound key; a word without consonants keeps its spelling."""
    return F.coalesce(F.nullif(sound_key(c), F.lit("")), F.regexp_replace(to_latin(c), r"[^a-z0-9]", ""))


def semantic_key(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(spell_latin(c), r"[^a-z\s]", " "), r"\s+", " "))
    words = F.transform(F.split(_replaced(t, L.PHRASES), " "), lambda w: _lookup(L.WORDS, w, w))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*L.STOP_WORDS)), " ")


def merge_keys(c: Column) -> Column:
    name, sem = norm_name(c), semantic_key(c)
    return F.when((F.length(sem) >= 8) & (sem != name), F.array(name, sem)).otherwise(F.array(name))


def identity_tokens(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(spell_latin(c), r"[^a-z0-9\s]", " "), r"\s+", " "))
    words = F.transform(_words(_replaced(t, L.PHRASES)), lambda w: _lookup(L.WORDS, w, w))
    return F.filter(words, lambda w: ~w.isin(*L.IDENTITY_NOISE))


def identity_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(identity_tokens(c))), " ")


def is_complex_name(c: Column) -> Column:
    words = F.split(F.regexp_replace(to_latin(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in L.COMPLEX_WORDS]))


def within_one_edit(a: Column, b: Column) -> Column:
    """Plain Levenshtein distance of at most one."""
    return F.levenshtein(a, b, 1) >= 0


def edit_within_one(a: Column, b: Column) -> Column:
    """As above, or one swap of neighbours."""
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return within_one_edit(a, b) | ((n == F.length(b)) & (n >= 2) & swap)


def words_almost_equal(a: Column, b: Column) -> Column:
    x, y = F.regexp_replace(to_latin(a), r"[^a-z0-9]", ""), F.regexp_replace(to_latin(b), r"[^a-z0-9]", "")
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & edit_within_one(x, y)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
