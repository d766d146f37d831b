"""The text keys as DuckDB expressions, from the same tables."""

from __future__ import annotations

from functools import reduce

from cartolex.functions import lexicon as L
from cartolex.functions.text import _PLAIN_FROM, _PLAIN_TO


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(e: str, pairs) -> str:
    return reduce(lambda x, p: f"replace({x}, {q(p[0])}, {q(p[1])})", pairs, e)


def lookup(table: dict, e: str, default: str) -> str:
    keys = ", ".join(q(str(k)) for k in table)
    values = ", ".join(q(v) if isinstance(v, str) else str(v) for v in table.values())
    return f"coalesce(map([{keys}], [{values}])[{e}], {default})"


def to_latin(e: str) -> str:
    return replaced(f"translate(lower({e}), {q(_PLAIN_FROM + L.letters(L.MATCHED)[0])}, {q(_PLAIN_TO + L.letters(L.MATCHED)[1])})", L.groups(L.MATCHED))


def fold_lower(e: str) -> str:
    """Marks of a lower-case text, digraph spelling."""
    return f"translate({replaced(e, L.DIGRAPHS.items())}, {q(_PLAIN_FROM)}, {q(_PLAIN_TO)})"


def to_cyrillic(e: str) -> str:
    return f"translate({replaced(fold_lower(f'lower({e})'), L.groups(L.TO_CYRILLIC))}, {q(L.letters(L.TO_CYRILLIC)[0])}, {q(L.letters(L.TO_CYRILLIC)[1])})"


def spell_latin(e: str) -> str:
    return f"translate({replaced(fold_lower(f'lower({e})'), L.groups(L.SPELLED))}, {q(L.letters(L.SPELLED)[0])}, {q(L.letters(L.SPELLED)[1])})"


def norm_type(e: str) -> str:
    return f"coalesce(regexp_replace(lower(trim({e})), '\\s+', ' ', 'g'), '')"


def type_rank(e: str) -> str:
    part = norm_type("p")
    return f"list_max(list_transform(string_split({norm_type(e)}, ';'), lambda p: {lookup(L.TYPE_RANKS, lookup(L.TYPE_ALIASES, part, part), '0')}))"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def cleaned(e: str, keep: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '[^{keep}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_name(e: str) -> str:
    return f"regexp_replace({spell_latin(e)}, '[^a-z0-9]', '', 'g')"


def phonetic_keys(e: str) -> str:
    """Distinct in order of first place."""
    kept = f"list_filter({words(cleaned(to_latin(e), 'a-z0-9'))}, lambda w: length(w) >= 3 or regexp_full_match(w, '\\d+'))"
    folded = f"list_transform({kept}, lambda w: {replaced('w', L.PHONETIC_FOLDS)})"
    return f"list_reduce({folded}, lambda a, w: case when list_contains(a, w) then a else list_append(a, w) end, []::varchar[])".replace(f"list_reduce({folded}, lambda a, w", f"list_reduce(list_transform({folded}, lambda x: [x]), lambda a, v").replace("list_contains(a, w) then a else list_append(a, w)", "list_contains(a, v[1]) then a else list_concat(a, v)")


def sound_key(e: str) -> str:
    plain = f"regexp_replace({to_latin(e)}, '[^a-z0-9]', '', 'g')"
    digits = f"regexp_replace({plain}, '[^0-9]', '', 'g')"
    letters = f"regexp_replace({plain}, '[0-9]', '', 'g')"
    w = replaced(letters, L.SOUND_FOLDS)
    for c in "abcdefghijklmnopqrstuvwxyz":
        w = f"regexp_replace({w}, '{c}{c}+', '{c}', 'g')"
    w = f"replace(regexp_replace({w}, 'c([ei])', 's\\1', 'g'), 'c', 'k')"
    w = f"regexp_replace(regexp_replace({w}, '(.)j', '\\1', 'g'), '[aeiouwyh]', '', 'g')"
    return f"case when {letters} = '' then {digits} else substring({w} || {digits}, 1, 8) end"


def semantic_key(e: str) -> str:
    t = replaced(cleaned(spell_latin(e), "a-z"), L.PHRASES)
    mapped = f"list_transform(string_split({t}, ' '), lambda w: {lookup(L.WORDS, 'w', 'w')})"
    stops = ", ".join(map(q, L.STOP_WORDS))
    return f"array_to_string(list_filter({mapped}, lambda w: w <> '' and w not in ({stops})), ' ')"


def identity_tokens(e: str) -> str:
    t = replaced(cleaned(spell_latin(e), "a-z0-9"), L.PHRASES)
    mapped = f"list_transform({words(t)}, lambda w: {lookup(L.WORDS, 'w', 'w')})"
    noise = ", ".join(map(q, L.IDENTITY_NOISE))
    return f"list_filter({mapped}, lambda w: w not in ({noise}))"


def identity_key(e: str) -> str:
    return f"array_to_string(list_sort(list_distinct({identity_tokens(e)})), ' ')"


def normalize_street(e: str) -> str:
    s = f"regexp_replace(lower({e}), '^(?:ул\\.?|улица|бул\\.?|булевар|пат|street|st\\.?|boulevard|blvd|ave\\.?|avenue)\\s+', '', 'i')"
    s = f"regexp_replace({s}, '(?:^|\\s)бр\\.?\\s*', ' ', 'i')"
    s = f"regexp_replace({s}, '\\s+\\d+(?:[\\s.\\-/]*(?:\\d+|[а-яa-z]+))*\\s*$', '', 'i')"
    return f"trim(regexp_replace(regexp_replace({s}, '[.,]', ' ', 'g'), '\\s+', ' ', 'g'))"


def street_key(e: str) -> str:
    return to_latin(normalize_street(e))
