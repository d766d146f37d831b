"""Names that mix scripts: look-alike letters are put right, word by word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cartolex.functions import lexicon as L

_CYR, _LAT = "Ѐ-ӿ", "A-Za-zÀ-ɏ"
_WORD, _CYRS, _LATS = re.compile(f"[{_LAT}{_CYR}]+"), re.compile(f"[{_CYR}]"), re.compile(f"[{_LAT}]")
_ROMAN, _RUN, _MARKED = re.compile("[IVXLC]+"), re.compile(f"[{_LAT}]+"), re.compile("[À-ɏ]")
_BASE = L.MARKED | L.DIGRAPHS
_SINGLE = {a: b for a, b in L.TO_CYRILLIC.items() if len(a) == 1}


def cyrillic(run: str) -> str:
    """A Latin run by sound, in its own case."""
    low = "".join(_BASE.get(c, c) for c in run.lower())
    for a, b in L.groups(L.TO_CYRILLIC):
        low = low.replace(a, b)
    out = "".join(_SINGLE.get(c, c) for c in low)
    if not re.search("[A-Z]", run):
        return out
    return out.upper() if not re.search("[a-z]", run) else out[:1].upper() + out[1:]


def _run(run: str) -> str:
    if _ROMAN.fullmatch(run):
        return run
    if _MARKED.search(run) or len(run) >= 3:
        return cyrillic(run)
    looks = L.LATIN_LOOKS
    return "".join((looks[c.upper()] if c.isupper() else looks[c.upper()].lower()) if c.upper() in looks else c for c in run)


def repair_script(s: str) -> str:
    """Each word that mixes scripts goes to the one that it is mostly in; words of one script stay."""
    lat, cyr = len(_LATS.findall(s)), len(_CYRS.findall(s))
    if not lat or not cyr:
        return s

    def word(m: re.Match) -> str:
        w = m[0]
        own_cyr = _CYRS.findall(w)
        own_lat = len(w) - len(own_cyr)
        if not own_cyr or not own_lat or _ROMAN.fullmatch(w):
            return w
        restorable = all(c in L.CYRILLIC_LOOKS for c in own_cyr)
        ambiguous = restorable and all(c.upper() in L.LATIN_LOOKS for c in w if not _CYRS.match(c))
        if restorable and (own_lat >= 2 * len(own_cyr) + 1 or (ambiguous and lat > cyr)):
            return "".join(L.CYRILLIC_LOOKS.get(c, c) for c in w)
        return _RUN.sub(lambda r: _run(r[0]), w)

    return _WORD.sub(word, s)


@F.pandas_udf(StringType())
def _repaired(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else repair_script(x))


def clean_name(c: Column) -> Column:
    """White space tidied, mixed words repaired; only rows that hold both scripts reach Python's work."""
    tidy = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    mixed = tidy.rlike(f"[{_CYR}]") & tidy.rlike(f"[{_LAT}]")
    return F.when(mixed, _repaired(F.when(mixed, tidy))).otherwise(tidy)
