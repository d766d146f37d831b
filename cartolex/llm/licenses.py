"""Licence notices and identifier tags by an Aho-Corasick automaton; tagged expressions by a shunting-yard evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from cartolex.llm.common import binary_column, small_batches, tidy, working

#: Fixed phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Phrases of further notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: How much each family of licences leaves to the user, from 0 (nothing) to 1 (everything).
FREEDOM = {
    "cc0": 1.0,
    "unlicense": 1.0,
    "mit": 0.95,
    "isc": 0.95,
    "bsd": 0.95,
    "apache-2": 0.9,
    "cc-by": 0.8,
    "mpl": 0.6,
    "lgpl": 0.5,
    "cc-by-sa": 0.4,
    "gpl": 0.3,
    "agpl": 0.2,
    "cc-by-nc": 0.1,
    "cc-by-nd": 0.1,
}
#: Words of an identifier tag, and the tag as it must stand in the text.
TAG_WORDS, TAG = "spdx license identifier", re.compile(rb"(?i)spdx-license-identifier[ \t]*:[ \t]*")
_PIECE = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?))")
#: Operators by how strongly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}

#: Bytes as words see them: A-Z lower-cased, everything below 0x80 but letters and digits a space.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


def family(identifier: str) -> tuple[str, float]:
    """The longest family that an identifier belongs to and its freedom; an unknown one is its own, and frees nothing."""
    name = identifier.lower()
    for end in range(len(name), 0, -1):
        if name[:end] in FREEDOM and (end == len(name) or name[end] in "-.+"):
            return name[:end], FREEDOM[name[:end]]
    return name, 0.0


def evaluate(raw: bytes, at: int, end: int) -> tuple[float, list[str], int] | None:
    """(freedom, labels, end) of the longest expression that begins at ``at``; None where no licence stands there.

    Two stacks, operators by binding strength: ``and`` asks for both sides (the lesser freedom, labels of both), ``or`` lets
    one choose (the side with more freedom, the left one if equal), ``with`` adds an exception to one licence, which gives
    back half of what it lacks. The expression ends before the first piece that doesn't fit; an operator without a right side
    falls away, and open parentheses close at the end. Linear in the pieces.
    """
    values: list[tuple] = []  # (freedom, licence or pair of values)
    marks: list[str] = []

    def apply() -> None:
        op, right, left = marks.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(((1 + left[0]) / 2, f"{left[1]} with {right[1]}"))
        elif op == "and":
            values.append((min(left[0], right[0]), (left[1], right[1])))
        else:
            values.append(left if left[0] >= right[0] else right)

    operand, done, depth = True, at, 0
    while m := _PIECE.match(raw, at, end):
        mark, name = m[1], (m[2] or b"").decode("ascii")
        word = name.lower()
        if operand:
            if mark == b"(" and not (marks and marks[-1] == "with"):
                marks.append("(")
                depth += 1
            elif name and word not in BINDS:
                # an exception is a name of its own
                values.append((0.0, word) if marks and marks[-1] == "with" else family(name)[::-1])
                operand, done = False, m.end()
            else:
                break
        elif mark == b")" and depth:
            while marks[-1] != "(":
                apply()
            marks.pop()
            depth -= 1
            done = m.end()
        elif word in BINDS and (word != "with" or (raw[done - 1 : done] != b")" and not (marks and marks[-1] == "with"))):
            while marks and marks[-1] != "(" and BINDS[marks[-1]] >= BINDS[word]:
                apply()
            marks.append(word)
            operand = True
        else:
            break
        at = m.end()
    if operand:
        while marks and marks[-1] == "(":
            marks.pop()
        if marks:
            marks.pop()
    while marks:
        if marks[-1] == "(":
            marks.pop()
        else:
            apply()
    if not values:
        return None
    freedom, tree = values[0]
    labels, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, str):
            labels.append(node)
        else:
            open_ += [node[1], node[0]]
    return freedom, labels, done


@lru_cache(maxsize=4)
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """Whole words only: phrases stand between single spaces."""
    out = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        out.add_word(f" {phrase} ", (i, len(phrase) + 2))
    out.make_automaton()
    return out


def scan(raw: bytes, base: tuple, notices: tuple) -> tuple[int, list[tuple[int, str, bool]], list[tuple[int, str, float, list[str]]]]:
    """(number of words, places as (word, label, base), expressions as (word, text, freedom, labels)) of one text."""
    flat = b" " + raw.translate(_AS_WORDS) + b" "
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    phrases = tuple(p for p, _ in base) + tuple(p for p, _ in notices) + (TAG_WORDS,)
    hits = sorted((end + 1 - size, i) for end, (i, size) in automaton(phrases).iter(flat.decode("latin-1")))
    places, expressions, word, passed = [], [], 0, 0
    words, nth, at = None, -1, 0
    for start, i in hits:
        word += flat.count(b" ", passed, start)
        passed = start
        if i < len(phrases) - 1:
            places.append((word, (base + notices)[i][1], i < len(base)))
            continue
        # a tag: on to its first word in the text as it stands
        words = words or _WORD.finditer(raw)
        while nth < word:
            at, nth = next(words).start(), nth + 1
        if m := TAG.match(raw, at):
            line = re.compile(rb"[\r\n]").search(raw, m.end())
            found = evaluate(raw, m.end(), line.start() if line else len(raw))
            if found:
                expressions.append((word, raw[m.end() : found[2]].decode("utf-8", "replace"), found[0], found[1]))
    return flat.count(b" ") - 1, places, expressions


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row for each row of ``docs``: the id, columns ``keep``, ``n_words``, ``places``, ``expressions``, ``labels``, ``score``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. ``places``: array of struct(word, label,
    base), where the words of a phrase stand one after the other, by word (from 0). ``expressions``: array of struct(word,
    text, score, labels), what the identifier tags of the text say, each up to the end of its line. ``labels`` are those of
    both, distinct and sorted; ``score`` is the freedom of the least free of them, 0 where there is none. Null texts are
    empty; empty texts have no words; null ids and repeated rows pass like others; texts are read whole, in time that grows
    with their length; other columns are not used, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [doc_id, *[c for c in keep if c != doc_id]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    own = [
        ("n_words", "bigint", pa.int64()),
        ("places", "array<struct<word:bigint,label:string,base:boolean>>", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
        ("expressions", "array<struct<word:bigint,text:string,score:double,labels:array<string>>>", pa.list_(pa.struct([("word", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("labels", pa.list_(pa.string()))]))),
        ("labels", "array<string>", pa.list_(pa.string())),
        ("score", "double", pa.float64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("licenses")
        for batch in batches:
            rows: list[list] = [[] for _ in own]
            for raw in binary_column(batch, "__text"):
                n, places, said = scan(raw.as_py(), base, notices)
                labels = {p[1] for p in places} | {x for e in said for x in e[3]}
                score = min([family(p[1])[1] for p in places] + [e[2] for e in said], default=0.0)
                values = (n, [dict(zip(("word", "label", "base"), p, strict=True)) for p in places], [dict(zip(("word", "text", "score", "labels"), e, strict=True)) for e in said], sorted(labels), score)
                for col, value in zip(rows, values, strict=True):
                    col.append(value)
            cols = [pa.array(col, kind) for col, (_, _, kind) in zip(rows, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], [*names, *[name for name, _, _ in own]])

    return docs.select(*names, docs[text].alias("__text")).mapInArrow(tidy(run), f"{fields}, " + ", ".join(f"{n} {k}" for n, k, _ in own))
