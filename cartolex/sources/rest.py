"""The snapshot query surface: parameters of a REST call become column predicates over text values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESERVED = {"select", "or", "order", "limit", "offset"}


def _condition(column: Column, op: str, value: str) -> Column:
    text = column.cast("string")
    if op == "is":
        return column.isNull() if value == "null" else F.lower(text).isin(value, "1" if value == "true" else "0")
    if op == "in":
        return text.isin(*[v.strip().strip('"') for v in value.strip("()").split(",")])
    if op == "like":
        return text.like(value.replace("*", "%"))
    return {"eq": text == value, "neq": text != value, "gt": text > value, "gte": text >= value, "lt": text < value, "lte": text <= value}[op]


def rest_query(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """select, column filters (``op.value``), ``or=(c.op.v,...)``, order, limit and offset; values compare as text.

    Unknown columns and operators raise ValueError.
    """
    def condition(name: str, rest: str) -> Column:
        op, _, value = rest.partition(".")
        if name not in df.columns or op not in ("eq", "neq", "gt", "gte", "lt", "lte", "like", "in", "is"):
            raise ValueError(f"{name}={rest}")
        return _condition(df[name], op, value)

    out = df
    for name, rest in params.items():
        if name not in _RESERVED:
            out = out.where(condition(name, rest))
    if "or" in params:
        terms = re.findall(r"(\w+)\.((?:in\.\([^)]*\))|[^,()]+)", params["or"].strip()[1:-1])
        any_ = [condition(n, r) for n, r in terms]
        both = any_[0]
        for c in any_[1:]:
            both = both | c
        out = out.where(both)
    if "order" in params:
        keys = []
        for part in params["order"].split(","):
            name, _, way = part.partition(".")
            keys.append(F.col(name).cast("string").desc_nulls_last() if way.startswith("desc") else F.col(name).cast("string").asc_nulls_last())
        out = out.orderBy(*keys)
    if "offset" in params:
        out = out.offset(int(params["offset"]))
    if "limit" in params:
        out = out.limit(int(params["limit"]))
    names = [c.strip() for c in params.get("select", "*").split(",")]
    return out if names == ["*"] else out.select(*names)
