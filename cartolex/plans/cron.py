"""Lines of a schedule told apart by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_lines(lines: DataFrame, boot: str, sync: list[str], forbidden: list[str]) -> DataFrame:
    """Adds kind (boot, sync, forbidden, other: the first that fits) and active (neither blank nor a comment)."""
    raw = F.trim("raw")
    any_of = lambda ps: raw.rlike("|".join(ps)) if ps else F.lit(False)
    kind = F.when(raw.contains("@reboot") & raw.contains(boot), "boot").when(any_of(sync), "sync").when(any_of(forbidden), "forbidden").otherwise("other")
    return lines.withColumn("kind", kind).withColumn("active", (raw != "") & ~raw.startswith("#"))


def strip_forbidden(lines: DataFrame) -> DataFrame:
    """Classified lines without the active forbidden ones; a second pass changes nothing."""
    return lines.where("not (active and kind = 'forbidden')")


def missing_sync(lines: DataFrame, required: DataFrame) -> DataFrame:
    """Required patterns that no active line holds. ``required``: pattern."""
    active = lines.where("active").select("raw")
    return required.join(active, F.expr("raw rlike pattern"), "left_anti")
