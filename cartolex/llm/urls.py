"""URL rules: host suffixes and path prefixes of each URL meet the rules in an equi-join on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import sized

#: Hex digits of the digest that the equi-join uses; the full digest confirms.
PREFIX_DIGITS = 8


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row, whatever its other columns hold.

    ``rules``: host, path (starts with ``/``), action. A rule fits its host and all subdomains where the path starts with
    the rule's path; the longest rule (host and path together) wins, then the longer host, then the smaller text. Rows
    that no rule fits get no rule and ``default``. Null URLs and those without ``://`` have an empty host and path and fit
    no rule. Rules with a null part or an empty host are left out; of equal rules the smallest action counts. Columns of
    the same names are replaced. Each distinct URL is judged once, so a hot URL or host costs one row. Of a host only the suffixes
    with as many labels as some rule's host has are built, so that a URL costs what it is long, times the rules' depths.
    """
    names = ("host", "path", "rule", "verdict")
    rows = pages.select(*[c for c in pages.columns if c not in names or c == url])
    known = rules.select("host", "path", "action").dropna().where("host <> ''").groupBy("host", "path").agg(F.min("action").alias("action"))
    labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    known = known.select(
        labels(F.col("host")).alias("_deep"),
        F.concat("host", "path").alias("_rule"), "action", F.length("path").alias("_plen"), F.length("host").alias("_hlen"), F.sha2(F.concat_ws("\x1f", "host", "path"), 256).alias("_digest")
    ).withColumn("_key", F.substring("_digest", 1, PREFIX_DIGITS))
    # at most one length for each place in a path, and one number of labels for each in a host, whatever the number of rules
    each = lambda c: F.array_sort(F.collect_set(c))
    lengths, depths = known.agg(each("_plen").alias("n"), each("_deep").alias("d")).first() or ([], [])

    deep = F.lit(depths or [0]).cast("array<int>")
    suffixes = F.transform(F.filter(deep, lambda n: n <= labels(F.col("_host"))), lambda n: F.call_function("substring_index", F.col("_host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(F.lit(lengths or [0]).cast("array<int>"), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    distinct = rows.select(F.col(url).alias("_url")).where(F.col(url).contains("://")).distinct()
    parts = distinct.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")).where("_host <> ''")
    said = parts.select("_url", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\x1f", h, p), 256))))).alias("_full"))
    said = said.withColumn("_key", F.substring("_full", 1, PREFIX_DIGITS))
    fits = said.join(sized(known, 256), "_key").where("_full = _digest")
    best = fits.groupBy("_url").agg(F.min_by(F.struct("_rule", "action"), F.struct(-(F.col("_plen") + F.col("_hlen")), -F.col("_hlen"), F.col("_rule"))).alias("_best"))
    out = rows.join(best, rows[url] == best["_url"], "left")
    u = rows[url]
    keep = [rows[c] for c in rows.columns if c not in names]
    return out.select(*keep, host_of(u).alias("host"), path_of(u).alias("path"), F.col("_best._rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
