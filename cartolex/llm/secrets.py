"""Secret scan on the JVM alone: candidates by pattern, told apart by how many repositories and owners hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import cut

#: Kinds of the base scan, in the order of the contract: pattern, group that holds the value, least length of the value.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
#: Further shapes, reported only where the corpus says that one owner alone holds the value.
OWNED = {
    "upperhex": (r"(?<![0-9A-Za-z])([0-9A-F]{32,})(?![0-9A-Za-z])", 1, 32),
    "prefixed": (r"(?<![A-Za-z0-9_])((?:gh[pousr]_|sk_live_|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,})", 1, 20),
}
#: A maximal run is found faster with its least length in the pattern; the spans are the same.
_FAST = {"hex": r"(?<![0-9a-f])([0-9a-f]{24,})", "access": r"(AKIA[A-Z0-9]{16,})"}
#: What a text must hold for a pattern to be tried at all.
_GATE = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"' ]*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "upperhex": r"[0-9A-F]{32}",
    "prefixed": r"(?:gh[pousr]_|sk_live_|xox[abprs]-|glpat-)",
}


def matches(text: Column, kind: str) -> Column:
    """array<struct<at, till, value>> of a kind: leftmost non-overlapping matches, failing ones dropped; code points."""
    pattern, group, least = (BASE | OWNED)[kind]
    pattern = _FAST.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<at:int,till:int,value:string>>")
    pairs = F.zip_with(F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda m, b: F.struct(F.length(m["w"]).alias("w"), m["v"].alias("v"), F.length(b).alias("b")))

    def walked(part: Column) -> Column:
        """Places from the start of a part, and the length of it all."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), empty.alias("found")),
            lambda acc, m: F.struct((acc["at"] + m["b"] + m["w"]).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + m["b"]).alias("at"), (acc["at"] + m["b"] + m["w"]).alias("till"), m["v"].alias("value")))).alias("found")),
        )

    def placed(m: Column) -> Column:
        """Parts of as many matches as there are parts: an array that grows is copied, so that whole texts would be squared."""
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(m))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(m) - 1) / step).cast("int"))), lambda i: walked(F.slice(m, i * step + 1, step)))
        return once(parts, lambda p: F.flatten(F.zip_with(p, before(p), lambda x, n: F.transform(x["found"], lambda f: F.struct((f["at"] + n).alias("at"), (f["till"] + n).alias("till"), f["value"].alias("value"))))))

    found = F.when(F.size(whole) > 0, once(pairs, placed)).otherwise(empty)
    return F.when(text.rlike(_GATE[kind]), F.filter(found, lambda m: F.length(m["value"]) >= least)).otherwise(empty)


def once(value: Column, of) -> Column:
    """``of`` a value that is worked out once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def before(parts: Column) -> Column:
    """The summed lengths of the parts before each."""
    sums = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
    return sums["all"]


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "source", owner: str | None = None, live_owners: int = 1) -> DataFrame:
    """One row for each row of ``docs``: the id and ``spans``, an array of struct(kind, at, till, base, live, n_repos, n_owners).

    Spans are ordered by place, then by kind as listed. Base kinds are always reported; the further shapes only if their
    value is live: held by at most ``live_owners`` owners. ``n_repos`` and ``n_owners`` count the distinct repositories and
    owners (by default each repository is its own owner) that hold the value anywhere in the corpus; a value whose
    repository is null counts as one. Null text is empty; a text of any length is scanned whole, in time that grows little faster than
    its matches; null or repeated ids and repeated rows stay separate rows. An empty table gives no rows. Other
    columns are not used. Values meet by SHA-256 digest alone.
    """
    kinds = [*BASE, *OWNED]
    kind_struct = lambda n, k: lambda m: F.struct(m["at"].alias("at"), F.lit(n).alias("nth"), m["till"].alias("till"), F.lit(k).alias("kind"), F.sha2(m["value"], 256).alias("digest"))
    found = F.flatten(F.array(*[F.transform(matches(F.col("_text"), k), kind_struct(n, k)) for n, k in enumerate(kinds)]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(repo).cast("string").alias("_repo"), (F.col(owner) if owner else F.col(repo)).cast("string").alias("_owner"))
    # the texts are read once; what is kept of them is small
    rows = cut(rows.select("doc_id", "_repo", "_owner", F.array_sort(found).alias("_found")), "secrets")
    held = rows.where(F.size("_found") > 0)
    # a digest's repositories first, one row each, then their number: a value that all rows hold is summed before it moves
    owned = held.select("_repo", "_owner", F.explode("_found.digest").alias("digest")).distinct()
    owned = owned.groupBy("digest", "_owner").agg(F.count("*").alias("_n")).groupBy("digest").agg(F.sum("_n").alias("n_repos"), F.count("*").alias("n_owners"))
    # copies of a text share their candidates, so each distinct set of candidates is told apart once
    held = held.withColumn("_key", F.sha2(F.array_join(F.transform("_found", lambda m: F.concat_ws(":", m["at"].cast("string"), m["till"].cast("string"), m["kind"], m["digest"])), ","), 256))
    each = held.select("_key", "_found").distinct().select("_key", F.explode("_found").alias("m")).select("_key", "m", F.col("m.digest").alias("digest"))
    live = F.col("n_owners") <= live_owners
    span = F.struct("m.at", "m.nth", "m.till", "m.kind", F.col("m.kind").isin(*BASE).alias("base"), live.alias("live"), "n_repos", "n_owners")
    told = each.join(owned, "digest").where(F.col("m.kind").isin(*BASE) | live).groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    shape = "array<struct<kind:string,start:int,end:int,base:boolean,live:boolean,n_repos:bigint,n_owners:bigint>>"
    named = F.transform("_spans", lambda m: F.struct(m["kind"], m["at"], m["till"], m["base"], m["live"], m["n_repos"], m["n_owners"])).cast(shape)
    none = F.array().cast(shape)
    out = held.join(told, "_key", "left").select("doc_id", F.coalesce(named, none).alias("spans"))
    return out.unionByName(rows.where(F.size("_found") == 0).select("doc_id", none.alias("spans")))
