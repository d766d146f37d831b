"""Mixing overlapping sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.llm.common import BROADCAST_BYTES, cut, small_batches

#: Distinct membership patterns that the flow is solved for on the driver.
MOST_PATTERNS = 250_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Source -> target: ``share`` of all sizes by weight, none above ``most`` times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > most * sizes[s] * total]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: list[tuple[tuple, int]], quotas: dict, most: int = 2) -> list[dict]:
    """For each pattern (its sources, its words) the words that go to each source: as many as the quotas and ``most`` copies of each
    pattern allow, at the least cost.

    A pattern offers its words once for each repetition, the r-th at cost r * r, so that no words are repeated more often than
    the quotas need. Only a path's first arc costs anything, so the cheapest paths of all are those of the first copies, then
    those of the second: the flow is a largest flow for each copy in turn, each behind the one before. Sources that no
    pattern shares need none: they take what their quota and their words allow.
    """
    sent: list[dict] = [{} for _ in patterns]
    shared = {s for sources, _ in patterns if len(sources) > 1 for s in sources}
    left = dict(quotas)
    alone = [i for i, (sources, _) in enumerate(patterns) if len(sources) == 1 and sources[0] not in shared]
    for _ in range(most):
        for i in alone:
            (s,), words = patterns[i]
            if n := min(words, left[s]):
                sent[i][s] = sent[i].get(s, 0) + n
                left[s] -= n
    joint = [i for i, (sources, words) in enumerate(patterns) if words and sources and (len(sources) > 1 or sources[0] in shared)]
    if joint:
        flow = _Flow([patterns[i][0] for i in joint], left)
        for _ in range(most):
            flow.extend([patterns[i][1] for i in joint])
        for i, got in zip(joint, flow.sent, strict=True):
            sent[i] = {s: n for s, n in got.items() if n}
    return sent


class _Flow:
    """A largest flow from patterns to sources by blocking flows over shortest paths; more words can be offered behind it."""

    def __init__(self, patterns: list[tuple], left: dict):
        self.patterns, self.left = patterns, left
        self.offer, self.sent = [0] * len(patterns), [{} for _ in patterns]
        self.fed: dict = {}  # source -> patterns that send it words

    def _send(self, p: int, s, n: int) -> None:
        self.sent[p][s] = self.sent[p].get(s, 0) + n
        self.fed.setdefault(s, {})[p] = None

    def extend(self, words: list[int]) -> None:
        for p, n in enumerate(words):
            self.offer[p] += n
            for s in self.patterns[p]:
                if n := min(self.offer[p], self.left[s]):
                    self._send(p, s, n)
                    self.offer[p] -= n
                    self.left[s] -= n
        while self._phase():
            pass

    def _phase(self) -> bool:
        """Words along all shortest paths; a path goes from a pattern to a source, and back to a pattern that feeds it."""
        depth = {p: 0 for p, n in enumerate(self.offer) if n}
        reach: dict = {}
        layer, d, found = list(depth), 0, False
        while layer and not found:
            after = []
            for p in layer:
                for s in self.patterns[p]:
                    if s not in reach:
                        reach[s] = d
                        if self.left[s]:
                            found = True
                        elif not found:
                            after += [q for q in self.fed.get(s, ()) if q not in depth and depth.setdefault(q, d + 1) == d + 1]
            layer, d = after, d + 1
        if not found:
            return False
        last = d - 1
        ways = {}

        def way(p: int):
            for s in self.patterns[p]:
                if reach.get(s) == depth[p]:
                    if depth[p] == last:
                        if self.left[s]:
                            yield s, None
                    else:
                        for q in list(self.fed.get(s, ())):
                            if depth.get(q) == depth[p] + 1 and self.sent[q].get(s):
                                yield s, q

        for start in [p for p, k in depth.items() if k == 0]:
            path: list[tuple] = []  # (pattern, source, pattern that gives way there)
            at = start
            while self.offer[start]:
                step = ways.get(at) or ways.setdefault(at, [way(at), None])
                if step[1] is None or not self._open(step[1]):
                    step[1] = next(step[0], None)
                if step[1] is None:
                    if not path:
                        break
                    at = path.pop()[0]
                    ways[at][1] = None
                    continue
                s, q = step[1]
                path.append((at, s, q))
                if q is not None:
                    at = q
                    continue
                n = min(self.offer[start], self.left[s], *[self.sent[y][x] for _, x, y in path[:-1]])
                for p, x, y in path:
                    self._send(p, x, n)
                    if y is not None:
                        self.sent[y][x] -= n
                        if not self.sent[y][x]:
                            self.fed[x].pop(y, None)
                self.offer[start] -= n
                self.left[s] -= n
                path, at = [], start
        return True

    def _open(self, step: tuple) -> bool:
        s, q = step
        return bool(self.left[s]) if q is None else bool(self.sent[q].get(s))


def mix_sources(docs: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """Adds ``source_size``, ``target`` (of the row's source; of several, their sums) and ``taken`` (words, repeats counted).

    ``source`` is a string or an array of strings: the sources that a document belongs to; null is a source of its own, an
    empty array belongs to none and gives nothing. ``size`` counts words; null counts as 0. Sources in order of code points,
    null last, have the weights in turn. A pattern's words are taken whole as often as the flow fills it; the rest comes from
    its documents in a seeded order of hashes, the last of them in part, so that a source's taken words meet its target to
    within a word. No document gives more than ``most`` times its size. Reruns agree: the order follows from ids and sizes;
    rows that repeat are told apart by nothing and may be swapped. Columns of the added names are replaced. An empty table
    gives no rows. With more than MOST_PATTERNS distinct sets of sources, none of them of several, the targets are the quotas and
    no flow is solved (``plan_many``); so many overlapping sets raise a ValueError, as their flow is solved on the driver.

    The order is dealt by buckets of hashes: sums for each bucket find the one where a pattern's rest ends, and only its
    documents are sorted, so that a hot source is never sorted in one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    array = docs.schema[source].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.col(source))) if array else F.array(F.col(source).cast("string"))
    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    rows = docs.select(*kept, F.coalesce(F.to_json(members), F.lit("[null]")).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_size"))
    summed = rows.groupBy("_key").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
    total = summed.limit(MOST_PATTERNS + 1).collect()
    if len(total) > MOST_PATTERNS:
        summed = cut(summed, "patterns")
        docs_in_all = summed.agg(F.sum("n")).first()[0]
        return _dealt(rows, plan_many(summed, weights, share, most), docs_in_all, kept, doc_id, small=False)
    patterns = [(tuple(json.loads(r["_key"])), int(r["words"])) for r in sorted(total, key=lambda r: r["_key"])]
    keys = sorted(r["_key"] for r in total)
    sizes: dict = {}
    for sources, words in patterns:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    aims = targets(sizes, weights, share, most)
    flows = route(patterns, {s: int(t + Fraction(1, 2)) for s, t in aims.items()}, most)

    plan = []
    for key, (sources, words), flow in zip(keys, patterns, flows, strict=True):
        full, rest = divmod(sum(flow.values()), words) if words else (0, 0)
        plan.append((key, sum(sizes[s] for s in sources), float(sum(aims[s] for s in sources)), full, rest))
    planned = spark.createDataFrame(plan, PLAN)  # a row for each pattern, MOST_PATTERNS at most
    size = sum(len(r["_key"]) + 40 for r in total)
    return _dealt(rows, planned, sum(r["n"] for r in total), kept, doc_id, small=size <= BROADCAST_BYTES)


#: What documents of a pattern give: whole copies and words of a rest.
PLAN = "_key string, source_size long, target double, _full long, _rest long"


def plan_many(patterns: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """The plan of very many patterns of one source each, which need no flow: a source's quota is its target.

    ``patterns``: _key, words. The same targets as ``targets`` gives, by rounds over the sharded sources: sums of the sources
    that are still open, until none is above ``most`` times its size. Patterns of several sources raise a ValueError.
    """
    if patterns.where(F.size(F.from_json("_key", "array<string>")) > 1).limit(1).count():
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns, some of several sources")
    of = patterns.select("_key", F.from_json("_key", "array<string>").alias("_m"), F.col("words").cast("decimal(38,0)").alias("words")).withColumn("_s", F.get("_m", F.lit(0)))
    none = of.where(F.size("_m") == 0).select("_key", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("_full"), F.lit(0).cast("long").alias("_rest"))
    ordered = of.where(F.size("_m") == 1).repartitionByRange(F.col("_s").isNull(), "_s").sortWithinPartitions(F.col("_s").isNull(), "_s")
    numbered = cut(ordered.withColumn("_id", F.monotonically_increasing_id()).select("_key", "words", "_id"), "sources")
    # ids count up from the start of each partition: its number times 2 ** 33
    sizes = sorted((r["p"], r["n"]) for r in numbered.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, {}
    for p, n in sizes:
        starts[p], before = before, before + n
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.shiftright("_id", 33))
    place = (first + F.col("_id").bitwiseAND((1 << 33) - 1)) % len(weights)
    now = numbered.select("_key", "words", F.get(F.array(*[F.lit(w).cast("decimal(38,0)") for w in weights]), place.cast("int")).alias("w"), F.lit(True).alias("open"))
    down = share.denominator
    left = share.numerator * int(now.agg(F.sum("words")).first()[0])  # of ``down`` parts
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    while True:
        weight = int(now.where("open").agg(F.sum("w")).first()[0] or 0)
        over = F.col("open") & (F.col("w") * big(left) > F.col("words") * big(down * most * weight))
        taken = now.where(over).agg(F.sum("words")).first()[0] if weight else None
        if taken is None:
            break
        now = cut(now.withColumn("open", F.col("open") & ~over), "open")
        left -= down * most * int(taken)
    quota = F.when(F.col("open"), F.expr(f"cast(floor((2 * w * cast('{left}' as decimal(38,0)) + cast('{down * weight}' as decimal(38,0))) / cast('{2 * down * weight}' as decimal(38,0))) as bigint)") if weight else F.lit(0)).otherwise((F.col("words") * most).cast("long"))
    target = F.when(F.col("open"), F.col("w").cast("double") * (left / (down * weight)) if weight else F.lit(0.0)).otherwise((F.col("words") * most).cast("double"))
    size = F.col("words").cast("long")
    planned = now.select("_key", size.alias("source_size"), target.alias("target"), quota.alias("_q"), size.alias("_n"))
    full = F.coalesce(F.expr("_q div nullif(_n, 0)"), F.lit(0))
    return planned.select("_key", "source_size", "target", full.alias("_full"), F.when(F.col("_n") > 0, F.col("_q") - full * F.col("_n")).otherwise(F.lit(0)).alias("_rest")).unionByName(none)


def _dealt(rows: DataFrame, planned: DataFrame, docs_in_all: int, kept: list[str], doc_id: str, small: bool) -> DataFrame:
    """``taken`` of every row by the plan of its pattern, which is sent where it is small: the order of hashes is dealt by buckets."""
    sent = F.broadcast if small else lambda df: df
    buckets = 1 << min(16, max(6, (docs_in_all // 2000).bit_length()))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - buckets.bit_length() + 1).cast("int"))
    # at most patterns * buckets sums, ordered within a pattern
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("w"))
    before = F.sum("w").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("w")
    ends = sums.withColumn("_before", before).join(sent(planned.select("_key", "_rest")), "_key").where("_before <= _rest and _rest < _before + w").select("_key", F.col("_bucket").alias("_end"), "_before")
    planned = planned.join(ends, "_key", "left")
    dealt = rows.join(sent(planned), "_key")
    whole = dealt.where("_end is null or _bucket <> _end").withColumn("_part", F.when(F.col("_bucket") < F.col("_end"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("_key").orderBy("_hash", doc_id, "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_ = dealt.where("_bucket = _end").withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before") - (F.sum("_size").over(order) - F.col("_size")))).cast("long"))
    out = whole.unionByName(cut_)
    return out.select(*kept, "source_size", "target", (F.col("_full") * F.col("_size") + F.col("_part")).alias("taken"))
