"""Near-duplicate vectors by a pivot-permutation index: inverted lists of nearest pivots, shared-pivot counts, cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import cut, forest
from cartolex.llm.components import components

#: Pivots grow with the root of the number of vectors between these bounds; they are all that is broadcast.
LEAST_PIVOTS, MOST_PIVOTS = 32, 2048
#: Hashed classes for each pivot that separated pivots are picked from.
DRAWN = 4
#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared where they share no ball.
DESCRIBED_BY, SHARED = 10, 3
#: Vectors of one tile of an inverted list.
TILE = 768


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _separated(m: np.ndarray, most: int, angle: float) -> np.ndarray:
    """Rows in their order, each more than ``angle`` away from all those before it that stay."""
    limit, some = np.cos(min(np.pi, angle)), []
    near = m @ m.T >= limit
    free = np.ones(len(m), bool)
    for i in range(len(m)):
        if free[i] and len(some) < most:
            some.append(i)
            free &= ~near[i]
    return m[some]


def _mask(col: pa.Array, k: int) -> np.ndarray:
    """Lists of pivots as rows of ones and zeros."""
    out = np.zeros((len(col), k), np.float32)
    out[np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten().to_numpy()] = 1
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", shared: int = SHARED, described_by: int = DESCRIBED_BY) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is at least ``threshold``; ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest vec_id reached, ``kept`` says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id link with nothing
    (component_id is their own id). Vectors of one length are compared with each other, by an index for each length.
    Repeated rows are linked copies of each other. Other columns are not used; an empty table gives no rows.

    Equal vectors are one class. Pivots are picked in the order of seeded hashes, 2 * sqrt(classes) of them between the
    bounds above, so that no two lie within twice the threshold's angle: however many rows crowd a region, no more than one
    pivot stands there for each such ball. A vector is listed with its nearest pivots and with all pivots within three times
    the angle. Two vectors are compared if they are within that of one pivot, so no link is missed where an end of it
    is within twice the angle of a pivot; elsewhere they must share enough nearest pivots. Each inverted list is cut into
    tiles, and two tiles meet in one task; a pair counts where its lowest common pivot is the list's. Tasks give numbers of
    links and a spanning forest, never the pairs.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    v = F.col(embedding)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x.cast("double"))).alias("v"))
    good = rows.where("v is not null and id is not null")
    alone = lambda df: df.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    out = alone(rows.where("v is null or id is null"))
    for dim in [r["d"] for r in good.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]:
        out = out.unionByName(_of_length(good.where(F.size("v") == dim), dim, kind, threshold, shared, described_by))
    return out


def _of_length(good: DataFrame, dim: int, kind: str, threshold: float, shared: int, described_by: int) -> DataFrame:
    """The rows of ``near_vectors`` for vectors (id, v) of one length, by an index of their own."""
    spark = good.sparkSession
    classes = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")), "vectors")
    n = classes.count()
    k = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * n**0.5)))
    # the classes of the smallest hashes, somewhat more than are drawn, so that no task sees more than its own rows
    h = F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(1 << 40))
    sample = classes.select("v", "id", h.alias("h")).where(F.col("h") < int(min(1.0, 1.5 * DRAWN * k / max(1, n)) * (1 << 40))).toArrow()
    sample = sample.take(np.argsort(sample["h"].to_numpy(), kind="stable")[: DRAWN * k])
    angle = float(np.arccos(min(1.0, max(-1.0, threshold))))
    pivots = _separated(_unit(_matrix(sample["v"].combine_chunks(), dim)), k, 2 * angle)
    ball = np.cos(min(np.pi, 3 * angle)) - 1e-9
    k = len(pivots)
    near = min(described_by, k)
    least = min(shared, near)
    sent = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                s = _unit(_matrix(part.column(0), dim)) @ sent.value.T
                top = np.argpartition(-s, near - 1, axis=1)[:, :near]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
                close = s >= ball
                ends = np.concatenate([[0], np.cumsum(close.sum(1))]).astype(np.int32)
                perm = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * near), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, perm, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(close)[1].astype(np.int32)))], ["v", "id", "m", "perm", "close"])

    index = cut(classes.mapInArrow(describe, f"v array<double>, id {kind}, m bigint, perm array<int>, close array<int>"), "index")
    posted = index.select("v", "id", "m", "perm", "close", F.explode(F.array_union("perm", "close")).alias("p"))
    lengths = posted.groupBy("p").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # k rows at most
    posted = posted.join(F.broadcast(lengths), "p").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = posted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("p", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") == F.greatest("t", "o")).alias("second"), "id", "m", "v", "perm", "close")

    def compare(key, group):
        p, a, b = (x.as_py() for x in key)
        group = group.combine_chunks()
        size = group.num_rows
        unit = _unit(_matrix(group.column("v").combine_chunks(), dim))
        m = group.column("m").to_numpy()
        second = group.column("second").to_numpy()
        mask, close = (_mask(group.column(c).combine_chunks(), k) for c in ("perm", "close"))
        left, right = (np.arange(size),) * 2 if a == b else (np.flatnonzero(~second), np.flatnonzero(second))
        lower = np.maximum(mask, close)[:, :p]
        links, us, vs = np.zeros(size, np.float64), [], []
        for i in range(0, len(left), 1024):
            l = left[i : i + 1024]
            hit = unit[l] @ unit[right].T >= threshold
            if a == b:
                hit &= l[:, None] < right[None, :]
            if hit.any():
                # whole blocks by matrix products: in a dense list nearly all pairs are hits
                hit &= ((mask[l] @ mask[right].T >= least - 0.5) | (close[l] @ close[right].T > 0.5)) & (lower[l] @ lower[right].T < 0.5)
                links[l] += hit @ m[right].astype(np.float64)
                links[right] += hit.T @ m[l].astype(np.float64)
                x, y = np.nonzero(hit)
                us.append(l[x])
                vs.append(right[y])
        links = links.astype(np.int64)
        x, y = (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
        ids = group.column("id").combine_chunks()
        root = forest(x, y, size)
        some = np.flatnonzero((links > 0) | (root != np.arange(size)))
        return pa.table({"id": ids.take(pa.array(some)), "n": pa.array(links[some], pa.int64()), "other": ids.take(pa.array(root[some]))})

    found = cut(tiles.groupBy("p", "a", "b").applyInArrow(compare, f"id {kind}, n bigint, other {kind}"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    label = index.select("id", "m").join(counts, "id", "left").join(joined.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left")
    label = label.select(F.col("id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    owner = good.join(classes.select("v", F.col("id").alias("rep")), "v").select("id", "rep")
    return owner.join(label, "rep").select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
