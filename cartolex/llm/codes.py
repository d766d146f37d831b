"""Vector codes: each part of a vector is named by the nearest of 256 entries, found by an exponion search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import cut, drop_cut, sized, tidy, working

#: Vectors that one numpy pass handles.
ROWS = 8192
#: Integers up to this size are exact in doubles.
EXACT = 2.0**52
LONG = 2**63 - 1
#: Labels with more than this part of the rows are hot: there are at most as many of them.
HOT = 1000


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers: by a product of doubles where that is exact, else by Python's integers."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    most = max(float(np.abs(x).max()), float(np.abs(c).max())) if x.size else 0.0
    if 4 * most * most * max(1, x.shape[1]) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1)


class Exponion:
    """Nearest entries of one codebook: for each entry the others by distance from it, ties by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = distances(entries, entries)
        self.order = np.stack([np.array(sorted(range(len(entries)), key=lambda j: (row[j], j)), np.int64) for row in between])
        self.apart = np.take_along_axis(between, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of each row, the lower index of equal ones, and the distances made.

        An entry as near as the start's lies within twice the row's distance from the start's entry, by the triangle
        inequality; with squares, within four times. So the start's list is scanned up to that radius, which holds every
        entry that can win or tie.
        """
        found, least, made = start.copy(), None, 0
        by = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by], prepend=-1, append=-1))
        parts = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows, s = by[lo:hi], int(start[by[lo]])
            own = distances(x[rows], self.entries[s : s + 1])[:, 0]
            # rows of a like radius are scanned together, each group up to its widest
            turn = np.argsort(own, kind="stable")
            rows, own = rows[turn], own[turn]
            ends = np.searchsorted(self.apart[s], 4 * own, side="right")
            at = 0
            while at < len(rows):
                end = int(np.searchsorted(ends, max(ends[at] + 8, ends[at] * 5 // 4), side="right"))
                listed = np.sort(self.order[s, : ends[end - 1]])
                d = distances(x[rows[at:end]], self.entries[listed])
                made += d.size
                best = d.argmin(1)  # the first of equal ones, and the listed indexes ascend
                found[rows[at:end]] = listed[best]
                parts.append((rows[at:end], d[np.arange(end - at), best]))
                at = end
        least = np.zeros(len(x), object if any(d.dtype == object for _, d in parts) else np.int64)
        for rows, d in parts:
            least[rows] = d
        return found, least, made


def _ints(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code (array of one index for each part), error, label_error, codebooks_sha256 of each vector that is kept.

    Rows whose vector is null, empty or holds null or non-finite components go. A component x counts as floor(scale * x), within
    a long's range, and a vector falls into ``parts`` equal parts. The first entries of each part are those of the smallest ids
    (of equal ids, the smaller vectors first; a null id comes last), fewer where there are fewer rows. Each round assigns every
    part to the nearest entry, the lower index of equally near ones, and moves each entry to the floor of its parts' mean;
    entries without parts stay. After the rounds parts are assigned once more; ``error`` sums their squared distances,
    ``label_error`` sums that over the rows of a label, nulls together; both stop at a long's end.

    Vectors of different lengths have codebooks of their own, and lengths that parts don't divide are filled with zeros. Repeated
    rows count each time. Other columns are not used. An empty table gives no rows.

    Entries (at most ``entries`` times a vector's numbers for each length) are all that the driver holds and sends. A round
    reads the table of the round before, in which each row carries its last code, where its search starts; sums of a task are
    added up by entry and component.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    said = vectors.schema[label].dataType.simpleString()
    v = F.col("_v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("_v")).where(fine)
    rows = rows.withColumn("_v", F.transform("_v", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    width = (F.ceil(F.size("_v") / parts) * parts).cast("int")
    rows = rows.select("id", "label", F.concat("_v", F.array_repeat(F.lit(0).cast("long"), width - F.size("_v"))).alias("v"), F.array_repeat(F.lit(0).cast("smallint"), parts).alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"))
    table = cut(rows, "codes")
    # for each length the rows with the smallest ids: an aggregate that holds no more than the entries of a length
    first = F.struct(F.col("id").isNull().alias("last"), "id", "v")
    widths = [r["w"] for r in table.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]
    books: dict[int, list[np.ndarray]] = {}
    for w in widths:
        top = table.where(F.size("v") == w).select(first.alias("f")).orderBy("f").limit(entries).select("f.v").toArrow()
        books[w] = list(np.moveaxis(_ints(top["v"].combine_chunks(), w).reshape(-1, parts, w // parts), 1, 0).copy())

    schema = f"id {kind}, label {said}, v array<bigint>, code array<smallint>, error decimal(38,0)"

    def assign(table: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            working("codes")
            search: dict[tuple[int, int], Exponion] = {}
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    sizes = batch.column(2).value_lengths().to_numpy()
                    for w in np.unique(sizes):
                        part = batch.filter(pa.array(sizes == w))
                        x, last = _ints(part.column(2), w), _ints(part.column(3), parts)
                        code, error = np.empty_like(last), 0
                        for p in range(parts):
                            if (w, p) not in search:
                                search[w, p] = Exponion(sent.value[w][p])
                            code[:, p], d, _ = search[w, p].nearest(x[:, p * w // parts : (p + 1) * w // parts], last[:, p])
                            error = error + d
                        codes = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * parts), pa.array(code.ravel().astype(np.int16)))
                        error = pa.array(np.minimum(error, LONG).astype(np.int64), pa.int64()).cast(pa.decimal128(38, 0))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), codes, error], ["id", "label", "v", "code", "error"])

        return table.mapInArrow(tidy(run), schema)

    def moved(table: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
        """Entries after a round: high and low halves of the numbers are summed apart, so that no sum of a task overflows."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            working("codes")
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                sizes = batch.column(0).value_lengths().to_numpy()
                for w in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == w))
                    x, code = _ints(part.column(0), w), _ints(part.column(1), parts)
                    if w not in total:
                        total[w] = np.zeros((3, parts, entries, w // parts), np.int64)
                    for p in range(parts):
                        own = x[:, p * w // parts : (p + 1) * w // parts]
                        by = np.argsort(code[:, p], kind="stable")
                        at = np.flatnonzero(np.diff(code[by, p], prepend=-1))
                        some = code[by[at], p]
                        for half, y in enumerate((own >> 32, own & 0xFFFFFFFF)):
                            total[w][half, p, some] += np.add.reduceat(y[by], at, axis=0)
                        total[w][2, p, some] += np.diff(at, append=len(by))[:, None]
            for w, t in total.items():
                p, e, j = np.nonzero(t[2])
                cols = [np.full(len(p), w), p, e, j, *(t[half, p, e, j] for half in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["w", "p", "e", "j", "hi", "lo", "n"])

        out = table.select("v", "code").mapInArrow(tidy(sums), "w bigint, p bigint, e bigint, j bigint, hi bigint, lo bigint, n bigint")
        out = out.groupBy("w", "p", "e", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo", "n")])
        new = {w: [b.copy() for b in book] for w, book in books.items()}
        for r in out.toLocalIterator():  # no more than the numbers of all entries
            new[r["w"]][r["p"]][r["e"], r["j"]] = (int(r["hi"]) * 2**32 + int(r["lo"])) // int(r["n"])
        return new

    for turn in range(rounds + 1):
        later = cut(assign(table, books), "codes")
        drop_cut(table)
        table = later
        if turn < rounds:
            books = moved(table, books)

    digests = {w: ",".join(str(x) for x in np.stack(books[w]).ravel().tolist()) for w in widths}
    digest = F.lit(None).cast("string")
    for w, text in digests.items():
        digest = F.when(F.size("v") == w, F.sha2(F.lit(text), 256)).otherwise(digest)
    capped = lambda c: F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = cut(table.groupBy("label").agg(F.sum("error").alias("sum"), F.count("*").alias("n")), "labels")
    # labels with many rows are few and go to every task; those of the rest shuffle once they are many
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * HOT > F.lit(total)
    named = lambda df, to: df.select(F.col("label").alias("_l"), F.col("sum").alias(to))
    out = table.join(F.broadcast(named(sums.where(hot), "s1")), F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
    rest = out.where("s1 is null").join(sized(named(sums.where(~hot), "s2"), 64), F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
    out = out.where("s1 is not null").withColumn("s2", F.lit(None).cast("decimal(38,0)")).unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), "code", capped(F.col("error")).alias("error"), capped(F.coalesce("s1", "s2")).alias("label_error"), digest.alias("codebooks_sha256"))
