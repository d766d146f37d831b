"""Exact top-k inner products: candidates by descending length, partial sums in a rotated basis, residual bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import cut

#: Queries that one pass over the candidates answers; their vectors are all that is broadcast.
QUERY_BLOCK = 8192
#: Longest vectors that give the first lower bounds of a pass.
SEED_ROWS = 4096
#: Beyond this, sums of products are not exact in doubles, and integers are used.
EXACT = 2.0**52
LONG = 2**63 - 1
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def usable(vec: str):
    """Holds no null and only finite numbers; an empty array has nothing to score."""
    v = F.col(vec)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond a long's range they stop at its ends."""
    if not len(q) or not len(v) or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(big, -LONG - 1, LONG).astype(np.int64)


class Best:
    """The k best (score descending, id ascending) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.least = np.full(n, -np.inf)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.id[i], ids])
        order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == -LONG - 1 else -score))[: self.k]
        self.score[i], self.id[i] = score[order], ids[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], float(self.score[i][-1]))


def scan(batches: Iterator[tuple[np.ndarray, np.ndarray]], qid: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """Goes through candidates by descending length. ``floor``: a score that the k-th best of each query reaches."""
    head = max(1, q.shape[1] // 4)
    qr = q @ turn
    q_len, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(qr[:, head:], axis=1)
    best = Best(len(q), k)
    best.least = floor.astype(np.float64).copy()
    for ids, v in batches:
        v_len = np.linalg.norm(v, axis=1)
        slack = 1e-9 * (1 + q_len * v_len.max())
        open_ = np.flatnonzero(q_len * v_len.max() + slack >= best.least)
        if not len(open_):
            break  # no later vector is longer
        vr = v @ turn
        bound = qr[open_, :head] @ vr[:, :head].T + q_rest[open_, None] * np.linalg.norm(vr[:, head:], axis=1)[None, :] + slack[open_, None]
        hit = bound >= best.least[open_, None]
        hit &= qid[open_, None] != ids[None, :]
        for row in np.flatnonzero(hit.any(1)):
            i, at = open_[row], np.flatnonzero(hit[row])
            best.add(i, exact_scores(q[i : i + 1], v[at])[0], ids[at])
    return best


def top_k_inner(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """For each query the k highest integer inner products over all other rows: query_id, rank (from 1), vec_id, score.

    Each component x counts as floor(scale * x). Ties go to the smaller id; with fewer candidates than k all come. Rows
    with a null id, a null or empty vector, or one that holds null or non-finite components take no part. A query is
    compared with the vectors of its length, and leaves out the rows of its own id. Repeated rows count each time; a query id
    that repeats is answered once, by its first vector in array order. Scores beyond a long stop at its ends.
    An empty table gives no rows. Other columns are not used.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        return df.where(usable(embedding) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))

    ints = whole(vectors).withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asked = whole(queries)
    answers = []
    for dim in [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]:
        answers += _of_length(ints.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, k)
    out = answers[0] if answers else spark.createDataFrame(pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64"), SCHEMA)
    for part in answers[1:]:
        out = out.unionByName(part)
    # at most k rows for a query and task; the best k of them by a sorted array
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("n"), F.col("vec_id"), F.col("score")))), 1, k)
    out = out.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _of_length(ints: DataFrame, asked: DataFrame, dim: int, k: int) -> list[DataFrame]:
    """Candidate answers (query_id, vec_id, score) of vectors of one length: at most k for each query and task, the best among them."""
    spark = ints.sparkSession
    answers = []

    def gram(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b.column(0), dim)
            m = m / max(1.0, np.abs(m).max(initial=0.0))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    # a dim x dim sum for each task, added up by row on the executors
    sums = ints.select("v").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    square = np.zeros((dim, dim))
    for r in sums.collect():  # dim * dim numbers
        square[r["i"], r["j"]] = r["x"]
    turn = np.linalg.svd(square)[0]

    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    n_asked = asked.count()
    blocks = max(1, math.ceil(n_asked / QUERY_BLOCK))
    ordered = ints.repartitionByRange(F.desc("len2"), F.col("id")).sortWithinPartitions(F.desc("len2"))
    if blocks > 1:
        asked, ordered = cut(asked.repartitionByRange(blocks, "id"), "queries"), cut(ordered, "candidates")
        # the range partitions of the written table are the blocks: one row for each
        bounds = sorted(r["id"] for r in asked.groupBy(F.input_file_name()).agg(F.min("id").alias("id")).collect())
        blocks = len(bounds)
    seeds = ints.orderBy(F.desc("len2"), "id").limit(SEED_ROWS).toArrow()
    sv, sid = matrix(seeds["v"], dim), seeds["id"].to_numpy()

    for b in range(blocks):
        block = asked
        if blocks > 1:
            block = asked.where(F.col("id") >= bounds[b]) if b + 1 >= len(bounds) else asked.where((F.col("id") >= bounds[b]) & (F.col("id") < bounds[b + 1]))
        rows = block.orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        qid, q = rows["id"].to_numpy(), matrix(rows["v"], dim)
        floor = scan(((sid[i : i + 512], sv[i : i + 512]) for i in range(0, len(sid), 512)), qid, q, np.full(len(q), -np.inf), turn, k).least
        sent = spark.sparkContext.broadcast((qid, q, floor, turn))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, floor, turn = sent.value

            def parts():
                for batch in batches:
                    ids, v = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
                    for i in range(0, len(ids), 1024):
                        yield ids[i : i + 1024], v[i : i + 1024]

            best = scan(parts(), qid, q, floor, turn, k)
            for _ in batches:
                pass
            n = [len(x) for x in best.id]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n), pa.int64()), pa.array(np.concatenate(best.id), pa.int64()), pa.array(np.concatenate(best.score), pa.int64())], ["query_id", "vec_id", "score"])

        part = ordered.select("id", "v").mapInArrow(run, SCHEMA)
        answers.append(part if blocks == 1 else cut(part, "answers"))
    return answers
