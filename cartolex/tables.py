"""Tables that a plan leaves in the folder all executors share, so that lost executors redo nothing before them."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.fixtures import shared_folder

_SESSIONS: set[str] = set()


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows written and read back; the session's tables go when the program ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/cartolex-tables/{spark.sparkContext.applicationId}"
    if at not in _SESSIONS:
        _SESSIONS.add(at)
        atexit.register(drop, spark, at)
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows over as many tasks as shuffles have, by columns: for work that costs far more than its rows' bytes, which alone say how
    many tasks read a file or follow a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, order: list[Column | str], cost: str, pos: str = "pos", spent: str = "spent") -> DataFrame:
    """Adds each row's place in one order over all rows (from 1) and the sum of costs up to and with it.

    Rows are dealt by ranges of the order and written in it; what the parts before hold in all is added to each part's own sums, so
    no task sees all rows. The driver holds two numbers for each part.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = cut(parts.withColumn("_part", F.shiftright("_id", 33)), "ordered")
    sums = sorted((r["_part"], r["n"], r["c"] or 0) for r in dealt.groupBy("_part").agg(F.count("*").alias("n"), F.sum(cost).alias("c")).collect())
    before, rows, total = [], 0, 0
    for part, n, c in sums:
        before.append((part, rows, total))
        rows, total = rows + n, total + c
    ahead = df.sparkSession.createDataFrame(before, "_part long, _rows long, _total long")
    own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_id"))).withColumn("_sum", F.sum(cost).over(own))
    out = out.join(F.broadcast(ahead), "_part")  # a row for each part
    return out.withColumn(pos, F.col("_nth") + F.col("_rows")).withColumn(spent, F.coalesce("_sum", F.lit(0)) + F.col("_total")).drop("_id", "_part", "_nth", "_sum", "_rows", "_total")
