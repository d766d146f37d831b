"""The corpus pipeline: five stages over documents, each judging all that the stage before it kept.

Every stage but the last returns the columns of its input, in order; columns beyond those of documents pass unchanged,
whatever their names. Stages work on whole texts of any length; an empty table stays empty. What becomes of null texts,
empty texts, repeated rows and ties is said at each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm import bpe, minhash, mixing, pii, quality
from cartolex.llm.common import cut, sized
from cartolex.llm.queries import trusted_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeps_columns(stage: Stage) -> Stage:
    """Further columns go by names of their own inside the stage, so that they clash with none of the operators' columns."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c: c if c in COLUMNS else f"__further_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*inside.values()), sf_dir)
        return out.select(*inside.values()).toDF(*inside)

    return run


@keeps_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, and with them null texts and texts without a word. Rows are judged
    one by one: repeated rows have one fate, and texts at the threshold stay."""
    return quality.judge_quality(docs, trusted_documents(spark, sf_dir)).where("kept").select(*docs.columns)


@keeps_columns
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id; of repeated rows of one id, the first text.

    Texts that are null or hold no word have no duplicates, and rows with a null id stay.
    """
    judged = minhash.near_duplicates(docs, size=5, percent=80)
    # a row that repeats an id keeps one text: both sides come down to one row for each id
    gone = cut(judged.where("not kept").select("doc_id").distinct(), "gone")
    kept = docs.join(sized(gone, 24), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.count():
        return kept
    again = kept.join(sized(twice, 24), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", "lang", "source")).alias("row"))
    return kept.join(sized(twice, 24), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*"))


@keeps_columns
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks, of spans that meet to one mark; n_chars follows. Null texts stay null."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    clean = pii.find_pii(docs, keep=rest, redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@keeps_columns
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole; those that it doesn't take go, and with them texts that
    are null or hold no word. A null source is one of its own. Documents of one hash are taken by id and size; rows that
    repeat are told apart by nothing, and any of them may be the one that is taken."""
    sizes = docs.withColumn("size", mixing.n_words(F.col("text")))
    mixed = mixing.mix_sources(sizes, weights=(3, 1, 2), share=Fraction(3, 2))
    times = F.floor(F.try_divide("taken", "size") + 0.5).cast("int")
    taken = mixed.where("size > 0").withColumn("_times", times).where("_times > 0")
    return taken.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether decoding them gives the text back; null counts as empty and has no tokens.
    Further columns go."""
    import public_tokenizers

    ranks, pattern = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN
    docs = docs.select("doc_id", "text", "lang", "source").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = bpe.encode_bpe(docs, ranks, pattern, decode=True)
    decoded = F.sha2("decoded", 256)
    return back.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("same"))


STAGES = [("quality", quality_stage), ("minhash", dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", token_stage)]

#: Models and seeded hashes of the stages are beyond SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
