"""Documents to token ids in five stages: quality rules, exact dedup, near dedup, source mix, SentencePiece.

Every stage reads what its predecessor wrote as Parquet. Scratch tables of a
stage are deleted when the next one starts, since its result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import exact_dedup, mixing, ngram_join, pieces_fst, quality
from yieldloom.llm.common import release, stage, staging_for, vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    """What the pipeline's last stage left in the scratch folder goes first; tables staged by others stay."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with staging_for("pipeline"):
            return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    return quality.keep_good(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a fixed row number: the whole rows as ``doc``, and (doc_id, text, row) of them."""
    rows = stage(docs.select(F.struct("*").alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows, rows.select("doc.doc_id", "doc.text", "row")


@_stage
def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    rows, slim = _numbered(docs)
    stays = exact_dedup.exact_dedup(slim, row_col="row").where("kept").select(F.col("row_id").alias("row"))
    return rows.join(stays.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the row with the smallest doc_id stays; documents without a word stay.

    Similar are a Jaccard of 0.8 or more on five-word shingles; the 0.85 on four words of ``op3_ngram_join`` are that query's own.
    """
    rows, slim = _numbered(docs)
    found = ngram_join.ngram_components(slim, k=5, percent=80, row_col="row").select("doc_id", "component", "row_id")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row_id"))["row_id"].alias("row"))
    stays = first.select("row").union(found.where("component is null").select(F.col("row_id").alias("row")))
    return rows.join(stays.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once per repeat that the mix starts; the document that crosses a source's budget is given whole."""
    sized = docs.select(F.col("doc_id"), F.col("source"), mixing.n_words("text").alias("size"), F.struct("*").alias("doc"))
    weighed = mixing.with_quality(sized, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix_sources(weighed, weight="quality_weight").where("copies > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "doc").select("doc.*")


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and what decoding them again shows."""
    return pieces_fst.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", dedup_exact),
    ("ngram_jaccard_join", dedup_near),
    ("mix_sources", mix),
    ("sentencepiece", sentencepiece),
]

#: The compression bands of the first stage can't be said in SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage gives is written to the shared scratch folder and read again."""
    from yieldloom.session import scratch_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES[:-1]:
        made = stage_of(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
