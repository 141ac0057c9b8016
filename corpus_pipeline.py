"""The corpus pipeline: quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafac.llm import near_dup, packing, quality, substring_dedup
from stratafac.llm.queries import BASE_FAILED
from stratafac.llm.tables import written


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose id and text hash ``rejected`` has.

    The rejected keys are written first, so that Spark chooses the join
    knowing their size.
    """
    keys = written(rejected.select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash")).distinct(), name)
    same = F.col("row.doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("row.text") == F.col("r_hash"))
    return _as_rows(docs).select("row").join(keys, same, "left_anti").select("row.*")


def _as_rows(docs: DataFrame) -> DataFrame:
    """``text`` beside ``row``, which has all columns, so that no name clashes with a stage's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose posterior quality
    probability is below one half, go.

    Rows are written once beside their features and filtered where they lie:
    the verdict depends on the row's own votes and the fitted model, so no text
    is shuffled. Null and empty texts fail the base rules; rows alike are
    judged alike and kept each; an empty table stays empty; extra columns are
    carried under one struct, whatever their names.
    """
    judged = quality.weakly_supervised(written(quality.features(_as_rows(docs), ("row",)), "quality-features"))
    return judged.where(f"not ({BASE_FAILED}) and good").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays.

    Null and empty texts and rows with a null id are in no group and stay; rows
    that repeat an id are judged by their own texts, and those that share a
    group's smallest id stay each; an empty table stays empty; extra columns are
    carried, whatever their names.
    """
    return _without(docs, near_dup.near_duplicates(docs).where("not kept"), "near-rejected")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a document of smaller id has are cut out;
    documents without any are left as they are.

    Null texts become empty; rows with a null id lose nothing; rows that repeat
    an id are cut each on its own; an empty table stays empty; extra columns are
    carried, whatever their names, and ``n_chars`` is counted anew.
    """
    rest = {c: f"f{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    # renamed, so that no name clashes with the operator's own
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f) for c, f in rest.items()))
    out = substring_dedup.substring_dedup(named, spacing="original", carry=tuple(rest.values()))
    made = {"doc_id": F.col("id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*((made[c] if c in made else F.col(rest[c])).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequences of at most 4096 tokens and offsets.

    Null and empty texts give one piece with the end id; repeated rows and rows
    with a null id are packed each; an empty table gives no pieces; extra
    columns are ignored.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.pack(written(pieces, "pieces"), capacity=4096).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("best_fit_packing", best_fit_packing),
]

#: Label models, sketches and tokenizers are beyond SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
