"""A corpus pipeline of four stages: language ID, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import decontaminate, jaccard_join, language_id, packing
from tomewright.llm.workspace import with_row_key, written

#: A text whose best language explains less than this share of its trigrams is rejected.
LEAST_LANGUAGE_SCORE = 0.3
ROW = "__tomewright_row"
#: None: SQL cannot express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined with a fair score; learns from all labelled rows."""
    return language_id.keep_determined(docs, language_id.train(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by five-word shingles at a similarity of 0.8: that of the smallest doc_id.

    Rows are told apart by their place, not their id: of rows that share the smallest id the first stays, a null id
    comes after all others, and a text without a link stays whatever its id.
    """
    keyed = with_row_key(docs, ROW, "doc_id")
    groups = jaccard_join.near_duplicates(keyed, 5, 80, doc_id=ROW)
    gone = groups.where("doc_id <> component_id").select("doc_id.file", "doc_id.at")
    here = (F.col(f"{ROW}.file") == gone["file"]) & (F.col(f"{ROW}.at") == gone["at"])
    return keyed.join(gone, here, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows with their sequence and place."""
    pieces = written(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces).drop("piece_key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
