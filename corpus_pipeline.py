"""The training-data pipeline: five of the llm operators over `documents`, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the folder that the cluster shares
and read again as the next stage's docs. All but the last return the columns of documents. Each begins with executors that
have given back the heap that the stage before it needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import decontamination, language, neardup, packing, quality
from sievelight.llm.tables import give_back, store

#: Some stages can't be expressed in SQL (trained models, byte-pair ids); tests/llm/test_queries.py holds every stage
#: against a plain computation on what its predecessor kept.
ORACLE_SQL: str | None = None
#: This share of the labelled documents that the network wasn't fitted on, and told rightly, may be less sure than the bar.
TAIL = 0.001
#: From fewer of them no bar is taken: the least sure of a handful says nothing about a tail.
FEWEST = 30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents sampled by importance resampling."""
    give_back(spark)
    return quality.filter_documents(docs, _table(spark, sf_dir, "labels"))


def least_sure(told: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> float:
    """The bar below which a language isn't told surely, from all labelled documents left out of the fit; 0 if fewer than FEWEST are told rightly."""
    right = told.where((language.remainder(id_col, 5) == 0) & (F.col(lang_col) == F.col("lang_pred")))
    n, bar = right.agg(F.count("*"), F.percentile(F.floor(F.col("score") * 1000) / 1000, F.lit(TAIL))).first()
    return bar if n >= FEWEST else 0.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a letter whose language is told no less surely than nearly all that are told rightly."""
    give_back(spark)
    net = language.learn(docs, language.remainder("doc_id", 5) != 0)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    told = store(language.identify(docs.select(*(F.col(c).alias(own[c]) for c in docs.columns)), net, text_col=own["text"]), "told")
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= least_sure(told, own["doc_id"], own["lang"])))
    return kept.select(*(F.col(own[c]).alias(c) for c in docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (shingles of five words, similarity 0.8)."""
    give_back(spark)
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without any benchmark passage of ten words."""
    give_back(spark)
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 1024 tokens."""
    give_back(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
