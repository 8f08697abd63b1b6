"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import decontam, langid, lines, neardup, packing
from fleetloom.llm.queries import LANGUAGE_FOLDS, LANGUAGE_HELD_OUT, SEQUENCE, TOKENIZER, fold_of
from fleetloom.session import checkpoint_folder, prepare_session


def _held(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator adds: ``text`` stays, the others are numbered."""
    return docs.toDF(*[c if c == "text" else f"held_{i}" for i, c in enumerate(docs.columns)])


def _as_before(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, back under their names."""
    return found.select(*[F.col(h).alias(c) for h, c in zip(_held(docs).columns, docs.columns, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: one without text (null or empty) or letters is rejected, repeated rows alike.

    The model learns as the query's does. An empty table stays empty; other columns may have any names.
    """
    held_out = F.coalesce(fold_of("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT, F.lit(False))
    model = langid.train(docs.where(~held_out))
    held = _held(docs)
    return _as_before(langid.predict(held, model, held.columns).where(F.col("lang_pred") != langid.UNDETERMINED), docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate on their source; ``n_chars`` follows the text.

    Equal texts are one page of a source, and a page that is mostly made of common lines keeps them, so a document that
    was copied, exactly or nearly, stays whole for the next stage. A null source is a source, a null text stays null.
    """
    kept = lines.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates, with all its rows where it is repeated.

    Documents without an id stay, and so do those without words, which resemble nothing.
    """
    kept = neardup.near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi")
    return known.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of ``benchmark``; null texts and an empty benchmark overlap nothing."""
    held = _held(docs)
    found = decontam.find_leaks(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), held.columns)
    return _as_before(found.where(F.size("items") == 0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; a null text is empty, a repeated row has pieces of its own."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE)


STAGES = [
    ("language", language),
    ("boilerplate", boilerplate),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language identification and packing cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written as Parquet and read again."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
