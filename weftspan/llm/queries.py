"""Queries of the text problems: each applies its operator, with the settings used in production, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.llm.leakage import find_leaks, leak_spans
from weftspan.llm.subjects import SubjectModel, assign_subjects, cell_claims, fit_subjects, index_cells, top_terms
from weftspan.llm.tokens import decode_ids, encode_texts
from weftspan.runtime import table


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_texts(table(spark, base, "documents"))


def p6_counts(spark: SparkSession, base: str) -> DataFrame:
    """Documents, characters and tokens per source and format."""
    docs = table(spark, base, "documents")
    sizes = encode_texts(docs.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n_ids"))
    about = docs.select("doc_id", "source", "nb_format", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return about.join(sizes, "doc_id").groupBy("source", "nb_format").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_characters"), F.sum("n_ids").alias("n_tokens"))


def p6_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    back = decode_ids(encode_texts(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p7_spans(spark: SparkSession, base: str) -> DataFrame:
    """Where the passages are: cell, output and offsets in it."""
    return leak_spans(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    """Leaks per benchmark: items that leaked, documents that hold some."""
    items = table(spark, base, "eval_items").select("item_id", "benchmark")
    return p7_found(spark, base).join(items, "item_id").groupBy("benchmark").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_leaks"))


_models: dict[tuple[str, str], SubjectModel] = {}


def _model(spark: SparkSession, base: str, anew: bool = False) -> tuple[SubjectModel, DataFrame]:
    """The fitted model and the indexed cells. Its small tables are kept for the session's other queries of the folder."""
    key = (spark.sparkContext.applicationId, base)
    docs, items = table(spark, base, "documents"), table(spark, base, "eval_items")
    if key in _models and not anew:
        return _models[key], index_cells(docs, _models[key], items)
    _models[key], indexed = fit_subjects(docs, table(spark, base, "subject_areas"), items)
    return _models[key], indexed


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return assign_subjects(*_model(spark, base, anew=True)).select("doc_id", "subject")


def p8_cells(spark: SparkSession, base: str) -> DataFrame:
    """The subject of each cell that has one, and how many of its terms that subject claims."""
    m, indexed = _model(spark, base)
    return cell_claims(indexed, m.table, m.topics).select("doc_id", F.col("cell").alias("cell_no"), "subject", F.round("weight", 3).alias("n_terms"))


def p8_topics(spark: SparkSession, base: str) -> DataFrame:
    """Topics with their subjects and top terms, for inspection."""
    m, _ = _model(spark, base)
    rows = [(k, s, ", ".join(words)) for k, (s, words) in enumerate(zip(m.topics, top_terms(m.table, list(m.terms), 20)))]
    return spark.createDataFrame(rows, "topic int, subject string, top_terms string")


def p8_composition(spark: SparkSession, base: str) -> DataFrame:
    """Notebooks and cells per subject and source; a notebook of several subjects counts for each."""
    found = assign_subjects(*_model(spark, base))
    docs = table(spark, base, "documents").select("doc_id", "source")
    return docs.join(found, "doc_id", "left").groupBy("source", F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce("n_cells", F.lit(0))).alias("n_cells"))


def p8_label_agreement(spark: SparkSession, base: str) -> DataFrame:
    """Labels of raters, which took no part in the fit, and how many of them the assignment has."""
    found = assign_subjects(*_model(spark, base)).select("doc_id", "subject", F.lit(1).alias("hit"))
    labels = table(spark, base, "doc_subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("subject is not null")
    return labels.join(found, ["doc_id", "subject"], "left").groupBy("subject").agg(F.count(F.lit(1)).alias("n_labels"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found"))


QUERIES = {"p6_ids": p6_ids, "p6_counts": p6_counts, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_spans": p7_spans, "p7_report": p7_report, "p8_found": p8_found, "p8_cells": p8_cells, "p8_topics": p8_topics, "p8_composition": p8_composition, "p8_label_agreement": p8_label_agreement}

ORACLES = {"p6_round_trip": "select doc_id, true as same from documents"}
