"""The corpus pipeline: documents through five operators, each stage over all that its predecessor kept.

Every stage takes documents with any further columns, of any names, and gives those columns back; an empty table gives an
empty one.  What a stage does with nulls, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, line_dedup, mixing, quality
from driftwell.llm.near_dedup import NearDedup, near_duplicates
from driftwell.llm.queries import table
from driftwell.llm.rows import without
from driftwell.llm.scratch import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others.  Of rows that repeat a doc_id all go when every one is rejected, else all
    stay; rows without doc_id stay.  A score at the threshold is accepted.
    """
    scored = quality.quality_scores(spark, docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("doc_id is not null").groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id")
    return without(docs, Scratch(spark, "pipeline-quality").keep(rejected, "rejected"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur in different documents; n_chars follows the text where there is one.

    Null texts stay null; a document of recurring lines only stays with an empty text, and is no one's copy from then on.  Rows
    that repeat a document are decided alike and both stay; copies of a text count as one document.
    """
    out = line_dedup.drop_recurring_lines(spark, docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates (five words a shingle, similarity 0.8).

    Null and blank texts are no one's copies and stay, and so do rows without doc_id.  Rows with equal doc_id and text are
    one row; rows with equal doc_id and different texts are one document and share its fate.
    """
    scratch = Scratch(spark, "pipeline-near")
    found = near_duplicates(spark, docs, NearDedup())
    copies = scratch.keep(found.where("not kept").select("doc_id").distinct(), "copies")
    return without(docs, copies, once=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain nothing.  Of rows that repeat a doc_id all go when one contains an item; rows without doc_id
    stay.  At exactly 80 % of an item's shingles a document contains it.
    """
    return decontaminate.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document that is left: doc_id, source, size, source_size, target, taken.

    One row for every row.  Null sources are one source; null texts have no words; documents with equal keys are taken in
    the order of their ids and sizes.
    """
    return mixing.mix_sources(spark, docs, mixing.label_weights(docs, table(spark, sf_dir, "labels")))


STAGES = [
    ("quality", good_documents),
    ("lines", without_boilerplate),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: A classifier is no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
