"""The registered queries of the subpackage: thin calls that apply one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import collocation, decontaminate, line_dedup, mixing, secrets, spelling, warc
from driftwell.llm.fingerprint import edit_report
from driftwell.llm.near_dedup import NearDedup, near_duplicates
from driftwell.llm.quality import quality_scores
from driftwell.llm.quote_linking import linked_conversations
from driftwell.llm.substring_dedup import repeated_strings
from driftwell.llm.token_rollup import corpus_rollup

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them go with templates that recur across documents, and the digest of the rest."""
    out = line_dedup.drop_recurring_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over four-word shingles at a similarity of 0.8."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), NearDedup(width=4))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document, learnt from the labels that are not held out."""
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, good labels drawing first."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(spark, docs, mixing.label_weights(docs, table(spark, sf_dir, "labels"))).drop("source")


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotations, with what they answer and their thread."""
    return linked_conversations(spark, table(spark, sf_dir, "conversations"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return decontaminate.contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, after inserts, deletes and revisions."""
    return corpus_rollup(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in 50-byte strings of earlier documents, and the digest of the rest."""
    return repeated_strings(spark, table(spark, sf_dir, "documents")).drop("kept")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and of its edited text."""
    return edit_report(spark, table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, and which values only few owners have."""
    return secrets.secret_report(spark, table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the words one edit from it, its form and the root of its forms."""
    return spelling.spelling_variants(spark, table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from its WARC record."""
    return warc.page_report(spark, table(spark, sf_dir, "pages"))


def op13_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of two and three words of every language."""
    return collocation.collocations(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_minhash_near_dedup, op3_quality_classifier, op4_source_mixing, op5_quote_linking, op6_benchmark_decontamination, op7_token_rollup, op8_suffix_dedup, op9_document_fingerprints, op10_secret_scan, op11_spelling_variants, op12_warc, op13_phrase_collocation)
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op6_benchmark_decontamination": decontaminate.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_phrase_collocation": collocation.ORACLE,
}
