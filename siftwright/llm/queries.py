"""Queries of the numbered operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import bpe, centroids, codebooks, decontaminate, extract, labelled, language, lines, nearsets, pii, pipeline, quality, substring, toxicity, transport
from siftwright.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    cleaned = lines.remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, by suffix arrays of the documents."""
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labelled rows outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document, by content-defined chunks."""
    return substring.describe(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labelled rows outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digest_documents(documents(spark, sf_dir))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back."""
    return transport.digest_documents(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.digest_documents(documents(spark, sf_dir), pipeline.TOKENIZER)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar."""
    return nearsets.near_duplicates(documents(spark, sf_dir), width=2)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after Lloyd rounds over all of them."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a code of four codebook entries."""
    return codebooks.describe(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language": op1_language,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_personal_data": op7_personal_data,
    "op8_transport_stream": op8_transport_stream,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_centroids": op11_centroids,
    "op12_main_text": op12_main_text,
    "op13_codebooks": op13_codebooks,
    "pipeline": pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_codebooks": codebooks.ORACLE,
}
