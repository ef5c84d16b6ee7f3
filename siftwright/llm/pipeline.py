"""A corpus-cleaning pipeline of five stages: language ID, line dedup, near-duplicate removal, benchmark decontamination
and SentencePiece encoding. Each stage is written as Parquet and read again as the next one's documents.

Stages keep clean documents: language ID drops texts without letters and those far above every language's calibrated
cross-entropy; line dedup only edits texts; of each group of near duplicates (five-word shingles, similarity 0.8) the
smallest doc_id stays; decontamination drops documents with at least a twentieth of their words in benchmark windows; the
last stage encodes the rest and returns token ids, their count, and the decoded text's digest. Null texts have no letters
and go in the first stage; rows that share a doc_id but not their text are documents of their own; empty tables pass
through; columns beyond those of documents are carried up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import bpe, decontaminate, flat, language, lines, nearsets
from siftwright.session import shared_folder

TOKENIZER = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that a language model of the corpus accepts."""
    model = language.train(docs)
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    return language.identify(docs, model, tuple(docs.columns), prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many sites share out of every document."""
    return lines.remove_boilerplate(docs, into=flat.free_name(docs, "n_lines_removed")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return nearsets.keep_one(docs, width=5).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    found = bpe.encode_documents(docs, TOKENIZER)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Stages of language models, similarity joins and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
