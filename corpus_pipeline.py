"""The training-data pipeline: five operators of marlstone.llm in a row over ``documents``.

Each stage takes the documents that its predecessor kept and returns documents, the last the packed
pieces.  ``run`` writes each stage to the shared folder and rereads it, so a lost executor never
costs more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import DOCUMENT_COLUMNS, read, write_table
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.language_id import keep_identified
from marlstone.llm.line_dedup import deduplicate_lines
from marlstone.llm.packing import pack
from marlstone.llm.simhash import deduplicate_near


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    return keep_identified(docs).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents left without text."""
    return deduplicate_lines(docs).select(*DOCUMENT_COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at a similarity of 0.8 of their five-word shingles, the
    document with the smallest doc_id stays."""
    return deduplicate_near(docs).select(*DOCUMENT_COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset)."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trigram models, XXH64 with a seed and a tokenizer are beyond SQL; tests/llm checks run() by parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
