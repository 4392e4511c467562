"""From raw documents to packed training sequences: five stages, each a written table that the next one reads.

Every stage takes any table with the columns of documents: nulls in any column, empty texts, repeated rows and further
columns of any name are carried along, and an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from siltworks.llm.frames import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model scores below one half, unchanged. Null and empty texts score 0 and stay; where nothing could be learnt all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lines that stand on many sites cut out of their texts, whatever their share; n_chars follows the text.

    No row goes: a text of such lines only becomes empty, and null and empty texts stay.
    """
    return line_dedup.recount(line_dedup.dedup_lines(docs, most_cut=None))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Repeated rows are copies of each other; texts without words (null, empty, blank) are linked with nothing and all stay.
    """
    return jaccard_join.drop_similar(docs, jaccard_join.Rule())


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, unchanged; texts without words hold none, and an item without words is in no text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is its end mark alone, a repeated row is packed again."""
    found = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Training, exact similarity components and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {}
