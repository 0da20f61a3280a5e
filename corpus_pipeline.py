"""The corpus pipeline: from raw documents to packed token rows.

Each stage takes the documents that its predecessor kept, reread from a written
table, and works on all of them. All but the last return the columns of
``documents``, further columns of any name included. An empty table passes all
stages as an empty one; a very long text is bounded by the stage's operator, as
its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, mixing, near_dedup, packing, toxicity
from strandline.session import materialise, ship, spread


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts are scored like texts without words; repeated rows go
    or stay together; without labels of both classes all stay.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard 0.8 or more.

    It is the one of the smallest doc_id; of rows that repeat it one stays. Null
    and empty texts are near nothing, rows without doc_id all stay.
    """
    ship(spark)
    return near_dedup.keep_one(docs, shingle=5, num=80, den=100)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go.

    Items of fewer words count as a whole; null and empty texts hold none;
    without items all stay.
    """
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with the words that it takes.

    A null source is one of its own; null and empty texts are not taken;
    repeated rows, and rows without doc_id, each take part.
    """
    ship(spark)
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids: every text whole, null and empty ones as an end id, repeated rows repeatedly."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", contaminated), ("mixing", mixed), ("packing", packed)]

#: SQL can't express a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next reads it."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
