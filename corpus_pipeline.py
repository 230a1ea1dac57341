"""From raw documents to a weighted mix: each stage reads what the one before it wrote.

Every stage but the last returns the columns of documents. The last returns a
row per document that is left, with the words the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm import decontaminate, line_dedup, mixture, ngram_join, toxicity
from jobscope.llm.common import read
from jobscope.session import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of the table, does not mark.

    A null or empty text has the score of the intercept; repeated rows and rows without an id
    are judged one by one. An empty table gives an empty one, here and in all stages.
    """
    labels = read(spark, sf_dir, "labels")
    model = toxicity.train(read(spark, sf_dir, "documents"), labels)
    return toxicity.clean(docs, model)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay, with null texts and without an id, too."""
    return line_dedup.clean(docs, min_docs=10, min_chars=1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays.

    It is that of the least id (null last); of repeated rows with its id and text one stays.
    All rows without a word, null texts among them, stay.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go.

    Null and empty texts have no words and stay; items without an id count, those without words do not.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), window=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left, a row for each row.

    Null and empty texts have size 0 and nothing is taken of them; documents without a source are a source, the last one.
    """
    return mixture.mix(docs, weights=[5, 2, 1], share=1.5, max_epochs=2, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixture", mixed),
]

# the classifier of the first stage has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
