"""A training corpus out of raw documents, in stages that each read what the one before wrote.

Every stage takes a table with the columns ``doc_id`` (an integer of any width) and ``text``; all
others, whatever they are called, pass through. What the stages do with odd rows:

| Row | toxicity | line dedup | n-gram Jaccard join | decontamination | packing |
|---|---|---|---|---|---|
| null or empty text | stays | stays | stays; equal empty texts of one id: one stays | stays | in no window |
| text without a word | stays | its lines count like any | stays | stays | packed |
| null doc_id | judged by its text | comes first in the order | in no group; of equal texts one stays | judged by its text | packed first |
| rows that repeat id and text | each judged, alike | one document, and all stay | one stays | each judged, alike | packed one after the other |
| ties | none: a bound that is met counts | the least (doc_id, text hash, line) is first | the least (doc_id, text hash) stays | none: a bound that is met counts | the earliest cut |

Texts of any length are taken whole. An empty table gives an empty table of the same columns (of
packing: of windows). Empty ``labels`` reject nothing, and an empty ``benchmark`` removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from threadloom.llm.runtime import fresh_dir, scratch
from threadloom.shipping import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a significant toxic passage, by a model of ``labels`` and of these documents.
    A text without a word has no passage."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier, whatever their neighbours; ``n_chars`` follows the text.
    A document that loses every line goes; one that had no line to lose, or no text, stays as it is."""
    ship(spark)
    kept = line_dedup.without_repeats(docs, window=1)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the least id, and of equal rows one. Rows without a
    text, or without an id and unlike any other, stay."""
    ship(spark)
    kept = ngram_join.one_of_equal_texts(ngram_join.keep_one_of_each(docs.filter("text IS NOT NULL")))
    return kept.unionAll(docs.filter("text IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Items without a word are in no document."""
    ship(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over all documents that are left, in the order (doc_id, text hash), null ids first."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Toxicity, block-max retrieval and packing have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result a Parquet table in the shared folder. What a stage
    wrote on its way is deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        where = fresh_dir(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
