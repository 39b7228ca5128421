"""From raw documents to packed sequences: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents and
may have more, under any names.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import packing, partenum, ppm, site_lines, winnowing
from graphloom.llm.shared import Scratch, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones speak, learnt from the labelled rows of docs.

    Null, empty and letterless texts have no language and go, and so do all
    documents if no row has a label.  A null id or label matters to nothing
    else; each row, repeated or not, is judged by its own text.
    """
    return ppm.keep_identified(docs, ppm.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows.

    All rows stay.  A null source is a source; a null text stays null, with a
    null n_chars; a text that loses all lines is empty.  Repeated rows are
    pages of their own.
    """
    return site_lines.drop_boilerplate(docs, counts=False).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id.

    Texts without words are linked with nothing and all stay.  A null id is
    larger than all others; of rows that repeat an id and a text one stays.
    """
    return partenum.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark of sf_dir.

    Rows are judged by their texts alone; null and empty ones stay.  Benchmark
    rows without an id or text match nothing.
    """
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens.

    A null or empty text is its end id alone; each row is a document of its
    own, also if its id is null or repeats.
    """
    return packing.packing_report(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; what the last does not read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as outputs:
        for name, stage in STAGES[:-1]:
            with Scratch(spark) as steps:
                docs = stored(stage(spark, docs, sf_dir), name)
                steps.keep(docs)
        outputs.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
