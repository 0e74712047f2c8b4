"""A training corpus from raw documents: five stages, each a table that the next one reads.

Toxic documents go, repeated lines go, one document of each near-duplicate class stays, documents with
benchmark passages go, and what is left is packed into training sequences.

Every stage but the last takes and returns the columns of COLUMNS; other columns of its input are left out, whatever their names. A null or empty
text is clean, has no lines to lose, resembles nothing and holds no passage, so such a document reaches the last stage, where it takes a row of 0
words. Rows that repeat in full are copies of one another: they lose the lines they share with the smallest, and one of them stays. Documents with
a null id are kept like others. An empty table gives an empty result. What becomes of repeated ids, ties and very long texts is said at each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm.decontam import mark_contamination
from parcelry.llm.lines import remove_repeated_lines
from parcelry.llm.neardup import near_duplicate_classes
from parcelry.llm.packing import pack_best_fit
from parcelry.llm.queries import severity_labels
from parcelry.sources.scratch import discard, keep, tables_of
from parcelry.llm.toxicity import fit_severity, score_severity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose predicted severity grade is 1 or more with probability of at least one half."""
    model = fit_severity(docs, severity_labels(spark, sf_dir))
    return score_severity(docs, model).filter(~F.col("toxic")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; every document stays, with the lines that are left."""
    text = F.col("kept_text")
    return remove_repeated_lines(docs).withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every near-duplicate class."""
    return near_duplicate_classes(docs).filter("representative").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 512 to 4096 words; a row per piece."""
    return pack_best_fit(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read back as the next one's input.

    What a stage keeps on the way goes as soon as its result is written, and the result as soon as the next one is.
    """
    docs = last = None
    for name, stage in STAGES[:-1]:
        source = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
        stay: list[DataFrame] = []
        with tables_of(spark, but=stay):
            docs = keep(stage(spark, source, sf_dir), f"stage-{name}")
            stay.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


# The severity model is trained, so SQL cannot express the first stage or what depends on it.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
