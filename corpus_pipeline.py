"""From raw documents to packed sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.line_dedup import dedup_lines
from refrain.llm.mixing import mix
from refrain.llm.near_dedup import near_duplicates
from refrain.llm.packing import pack, tokenizer_path
from refrain.llm.quality import keep_good
from refrain.llm.scratch import Scratch, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the trees reject go.

    Null, empty and short texts are rejected; a text of any length is judged whole, each of repeated rows, with or without doc_id.
    """
    return keep_good(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another one stands for go, and with them documents that had no other.

    Of equal or similar lines the one with the least doc_id, in it the first, stays. Null texts, texts without
    a word and rows without doc_id stay as they are; rows that repeat doc_id and text count as one and both stay.
    """
    out = dedup_lines(docs, keep=("lang", "source")).filter((F.size("gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id.

    Null and empty texts are like nothing and stay, as do rows without doc_id. Rows that repeat a doc_id stay or go together.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def pareto_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null texts and texts without a word have no words to take and go. A null source is a source like others. Repeated
    rows are drawn each, in any order of the table alike.
    """
    taken = mix(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    A null or empty text is a piece of its own, the end id; a long text is cut into pieces; repeated rows are packed each.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing to target weights", pareto_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the trees nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; each but the last is written and read again. Columns of documents besides COLUMNS are not read; an empty table gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
