"""A corpus pipeline from five of the training-data operators: quality, lines, near-duplicates, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last
return the columns of `documents`. The labels and the benchmark are read from sf_dir. Rows without doc_id go at
the first stage: no later decision could name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontam import keep_clean
from corpusloom.llm.gam import keep_good
from corpusloom.llm.linejoin import Lines, without_repeated_lines
from corpusloom.llm.minhash import Similarity, keep_one
from corpusloom.llm.packing import pack
from corpusloom.llm.queries import table, tokenizer
from corpusloom.llm.store import Scratch

#: Documents of this similarity or more, in percent, are near-duplicates of each other.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; those of which nothing remains go."""
    return without_repeated_lines(docs, Lines(least=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs, Similarity(percent=NEAR))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("packing", packing)]

#: SQL can't express the classifier, the sketches or the tokenizer; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *(F.col(c) for c in ("lang", "source", "n_chars")))
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
