"""The corpus pipeline: documents in, token ids out, through five operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All
but the last return the columns of ``documents``, whatever other columns there are with
them.  Every stage judges each row by itself: null, empty and blank texts, repeated rows
and ids are decided as its docstring says, ties by fixed hashes, and an empty table
gives an empty one.  No stage can be said in SQL from end
to end (a learned classifier, greedy tiling, a knapsack, a tokenizer), so there is no
SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakwright.llm.chosen_path import drop_near_duplicates
from leakwright.llm.dac import read_token_table, write_token_table
from leakwright.llm.decontaminate import drop_leaks
from leakwright.llm.mixing import mix
from leakwright.llm.quality import keep_quality
from leakwright.llm.registry import END_ID, tokenizer_path
from leakwright.llm.textcore import bound_batches
from leakwright.sources.shared_tables import discard, new_path, scratch, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; learned from the labels that are not held out.

    Texts that are null, empty or very long are scored whole like all others; equal texts score alike.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a similarity of 0.8 or more.

    The smallest id stays, null ids last, of repeated rows one; texts without words all stay.
    """
    return drop_near_duplicates(docs, k=5, ratio=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without half of any benchmark item; null and empty texts and an empty benchmark match nothing."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, sources weighing 5, 2 and 1 in turn.

    Null is a source of its own; texts without words go as often as all of their source
    do; of equal rows as many are taken as the plan wants.
    """
    return mix(docs, weights=(5, 2, 1), max_repeats=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, length and checksum of the ids of every row, read back from the token file.

    Rows follow each other by id, null first, then by text; null and empty texts are the end id alone.
    """
    path = new_path(spark, "tokens")
    write_token_table(docs, path, tokenizer_path(), END_ID)
    return read_token_table(spark, path)


def _bounded(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _bounded(quality)),
    ("near-duplicates", _bounded(near_dedup)),
    ("decontamination", _bounded(decontaminate)),
    ("mixing", _bounded(mix_sources)),
    ("token file", _bounded(tokens)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it.

    What a stage kept and made on its way is deleted when the next one's result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept += {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
