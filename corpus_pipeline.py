"""From raw documents to a mixed, shuffled training set.

Each stage works on all that its predecessor kept. Rows are documents; from the
mixing on a document is there as often as the mix takes it. Stages decide row by row,
also where ids are null or shared; a null text counts as empty; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewise.llm.decontamination import find_leaks
from slicewise.llm.mixing import mixed_rows
from slicewise.llm.near_dedup import near_dedup
from slicewise.llm.sharding import shard
from slicewise.llm.tables import freeze, read, with_row_key, with_text_key, without_ids
from slicewise.llm.toxicity import fit_toxicity, without_toxic
from slicewise.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    A score follows from the text alone, so rows with one text go or stay together, whatever their
    ids. Texts without words score by the bias and stay. Without labels nothing is known to be toxic and
    all rows stay.
    """
    ship(spark)
    return without_toxic(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, a null id being the largest.

    Of rows that are near copies of each other and share an id, or have none, one stays. Texts without
    words are copies of nothing and all stay.
    """
    ship(spark)
    rows, key = with_row_key(docs)
    return without_ids(rows, near_dedup(rows, threshold=75, id_col=key).where("not kept"), key).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go.

    That follows from the text alone, so rows with one text go or stay together, whatever their ids, and
    a row doesn't go because another with its id leaks.
    """
    ship(spark)
    rows, key = with_text_key(docs)
    leaks = find_leaks(rows, read(spark, sf_dir, "benchmark"), threshold=0.6, least=0.75, id_col=key)
    return without_ids(rows, leaks, key).select(*[f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in code point order weigh 3, 1, 2, repeating; 150 % of the words, no source more than twice.

    A null source is one of its own, last in order; rows repeated in full are taken as often as each other.
    """
    ship(spark)
    return mixed_rows(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of equal row counts in uniform random order: adds shard and slot, in place of columns of these names."""
    ship(spark)
    return shard(docs, shards=24)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has neither the classifier nor the random permutation; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = freeze(docs, f"pipeline_{name}")
    return docs
