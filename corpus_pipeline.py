"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes all that its predecessor kept, written as Parquet and read again,
and all but the last return the columns of documents: columns of other names are left
out, missing ones are null. All stages take null ids and texts, empty and very long
texts, repeated ids and rows, and empty tables, as their docstrings and those of the
operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import common, line_dedup, minhash_dedup, packing, substring_dedup, toxicity

#: Which columns a document has, whatever the stage.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    known = common.pick(docs, **{c: c for c in COLUMNS if c in have})
    return known.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Rows stay as they are, null texts too, which score as empty ones do; repeated texts go
    or stay alike. Without labels of both classes the model scores all texts alike: all
    stay, unless every label says toxic.
    """
    docs = _columns(docs)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share; each such line stays in the document with the largest id.

    Every row stays, maybe with an empty text; a null text stays null, and rows that lose
    nothing are as they were.
    """
    return line_dedup.with_lines_dropped(_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; all without words.

    A null id is smaller than any other; of rows that share the smallest id, the least by
    content stays, of exact repeats one. Null, empty and blank texts are nobody's copy.
    """
    docs = _columns(docs)
    found = minhash_dedup.near_duplicates(docs).select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("_doc"), F.col("rk").alias("_rk"), "root")
    found = common.materialize(found, "near-copies")
    grouped = found.where("root is not null")
    first = grouped.groupBy("root").agg(F.min(F.struct("_doc", "_rk")).alias("f"), F.count(F.lit(1)).alias("n"))
    kept = first.select("f._doc", "f._rk").unionByName(found.where("root is null").select("_doc", "_rk").distinct())
    rows = common.row_keys(docs, F.col("doc_id"), F.col("text")).join(kept.hint("shuffle_hash"), ["_doc", "_rk"], "left_semi")
    # rows that repeat an id and a text are one key: only then is one of them to be chosen
    twice = grouped.groupBy("_doc", "_rk").count().where("count > 1").select("_doc", "_rk")
    if not twice.isEmpty():
        again = rows.join(twice, ["_doc", "_rk"], "left_semi").dropDuplicates(["_doc", "_rk"])
        rows = rows.join(twice, ["_doc", "_rk"], "left_anti").unionByName(again)
    return rows.select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier documents hold; ids rank them, null first.

    Every row stays, maybe with an empty text; a null text stays null. Of rows that share
    an id the least by content comes first, exact repeats are treated alike.
    """
    return substring_dedup.with_passages_removed(_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences for training. Null and empty texts are one piece of the end id; texts longer than a sequence are several."""
    return packing.pack(_columns(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("packing", pack_sequences)]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
