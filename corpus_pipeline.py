"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; n_chars follows the text. A null text counts as an empty
one and is an empty one from the third stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.llm import bpe, jaccard, labelled, packing, repeats, secrets, toxicity
from searchloom.llm.registry import vocabulary
from searchloom.llm.tables import table, written

#: A text this likely to be toxic is rejected.
TOXIC = 0.3


def _apart(docs: DataFrame, *more):
    """(row, text, more): docs with its other columns as one, so that no name of
    theirs meets another."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "text", *more)


def _together(rows: DataFrame, docs: DataFrame, new: bool = False) -> DataFrame:
    """Rows (row, text) in the columns of docs; a new text gives n_chars anew."""
    kinds = docs.schema
    cols = {c: F.col("text").cast(kinds[c].dataType) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if new:
        cols["n_chars"] = F.length("text").cast(kinds["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in cols.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the machine trained on the labelled ones doesn't reject."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 4) != 2)
    return _together(toxicity.score(_apart(docs), machine, keep=["row", "text"]).where(F.col("score") < TOXIC), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by a similarity of 0.8 or more of five-word
    shingles, the document with the smallest doc_id; of its rows with one doc_id,
    the one of least hash. Rows are told apart by a hash of doc_id and text, so
    rows of one doc_id with other texts are documents of their own, and of rows
    that repeat both one stays. Documents without doc_id or without words stay."""
    keyed = _apart(docs, "doc_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("node"))
    found = jaccard.classes(keyed, key="node", words=5, num=80, den=100).where("node IS NOT NULL").distinct()
    found = written(found.join(keyed.where("doc_id IS NOT NULL").select("doc_id", "node").distinct(), "node"), "nodes")
    least = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.node")
    one = W.partitionBy("node").orderBy("doc_id")
    rows = keyed.join(least, "node", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    wordless = keyed.join(found.where("n_shingles = 0").select("node"), "node", "left_semi")
    return _together(rows.select("row", "text").unionByName(wordless.select("row", "text")), docs).unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes or more that start earlier
    too, in whole characters."""
    out = repeats.remove_repeats(_apart(docs, "doc_id"), keep=["row"], whole_characters=True)
    return _together(out.select("row", F.decode("kept", "UTF-8").alias("text")), docs, new=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret."""
    out = secrets.scan(_apart(docs), keep=["row"])
    return _together(out.select("row", F.col("redacted").alias("text")), docs, new=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"), special=bpe.added_tokens(vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The first stage's model can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
