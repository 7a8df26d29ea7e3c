"""A corpus from raw documents: quality classifier, line dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet
and reads it again as the next stage's docs. All but the last return the columns of docs.
Rows of docs may repeat a doc_id; every stage's module states what it does then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, jaccard_join, line_dedup, mixing, quality_cnn
from ledgerline.llm.common import Scratch, numbered, passing, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold; the others go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_cnn.fit(docs, labels)
    return quality_cnn.score(docs, model, column="__score").where(F.col("__score") >= quality_cnn.THRESHOLD).drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those with no line left go."""
    out = line_dedup.dedup(docs).where(~F.col("emptied"))
    return out.select(*(F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id, and of its rows' texts the one of the smallest hash.

    Rows that are equal in doc_id and text are one document. Null doc_ids stay.
    """
    numbers, names = numbered(docs, Scratch(spark, "near"))
    gone = jaccard_join.join(numbers, doc_id="doc").where("doc_id <> component_id").select(F.col("doc_id").alias("doc"))
    if names is None:
        return docs.join(gone.withColumnRenamed("doc", "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce("text", F.lit(""))))
    once = rows.where("doc_id is not null").dropDuplicates(["doc_id", "__row"])
    left = once.join(names.join(gone, "doc").select("doc_id", F.col("row").alias("__row")), ["doc_id", "__row"], "left_anti")
    return left.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, by the quotas of the mix of sources; 0 to 3 rows of each."""
    taken = mixing.whole(docs).where("copies > 0")
    return taken.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the text that they decode to."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text")).drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: SQL can't state the network and the tokenizer. Tests hold line dedup, near dedup, mix and tokens against brute force
#: on their own inputs, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder and read again; what a stage wrote for itself goes."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with passing():
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
