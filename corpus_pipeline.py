"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` applies them in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelica.llm import minhash, mixing, packing, quality, substring
from allelica.llm.common import cut, ready

#: Columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle, similarity in percent, words of a repeated passage, most epochs of a source, words of a bin.
SHINGLE, PERCENT, WINDOW, MOST_EPOCHS, CAPACITY = 5, 80, 13, 2.0, 1024


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the quality classifier rejects. It learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    return quality.split_low(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of each group of near-duplicates.

    Documents without words and rows with a null id are in no group and stay.
    Rows that share an id are one document if their texts are equal (the least
    row stays), else documents of their own, in the order of their texts' hashes.
    """
    known = docs.select(*COLUMNS).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    texts = known.select("doc_id", "h").distinct().withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")))
    more = cut(texts.where("number > 1").select("doc_id", "h", F.xxhash64("doc_id", "h").alias("own")))
    if more.isEmpty():
        kept = minhash.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT).where("kept and id is not null")
        one = known.join(kept.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    else:
        known = cut(known.join(more, ["doc_id", "h"], "left").withColumn("own", F.coalesce("own", "doc_id")))
        groups = minhash.near_duplicates(known, id_col="own", shingle=SHINGLE, percent=PERCENT).select(F.col("id").alias("own"), "component_id").distinct()
        groups = groups.join(known.select("own", "doc_id", "h").distinct(), "own")
        least = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "h", "own")).alias("least"))
        one = known.join(least.select("least.own"), "own", "left_semi")
    one = one.groupBy("doc_id", "h").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("row")).select("doc_id", "row.*")
    return one.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; a document of which nothing is left goes."""
    out = substring.remove_repeated(docs, window=WINDOW, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("c1"))
    out = out.where("n_removed = 0 or n_removed < n_words").select(F.col("c0").alias("doc_id"), text.alias("text"), F.col("c2").alias("lang"), F.col("c3").alias("source"), F.col("c4").alias("old"), "n_removed")
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("old"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of smaller sources, up to a limit, towards equal weights; none is left out."""
    return mixing.mix(docs.select(*COLUMNS), most_epochs=MOST_EPOCHS).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into bins; repeats of a document are one duplicate cluster, and never share a bin."""
    out = packing.pack(docs, capacity=CAPACITY, cluster=F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_bins),
]

#: The classifier and the packing are iterative; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet to the shared checkpoint folder and read again.

    A result goes when the next is written; the last one's stays.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
