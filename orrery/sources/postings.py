"""A full-text index: for each word the texts that hold it and how often, in buckets by word, and the texts' lengths.

It is built once per generation of the texts. A query reads the buckets of its own words only, and joins the lengths to
the few texts that hold one; the corpus is not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.retrieval import bm25_score, words_of

#: Buckets of words, a folder each.
BUCKETS = 64


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(docs: DataFrame, key: str, text: Column, root: str, buckets: int = BUCKETS) -> None:
    """Write the index of docs under `root`: postings, lengths, and one row of corpus figures. Null texts have no words; keys are unique."""
    words = docs.where(text.isNotNull()).select(F.col(key).alias("key"), words_of(text).alias("w"))
    words.select("key", F.size("w").alias("dl")).write.mode("overwrite").parquet(f"{root}/lengths")
    p = words.select("key", F.explode("w").alias("word")).groupBy("word", "key").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    p = p.withColumn("bucket", _bucket(F.col("word"), buckets))
    # a word that nearly all texts hold does not fill one file: its rows are dealt over a few
    p.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("word").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    lengths = docs.sparkSession.read.parquet(f"{root}/lengths")
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/corpus")


def search(spark: SparkSession, root: str, terms: list[str], k: int | None = None) -> DataFrame:
    """(key, dl, score): the texts that hold a term, the k best; terms are whole words in lower case."""
    corpus = spark.read.parquet(f"{root}/corpus").first()  # one row
    terms = list(dict.fromkeys(terms))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "w string").select(_bucket(F.col("w"), corpus["buckets"])).collect()] if terms else []
    lengths = spark.read.parquet(f"{root}/lengths")
    postings = spark.read.schema(f"word string, key {dict(lengths.dtypes)['key']}, tf int, bucket int").parquet(f"{root}/postings")
    p = postings.where(F.col("bucket").isin(*buckets) & F.col("word").isin(*terms) if terms else F.lit(False))
    found = p.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # one row per term
    hit = p.join(F.broadcast(found), "word").join(lengths, "key")
    one = bm25_score(F.col("tf"), F.col("df"), F.col("dl"), F.lit(corpus["n"]), F.lit(corpus["avgdl"] or 1.0))
    out = hit.groupBy("key", "dl").agg(F.sum(one).alias("score")).select("key", "dl", "score")
    return out if k is None else out.orderBy(F.desc("score"), "key").limit(k)
