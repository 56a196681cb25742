"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage judges repeated rows alike, keeps null ids, and gives no rows for an empty table. Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet to
the shared checkpoint folder and rereads as the next stage's documents. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsela.llm import decontamination, jaccard_join, language_id, packing, quality_model
from sparsela.llm.exchange import release, written
from sparsela.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay. Null and empty texts, texts without a letter and texts
    unlike all learned languages (``language_id.score_limit``) go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more stay; a null or empty text is judged as one empty
    passage, and a score of exactly 0.5 stays."""
    return quality_model.keep_good(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays;
    of repeated rows one, and every row without an id. Texts that share an id are documents of their own."""
    known = docs.where("doc_id is not null").withColumn("_text", F.xxhash64("text"))
    several = known.groupBy("doc_id").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).where("a < b")
    if not several.isEmpty():
        # numbers in the order of ids stand for the documents
        numbers = written(known.select("doc_id", "_text").distinct().sort("doc_id", "_text").withColumn("_row", F.monotonically_increasing_id()))
        known = written(known.join(numbers, ["doc_id", "_text"]))
        first = jaccard_join.near_duplicates(known, "_row", n=5, percent=80, links=False).where("component_id = _row").select("_row")
        kept = known.join(first, "_row", "left_semi").dropDuplicates(["_row"])
        return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
    found = jaccard_join.near_duplicates(docs, n=5, percent=80, links=False)
    first = found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    one = docs.join(first.where("_rows = 1"), "doc_id", "left_semi")
    repeated = docs.join(first.where("_rows > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(repeated).unionByName(docs.where("doc_id is null")).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, at 0.8 of its distinct five-word shingles exactly too.
    Null and empty texts hold none; an empty benchmark takes nothing away."""
    return decontamination.drop_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null or empty text is its end id alone, and
    repeated rows are packed as often as they occur."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language id", language), ("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("packing", packed)]

#: SQL cannot express the models and the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of documents. Tables that the stages wrote are removed when the
    next stage's is there; the last one stays, since the result reads it (``exchange.release``)."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            release(spark, docs)  # what the stages before have written
    return docs
