"""A training corpus from raw documents in five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, minhash, mixing, suffixes
from lectern.plans.stage import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; texts that are null or without a letter go."""
    found = langid.identify(docs, langid.train(docs))
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Repeated rows of it are one.

    Copies are alike from 0.80 on; 10 bands of 2 rows miss every table there with the 7e-5 that op8's 8 have at 0.85.
    """
    kept = minhash.near_duplicates(docs, percent=80, bands=10).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    return known.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes or of 51 words that occur twice; documents of which no word is left go.

    51 words may have under 400 bytes, and 400 bytes under 51 words (long words, scripts without blanks).
    """
    cut = suffixes.deduplicate(docs, words=51)
    cut = cut.withColumn("text", F.col("kept_text")).where(F.col("text").rlike(mixing.WORD))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, or starts to take it.

    A document of which it takes a part stays whole, so a source may exceed its target by less than a document a shard.
    """
    mixed = mixing.mix(docs)
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return mixed.where("taken > 0").withColumn("__time", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode_documents(docs, keep=("doc_id", "source", "lang"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("suffix-array dedup", repeated_passages), ("mixing", mixture), ("BPE", tokens)]

#: A trained model and seeded draws are no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the mixed documents. Each stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark) as space:
        for k, (name, stage) in enumerate(STAGES):
            before, last = docs, k == len(STAGES) - 1
            docs = (space.finish if last else space.table)(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            if k:
                space.drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
