"""The stages of the corpus pipeline, and the query that runs them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.llm import bpe, mixing, neardup, pii, toxicity
from strataframe.llm.common import table
from strataframe.operators.spatial import ranked
from strataframe.runtime import cut, shared_folder, sized_broadcast

#: Repeated ids that may be broadcast to set their rows apart.
REPEATED_IDS = 1_000_000


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, score every text, let predicted ones go.

    Null and empty texts hold nothing toxic and stay; equal rows go or stay together; without any usable label, or
    without documents, nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def _row_keys(docs: DataFrame) -> DataFrame:
    """Add ``_key``, a number that equal rows share and that follows the order of ids; null for null ids."""
    hashed = docs.withColumn("_row", F.xxhash64(*docs.columns))
    keys = cut(ranked(hashed.where("doc_id IS NOT NULL").select("doc_id", "_row").distinct(), "doc_id", "_row").withColumnRenamed("pos", "_key"))
    return hashed.join(sized_broadcast(keys, keys.count(), REPEATED_IDS), ["doc_id", "_row"], "left").select(*docs.columns, "_key")


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays: five-word shingles, similarity 0.8, smallest id.

    Rows that repeat a whole row stay once.  Where ids repeat, a row goes by its place among all ids and row hashes,
    so a copy does not take another document of its id along.  Keys and ids are few or many, so they are
    broadcast within a checked count and joined by a shuffle beyond it.
    """
    again = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = again.count()
    keyed = docs.withColumn("_key", F.col("doc_id")) if n == 0 else _row_keys(docs)
    gone = cut(neardup.near_duplicates(keyed, key="_key", width=5, percent=80).where("NOT kept").select("_key").distinct())
    left = keyed.join(sized_broadcast(gone, gone.count(), REPEATED_IDS), "_key", "left_anti").select(*docs.columns)
    if n == 0:
        return left
    twice = sized_broadcast(again, n, REPEATED_IDS)
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates()).select(*docs.columns)


def personal_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text are replaced by their kind; ``n_chars`` follows the text.

    Null texts keep their null and their ``n_chars``; rows are cleaned one by one, so repeats and order do not matter.
    """
    cleaned = pii.redact(pii.find_pii(docs))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target takes it.

    Null sources are one source, the last by name; texts without a word have no size and are taken by none; which
    documents a source's fraction holds is told by a seeded hash, equal rows side by side.
    """
    return mixing.repeated(mixing.mix(docs, mixing.word_count("text"), whole_documents=True)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text back.

    Null and empty texts have no ids and come back as empty; a row gives a row, repeated ones too.
    """
    out = bpe.encode_documents(docs.select("doc_id", "source", "lang", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", toxic_out), ("near_duplicates", copies_out), ("personal_data", personal_out), ("mixing", mixed), ("byte_bpe", encoded)]


#: A trained classifier and a tokenizer are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``; every stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
