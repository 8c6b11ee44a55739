"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Near duplicates and decontamination use five-word shingles and a
similarity of at least 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm import common, decontaminate, language_id, mixing, near_dups, token_store

#: A prediction under this score has no language with most of the weight.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: not `und`, and no score under LEAST_SCORE. Learns from documents with a lang."""
    model = language_id.fit(docs.select("lang", "text"))
    whole = docs.select(F.col("text").cast("string").alias("text"), F.struct(*common.columns(docs)).alias("row"))
    found = language_id.predict(whole, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates."""
    gone = near_dups.near_dups(docs, 5).filter("not kept").select("doc_id", "th").distinct()
    last = F.lit((1 << 63) - 1)
    gone = gone.select(F.coalesce("doc_id", last).alias("id"), "th")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.struct(*common.columns(docs)).alias("row"))
    return keyed.join(gone, ["id", "th"], "left_anti").select("row.*")


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass that took words of it, with those words as its text."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a token store and reads it: doc_id, start, n_tokens and checksum of each row."""
    return token_store.stored_tokens(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dups", one_of_each),
    ("decontaminate", no_leaks),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: Tokenising and the trained model are beyond SQL; tests/llm has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
