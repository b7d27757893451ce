"""Cleans and packs a corpus in five stages, each on all that the one before kept.

Every stage but the last returns the columns of documents.  Where a stage drops rows, a row is known by its id and the sum of
its text, so the same rows go however the input is split, however often it is read, and whichever executors are lost.

Special input: null ids and texts are kept as they are (a null text has no words, tokens or secrets); rows of equal id and text are
copies, of which one stays; of ties between near copies the least id stays, of equal ids the least sum; texts of any length are
read whole; an empty table gives no rows in any stage; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.llm import decontamination, jaccard, packing, secrets, toxicity
from tamarind.llm.workspace import new_dir, ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Rows of a table of sums (16 bytes each) that may be broadcast; a larger one is joined by a shuffle.
SMALL = 500_000


def marked(docs: DataFrame) -> DataFrame:
    """The documents with mark: 16 bytes of a sum of id and text, null told apart from empty."""
    whole = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.concat(F.lit(":"), F.col("text")))
    return docs.select(*COLUMNS, F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("mark"))


def small(marks: DataFrame) -> DataFrame:
    """For a join: broadcast if its size allows."""
    return F.broadcast(marks) if marks.count() <= SMALL else marks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those with a score of at least a half."""
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, name="toxic_score").filter("toxic_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near-copies the document with the least id stays."""
    ship(spark)
    rows = marked(docs)
    joined = jaccard.jaccard_join(rows.withColumn("row", F.struct("doc_id", "mark")), id_col="row")
    judged = joined.groupBy("doc_id.mark").agg(F.min(F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("stays"), F.count("*").alias("many"))
    judged = stored(judged.filter("not stays or many > 1"), new_dir(spark, "copies"))
    kept = rows.join(small(judged.select("mark")), "mark", "left_anti").select(*COLUMNS)
    # Rows of equal id and text: any one of them.
    twice = rows.join(small(judged.filter("stays").select("mark")), "mark", "left_semi").groupBy("mark").agg(F.min(F.struct(*COLUMNS)).alias("x"))
    return kept.unionByName(twice.select("x.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which benchmark windows cover at least a twentieth of the words."""
    ship(spark)
    rows = marked(docs)
    judged = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="mark")
    hit = decontamination.hit_words(F.col("hits"))
    gone = judged.filter((hit > 0) & (20 * hit >= F.col("n_words"))).select(F.col("doc_id").alias("mark")).distinct()
    return rows.join(small(stored(gone, new_dir(spark, "contaminated"))), "mark", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every finding is replaced by a mark."""
    ship(spark)
    found = secrets.find_secrets(docs.select(*(c for c in COLUMNS)), secrets.fit(docs), keep=("lang", "source", "n_chars"), redacted="text")
    n_chars = F.when(F.size("findings") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return found.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: doc_id, piece, start, length, ids, sequence_id, offset."""
    ship(spark)
    return packing.best_fit_pack(docs, TOKENIZER, 4096, 1)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]

#: Neither the models nor the tokenizer can be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), new_dir(spark, name))
    return docs
