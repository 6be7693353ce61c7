"""The corpus pipeline: from raw documents to a mixed, clean corpus, one operator of ``stallscope.llm`` for each stage.

Every stage works on all that the one before kept, written as Parquet and read again. All but the last return the
columns of ``documents``; the last adds ``mix_copy`` and ``mix_shard``, in place of columns of these names.

1. ``language``: learns the languages from the rows that have one, and rejects documents without a letter or with
   too few n-grams of any learned language.
2. ``near_duplicates``: of each group linked by five-word shingles at a similarity of 0.8, one document stays.
3. ``decontaminate``: documents that contain a benchmark item go.
4. ``secrets``: reported secrets are masked in the text; no document goes.
5. ``mix``: sources are taken to their target weights and shuffled into shards.

Null texts are rejected by the first stage. Repeated rows are near duplicates of each other. A null document number
is no reason to reject. An empty table gives an empty corpus. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallscope.llm import decontaminate, language_bits, mixing, odd_sketch, secret_scan
from stallscope.llm.common import ship, table
from stallscope.llm.queries import CHECKS as OPERATORS
from stallscope.session import Staging

LEAST_LANGUAGE_SCORE = 0.3
ORACLE_SQL = None  # learned filters, sketches, compression and hash permutations aren't SQL; the tests compare by brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = language_bits.learn(docs.where(~language_bits.held_out()))
    return language_bits.predict(docs, model, keep=LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # A document without a number goes by a negative one made of its text.
    own = F.coalesce("doc_id", -F.abs(F.xxhash64("text") % (1 << 62)) - 1)
    found = odd_sketch.near_duplicates(docs.select(own.alias("doc_id"), "text"), odd_sketch.Near())
    number, place = free_name(docs, "number"), free_name(docs, "place")
    first = found.where("kept").select(F.col("doc_id").alias(number)).distinct()
    kept = docs.withColumn(number, own).join(first, number, "left_semi")
    # Of repeated rows one stays; the join has them side by side already.
    among = F.row_number().over(Window.partitionBy(number, F.xxhash64("text")).orderBy(F.lit(0)))
    return kept.withColumn(place, among).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer where the documents have such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("secrets", secrets), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what a stage has read is removed once the next is written."""
    staging, docs = Staging(spark, "corpus"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = staging.write(name, stage(spark, docs, sf_dir))
        if k:
            staging.drop(STAGES[k - 1][0])
    return docs


CHECKS = {**OPERATORS, "pipeline": (run, ORACLE_SQL)}
