"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared checkpoint folder and read again as the next stage's input. Intermediate tables are deleted when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.llm import queries as q
from wardlight.llm._shared import cut_lineage, shared_path
from wardlight.llm.line_dedup import line_dedup
from wardlight.llm.mixing import first_words, mix
from wardlight.llm.near_dedup import near_duplicates
from wardlight.llm.packing import pack
from wardlight.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences."""
    return quality_rules(docs, keep_text=True).where("kept").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of three lines or more that an earlier document has; a text that loses all goes."""
    left = line_dedup(docs).where("n_removed < n_lines or n_removed = 0")
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, and all rows without doc_id.

    Of rows with the same doc_id the first by text (null last), lang, source and n_chars is left.
    """
    classes = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    first = F.min(F.struct(F.col("text").isNull().alias("empty"), *[c for c in COLUMNS if c != "doc_id"])).alias("r")
    named = docs.join(classes, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "r.*").select(*COLUMNS)
    return named.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for: a row for each epoch that takes one.

    Where a leaf's target ends inside a document, its text is cut after the words that are taken. A text without words
    and a row without doc_id are never taken; repeated rows are taken each.
    """
    key = F.xxhash64("text", "lang", "source", "n_chars")
    taken = mix(docs, q.domain_of(), percent=q.MIX_PERCENT, max_epochs=q.MIX_EPOCHS, weights=q.MIX_WEIGHTS, seed=q.MIX_SEED, key=key)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars", key.alias("key"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("n_chars"))
    one = one.withColumn("copy", copy).where("copy = 1").drop("copy")
    cut = F.col("n_taken") < F.col("n_tokens")
    text = F.when(cut, first_words(F.col("text"), F.col("n_taken"))).otherwise(F.col("text"))
    n_chars = F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return one.join(taken.select("doc_id", "key", "n_tokens", "n_taken"), ["doc_id", "key"]).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return pack(docs, q.tokenizer_file("byte_bpe_50k.json"), length=1024, ranks=q.tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenising has no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = q.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
