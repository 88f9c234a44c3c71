"""A corpus pipeline: from raw documents to token ids, by five operators of ledgerspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the
columns of documents. Rows keep their doc_id throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, line_dedup, mixing, near_dup, quality_classifier
from ledgerspark.llm.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: None: the least budget that takes every document at least once, from the sizes of the leaves; small leaves of high weight are repeated.
BUDGET_PERCENT = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it: once per whole epoch, and once more in the prefix of the next.

    Where a prefix ends inside a document, the last copy is the document's first words up to there, so a leaf gets exactly
    its budget. Only texts without words are dropped, where their domain, language and source have no words at all.
    """
    taken = mixing.mix_sources(docs, percent=BUDGET_PERCENT, carry=COLUMNS)
    copies = F.col("whole_epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)
    rows = taken.withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    cut = F.expr("copy > whole_epochs and prefix_tokens < n_tokens")
    text = F.when(cut, mixing.first_words(F.col("carried.text"), F.col("prefix_tokens"))).otherwise(F.col("carried.text"))
    rows = rows.select("carried.*", text.alias("_text"), cut.alias("_cut")).withColumn("text", F.col("_text"))
    return rows.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the hash of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, pattern, decoded=True, text=False)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier's verdicts and token ids can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, in order; each stage's rows are written before the next reads them."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
