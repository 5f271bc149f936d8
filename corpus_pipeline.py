"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes the documents that the one before it kept. A stage is a function of
(spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import cdc_dedup, compression_bands, packing, secret_forest, simhash
from cytolake.llm.common import save, table, unsigned32

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; other columns end here."""
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go, null and empty texts among them; equal
    rows are judged alike. The bands are fitted on the documents that the table of labels calls good."""
    own = _documents(docs)
    bands = compression_bands.fit(own, table(spark, sf_dir, "labels"))
    return _documents(compression_bands.quality_rules(own, bands=bands, lang_col="lang").where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id. Of rows that share
    this id the one whose text sorts first stays; rows with a null id stay as they are."""
    kept = simhash.near_dedup(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"))
    own = _documents(docs)
    stay = own.join(kept, own["doc_id"] == kept["_id"], "left_semi")
    # a merge join leaves the rows of an id side by side, so the aggregate takes them in that order without a shuffle of its own
    one = stay.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))
    return one.select("doc_id", "r.*").unionByName(own.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the texts; a document of which no word is left goes. Null texts stay
    null, rows with a null id stay as they are, and rows that repeat an id are one document."""
    cut = cdc_dedup.cut(_documents(docs))
    size = F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    left = (F.col("removed_words") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return _documents(cut.where(left).withColumn("n_chars", size))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays, null texts, very long ones and repeated rows too; no rows:
    no rows. The forest knows the language of the documents that the table of labels calls good."""
    own = _documents(docs)
    forest = secret_forest.fit(spark, usual=secret_forest.language(own, table(spark, sf_dir, "labels")))
    masked = secret_forest.redact(own.withColumn("_old", F.col("text")), forest=forest)
    size = F.when(F.col("text") == F.col("_old"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return _documents(masked.withColumn("n_chars", F.coalesce(size, F.col("n_chars"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, in windows of the sources' shares. A null text is
    the end token alone; rows that repeat an id, or have none, are documents of their own."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", unsigned32(F.crc32("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

#: Tokens, fingerprints and compression are not in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage{k}")
    return docs
