"""From raw documents to packed training sequences, one stage after the other.

Each stage gets the documents that its predecessor kept, as a stored table, and returns
documents with the same columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.minhash_dedup import near_duplicates
from paddock.llm.packing import best_fit_packing
from paddock.llm.secret_scan import redacted, scan_secrets
from paddock.llm.substring_dedup import substring_dedup
from paddock.llm.toxicity import fit, toxicity
from paddock.session import ship_package, store

TOXIC = 0.7
#: Of word shingles in common, by the general rule for stages; op7 has its own 85.
ALIKE = 80
CAPACITY = 2048


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text, with obfuscation undone, scores below TOXIC."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, fit(docs, labels)).where(F.col("score") < TOXIC).drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each near-duplicate group with the smallest id; rows without id stay."""
    ship_package(spark)
    kept = near_duplicates(docs.select("doc_id", "text"), ALIKE).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id holds.

    A text that keeps all its words stays as it is; in others, kept words are parted by
    one space.  A text all of whose words went is empty.
    """
    ship_package(spark)
    found = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _measured(found.withColumn("text", text).select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    ship_package(spark)
    return _measured(redacted(scan_secrets(docs)).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of CAPACITY tokens."""
    import public_tokenizers

    ship_package(spark)
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# Learned scores, set similarity and tokenizing are beyond SQL; tests/llm holds the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, f"stage-{name}")
    return docs
