"""The dealt operators on whole tables, one query each.

Expected SQL is given where SQL can express the whole result; tokenizers, learned models,
fingerprints, spans and packing plans are beyond it.  tests/llm holds each operator against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paddock.session import ship_package

from . import expected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {
    "op1_warc_index": expected.WARC_INDEX,
    "op3_substring_dedup": expected.SUBSTRING_DEDUP,
    "op7_minhash": expected.MINHASH,
}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[name] = query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op3(spark, sf_dir):
    from .substring_dedup import op3

    return op3(table(spark, sf_dir, "documents"))


_register("op3_substring_dedup", _op3)


def _op6(spark, sf_dir):
    import public_tokenizers

    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_register("op6_best_fit_packing", _op6)


def _op2(spark, sf_dir):
    import public_tokenizers

    from .sentencepiece_codec import op2

    return op2(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_register("op2_sentencepiece", _op2)


def _op9(spark, sf_dir):
    from .lm_scoring import op9

    return op9(table(spark, sf_dir, "documents"))


_register("op9_context_mixing", _op9)


def _op8(spark, sf_dir):
    from .secret_scan import op8

    return op8(table(spark, sf_dir, "documents"))


_register("op8_secret_ledger", _op8)


def _op10(spark, sf_dir):
    from .toxicity import op10

    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_register("op10_toxicity", _op10)


def _op5(spark, sf_dir):
    from .quality_rules import op5

    return op5(table(spark, sf_dir, "documents"))


_register("op5_weak_supervision", _op5)


def _op4(spark, sf_dir):
    from .order_minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


_register("op4_order_minhash", _op4)


def _op1(spark, sf_dir):
    from .warc import op1

    return op1(table(spark, sf_dir, "pages"))


_register("op1_warc_index", _op1)


def _op7(spark, sf_dir):
    from .minhash_dedup import op7

    return op7(table(spark, sf_dir, "documents"))


_register("op7_minhash", _op7)


def _op13(spark, sf_dir):
    from .sharding import op13

    return op13(table(spark, sf_dir, "documents"))


_register("op13_sampled_splitters", _op13)


def _op12(spark, sf_dir):
    from .whitening import op12

    return op12(table(spark, sf_dir, "embeddings"))


_register("op12_jacobi_davidson", _op12)


def _op11(spark, sf_dir):
    import public_tokenizers

    from .cross_alignment import op11

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return op11(table(spark, sf_dir, "documents"), *paths)


_register("op11_pair_hashing", _op11)
