"""The queries of this package, with the production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spacemill.llm import chunk_dedup, decontaminate, exact_dedup, mixing, near_dedup, oracle, pii, secret_scan, sharding, toxicity, warc
from spacemill.llm.common import dropping, new_path, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("links")


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is a source and language, its owner the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = secret_scan.scan(docs, ["source", "lang"], ["source"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.spans_string(F.col("spans")).alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_place")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled captures hold their payloads; of these rows the digest columns are derived."""
    kept: list[DataFrame] = []
    with dropping(spark, kept):
        path = new_path(spark, "warc")
        warc.write_warc(table(spark, sf_dir, "pages"), path)
        records = stage(warc.read_warc(spark, path), "warc-records")
        kept.append(records)
    return warc.revisits_resolved(warc.assemble(records))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minhash_near_dedup, op2_jump_sharding, op3_decontamination, op4_secret_scan, op5_substring_dedup, op6_exact_dedup, op7_toxicity, op8_pfair_mixing, op9_pii, op10_warc)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": oracle.OP1, "op2_jump_sharding": oracle.OP2, "op3_decontamination": oracle.OP3, "op4_secret_scan": oracle.OP4, "op6_exact_dedup": oracle.OP6, "op8_pfair_mixing": oracle.OP8, "op10_warc": oracle.OP10}
