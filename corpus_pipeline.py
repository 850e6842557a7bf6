"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage is written as Parquet and read again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spacemill.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from spacemill.llm.common import delete, dropping, made, stage as staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24
#: Keys of dropped rows up to which they are broadcast (some 80 MB); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def key() -> Column:
    """What tells rows apart: the id, null ids last, with the text's hash and length, since ids may be null or repeat."""
    text = F.col("text")
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in the staged, distinct gone (column key)."""
    few = gone.count() <= BROADCAST_KEYS
    return docs.select(*COLUMNS, key().alias("key")).join(F.broadcast(gone) if few else gone, "key", "left_anti").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of the training folds, does not reject.

    Null and empty texts have no hits and stay, as do all rows where labels of either kind are lacking. Rows are judged one by
    one, so repeated ids and rows do not matter. Other columns than those of documents are left out.
    """
    with dropping(spark, []):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near-duplicates.

    Null ids come after others; of rows that repeat an id, that with the smaller hash of its text. Of rows that
    repeat id and text one stays. Null and empty texts are near-duplicates of nothing, so each of them stays, but for rows that
    repeat id and text.
    """
    keyed = docs.select("text", key().alias("key"))
    kept: list[DataFrame] = []
    with dropping(spark, kept):
        found = staged(near_dedup.near_duplicates(keyed, id_col="key").select("key", "kept"), "pipeline-kept")
        gone = staged(found.where("not kept").select("key").distinct(), "pipeline-gone")
        again = staged(found.where("kept").groupBy("key").count().where("count > 1").select("key"), "pipeline-again")
        kept += [gone, again]
    out = without(docs, gone)
    if again.isEmpty():
        return out
    rows = out.withColumn("key", key())
    few = again.count() <= BROADCAST_KEYS
    repeated = rows.join(F.broadcast(again) if few else again, "key", "left_semi").dropDuplicates(["key"])
    return without(out, again).unionByName(repeated.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window.

    Null and empty texts have none and stay. Each row is judged by its own text, whether or not its id is null or repeats.
    """
    kept: list[DataFrame] = []
    with dropping(spark, kept):
        marked = decontaminate.decontaminate(docs.select("text", key().alias("key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0)
        gone = staged(marked.where("contaminated").select("key").distinct(), "pipeline-gone")
        kept.append(gone)
    return without(docs, gone)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each once, in the order of the Pfair schedule: part files, and rows in them, follow the mix.

    A null source is a source like others, a null text has no bytes; repeated rows are given as often as they are there.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard by jump hashing; slots number a shard's documents without gaps, in the order of the mix.

    That order is the part files' and the rows' in them; docs that are not read from files are written first. A null id counts
    as 0, a null text has no bytes; rows that repeat an id share its shard and have a slot each.
    """
    order = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        rows = docs.select(*COLUMNS, *order)
    except AnalysisException:
        rows = staged(docs.select(*COLUMNS), "pipeline-rows").select(*COLUMNS, *order)
    return sharding.shard_documents(rows, SHARDS, sequence=("_file", "_row"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The toxicity stage learns a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents. Each stage's result is staged; what it was made of is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = set(made(spark))
        after = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, [p for p in made(spark) if p not in before and p != after.staged_at])
        if name != STAGES[0][0]:
            delete(spark, [docs.staged_at])
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
