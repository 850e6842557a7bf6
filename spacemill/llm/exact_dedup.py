"""Exact deduplication: local, salted and global combining, comparing full content at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spacemill.llm.common import lookup, salt_of, stage


def normalised(text: Column) -> Column:
    """The text with each ``[\\x20\\x09-\\x0D]+`` as one space; null counts as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    1. Partial aggregation on (digest, salt, text) drops a partition's own copies.
    2. The same key, shuffled, merges each salted part of a digest's group.
    3. At most SALTS winners of each (digest, text) meet by digest and merge.
    Each merge groups by the whole normalised text, so a digest that two texts share never joins them. Rows
    then find their group by digest where stage 3 proved it to hold one text, else by digest and text.

    A null text counts as empty; the smallest non-null id of a group stays, and rows that repeat that id and
    its text are kept alike. A group whose ids are all null keeps its rows, with keep_id null. Other columns are not looked at.
    """
    n = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = n.select("id", "norm", digest(F.col("norm")).alias("digest"), salt_of("id").alias("salt"))
    # a slim row each, so that finding the groups needs no text again
    slim = stage(rows.select("id", "digest", "salt", *([] if digest is sha256 else [sha256(F.col("norm")).alias("text_sha256")])), "exact-rows")
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = stage(by_digest, "exact-groups")
    single = groups.where("texts = 1").drop("texts")
    out = lookup(slim, single, "digest", "salt", "inner")
    cols = ["id", "keep_id", "group_size", "text_sha256"]
    out = out.select("id", "keep_id", "group_size", F.col("digest" if digest is sha256 else "text_sha256").alias("text_sha256"))
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():  # two texts under one digest: those rows go by digest and text
        hit = rows.join(shared, "digest", "left_semi")
        found = winners.join(shared, "digest", "left_semi")
        out = out.unionByName(hit.join(found, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm"))).select(*cols))
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
