"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows are reduced to one candidate per digest, anti-joined (sort-merge) with the index, and the digests the
index lacks are appended. Everything is DataFrame code.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, hot_joined, row_key, rows_of, written


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the id of the row that stays.

    ``path`` holds Parquet files in ``buckets`` buckets by ``text_sha256``, each sorted by it, so the anti-join and
    the lookup of a batch read the index without shuffling it. Opening the same path again, also in a later
    session, continues that index; ``buckets`` must then be as before. Choose ``buckets`` so that a bucket of the
    final index fits a task (about 100 million digests each).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Adds (text_sha256, keep_id) rows, one writer task per bucket."""
        (
            new.select("text_sha256", "keep_id")
            .repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def dedup(self, docs: DataFrame) -> DataFrame:
        """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; then extends the index.

        Of the batch's rows with one digest, that with the smallest doc_id stays unless the index already has the
        digest; then none does and keep_id is the index's. group_size counts rows of the batch. Null text is the
        empty text; null ids come after all others; of repeated rows exactly one stays. An empty table gives no
        rows; other columns of ``docs`` are ignored. The decisions are written before the index grows, so a lost
        executor or a failed append never turns a kept row into a dropped one.
        """
        rows = written(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                digest(F.col("text")).alias("text_sha256"),
                F.monotonically_increasing_id().alias("row_id"),
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")))
        groups = written(
            rows.groupBy("text_sha256")
            .agg(first.alias("first"), F.count("*").alias("group_size"))
            .select("text_sha256", "group_size", F.col("first.doc_id").alias("first_id"), F.col("first.row_id").alias("first_row")),
            "digest-groups",
        )
        new = groups.join(self.read().hint("merge"), "text_sha256", "left_anti").select(
            "text_sha256", "group_size", F.col("first_id").alias("keep_id"), "first_row"
        )
        new = written(new, "digest-new")
        old = groups.join(self.read().hint("merge"), "text_sha256").select(
            "text_sha256", "group_size", "keep_id", F.lit(None).cast("long").alias("first_row")
        )
        keepers = written(new.unionByName(old), "digest-keepers")
        out = written(
            hot_joined(rows, keepers, "text_sha256", "group_size").select(
                "doc_id",
                "keep_id",
                "group_size",
                F.coalesce(F.col("row_id") == F.col("first_row"), F.lit(False)).alias("kept"),
                "text_sha256",
                "row_id",
            ),
            "digest-decisions",
        )
        self.append(new)
        return out


def distinct_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: a left-semi join on the decisions.

    Of repeated rows (same id and text) all but one go, whatever their other columns. Whole rows are shuffled once.
    """
    kept = index.dedup(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("row_key"))
    return rows_of(docs, row_key(docs["doc_id"].cast("long"), digest(docs["text"])), kept)
