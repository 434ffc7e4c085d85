"""Exact deduplication against a persistent index of digests (DataFrame operations only).

The index is a table (digest, keep_id, batch), bucketed and sorted by digest, at a location that
outlives the session.  A batch is digested and grouped with partial aggregation; the sort-merge
anti-join with the index, to which the index brings no shuffle, finds the texts that are new, and
these decide: one row of each is kept, and they are what is appended.  The index stays bucketed.

Nulls count as empty text.  Of equal texts in a batch the largest doc_id stays; a text
that an earlier batch brought stays under that batch's doc_id.  A batch that is run again
under its name, say after a failure, finds its own texts new again, and appends none twice.
Rows that repeat both doc_id and text count, and one of them stays: in keep_distinct the one whose columns
have the least hash.  A null doc_id ranks below all others.
Extra columns are not read.  An empty batch gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z (only) to a-z.  lower() does just that where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """The table at a location in the shared store; opened under a name of this session's catalog."""

    def __init__(self, spark: SparkSession, location: str, buckets: int):
        self.spark, self.name = spark, f"wayfold_digests_{hashlib.sha256(location.encode()).hexdigest()[:24]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch brought."""
        return groups.repartition(self.buckets, "digest").join(self.rows().filter(F.col("batch") != batch).hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add what is new, each task one sorted file of a bucket, but for what an earlier run of the batch added."""
        absent = new.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")
        absent.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """The name goes, the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n): n rows have that doc_id and that text."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def dedup_against(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest; new texts go into the index."""
    batch = batch or uuid.uuid4().hex
    rows = common.stash(digests(docs), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = common.stash(groups, "groups")
    new = common.stash(index.new(groups, batch), "new")
    old = index.rows().filter(F.col("batch") != batch).groupBy("digest").agg(F.min("keep_id").alias("keep_id"))
    old = groups.drop("keep_id").join(old.hint("merge"), "digest").select("digest", "keep_id", "group_size", F.lit(False).alias("new"))
    known = common.stash(new.withColumn("new", F.lit(True)).unionByName(old), "known")
    index.append(new, batch)
    met = common.attach(rows, known, "digest", "group_size")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return met.select("doc_id", "keep_id", "group_size", (first & F.col("new")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, location: str | None = None, batch: str | None = None) -> DataFrame:
    """dedup_against the index at a location, which stays; without one, against an empty index in the shared folder."""
    spark = docs.sparkSession
    index = DigestIndex(spark, location or common.scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return common.stash(dedup_against(docs, index, batch), "exact")
    finally:
        index.close()


def keep_distinct(docs: DataFrame, location: str | None = None, batch: str | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops; the columns stay as they are.

    A row is found by doc_id and digest together, so the texts move once."""
    kept = exact_dedup(docs, location, batch).filter("kept").select(F.col("doc_id").alias("_0"), F.col("digest").alias("_1"))
    marked = docs.select(F.col("doc_id").alias("_0"), digest(F.col("text")).alias("_1"), common.whole(docs.columns).alias("_2"))
    same = (F.col("l._1") == F.col("r._1")) & F.col("l._0").eqNullSafe(F.col("r._0"))
    met = marked.alias("l").join(kept.alias("r").hint("merge"), same, "left_semi")
    return met.groupBy("_1", "_0").agg(F.min_by("_2", F.xxhash64("_2")).alias("_2")).select("_2.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
