"""Token counts through a digest cache.

The cache is an append-only table (digest, n_tokens, version) at a location that outlives the
session: the digest of a text's bytes, the count, and the digest of the tokenizer's file.  It is
partitioned by version and bucketed by digest, so a batch meets only its version's counts, and the
cache brings no shuffle.  The texts that it lacks are encoded, by the rows of one representative
doc_id each, and their counts are appended; a batch that is run again finds them there.
The tokenizer changes nothing in a text before it splits it, so content is
normalised only in that null counts as empty.  Counts are those of the library, with no
begin, end or added special tokens; an added token's string in a text is that token.
Repeated rows each get their row; extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counts_of(texts: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text; what is encoded is the distinct words of a run of texts."""
    ids, out = words.library_ids(path), [np.zeros(0, np.int64)]

    def count(parts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in ids(parts)], np.int64)

    for run in words.runs(texts):
        p = words.Parts(run, lower=False)
        stems, tails, others = (count(x) for x in ([w.decode() for w in p.stems], [w.decode() for w in p.tails], p.others))
        plain, each = p.stem >= 0, np.zeros(len(p.stem), np.int64)
        each[plain] = stems[p.stem[plain]] + tails[p.tail[plain]]
        each[~plain] = others[p.tail[~plain]]
        out.append(p.sums(each))
    return np.concatenate(out)


def _encoder(path: str):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts_of(b.column("text"), path))], ["digest", "n_tokens"])

    return run


def digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


class CountCache:
    """The table at a location in the shared store; opened under a name of this session's catalog."""

    def __init__(self, spark: SparkSession, location: str, buckets: int):
        self.spark, self.name, self.buckets = spark, f"wayfold_counts_{hashlib.sha256(location.encode()).hexdigest()[:24]}", buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, n_tokens BIGINT, version STRING) USING parquet "
            f"PARTITIONED BY (version) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def rows(self, version: str) -> DataFrame:
        """(digest, n_tokens); two runs at the same time may have counted a text twice."""
        rows = self.spark.table(self.name).filter(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame, version: str) -> None:
        rows = counted.repartition(self.buckets, "digest").select("digest", "n_tokens", F.lit(version).alias("version"))
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """The name goes, the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def count_tokens(docs: DataFrame, path: str, location: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row; the cache at a location, which stays, grows by what it lacked.

    Without a location the cache is an empty one in the shared folder."""
    spark = docs.sparkSession
    cache = CountCache(spark, location or common.scratch_path(spark, "token-cache"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return _counted(docs, path, cache)
    finally:
        cache.close()


def _counted(docs: DataFrame, path: str, cache: CountCache) -> DataFrame:
    version = version_of(path)
    rows = common.stash(digested(docs), "digested")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    met = common.stash(groups.repartition(cache.buckets, "digest").join(cache.rows(version).hint("merge"), "digest", "left"), "met")
    misses = met.filter("n_tokens is null").select(F.col("digest").alias("__d"), F.col("rep").alias("__r"))
    texts = docs.select("doc_id", "text").withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    same = (F.col("digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__r"))
    todo = texts.join(misses.hint("merge"), same, "left_semi").select("digest", "text")
    new = todo.mapInArrow(_encoder(path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new = common.stash(new, "counted")
    cache.append(new, version)
    known = met.filter("n_tokens is not null").select("digest", "n", "n_tokens")
    known = known.unionByName(met.drop("n_tokens").join(new, "digest").select("digest", "n", "n_tokens"))
    return common.attach(rows, common.stash(known, "known"), "digest", "n").select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = count_tokens(docs, words.public_path(VOCABULARY))
    return got.withColumn("over_limit", F.col("n_tokens") > LIMIT)
