"""What the corpus operators share: scratch tables, joins that stand hot keys, linked groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.shared import brief_shuffles, drop, scratch_path, shared_dir, stash

__all__ = ["attach", "brief_shuffles", "by_rows", "drop", "held_out", "linked_groups", "scratch_path", "shared_dir", "sorted_groups", "stash", "table", "task_count", "text_rows", "whole", "with_id"]

#: A key with more than this part of all rows is *hot*; there are at most HOT_PARTS such keys.
HOT_PARTS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold 8 MB, so that long texts do not add up to large ones; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "268435456", "67108864", "256MB", "64MB", "9223372036854775807"):  # Spark's own values
        spark.conf.set(key, str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(df: DataFrame, bytes_per_task: int) -> int:
    """Tasks for a stage over df, from the planner's size estimate and never under the session's own number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unknown = size > 1 << 52  # what the planner says of data that it can't measure
    return least if unknown else max(least, -(-size // bytes_per_task))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold of a document that nothing may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` labelled documents of the training folds, chosen by a hash of their id.

    `most` is the documented bound of the sample, so the result may be broadcast."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    one = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def whole(columns: list[str]) -> Column:
    """All columns of a row as one, so that what is put beside it clashes with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


#: Stands for a null doc_id, and comes before all others.
NULL_ID = -(1 << 63)


def with_id(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))


def by_rows(docs: DataFrame, run: Callable[[DataFrame], DataFrame], *held: str) -> DataFrame:
    """run(docs), for a run that takes a doc_id to be of one row.

    Where several rows share one, or null, the rows are numbered in the order of their doc_ids (null first) and
    texts; the numbers stand for doc_ids in run, and the columns `held` of its result get their doc_ids back."""
    if with_id(docs.select("doc_id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return run(docs)
    rest = [c for c in docs.columns if c != "doc_id"]
    order = [F.col("_1").asc_nulls_first(), F.xxhash64("_2.text").asc(), F.xxhash64("_2").asc()]
    rows = docs.select(F.col("doc_id").alias("_1"), whole(rest).alias("_2")).repartitionByRange(task_count(docs, 16 << 20), *order).sortWithinPartitions(*order)
    rows = stash(rows.withColumn("_0", F.monotonically_increasing_id()), "rows")
    got = run(rows.select(*[(F.col("_0") if c == "doc_id" else F.col("_2")[c]).alias(c) for c in docs.columns]))
    columns = got.columns
    for c in held:  # the row is one column while its doc_id comes back
        names = rows.select(F.col("_0"), (F.col("_1") if c == "doc_id" else F.coalesce(F.col("_1").cast("long"), F.lit(NULL_ID))).alias("_1"))
        got = got.select(F.col(c).alias("_0"), whole([x for x in columns if x != c]).alias("_2")).join(names.hint("merge"), "_0")
        got = got.select(*[(F.col("_1") if x == c else F.col("_2")[x]).alias(x) for x in columns])
    return got


def _zipped(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        k = b.schema.get_field_index("z")
        z = pa.array([pack.compress(x) for x in b.column(k).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([z if i == k else c for i, c in enumerate(b.columns)], b.schema.names)


def text_rows(docs: DataFrame) -> DataFrame:
    """docs with id, and z, the compressed bytes of the text (null as empty), in its place: for shuffles of texts."""
    d = with_id(docs).withColumn("z", F.coalesce(F.col("text"), F.lit("")).cast("binary")).drop("text")
    return d.mapInArrow(_zipped, d.schema)


def sorted_groups(batches, keys: int) -> Iterator[list[list]]:
    """The groups of rows, as columns, of a partition sorted by its first `keys` columns; a group may span batches."""
    now, held = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        marks = list(zip(*columns[:keys], strict=True))
        at = 0
        while at < len(marks):
            end = at + 1
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            part = [c[at:end] for c in columns]
            if marks[at] == now:
                held = [a + p for a, p in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                now, held = marks[at], part
            at = end
    if held is not None:
        yield held


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with the one group of their key; both are tables that are cheap to read twice.

    The rows of hot keys would meet in one task, so those keys (at most HOT_PARTS,
    whatever the data) are broadcast, and the others join by a shuffle."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(200, -(-(total or 0) // HOT_PARTS))
    if (most or 0) <= least:
        return rows.join(groups.hint("merge"), key)
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return few.unionByName(rest)


def linked_groups(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected group, for the nodes that have links.

    Alternating large-star and small-star contraction; each round is a grouped minimum
    (combined before the shuffle) and a join that takes hubs apart, and is
    written to the shared folder.  The rounds grow with the logarithm of the nodes."""
    spark = links.sparkSession
    edges = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("m", "u")), "least")
        met = attach(both, least, "u", "degree")
        if large:  # larger neighbours move to the least one
            out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours and the node itself move to the least one
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        out = out.filter("u <> v")
        return stash(out if large else out.distinct(), "star")

    state = None
    for _ in range(rounds):
        edges = star(star(edges, True), False)
        # settled when each node hangs on one root and no root hangs on another
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"links did not settle in {rounds} rounds in {shared_dir(spark)}")
