"""Tables between rounds, and joins with a side whose size was checked."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the query side of a pair join is broadcast.
BROADCAST_ROWS = 5_000
_SCRATCH: dict[str, SparkSession] = {}
_LOCAL: dict[str, str] = {}
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the session names none, a temporary one serves
    in local mode; on a cluster that is an error, since executors do not see each other's folders."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="wayfold-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    root = f"{shared_dir(spark)}/wayfold-{spark.sparkContext.applicationId}"
    _SCRATCH[root] = spark
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation.  The files go when the driver's Python ends, or by drop."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[got] = path
    return got


def drop(*tables: DataFrame) -> None:
    """Delete tables of stash that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, _TABLES.pop(t))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go when the query that wrote them ends, not when the driver's memory is cleaned."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@atexit.register
def drop_scratch() -> None:
    """Delete the scratch tables of sessions that still run."""
    while _SCRATCH:
        root, spark = _SCRATCH.popitem()
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, root)


def all_pairs(queries: DataFrame, data: DataFrame, condition: Column) -> DataFrame:
    """queries x data where the condition holds.

    Few queries (counted, up to BROADCAST_ROWS) are broadcast.  More are dealt into
    blocks of that size, and the data meets each block by an equality join, so that no
    side has to fit anywhere and every task holds one block."""
    n = queries.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return data.join(F.broadcast(queries), condition)
    blocks = -(-queries.count() // BROADCAST_ROWS)
    q = queries.withColumn("__block", F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(blocks)))
    d = data.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__salt", F.pmod(F.xxhash64(*data.columns[:1]), F.lit(64)))
    q = q.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return d.join(q, (F.col("__b") == F.col("__block")) & (F.col("__salt") == F.col("__s")) & condition).drop("__block", "__b", "__salt", "__s")


def arithmetic_hash(c: Column, seed: int) -> Column:
    """A number in [0, 2**32) that any SQL engine computes alike."""
    low = F.pmod(c.cast("long"), F.lit(1 << 31))  # so that no product overflows
    return F.pmod(low * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))
