"""All pairs of two tables, a block of rows of either side at a time.

A pair of blocks is one row; what numpy makes of it leaves the task, not the pairs.  No side has to fit
anywhere, and a row is of a bounded size whatever the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels

#: Points (or other numbers) of a block, and rows of it.
POINTS, ROWS = 60_000, 1_000
#: Blocks that are dealt as one where a side has more than SIDE: each side goes to as many tasks as the other has parts.
JOINED, SIDE = 10, 10
#: Tasks at most that the pairs of parts are dealt to.
TASKS = 2_000


def flat(traj: DataFrame, id_: str, pts: str, *more: str) -> DataFrame:
    """id, x, y and further columns of trajectories that are not null."""
    rows = traj.filter(F.col(id_).isNotNull() & F.col(pts).isNotNull())
    return rows.select(F.col(id_).cast("long").alias("id"), F.col(pts).getField("x").alias("x"), F.col(pts).getField("y").alias("y"), *more)


def _count(rows: DataFrame, weight: Column, points: int, most: int) -> int:
    """Parts that a side is dealt in."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(weight)).first()
    blocks = max(1, -(-n // most), -(-int(total or 0) // points))
    return max(min(blocks, SIDE), -(-blocks // JOINED))


def _cut(rows: pa.StructArray, points: int, most: int) -> list[pa.StructArray]:
    """The blocks of a part."""
    x = rows.field("x") if rows.type.get_field_index("x") >= 0 else None
    sizes = np.diff(x.offsets.to_numpy()) if x is not None and pa.types.is_list(x.type) else np.ones(len(rows), np.int64)
    total, out, at = np.append(0, np.cumsum(sizes)), [], 0
    while at < len(rows):
        stop = min(at + most, max(at + 1, int(np.searchsorted(total, total[at] + points, side="right")) - 1))
        out.append(rows.slice(at, stop - at))
        at = stop
    return out


def _dealt(rows: DataFrame, n: int, name: str) -> DataFrame:
    part = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    return rows.select(part.alias(name), F.struct(*rows.columns).alias("r")).groupBy(name).agg(F.collect_list("r").alias(f"{name}_rows"))


def met(left: DataFrame, right: DataFrame, run: Callable[[pa.StructArray, pa.StructArray], Iterator[dict]], schema: str, points: tuple[int, int] = (POINTS, POINTS), rows: tuple[int, int] = (ROWS, ROWS)) -> DataFrame:
    """run(block of left, block of right) for all pairs of blocks; it yields columns by name.

    What is dealt are parts of up to JOINED blocks, which a task cuts: with as many parts as blocks, large tables would be written as often as they have blocks.

    Both tables have `id`, by whose hash they are dealt; an array column `x`, where there is one, is the weight of a row."""
    weight = lambda t: F.size("x") if dict(t.dtypes).get("x", "").startswith("array") else F.lit(1)
    nl, nr = (_count(t, weight(t), p, r) for t, p, r in zip((left, right), points, rows, strict=True))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, nl * nr))
    a = _dealt(left, nl, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).repartition(tasks, "a", "b")
    b = _dealt(right, nr, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).repartition(tasks, "a", "b")
    both = a.join(b.hint("shuffle_hash"), ["a", "b"]).select("a_rows", "b_rows")
    return both.mapInArrow(_runner(run, _schema(spark, schema), points, rows), schema)


def _schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _runner(run, schema: pa.Schema, points: tuple[int, int], rows: tuple[int, int]):
    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (_cut(batch.column(c).slice(k, 1).flatten(), points[c], rows[c]) for c in (0, 1))
                for got in (got for a in left for b in right for got in run(a, b)):
                    size = len(next(iter(got.values())))
                    for at in range(0, size, 200_000):
                        part = (got[f.name][at : at + 200_000] for f in schema)
                        yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(part, schema, strict=True)], schema=schema)

    return each


def column(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def paths(rows: pa.StructArray) -> kernels.Paths:
    x, y = rows.field("x"), rows.field("y")
    xy = np.stack([x.flatten().to_numpy(zero_copy_only=False).astype(float), y.flatten().to_numpy(zero_copy_only=False).astype(float)])
    return kernels.Paths(xy, np.diff(x.offsets.to_numpy()))


def lists(rows: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all entries of an array column, one after the other, the number of entries of each row)."""
    x = rows.field(name)
    return x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())


def first_n(values: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least values, of equal ones the first, in this order."""
    if len(values) > n:
        most = np.partition(values, n - 1)[n - 1]
        below = np.flatnonzero(values < most)
        at = np.concatenate([below, np.flatnonzero(values == most)[: n - len(below)]])
    else:
        at = np.arange(len(values))
    return at[np.lexsort((at, values[at]))]


def best_of(group: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least (dist, id) of each group."""
    order = np.lexsort((ids, dist, group))
    of = group[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]
