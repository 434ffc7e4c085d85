"""Readers and writers of trajectory, graph and result files.

The engine's own form is Parquet; these formats are for exchange.  Binary files hold
little-endian int32 counts and float64 or int32 values.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
TRAJ = f"traj_id bigint, pts array<{POINT}>"
SCORE = "que_index int, tra_idx int, s int, e int, score1 double"


def read_json(spark: SparkSession, path: str, swap_xy: bool = False) -> DataFrame:
    """[[[x, y], ...], ...]: one trajectory for each element, numbered from 0.  A missing file gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TRAJ)
    rows = text.select(F.posexplode(F.from_json("value", "array<array<array<double>>>")).alias("traj_id", "t"))
    x, y = (1, 0) if swap_xy else (0, 1)
    return rows.select(F.col("traj_id").cast("long"), F.transform("t", lambda p: F.struct(F.get(p, F.lit(x)).alias("x"), F.get(p, F.lit(y)).alias("y"))).alias("pts"))


def write_json(traj: DataFrame, path: str) -> None:
    """One JSON array of trajectories in a file, for exchange of small tables."""
    one = F.transform("pts", lambda p: F.array(p["x"], p["y"]))
    rows = traj.select("traj_id", one.alias("t")).agg(F.array_sort(F.collect_list(F.struct("traj_id", "t"))).alias("all"))
    rows.select(F.to_json(F.transform("all", lambda r: r["t"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A count line, then that many lines `time x y`, again and again; the time is dropped."""

    def parse(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                lines, at, ids, pts = text.split("\n"), 0, [], []
                while at < len(lines):
                    if not lines[at].strip():
                        at += 1
                        continue
                    n = int(lines[at])
                    rows = [line.split() for line in lines[at + 1 : at + 1 + n]]
                    ids.append(len(ids))
                    pts.append([{"x": float(r[1]), "y": float(r[2])} for r in rows])
                    at += 1 + n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pts, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], ["traj_id", "pts"])

    return spark.read.text(path, wholetext=True).mapInArrow(parse, TRAJ)


def write_polylines(traj: DataFrame, path: str) -> None:
    """A count line and a line `x y` with five digits for each point, trajectory by trajectory."""
    line = F.concat_ws("\n", F.size("pts").cast("string"), F.array_join(F.transform("pts", lambda p: F.format_string("%.5f %.5f", p["x"], p["y"])), "\n"))
    traj.orderBy("traj_id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_driver_csv(spark: SparkSession, path: str, bound: int | None = None) -> DataFrame:
    """driver, traj, t, lon, lat: points of a driver's trajectory in order of (t, lat, lon), as (lat, lon); numbered by driver and traj."""
    rows = spark.read.schema("driver string, traj string, t long, lon double, lat double").csv(path)
    got = rows.groupBy("driver", "traj").agg(F.array_sort(F.collect_list(F.struct("t", "lat", "lon"))).alias("p"))
    got = got if bound is None else got.orderBy("driver", "traj").limit(bound)
    pts = F.transform("p", lambda p: F.struct(p["lat"].alias("x"), p["lon"].alias("y")))
    ids = F.row_number().over(Window.orderBy("driver", "traj")) - 1 if bound is not None else F.xxhash64("driver", "traj")
    return got.select("driver", "traj", ids.cast("long").alias("traj_id"), pts.alias("pts"))


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(parse(data), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_binary(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """int32 count, then for each trajectory int32 n and n pairs of float64."""

    def parse(data: bytes) -> list[dict]:
        n, at, out = struct.unpack_from("<i", data)[0], 4, []
        for k in range(n if limit is None else min(n, limit)):
            m = struct.unpack_from("<i", data, at)[0]
            v = np.frombuffer(data, "<f8", 2 * m, at + 4).reshape(m, 2).tolist()
            out.append({"traj_id": k, "pts": [{"x": x, "y": y} for x, y in v]})
            at += 4 + 16 * m
        return out

    return _binary(spark, path, parse, TRAJ)


def read_ragged(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """Rows of int32 length and values (int: int32, double: float64, float: float32) up to the end: row, values."""
    code = {"int": "<i4", "double": "<f8", "float": "<f4"}[kind]

    def parse(data: bytes) -> list[dict]:
        at, out = 0, []
        while at < len(data):
            n = struct.unpack_from("<i", data, at)[0]
            out.append({"row": len(out), "values": np.frombuffer(data, code, n, at + 4).tolist()})
            at += 4 + n * np.dtype(code).itemsize
        return out

    return _binary(spark, path, parse, f"row bigint, values array<{kind}>")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """int32 rows; for each int32 n and n pairs of int32: row, values array of (s, e)."""

    def parse(data: bytes) -> list[dict]:
        rows, at, out = struct.unpack_from("<i", data)[0], 4, []
        for k in range(rows):
            n = struct.unpack_from("<i", data, at)[0]
            v = np.frombuffer(data, "<i4", 2 * n, at + 4).reshape(n, 2).tolist()
            out.append({"row": k, "values": [{"s": s, "e": e} for s, e in v]})
            at += 4 + 8 * n
        return out

    return _binary(spark, path, parse, "row bigint, values array<struct<s:int,e:int>>")


def read_top_points(spark: SparkSession, path: str) -> DataFrame:
    """int32 n and n ids."""

    def parse(data: bytes) -> list[dict]:
        return [{"traj_id": k} for k in np.frombuffer(data, "<i4", struct.unpack_from("<i", data)[0], 4).tolist()]

    return _binary(spark, path, parse, "traj_id bigint")


def read_top_indices(spark: SparkSession, path: str) -> DataFrame:
    """int32 count; for each int32 id, int32 m and m ids: src, rank, dst."""

    def parse(data: bytes) -> list[dict]:
        n, at, out = struct.unpack_from("<i", data)[0], 4, []
        for _ in range(n):
            src, m = struct.unpack_from("<ii", data, at)
            out += [{"src": src, "rank": r, "dst": d} for r, d in enumerate(np.frombuffer(data, "<i4", m, at + 8).tolist())]
            at += 8 + 4 * m
        return out

    return _binary(spark, path, parse, "src bigint, rank int, dst bigint")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """int32 rows, int32 columns, then float64 values row by row: row, values."""

    def parse(data: bytes) -> list[dict]:
        rows, cols = struct.unpack_from("<ii", data)
        return [{"row": k, "values": v} for k, v in enumerate(np.frombuffer(data, "<f8", rows * cols, 8).reshape(rows, cols).tolist())]

    return _binary(spark, path, parse, "row bigint, values array<double>")


def pack_trajectories(rows: list[list[tuple[float, float]]]) -> bytes:
    return struct.pack("<i", len(rows)) + b"".join(struct.pack("<i", len(r)) + np.array(r, "<f8").tobytes() for r in rows)


def pack_ragged(rows: list[list], code: str = "<i4") -> bytes:
    return b"".join(struct.pack("<i", len(r)) + np.array(r, code).tobytes() for r in rows)


def pack_ranges(rows: list[list[tuple[int, int]]]) -> bytes:
    return struct.pack("<i", len(rows)) + b"".join(struct.pack("<i", len(r)) + np.array(r, "<i4").tobytes() for r in rows)


def pack_top_points(ids: list[int]) -> bytes:
    return struct.pack("<i", len(ids)) + np.array(ids, "<i4").tobytes()


def pack_top_indices(rows: dict[int, list[int]]) -> bytes:
    return struct.pack("<i", len(rows)) + b"".join(struct.pack("<ii", k, len(v)) + np.array(v, "<i4").tobytes() for k, v in rows.items())


def pack_dense(rows: list[list[float]]) -> bytes:
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of a dense matrix have one length")
    return struct.pack("<ii", len(rows), len(rows[0]) if rows else 0) + np.array(rows, "<f8").tobytes()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE).option("header", True).option("enforceSchema", True).csv(path)


def read_truth(spark: SparkSession, path: str, k: int) -> DataFrame:
    """A line of ids for each query, best first: query_id (by line), rank from 1, traj_id."""
    text = spark.read.text(path, wholetext=True).filter("value <> ''").select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("query_id", "line"))
    ids = F.slice(F.split(F.trim("line"), " +"), 1, k)
    return text.select(F.col("query_id").cast("long"), F.posexplode(ids).alias("r", "id")).filter("id <> ''").select("query_id", (F.col("r") + 1).alias("rank"), F.col("id").cast("long").alias("traj_id"))


def write_truth(truth: DataFrame, path: str) -> None:
    """Lines of ids in rank order, one for each query."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "traj_id"))), lambda r: r["traj_id"].cast("string"))
    truth.groupBy("query_id").agg(F.array_join(ids, " ").alias("value")).orderBy("query_id").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_topk(top: DataFrame, path: str) -> None:
    top.orderBy("query_id", "rank").select(F.col("query_id").alias("Query Index"), F.col("traj_id").alias("Neighbor Index"), F.col("dist").alias("Distance")).write.mode("overwrite").option("header", True).csv(path)


def append_matches(matches: DataFrame, path: str) -> None:
    matches.select("query_id", "traj_id", "start", "end", "dist").write.mode("append").csv(path)


def string_path(s: Column) -> Column:
    """A text as a path: each character is the point (code, code)."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.struct(F.ascii(c).cast("double").alias("x"), F.ascii(c).cast("double").alias("y")))


def split_fields(s: Column, separator: str) -> Column:
    """Fields between separators; an empty last field is kept."""
    quoted = "\\Q" + separator + "\\E"
    return F.split(s, quoted, -1)
