"""Best-fit packing of token sequences with certified bin counts.

Each text's ids, closed by id 0, make one document; only documents longer than a
sequence are cut, into whole sequences and a rest.  The pieces are dealt by hash into
partitions of bounded size, and each is packed by best-fit decreasing.  Lower bounds from
dual-feasible functions over the partition's sizes certify its count; where count and
bound differ, the pieces of the sequences that are not full leave their partitions, are
dealt anew together with those of the other such partitions, and are packed again.  A
round is taken only if it saves sequences.  Rounds go on until the count of all sequences meets
the bound over all sizes, or PATIENCE rounds in a row save nothing; then the sequences
that are not full in any partition, certified ones too, exchange their pieces in the same way.

Ids are those of the library.  The distinct plain words of a batch are encoded by the
token automaton, compiled from the same vocabulary; all else goes through the library itself.

Null counts as empty (one piece, of id 0).  Repeated rows are packed like any others.
Extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .token_automaton import END, TokenAutomaton

VOCABULARY, CAPACITY = "word_bpe_49k.json", 2048
#: Pieces of a partition, on average; a packing task holds some 20 MB.
PIECES = 40_000
#: Rounds in a row that may save nothing.
PATIENCE = 2
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", sequence_id long, offset long, fill long, bins long, bound long"


def ids_of(run: pa.Array, path: str, automaton: TokenAutomaton) -> words.Ragged:
    """The ids of a run of texts.  Stems are lower-cased Latin letters in composed form, which the
    automaton encodes; tails of marks, and all other parts, go to the library."""
    p, ids = words.Parts(run, lower=True), words.library_ids(path)
    stems = automaton.encode_words([w.removeprefix(b" ") + END for w in p.stems])
    groups = (stems, ids([w.decode() for w in p.tails]), ids(p.others))
    return p.texts(p.spell(*[words.Ragged.of(g, np.uint32) for g in groups]))


@functools.cache
def compiled(path: str) -> TokenAutomaton:
    """Compiled once, on the driver; some 25 MB, whatever the data."""
    return TokenAutomaton.load_words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces."""

    shared = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches):
        for b in batches:
            ids, rows, at = b.column("doc_id").to_pylist(), [[], [], [], [], []], 0
            for part in words.runs(b.column("text")):
                found = ids_of(part, path, shared.value)
                flat = memoryview(np.ascontiguousarray(found.flat, "<u4")).cast("B")
                for k, (lo, hi) in enumerate(zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True)):
                    total = hi - lo + 1  # with the closing id 0
                    for j, start in enumerate(range(0, total, capacity)):
                        n = min(capacity, total - start)
                        crc = zlib.crc32(flat[4 * (lo + start) : 4 * min(lo + start + n, hi)])
                        if start + n == total:
                            crc = zlib.crc32(bytes(4), crc)
                        for column, v in zip(rows, (ids[at + k], j, start, n, crc), strict=True):
                            column.append(v)
                at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The most bins that dual-feasible functions prove necessary for the sizes."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity) if len(sizes) else 0


def bound_of(count: np.ndarray, capacity: int) -> int:
    """lower_bound, from the number of pieces of each size."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # sizes over capacity - e count as whole, sizes under e as nothing
    small, large = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    whole = large[-1] - large[capacity - e]
    middle = small[capacity - e] - small[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 33):  # rounding to multiples of 1/k, exact multiples of 1/(k+1) staying as they are
        exact = (k + 1) * x % capacity == 0
        scaled = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, offset in it, fill of each bin); sizes must not increase.

    Free room is at most `capacity`, so the fullest bin that takes a size is found
    among the bits of one number."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, fills = 0, [], [], []
    for s in sizes:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(capacity - r)
        fills[b] += s
        if r := r - s:
            if not room[r]:
                mask |= 1 << r
            room[r].append(b)
    return bins, offsets, fills


def _deal(rows: DataFrame, n: int, turn: int, capacity: int) -> DataFrame:
    """Pack rows in about n / PIECES partitions; the shuffle sorts nothing, each task holds its own pieces."""

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        size, doc, piece = (t.column(c).to_numpy() for c in ("length", "doc_id", "piece"))
        doc = np.nan_to_num(doc, nan=-1).astype(np.int64)
        order = np.lexsort((piece, doc, -size))
        bins, offsets, fills = best_fit(size[order].tolist(), capacity)
        bins, at = np.array(bins), TaskContext.get().partitionId()
        out = t.take(pa.array(order)).append_column("sequence_id", pa.array(bins + (turn << 48) + (at << 24)))
        for name, v in (("offset", np.array(offsets)), ("fill", np.array(fills)[bins]), ("bins", np.full(len(bins), len(fills))), ("bound", np.full(len(bins), lower_bound(size, capacity)))):
            out = out.append_column(name, pa.array(v, pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    parts = max(1, -(-n // PIECES))
    key = F.xxhash64("doc_id", "piece", F.lit(turn))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(parts, key).mapInArrow(run, _PACKED)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset."""
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # up to `capacity` rows
        count[r["length"]] = r["count"]
    bound, open_ = bound_of(count, capacity), F.col("fill") < capacity
    pool = common.stash(_deal(rows, int(count.sum()), 0, capacity), "packed")
    n, used = _size(pool)
    done, settled, turn = None, 0, 0  # of those that are settled: rows, sequences; the others are in the pool
    for kind in ((F.col("bins") > F.col("bound")) & open_, open_):
        every = pool if done is None else done.unionByName(pool)
        total = settled + used
        done, pool = every.filter(~kind), every.filter(kind)
        n, used = _size(pool)
        settled, idle = total - used, 0
        while settled + used > bound and used > 1 and idle < PATIENCE:
            turn += 1
            now = common.stash(_deal(pool, n, turn, capacity), "packed")
            bins = _size(now)[1]
            idle = idle + 1 if bins >= used else 0
            if bins < used:
                done, pool = done.unionByName(now.filter(~kind)), now.filter(kind)
                left = _size(pool)
                settled, n, used = settled + bins - left[1], *left
    return done.unionByName(pool)


def _size(packed: DataFrame) -> tuple[int, int]:
    """(pieces, sequences)"""
    return tuple(packed.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))).first())


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    got = pack(common.stash(pieces(docs, path, capacity), "pieces"), capacity)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), words.public_path(VOCABULARY))
