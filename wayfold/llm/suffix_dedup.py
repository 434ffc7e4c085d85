"""Removal of repeated passages, by refining suffix buckets.

A byte goes if it lies in a LENGTH-byte string that also starts earlier: in a smaller
doc_id, or in the same document at an earlier offset; strings are judged on the input.

1. *Initial buckets.*  Suffixes at the anchors of windows (repeat_kernels.py) are put in
   buckets by their q-gram; windows that share an anchor travel as one row, with the
   identifier of all bytes they span.  Rows that repeat a span within a run of texts are
   settled on the spot, so a passage that all documents share leaves each run once.
2. *Refinement.*  Rows meet by bucket, and each bucket is sorted by span identifier: all but the
   first of equal spans are repeats.  A bucket that holds one span is final.
3. *Recursive refinement.*  Where a bucket holds several spans, the first of each is opened
   into cores: 93 bytes that eight windows in a row share.  Their identifiers come from those of
   the q-grams at later offsets, each step reusing the last (25, 50 and 93 bytes).  Cores
   meet by identifier; a core that is alone is final, and the windows of the others are
   told apart by the seven bytes on either side, which travel along.  All but the
   first of equal windows are repeats.
4. The repeats of a document are brought to its text and cut out.

Shuffles move rows of some 25 bytes, one for about 40 bytes of text, and the texts twice, compressed.
Repeats that are settled early travel with those rows, as spans of negative n.
No group is gathered in a task: tasks sort hash partitions of bounded size, and repeats
within a run have gone before.  Spans are equal where bucket (32 bits) and identifier (64 bits) both are, windows where the
core's identifier and that of the 14 bytes around it are: over 1e13 rows fewer than one in a hundred corpora has a false pair.

Null text counts as empty.  Null doc_ids come before all others.  Rows that share a
doc_id, or null, are documents of their own, in the order of a hash of their texts.  No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import repeat_kernels as rk

LENGTH, STEP = rk.LENGTH, rk.STEP
#: Anchor rows that are settled together before they leave a task.
RUN = 1_000_000
#: Bytes of text for each task of a refinement.
TASK_BYTES = 24 << 20
_ROWS = "bucket int, span long, doc long, start long, n long"
_CORES = "core long, left long, right long, doc long, start long, n long"
_SPANS = "doc long, kind int, start long, end long, anchor long"


def _batch(names: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [x.split(" ") for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _slices(docs: list[int], texts: list[bytes]):
    """Runs of texts as (bytes, bounds, doc of each text, offset of each text in its document)."""
    data, doc, base, size = [], [], [], 0
    for d, t in zip(docs, texts, strict=True):
        for at in range(0, max(1, len(t) - LENGTH + 1), rk.SLICE // 2):
            part = t[at : at + rk.SLICE // 2 + LENGTH - 1]  # windows that start in this half slice
            if len(part) < LENGTH:
                continue
            if size + len(part) > rk.SLICE:
                yield data, doc, base
                data, doc, base, size = [], [], [], 0
            data.append(part)
            doc.append(d)
            base.append(at)
            size += len(part)
    if data:
        yield data, doc, base


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _early(doc, start, end):
    """Spans that repeat, merged, with a number that spreads them over tasks."""
    d, s, e = rk.merged(doc, start, end)
    return d, s, e, rk._mixed(d.view(np.uint64) + np.uint64(1)).view(np.int64)


def _anchors(batches):
    """Rows of step 1; n holds the number of windows and, from bit 8 on, the way to the anchor."""
    held: list[tuple] = []
    count = 0

    def settle():
        bucket, span, doc, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, late, new = rk.not_first(bucket, span, doc, start)
        go, gone = np.sort(order[new]), order[late]
        for at in range(0, len(go), 200_000):
            k = go[at : at + 200_000]
            yield _batch(_ROWS, bucket[k], span[k], doc[k], start[k], n[k])
        d, s, e, spread = _early(doc[gone], start[gone], start[gone] + (n[gone] & 255) + LENGTH - 1)
        if len(d):
            yield _batch(_ROWS, spread >> 32, spread, d, s, s - e)

    for b in batches:
        ids, texts = b.column("id").to_pylist(), b.column("data").to_pylist()
        for parts, doc, base in _slices(ids, texts):
            data, bounds = _flat(parts)
            bucket, span, text, lo, n, way = rk.anchor_ranges(data, bounds)
            doc, base = np.array(doc, np.int64), np.array(base, np.int64)
            held.append(((bucket >> np.uint64(32)).astype(np.uint32).view(np.int32), span.view(np.int64), doc[text], lo - bounds[text] + base[text], n | way << 8))
            count += len(n)
            if count > RUN:
                yield from settle()
                held, count = [], 0
    if held:
        yield from settle()


def _gathered(batches) -> list[np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return [t.column(k).to_numpy() for k in range(t.num_columns)]


def _refine(batches):
    """Step 2 over one hash partition of buckets: repeats (kind 1) and spans to open (kind 2)."""
    got = _gathered(batches)
    if got is None:
        return
    k = got[4] < 0
    if k.any():
        yield _batch(_SPANS, got[2][k], np.ones(k.sum()), got[3][k], got[3][k] - got[4][k], np.zeros(k.sum()))
    bucket, span, doc, start, n = (x[~k] for x in got)
    order, late, new = rk.not_first(bucket, span, doc, start)
    k = order[late]
    if len(k):
        yield _batch(_SPANS, doc[k], np.ones(len(k)), start[k], start[k] + (n[k] & 255) + LENGTH - 1, np.zeros(len(k)))
    k = order[new]
    same = bucket[k][1:] == bucket[k][:-1]
    several = np.zeros(len(k), bool)
    several[1:] |= same
    several[:-1] |= same
    k = k[several]
    if len(k):
        yield _batch(_SPANS, doc[k], np.full(len(k), 2), start[k], start[k] + (n[k] & 255), start[k] + (n[k] >> 8))


def _cores_of(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray):
    """The cores of windows lo..hi-1 of each span: (identifier, left, right, place of the core, first and last i).

    A window that starts at anchor - o has the core at anchor - o // STEP * STEP, so equal
    windows have equal cores."""
    first, last = (anchor - hi + 1) // STEP, (anchor - lo) // STEP
    count = last - first + 1
    span = np.repeat(np.arange(len(lo)), count)
    block = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + first[span]
    at = anchor[span] - STEP * block
    i0 = np.maximum(0, at - hi[span] + 1)
    i1 = np.minimum(STEP - 1, at - lo[span])
    core = np.zeros(len(at), np.uint64)
    for begin in range(0, len(text), rk.SLICE // 2):
        own = np.flatnonzero((at >= begin) & (at < begin + rk.SLICE // 2))
        if len(own):
            core[own] = rk.core_ids(rk.Prefixes(text[begin : begin + rk.SLICE // 2 + LENGTH]))[at[own] - begin]
    left, right = rk.contexts(text, at)
    return core, left, right, at, i0, i1


def _open(batches):
    """Step 3: the cores of the spans to open, from rows (id, z, spans); n holds the first and last window."""
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        for doc, z, spans in zip(b.column("id").to_pylist(), b.column("z").to_pylist(), b.column("spans"), strict=True):
            text = np.frombuffer(unzip.decompress(z), np.uint8)
            lo, hi, anchor = (x.to_numpy() for x in spans.values.flatten())
            fits = hi + LENGTH - 1 <= len(text)  # else of another row with this doc_id
            core, left, right, at, i0, i1 = _cores_of(text, lo[fits], hi[fits], anchor[fits])
            yield core.view(np.int64), left.view(np.int64), right.view(np.int64), np.full(len(at), doc, np.int64), at, i0 | i1 << 8


def _cores(batches):
    """_open, with cores that repeat in a run of texts settled before they leave."""
    held: list[tuple] = []
    count = 0

    def settle():
        core, left, right, doc, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = rk._mixed(rk._mixed(core.view(np.uint64) + left.view(np.uint64) * rk._MIX) + right.view(np.uint64) * rk._MIX + n.view(np.uint64))
        order, late, new = rk.not_first(core, whole, doc, at)
        go, gone = np.sort(order[new]), order[late]
        for k in (go[x : x + 200_000] for x in range(0, len(go), 200_000)):
            yield _batch(_CORES, core[k], left[k], right[k], doc[k], at[k], n[k])
        d, s, e, spread = _early(doc[gone], at[gone] - (n[gone] >> 8), at[gone] - (n[gone] & 255) + LENGTH)
        if len(d):
            yield _batch(_CORES, spread, s, e, d, s, np.full(len(d), -1))

    for row in _open(batches):
        held.append(row)
        count += len(row[0])
        if count > RUN:
            yield from settle()
            held, count = [], 0
    if held:
        yield from settle()


def _last(batches):
    """All but the first of equal windows, in one hash partition of cores."""
    got = _gathered(batches)
    if got is None:
        return
    k = got[5] < 0
    if k.any():
        yield _batch(_SPANS, got[3][k], np.ones(k.sum()), got[1][k], got[2][k], np.zeros(k.sum()))
    core, left, right, doc, at, n = (x[~k] for x in got)
    order = np.argsort(core, kind="stable")
    same = core[order][1:] == core[order][:-1]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    k = order[several]
    if not len(k):
        return
    i0, i1 = n[k] & 255, n[k] >> 8
    count = i1 - i0 + 1
    row = np.repeat(k, count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(i0, count)
    ids = rk.window_ids(core[row].view(np.uint64), left[row].view(np.uint64), right[row].view(np.uint64), i)
    doc, start = doc[row], at[row] - i
    order, late, _ = rk.not_first(core[row], ids, doc, start)
    k = order[late]
    if len(k):
        d, s, e = rk.merged(doc[k], start[k], start[k] + LENGTH)
        yield _batch(_SPANS, d, np.ones(len(d)), s, e, np.zeros(len(d)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, spans): the byte spans, not merged, that repeat an earlier passage."""
    docs = docs.select("doc_id", "text")
    data = common.with_id(docs).select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    tasks = common.task_count(docs, TASK_BYTES)
    found = common.stash(data.mapInArrow(_anchors, _ROWS).repartition(tasks, "bucket").mapInArrow(_refine, _SPANS), "refined")
    todo = found.filter("kind = 2").groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "end", "anchor")).alias("spans"))
    cores = common.text_rows(docs).drop("doc_id").join(todo.hint("merge"), "id").select("id", "z", "spans").mapInArrow(_cores, _CORES)
    late = cores.repartition(tasks, "core").mapInArrow(_last, _SPANS)
    spans = found.filter("kind = 1").unionByName(late)
    return spans.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cuts(b: pa.RecordBatch):
    """(bytes, which go) of each row of (.., z, spans)."""
    unzip = zstandard.ZstdDecompressor()
    for z, spans in zip(b.column("z").to_pylist(), b.column("spans"), strict=True):
        text = np.frombuffer(unzip.decompress(z), np.uint8)
        if spans.is_valid:
            lo, hi = (x.to_numpy() for x in spans.values.flatten())
            yield text, rk.covered(len(text), lo, hi)
        else:
            yield text, np.zeros(len(text), bool)


def _reports(batches):
    for b in batches:
        out = [[], [], [], []]
        for text, gone in _cuts(b):
            runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
            for column, v in zip(out, (len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what stays."""
    return common.by_rows(docs.select("doc_id", "text"), _report, "doc_id")


def _report(docs: DataFrame) -> DataFrame:
    rows = common.text_rows(docs.select("doc_id", "text")).join(repeated_spans(docs).hint("merge"), "id", "left")
    return rows.select("doc_id", "z", "spans").mapInArrow(_reports, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut out of their texts; n_chars, where there is one, follows.

    A character that loses some of its bytes goes with them; a null text stays null."""
    return common.by_rows(docs, _cut, "doc_id")


def _cut(docs: DataFrame) -> DataFrame:
    inside = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no column clashes
    marked = docs.select("doc_id", "text", F.col("text").isNull().alias("__null"), *[F.col(f"`{c}`").alias(x) for c, x in inside.items()])
    rows = common.text_rows(marked).join(repeated_spans(docs).hint("merge"), "id", "left").drop("id")
    others = [c for c in rows.columns if c not in ("z", "spans")]
    schema = rows.select(*others, F.lit("").alias("text")).schema

    def run(batches):
        for b in batches:
            kept = [text[~gone].tobytes().decode("utf-8", "ignore") for text, gone in _cuts(b)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(kept, pa.string())], [*others, "text"])

    got = rows.mapInArrow(run, schema).withColumn("text", F.when(~F.col("__null"), F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn(inside["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*[F.col(inside.get(c, c)).alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
