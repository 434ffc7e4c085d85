"""Jaccard similarity join of word shingles, by chosen paths.

Texts are sets of shingles: every five words in a row (words are runs without white space,
A-Z lower-cased; a text of one to four words is one shingle).  Texts with equal sets form
one *class*, and one of each goes on: its document of least id.

1. A set is embedded as TOKENS minhash tokens; two sets share each token with a
   probability equal to their similarity.
2. A *run* splits the classes on tokens that it samples, ROOT at the root, so a bucket holds
   classes that agree on its path.  Buckets of up to LIMIT classes are compared by brute
   force.  Larger ones are compared with one pivot: what is close to it is
   linked and done, the rest is split on more pairs of tokens sampled at that node, again and
   again; what is still large after DEPTH splits is compared block by block, all of it.
   Runs repeat until a pair at the threshold is missed with a probability under
   1 - RECALL, whatever bucket it fell in.  Equal buckets of several runs are compared once,
   and split as often as all of them would be.
3. Comparisons use tokens and a lower threshold, and yield links that only *connect*
   (one for each class and bucket at most).  Each connected group is then compared by its exact sets, all pairs
   in blocks of bounded size, so no link between different texts is lost and none is counted twice.
   Where only the groups are asked for (keep_one), the members of each block meet the group's least member first, and
   only those that this doesn't settle meet the other blocks: a group of near copies costs its size, not its square.

Results are by document: the least doc_id it is linked to through any chain (class_id),
and its number of links, copies included.  Pairs are counted, never written out.

Null counts as empty; texts without words are linked to nothing.  Repeated rows count as copies.
Rows that share a doc_id, or null, are compared by their own texts.
A null doc_id comes before all others.  Extra columns are not read.  No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from . import repeat_kernels as rk

SHINGLE, TENTHS = 5, 8  # similarity of TENTHS / 10 or more
TOKENS, LIMIT, ROOT, DEPTH, CHILDREN = 96, 256, 3, 3, 2
RECALL = 0.9998
#: Agreement of tokens from which a bucket's classes are candidates; five deviations under the threshold.
CLOSE = 0.6
#: To a pivot: classes are linked from NEAR on, and done from DONE on.  Distances of sets obey the triangle
#: inequality: what has a similarity of 0.65 to the pivot and 0.8 to another class puts that class at 0.45 to the
#: pivot at least, so both are linked to it already and need not meet again.
NEAR, DONE = 0.35, 0.75
#: Shingles in a block of exact comparison.
BLOCK_SHINGLES = 300_000
_RNG = np.random.default_rng(77)
_ODD = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def missed(runs: int) -> float:
    """The probability that a pair at the threshold meets in no leaf, after all splits, or seems too far when it does.

    All runs sample from the same tokens, so it is taken over the number of them that the pair shares."""
    j, out = TENTHS / 10, 0.0
    for shared in range(TOKENS + 1):
        p, q = math.comb(TOKENS, shared) * j**shared * (1 - j) ** (TOKENS - shared), shared / TOKENS
        below = 1.0
        for _ in range(DEPTH):
            below = 1 - (1 - q * q * below) ** CHILDREN
        out += p * (1 - q**ROOT * below) ** runs if shared >= CLOSE * TOKENS else p
    return out


def runs_needed() -> int:
    return next(r for r in range(1, 1000) if missed(r) <= 1 - RECALL)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    out: list[np.ndarray] = []
    for run in _runs(texts):
        data = np.frombuffer(b" ".join(run).lower() + b" ", np.uint8)
        bounds = np.cumsum([0, *[len(t) + 1 for t in run]])
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts = edge[~space[edge]]
        if not space[0]:
            starts = np.concatenate([[0], starts])
        ends = edge[space[edge]]
        pre = rk.Prefixes(data) if len(data) <= rk.SLICE else None
        hashes = pre.spans(starts, ends) if pre else _long_hashes(data, starts, ends)
        hashes ^= (ends - starts).astype(np.uint64)
        first = np.searchsorted(starts, bounds)
        last = len(hashes) - SHINGLE + 1
        grams = rk._mixed(sum(hashes[k : last + k] * _PLACE[k] for k in range(SHINGLE))) if last > 0 else hashes[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(rk._mixed(np.array([sum(int(h) * int(c) for h, c in zip(hashes[a:b], _PLACE, strict=False)) + int(b - a) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(hashes[:0])
    return out


def _runs(texts: list[bytes]):
    run, size = [], 0
    for t in texts:
        if run and size + len(t) + 1 > rk.SLICE // 2:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def _long_hashes(data, starts, ends):
    """Hashes of the words of a text that is longer than a slice, slice by slice."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + rk.SLICE, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        if hi - lo <= rk.SLICE:
            out[at:stop] = rk.Prefixes(data[lo:hi]).spans(starts[at:stop] - lo, ends[at:stop] - lo)
        else:  # one word that is longer than a slice
            import xxhash

            out[at] = xxhash.xxh64_intdigest(data[lo:hi].tobytes())
        at = stop
    return out


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """The minhash tokens of sets that are not empty: one row each."""
    flat, cuts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), TOKENS), np.int32)
    for k in range(TOKENS):
        h = (flat * _ODD[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, cuts).astype(np.uint32).view(np.int32)
    return out


def _embedded(batches):
    for b in batches:
        ids, texts = b.column("id").to_pylist(), b.column("data").to_pylist()
        for at in range(0, len(ids), 200):
            part, sets = ids[at : at + 200], shingles(texts[at : at + 200])
            some = [k for k, s in enumerate(sets) if len(s)]
            tokens: list = [None] * len(sets)
            if some:
                for k, row in zip(some, embed([sets[k] for k in some]).tolist(), strict=True):
                    tokens[k] = row
            digest = []
            for doc, s in zip(part, sets, strict=True):
                if len(s):
                    m = rk._mixed(s * _ODD[0])
                    digest.append(int(s.sum(dtype=np.uint64)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(m)).to_bytes(8, "little") + len(s).to_bytes(4, "little"))
                else:
                    digest.append(b"none" + doc.to_bytes(8, "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["id", "digest", "n", "tokens"])


def embedded(docs: DataFrame) -> DataFrame:
    """id, digest of the set, its size n, tokens."""
    d = common.with_id(docs.select("doc_id", "text")).select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return d.mapInArrow(_embedded, "id long, digest binary, n long, tokens array<int>")


def _forest(close: np.ndarray, ids: np.ndarray):
    """(members, least id of their connected part) of those that have a link; close: symmetric."""
    label = np.arange(len(ids))
    while True:
        least = np.where(close, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(close.any(axis=1))
    return ids[linked], ids[label[linked]]


def _compare(batches):
    """Links within blocks of a bucket, from rows (path, u, v, block, id, tokens)."""
    a, b = [], []
    for _, u, v, block, ids, tokens in common.sorted_groups(batches, 3):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        ids, block, t = np.array(ids, np.int64)[order], np.array(block)[order], np.array(tokens, np.int32)[order]
        close = np.empty((len(ids), len(ids)), bool)
        for k in range(len(ids)):
            close[k] = np.count_nonzero(t == t[k], axis=1) >= CLOSE * TOKENS
        if u[0] != v[0]:
            close &= block[:, None] != block[None, :]
        np.fill_diagonal(close, False)
        x, y = _forest(close, ids)
        keep = x != y
        a.append(x[keep])
        b.append(y[keep])
        if sum(map(len, a)) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _units(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows once for each pair (u, v) of blocks of their group that includes their own block."""
    d = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select(key, F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", *[c for c in rows.columns if c != key])


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect all classes that may be similar; classes: a table (id, tokens)."""
    rng = np.random.default_rng(4242)
    starts = [rng.choice(TOKENS, ROOT, replace=False).tolist() for _ in range(runs_needed())]
    paths = F.array(*[F.xxhash64(F.lit(r), *[F.get("tokens", F.lit(k)) for k in at]) for r, at in enumerate(starts)])
    same = F.aggregate(F.zip_with("tokens", "theirs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)

    def child(c):  # two different tokens, the same for all that share the path
        i = F.pmod(F.xxhash64("path", c, F.lit("i")), F.lit(TOKENS)).cast("int")
        j = F.pmod(i + 1 + F.pmod(F.xxhash64("path", c, F.lit("j")), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
        return F.xxhash64("path", c, F.get("tokens", i), F.get("tokens", j))

    children = F.explode(F.transform(F.sequence(F.lit(1), F.lit(CHILDREN) * F.col("times")), child))
    tasks = common.task_count(classes, 16 << 20)
    rows, links = classes.select("id", F.explode(paths).alias("path")), None
    for level in range(DEPTH + 1):
        rows = common.stash(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("size > 1")
        sizes = common.stash(sizes.groupBy("size", "pivot", "x", "y").agg(F.min("path").alias("path"), F.count(F.lit(1)).cast("int").alias("times")).drop("x", "y"), "buckets")
        last = level == DEPTH
        if not last:  # the tokens of the pivots, of which there are LIMIT times fewer than rows, come along with the sizes
            theirs = classes.select(F.col("id").alias("pivot"), F.col("tokens").alias("theirs"))
            split = sizes.filter(F.col("size") > LIMIT).join(theirs.hint("merge"), "pivot")
            sizes = sizes.filter(F.col("size") <= LIMIT).withColumn("theirs", F.lit(None).cast("array<int>")).unionByName(split)
        met = rows.join(sizes.hint("merge"), "path")
        if level == 0:  # from here on the rows that are left carry their tokens
            met = met.join(classes.select("id", "tokens").hint("merge"), "id")
        met = common.stash(met.select("path", "size", "times", "pivot", "id", "tokens", (F.lit(None).cast("int") if last else same).alias("same")), "met")
        leaves = met if last else met.filter(F.col("size") <= LIMIT)
        units = _units(leaves.select("path", "size", "id", "tokens"), "path", F.ceil(F.col("size") / LIMIT)).select("path", "u", "v", "block", "id", "tokens")
        found = units.repartition(tasks, "path", "u", "v").sortWithinPartitions("path", "u", "v").mapInArrow(_compare, "a long, b long")
        found = common.stash(found, "candidates")
        links = found if links is None else links.unionByName(found)
        large = met.filter(F.col("size") > LIMIT)
        if last or large.isEmpty():
            return links
        near = large.filter("id <> pivot")
        links = links.unionByName(near.filter(F.col("same") >= NEAR * TOKENS).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        rows = near.filter(F.col("same") < DONE * TOKENS).select("id", children.alias("path"), "tokens")
    raise AssertionError("unreachable")


def _exact(batches):
    """Exact links within a unit, from rows (root, u, v, side, id, copies, z): all pairs where all have side 0,
    those of different sides else.  (id, links, to): links counts copies; to is the least id of the part it is connected with."""
    unzip = zstandard.ZstdDecompressor()
    for _, _, _, side, ids, copies, z in common.sorted_groups(batches, 3):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        ids, side, copies = (np.array(x, np.int64)[order] for x in (ids, side, copies))
        sets = shingles([unzip.decompress(z[k]) for k in order])
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n > 1
        column = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), sizes)[shared[inv]]
        col = column[inv][shared[inv]]
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
        both, width = np.zeros((len(ids), len(ids)), np.float32), 4096
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, [at, at + width])
            x = np.zeros((len(ids), width), np.float32)
            x[row[lo:hi], col[lo:hi] - at] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        close = (10 * both >= TENTHS * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
        if side.any():
            close &= side[:, None] != side[None, :]
        close &= ids[:, None] != ids[None, :]
        linked, to = _forest(close, ids)
        links = close.astype(np.int64) @ copies
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(links[np.flatnonzero(close.any(axis=1))]), pa.array(to)], ["id", "links", "to"])


def _exact_links(rows: DataFrame, tasks: int) -> DataFrame:
    """(id, links, to) from rows (root, u, v, side, id, copies, z)."""
    units = rows.select("root", "u", "v", "side", "id", "copies", "z").repartition(tasks, "root", "u", "v").sortWithinPartitions("root", "u", "v")
    return common.stash(units.mapInArrow(_exact, "id long, links long, to long"), "exact-links")


def _all_links(texts: DataFrame, tasks: int) -> DataFrame:
    """All links in each group of rows (root, blocks_, id, copies, z)."""
    units = _units(texts, "root", F.col("blocks_"))
    return _exact_links(units.withColumn("side", F.when(F.col("u") == F.col("v"), 0).when(F.col("block") == F.col("u"), 1).otherwise(2)), tasks)


def _connecting_links(texts: DataFrame, tasks: int) -> DataFrame:
    """Links that connect what all links in each group connect.

    Each block meets the group's least member, whose text is dealt to all blocks; members
    that are connected with it are connected with each other, so only the others meet all blocks."""
    texts = common.stash(texts.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks_")).cast("int")), "texts")
    every = F.sequence(F.lit(0), (F.col("blocks_") - 1).cast("int"))
    own = texts.withColumn("u", F.explode(F.when(F.col("id") == F.col("root"), every).otherwise(F.array("block"))))
    links = _exact_links(own.withColumns({"v": F.col("u"), "side": F.lit(0)}), tasks)
    settled = links.filter("id <> to").select("id", F.col("to").alias("root")).distinct()
    left = texts.filter("blocks_ > 1 and id <> root").join(settled.hint("merge"), ["id", "root"], "left_anti").select("root", "blocks_", "id", "copies", "z")
    left = common.stash(left, "unsettled")
    if left.isEmpty():
        return links
    rest = common.stash(left.groupBy("root").agg(F.count(F.lit(1)).alias("rest")).withColumn("parts", F.ceil(F.col("rest") / LIMIT).cast("int")), "unsettled-sizes")
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    one = common.attach(left, rest, "root", "rest").withColumns({"u": F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"), "v": F.explode(every), "side": F.lit(1)})
    two = common.attach(texts, rest, "root", "rest").withColumns({"u": F.explode(parts), "v": F.col("block"), "side": F.lit(2)})
    return links.unionByName(_exact_links(one.unionByName(two, allowMissingColumns=True), tasks))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """id, class_id, n_links of each row of docs."""
    return common.by_rows(docs.select("doc_id", "text"), _classes, "id", "class_id")


def _classes(docs: DataFrame, counted: bool = True) -> DataFrame:
    """id, class_id and, if counted, n_links."""
    rows = common.stash(embedded(docs), "embedded")
    classes = common.stash(rows.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    marked = rows.filter("n > 0").join(classes.select("digest", "id").hint("merge"), ["digest", "id"])
    marked = common.stash(marked.select("id", "n", "tokens"), "tokens")
    groups = common.linked_groups(candidate_links(marked))
    met = groups.select(F.col("node").alias("id"), "root").join(marked.select("id", "n").hint("merge"), "id").join(classes.select("id", "copies").hint("merge"), "id")
    met = common.stash(met, "members")
    total = met.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    met = common.attach(met, common.stash(total, "sizes"), "root", "members")
    blocks = F.greatest(F.ceil(F.col("members") / LIMIT), F.ceil(F.col("total") / BLOCK_SHINGLES))
    texts = common.text_rows(docs.select("doc_id", "text")).select("id", "z").join(met.select("id", "root", "copies", blocks.alias("blocks_")).hint("merge"), "id")
    exact = (_all_links if counted else _connecting_links)(texts, common.task_count(docs, 24 << 20))
    ends = common.linked_groups(exact.select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = classes.join(ends.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").withColumn("class_id", F.coalesce("root", "id"))
    columns = ["class_id"]
    if counted:
        known = known.join(exact.groupBy("id").agg(F.sum("links").alias("links")).hint("merge"), "id", "left")
        known = known.withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        columns.append("n_links")
    known = common.stash(known.select("digest", "copies", *columns), "known")
    return common.attach(rows.select("id", "digest"), known, "digest", "copies").select("id", *columns)


def _shown(c: str):
    return F.when(F.col(c) != common.NULL_ID, F.col(c))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that are similar, through any chain, to one of smaller doc_id; the columns stay as they are.

    Of similar rows that repeat the doc_id that stays, one stays; others of that doc_id stay by their own texts."""
    return common.by_rows(docs, _one, "doc_id")


def _one(docs: DataFrame) -> DataFrame:
    kept = _classes(docs, counted=False).filter("id = class_id").select(F.col("id").alias("_1"))
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("_1"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_2"))
    return marked.join(kept.hint("merge"), "_1", "left_semi").select("_2.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = similarity_classes(common.table(spark, sf_dir, "documents"))
    return got.select(_shown("id").alias("doc_id"), _shown("class_id").alias("class_id"), "n_links")


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce(m.b, d.doc_id)) AS class_id, coalesce(c.n, 0) AS n_links
FROM documents d
LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = d.doc_id
"""
