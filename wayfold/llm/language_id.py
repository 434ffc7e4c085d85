"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; the n-grams of n = 1, 2 and 3 are hashed into BUCKETS counts
for each n, in numpy over a run of texts at once.  Counts come from every document of the
training folds, whole texts, summed before the shuffle; the driver gets languages x
buckets numbers at most, whatever the data, and the log-probability matrix goes with the
tasks.  A batch is scored as a sparse product: a text's n-grams are its row's entries,
gathered from the matrix and added up between row bounds.

Null texts and texts without a letter (Unicode's categories L*) are `und` with score 0.  The score is the
posterior probability under priors from the training documents.  Null languages teach nothing; without any learned
language all rows are `und`; more than LANGUAGES of them are an error, since the matrix has a row for each.
Each row gets its row, repeated rows too; extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
SMOOTHING = 0.5
#: Bound of the matrix on the driver and in each task: 200 MB.
LANGUAGES = 500
_LETTER = regex.compile(r"\p{L}")
#: Stands for a document in place of a bucket.
_DOCUMENT = -1
_FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_SHIFT = np.uint32(17)  # 32 bits less those of BUCKETS


def _slices(texts: list[str | None], most: int):
    """Runs of texts (null as empty) of about `most` characters, at least one text each."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts with a 0 after each, bounds of the texts)."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])


def _hashes(flat: np.ndarray):
    """For each n the bucket of the n-gram that begins at each place, counted on from the last n."""
    h = np.zeros(len(flat), np.uint32)
    for k, n in enumerate(ORDERS):
        h = h[: len(flat) - n + 1] + flat[n - 1 :]
        h = h * _FACTORS[k]
        h ^= h >> np.uint32(15)
        yield n, ((h * _FACTORS[0]) >> _SHIFT).astype(np.int32) + k * BUCKETS


def _counts(batches):
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total = np.zeros(BUCKETS * len(ORDERS), np.int64)
            for run in _slices(texts, 500_000):
                flat, bounds = _points(run)
                ends = np.zeros(len(flat), bool)
                ends[bounds[1:] - 1] = True
                for n, h in _hashes(flat):
                    inside = ~ends[n - 1 :]  # an n-gram that reaches a text's end mark is none
                    for j in range(n - 1):
                        inside &= ~ends[j : len(flat) - n + 1 + j]
                    total += np.bincount(h[inside], minlength=len(total))
            at = np.flatnonzero(total)
            bucket, n = np.append(at, _DOCUMENT), np.append(total[at], len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["lang", "h", "n"])


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, priors: np.ndarray):
        self.langs, self.logs, self.priors = langs, logs, priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for run in _slices(texts, 500_000):
            flat, bounds = _points(run)
            logs = np.zeros((len(self.langs), len(run)))
            for n, h in _hashes(flat):
                starts, stops = bounds[:-1], bounds[1:] - n
                own = np.flatnonzero(stops > starts)
                if not len(own):
                    continue
                cuts = np.stack([starts[own], np.minimum(stops[own], len(h) - 1)], axis=1).ravel()
                tail = stops[own][-1] >= len(h)
                for k in range(len(self.langs)):
                    terms = self.logs[k][h]
                    sums = np.add.reduceat(terms, cuts, dtype=np.float64)[::2]
                    if tail:
                        sums[-1] = terms[starts[own][-1] :].sum(dtype=np.float64)
                    logs[k, own] += sums
            logs += self.priors[:, None]
            best = logs.argmax(axis=0)
            p = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
            for t, b, s in zip(run, best, p, strict=True):
                known = _LETTER.search(t) is not None
                names.append(self.langs[b] if known else "und")
                scores.append(float(s) if known else 0.0)
        return names, scores


def fit(docs: DataFrame) -> Model | None:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out()).select("lang", "text")
    found = common.stash(rows.mapInArrow(_counts, "lang string, h int, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "grams")
    known = found.filter(F.col("h") == _DOCUMENT).select("lang", "n").orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not known:
        return None
    langs, docs_of = [r.lang for r in known], np.array([r.n for r in known], np.float64)
    t = found.filter(F.col("h") != _DOCUMENT).toArrow()
    place = {x: k for k, x in enumerate(langs)}
    counts = np.full((len(langs), BUCKETS * len(ORDERS)), SMOOTHING)
    counts[[place[x] for x in t.column("lang").to_pylist()], t.column("h").to_numpy()] += t.column("n").to_numpy()
    for k in range(len(ORDERS)):
        part = counts[:, k * BUCKETS : (k + 1) * BUCKETS]
        part /= part.sum(axis=1, keepdims=True)
    return Model(langs, np.log(counts).astype(np.float32), np.log(docs_of / docs_of.sum()))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 98,304 floats

    def run(batches):
        m = shared.value
        for b in batches:
            names, scores = m.predict(b.column("text").to_pylist()) if m else (["und"] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
