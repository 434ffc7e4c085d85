"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a short vector of transformed statistics (shares of capitals, symbols,
repeats ...; shares go through a log-odds map, the length of words through a logarithm); a text's length is none of them.  Each class
has a mean and a covariance that is shrunk towards the diagonal of the pooled one; the
Cholesky factor of each is computed once, on the driver, and its inverse goes with the
task.  A score is the logistic of the difference of the two log densities, plus priors.

Fitting reads at most SAMPLE labelled documents of the training folds, chosen by a hash
of their id; statistics and scores read whole texts.  Null counts as empty, and empty
texts get the score of their statistics like any other.  If a class has no example the
score is the share of label 1 (one half without any).  Each row gets its row; extra
columns are kept by `scored`, and no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample, in rows (doc_id, label); it is broadcast.
SAMPLE = 40_000
CUTOFF = 0.7
#: Weight of the pooled diagonal in each class's covariance, and the least variance.
SHRINKAGE, LEAST_VARIANCE = 0.1, 1e-3
LEAST_SHARE = 1e-3
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>!@^~=+_\\{}[]"
NAMES = ["capital_pairs", "symbols", "digits", "other_ascii", "repeated_words", "repeated_pairs", "distinct_words", "word_length"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in SYMBOLS]] = 4
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 5
_CLASS[128:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def _odds(share: float) -> float:
    """Log-odds of a share, held off the ends by LEAST_SHARE, whatever the length of the text."""
    return math.log((share + LEAST_SHARE) / (1 - share + LEAST_SHARE))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    classes = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    kinds = np.bincount(classes, minlength=7)
    shouts = np.count_nonzero((classes[1:] == 2) & (classes[:-1] == 2))
    chars = max(1, int(kinds.sum() - kinds[6]))
    ws = text.split()
    n = max(1, len(ws))
    same = sum(map(str.__eq__, ws, ws[1:]))
    pairs = len(set(zip(ws, ws[1:], strict=False)))
    return [
        _odds(shouts / max(1, kinds[1] + kinds[2])),
        _odds(kinds[4] / chars),
        _odds(kinds[3] / chars),
        _odds(kinds[5] / chars),
        _odds(same / n),
        _odds(max(0.0, 1 - pairs / max(1, len(ws) - 1)) if len(ws) > 1 else 0.0),
        _odds(len(set(ws)) / n),
        math.log(chars / n + 1),
    ]


class Discriminant:
    """Two Gaussians; `factors` are the inverses of the Cholesky factors of their covariances."""

    def __init__(self, means, factors, constants, prior: float | None):
        self.means, self.factors, self.constants, self.prior = means, factors, constants, prior

    @classmethod
    def fit(cls, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
        """moments of labels 0 and 1: count, sum, sum of outer products."""
        counts = [moments[k][0] if k in moments else 0 for k in (0, 1)]
        if not min(counts):
            return cls(None, None, None, counts[1] / sum(counts) if sum(counts) else 0.5)
        means, covs = [], []
        for k in (0, 1):
            n, s, o = moments[k]
            means.append(s / n)
            covs.append(o / n - np.outer(s / n, s / n))
        pooled = np.diag(np.diag((counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)))
        factors, constants = [], []
        for k in (0, 1):
            cov = (1 - SHRINKAGE) * covs[k] + SHRINKAGE * pooled + LEAST_VARIANCE * np.eye(len(pooled))
            chol = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(chol))
            constants.append(math.log(counts[k] / sum(counts)) - np.log(np.diag(chol)).sum())
        return cls(means, factors, constants, None)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    d = len(NAMES)
    sample = common.sampled_labels(labels, "quality", SAMPLE)

    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            y = b.column("label").to_numpy()
            x = _matrix(b.column("text").to_pylist())
            for k in (0, 1):
                part = x[y == k]
                old = sums.get(k, [0, np.zeros(d), np.zeros((d, d))])
                sums[k] = [old[0] + len(part), old[1] + part.sum(axis=0), old[2] + part.T @ part]
        for k, (n, s, o) in sums.items():
            yield pa.RecordBatch.from_pydict({"label": [k], "n": [n], "s": [s.tolist()], "o": [o.ravel().tolist()]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    moments: dict[int, tuple] = {}
    for r in rows.mapInArrow(run, "label long, n long, s array<double>, o array<double>").collect():  # two rows from each task
        old = moments.get(r.label, (0, np.zeros(d), np.zeros((d, d))))
        moments[r.label] = (old[0] + r.n, old[1] + np.array(r.s), old[2] + np.array(r.o).reshape(d, d))
    return Discriminant.fit({k: v for k, v in moments.items() if v[0]})


def scored(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """docs with the score in one more column."""
    place = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches):
        for b in batches:
            score = model.scores(_matrix(b.column(place).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; the columns stay as they are."""
    rows = docs.select("text", common.whole([c for c in docs.columns if c != "text"]).alias("_2"))
    got = scored(rows, fit(docs, labels)).filter(F.col("score") >= CUTOFF)
    return got.select(*[(F.col("text") if c == "text" else F.col("_2")[c]).alias(c) for c in docs.columns])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return got.select("doc_id", common.held_out().alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))
