"""Quality rules: counts of words, symbols and repeats, then a hashed n-gram ratio.

All of it is DataFrame operations.  The method: whole words, one (n = 1) and two
in a row (n = 2), are hashed into BUCKETS counts each; one multinomial is that of trusted
texts, one that of the whole corpus, both smoothed.  A text's score is its log-likelihood
ratio between the two, divided by its number of n-grams, and a text is kept if the score
reaches a threshold: a fixed margin under the mean score of the trusted texts, so every
document is judged alike.

Trusted texts are all those of the training folds that the labels call good, and the corpus
counts cover every document; nothing is sampled.  Null counts as empty; a text without words
fails the base rules.  Each row gets its row, repeated rows too; extra columns are not
read; no rows give no rows.  Without trusted texts all ratios are 0 and the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Trusted doc_ids up to which they are broadcast; more meet the documents by a shuffle.
TRUSTED = 500_000
#: Hash buckets for each n; the broadcast table has 2 * BUCKETS numbers.
BUCKETS = 1 << 15
#: How far below the trusted mean a score may lie, in nats for each n-gram.
MARGIN = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACE = "\\x20\\x09-\\x0D"


def words(text: Column) -> Column:
    """The runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    found = F.split(text, f"[{SPACE}]+")
    return F.filter(found, lambda w: w != "")


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the base counts, with the words `ws` of each text.

    Each step is a column of its own: what a lambda refers to is then computed once."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"ws": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    n = F.size("ws")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(WINDOW)]))
    d = d.withColumn("hs", F.when(n >= WINDOW, hashes))
    placed = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("hs")) < F.size("hs"), placed))

    def twice(p: Column, k: Column) -> Column:
        """The sorted neighbour on either side has the same hash."""
        return F.coalesce(F.get("placed", k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("placed", k + 1)["h"] == p["h"], F.lit(False))

    d = d.withColumn("at", F.sort_array(F.transform(F.filter("placed", twice), lambda p: p["i"])))
    # a window covers its words up to the next such window's start
    cover = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeats = F.when(F.col("at").isNotNull(), F.aggregate(cover, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeats.cast("long"),
        }
    ).drop("text", "lines", "hs", "placed", "at")


def with_ngrams(d: DataFrame) -> DataFrame:
    """d with `grams`: the buckets of the n-grams of its words `ws`."""
    d = d.withColumn("hashes", F.transform("ws", lambda w: F.xxhash64(w)))
    ones = F.transform("hashes", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    twos = F.zip_with(F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0))), F.slice("hashes", 2, F.size("hashes")), lambda a, b: (F.lit(BUCKETS) + F.pmod(F.xxhash64(a, b), F.lit(BUCKETS))).cast("int"))
    return d.withColumn("grams", F.when(F.size("ws") > 1, F.concat(ones, twos)).otherwise(ones)).drop("hashes", "ws")


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """The log ratio of each bucket; trusted: different doc_ids."""
    marked = docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(1).alias("t")), "doc_id", "left")
    d = marked.select("doc_id", words(F.col("text")).alias("ws"), F.coalesce("t", F.lit(0)).alias("t"))
    grams = with_ngrams(d).select("t", F.explode_outer("grams").alias("g"))  # explode() would infer a filter that computes the n-grams again
    counts = grams.groupBy("g").agg(F.sum("t").alias("target"), F.count(F.lit(1)).alias("raw")).collect()  # 2 * BUCKETS rows at most
    out = [0.0] * (2 * BUCKETS)
    for part in (range(BUCKETS), range(BUCKETS, 2 * BUCKETS)):
        own = [r for r in counts if r.g is not None and r.g in part]
        target, raw = sum(r.target for r in own), sum(r.raw for r in own)
        if target:
            for r in own:
                out[r.g] = math.log((r.target + 0.5) / (target + 0.5 * BUCKETS)) - math.log((r.raw + 0.5) / (raw + 0.5 * BUCKETS))
    return out


def with_score(d: DataFrame, weights: list[float]) -> DataFrame:
    """d, that has `ws`, with the score; the table of weights is one constant array."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(table, g))
    return with_ngrams(d).withColumn("llr", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)).drop("grams")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept of every row."""
    good = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & ~common.held_out())
    trusted = common.stash(good.select("doc_id").distinct(), "trusted")
    trusted = trusted.hint("broadcast" if trusted.count() <= TRUSTED else "merge")
    weights = ratios(docs, trusted)
    seen = docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("ws"))
    mean = with_score(seen.filter(F.size("ws") >= MIN_WORDS), weights).agg(F.avg("llr")).first()[0]
    least = round((mean or 0.0) - MARGIN, 9)
    d = with_score(with_counts(docs), weights).withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5_quality_rules alone: what SQL can check."""
    return with_counts(common.table(spark, sf_dir, "documents")).withColumn("base_failed", base_failed()).drop("ws")


BASE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, generate_series(0, {WINDOW - 1}) AS s(k) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed
FROM b
"""
