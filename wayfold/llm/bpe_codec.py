"""Encoding and decoding whole texts with the token automaton.

Texts are split as the vocabulary's pattern says, added tokens first; the automaton
encodes the distinct pieces of a batch by table look-ups (token_automaton.py) and
decodes by emitting labels.  Null counts as empty.  Bytes that are no UTF-8 cannot
arise from a text's own ids; decode() replaces them, as the library does.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, words
from .token_automaton import TokenAutomaton, read_byte_bpe

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODECS: dict[str, Codec] = {}


class Codec:
    def __init__(self, path: str, automaton: TokenAutomaton):
        self.automaton = automaton
        self.added = read_byte_bpe(path)[2]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(PATTERN).findall

    def split(self, part: str) -> list[str]:
        if any(x in part for x in self.added):
            return [p for x in self.special.split(part) if x for p in ([x] if x in self.added else self.pieces(x))]
        return self.pieces(part)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        split = [self.split(t) for t in texts]
        new = list({p for x in split for p in x})
        ids = dict(zip(new, self.automaton.encode_words([p.encode() for p in new]), strict=True))
        ids |= {p: [k] for p, k in self.added.items()}
        return [[k for p in x for k in ids[p]] for x in split]

    def decode_bytes(self, ids) -> bytes:
        return self.automaton.decode(ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """(number of ids, digest of the ids, digest of the decoded text), each of all texts."""
        out: tuple[list, list, list] = ([], [], [])
        for run in words.runs(texts):
            p = words.Parts(run, lower=False)
            groups = [self.automaton.encode_words(p.stems), self.automaton.encode_words(p.tails), self.encode_batch(p.others)]
            size = p.spell(*[words.Ragged.of([(len(x),) for x in g], np.int64) for g in groups])
            shown = p.texts(p.spell(*[words.Ragged.of([("%d," * len(x) % tuple(x)).encode() for x in g], np.uint8) for g in groups]))
            data = p.texts(p.spell(*[words.Ragged.of([self.decode_bytes(x) for x in g], np.uint8) for g in groups]))
            out[0].extend(p.texts(size).sums().tolist())
            for r, column, strip in ((shown, out[1], 1), (data, out[2], 0)):
                flat = memoryview(np.ascontiguousarray(r.flat))
                for a, b in zip(r.offsets[:-1].tolist(), r.offsets[1:].tolist(), strict=True):
                    chunk = flat[a : max(a, b - strip)]
                    if not strip:
                        chunk = bytes(chunk).decode("utf-8", "replace").encode()
                    column.append(hashlib.sha256(chunk).hexdigest())
        return out


@functools.cache
def compiled(path: str) -> TokenAutomaton:
    """Compiled once, on the driver; some 25 MB for these vocabularies, whatever the data."""
    return TokenAutomaton.load(path)


def shared_codec(spark: SparkSession, path: str):
    """A function that gives each worker its codec."""
    shared = spark.sparkContext.broadcast(compiled(path))

    def codec() -> Codec:
        if path not in _CODECS:
            _CODECS[path] = Codec(path, shared.value)
        return _CODECS[path]

    return codec


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids."""

    codec = shared_codec(docs.sparkSession, path)

    def run(batches):
        c = codec()
        for b in batches:
            ids = [c.encode_batch([t])[0] for t in pc.fill_null(b.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    codec = shared_codec(rows.sparkSession, path)

    def run(batches):
        c = codec()
        for b in batches:
            text = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode, both through the automaton."""

    codec = shared_codec(docs.sparkSession, path)

    def run(batches):
        c = codec()
        for b in batches:
            n, ids, text = c.digests(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), words.public_path(VOCABULARY))
