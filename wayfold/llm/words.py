"""Tokenizing whole texts through their distinct words.

Both byte-pair vocabularies in use split a text, before any merge, at every single
space between two non-space characters: the space opens the next part.  So a text can
be cut there and each part encoded alone, and equal parts need encoding once.  Added
tokens hold no space, so they stay whole inside a part.

A run of some megabytes of text is cut and its parts are numbered in Arrow; most parts are
*plain*, a stem of Latin letters and a tail of ASCII marks, which the vocabularies split
there, so stems and tails are numbered once more.  What is encoded is the distinct stems,
tails and other parts; texts are put together again by gathers in numpy.  Nothing is kept
from one run to the next, so memory is bounded by the run.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space to anyone: where a space stands next to it, a text is not cut.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_SPACE = f"^ | $| [{_SPACE}]|[{_SPACE}] "
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of a run of texts.
RUN = 6_000_000
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False  # the signs among the Latin letters


def _places(begin: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for each row i of the sizes in offsets; in 32 bits where `most`, the largest place, allows."""
    kind = np.int32 if max(most, int(offsets[-1])) < 1 << 31 else np.int64
    at = np.repeat((begin - offsets[:-1]).astype(kind), np.diff(offsets))
    at += np.arange(len(at), dtype=kind)
    return at


class Ragged:
    """Rows of different lengths: flat[offsets[i]:offsets[i + 1]]."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets

    @classmethod
    def of(cls, rows: list, dtype) -> Ragged:
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        if dtype == np.uint8:
            return cls(np.frombuffer(b"".join(rows), np.uint8), offsets)
        return cls(np.fromiter((x for r in rows for x in r), dtype, int(offsets[-1])), offsets)

    def sums(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.flat)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def take(self, index: np.ndarray) -> Ragged:
        begin = self.offsets[index]
        offsets = np.concatenate([[0], np.cumsum(self.offsets[index + 1] - begin)])
        return Ragged(self.flat[_places(begin, offsets, len(self.flat))], offsets)


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _numbered(r: Ragged) -> tuple[np.ndarray, list[bytes]]:
    """(number of each row's bytes, the distinct rows)."""
    a = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r.offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(r.offsets)), pa.py_buffer(np.ascontiguousarray(r.flat))])
    d = a.dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts (null as empty) in runs of about RUN bytes, one text at least."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + RUN, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


class Parts:
    """The parts of a run of texts.

    `index` numbers the part at each place, texts begin at `bounds`.  Part k is the stem
    `stem[k]` and the tail `tail[k]`, or, where stem[k] < 0, others[tail[k]] as a whole."""

    def __init__(self, texts: pa.Array, lower: bool):
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        if len(odd):
            cut = pa.array([_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
            where = np.arange(len(texts))
            where[odd] = len(texts) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, cut]).take(pa.array(where))
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.flatten().cast(pa.large_string()).dictionary_encode()
        self.bounds -= self.bounds[0]
        self.index = numbered.indices.to_numpy().astype(np.int64)
        heads, at = np.unique(self.index[self.bounds[:-1]], return_inverse=True)
        self.index[self.bounds[:-1]] = len(numbered.dictionary) + at
        inner = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), numbered.dictionary, pa.scalar(" ", pa.large_string()))
        every = pa.concat_arrays([inner, numbered.dictionary.take(pa.array(heads))])
        data, offsets = _strings(every)
        kind = _KIND[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & _SECOND[data[1:]])
        kind[pair] = kind[pair + 1] = 0
        begin, end = offsets[:-1], offsets[1:]
        some = np.flatnonzero(end > begin)
        opened = np.zeros(len(begin), np.int64)
        opened[some] = data[begin[some]] == 32
        kind[begin[some][opened[some] == 1]] = 0
        first = begin + opened
        plain = np.zeros(len(begin), bool)
        has = first < end
        plain[has] = kind[first[has]] == 0
        back = np.zeros(len(kind), np.int8)
        back[1:] = (kind[1:] == 0) & (kind[:-1] == 1)
        inside = begin[some]
        back[inside] = 0
        wrong = np.concatenate([[0], np.cumsum(back + (kind == 2), dtype=np.int32)])
        letters = np.concatenate([[0], np.cumsum(kind == 0, dtype=np.int32)])
        plain &= wrong[end] == wrong[begin]
        size = letters[end] - letters[begin]
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            data[pair[data[pair + 1] < 0x9F] + 1] += 32
        k = np.flatnonzero(plain)
        cuts = np.stack([begin[k], begin[k] + size[k], end[k]], axis=1)
        stems = _between(data, cuts[:, 0], cuts[:, 1])
        tails = _between(data, cuts[:, 1], cuts[:, 2])
        self.stem, self.tail = np.full(len(begin), -1, np.int64), np.zeros(len(begin), np.int64)
        self.stem[k], self.stems = _numbered(stems)
        self.tail[k], self.tails = _numbered(tails)
        rest = np.flatnonzero(~plain)
        self.tail[rest] = np.arange(len(rest))
        self.others = every.take(pa.array(rest)).to_pylist()

    def spell(self, stems: Ragged, tails: Ragged, others: Ragged) -> Ragged:
        """The row of each distinct part, from the rows of what was to be encoded."""
        n, m = len(stems.offsets) - 1, len(tails.offsets) - 1
        size = np.concatenate([np.diff(x.offsets) for x in (stems, tails, others)] + [[0]])
        table = Ragged(np.concatenate([x.flat for x in (stems, tails, others)]), np.concatenate([[0], np.cumsum(size)]))
        plain = self.stem >= 0
        pairs = np.stack([np.where(plain, self.stem, n + m + self.tail), np.where(plain, n + self.tail, len(size) - 1)], axis=1).ravel()
        got = table.take(pairs)
        return Ragged(got.flat, got.offsets[::2])

    def texts(self, parts: Ragged) -> Ragged:
        """The row of each text, from those of the parts."""
        got = parts.take(self.index)
        return Ragged(got.flat, got.offsets[self.bounds])

    def sums(self, parts: np.ndarray) -> np.ndarray:
        """For each text the sum over its parts."""
        total = np.concatenate([[0], np.cumsum(parts[self.index])])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def _between(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Ragged:
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    return Ragged(data[_places(begin, offsets, len(data))], offsets)


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, once in each worker; neither truncation nor padding."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def library_ids(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids by the library, a few thousand texts at a time (its results are large objects)."""
    t = tokenizer(path)

    def ids(parts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(parts), 4000) for e in t.encode_batch_fast(parts[at : at + 4000], add_special_tokens=False)]

    return ids


def public_path(name: str) -> str:
    """Where this machine keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
