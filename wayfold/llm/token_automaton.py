"""Byte-pair tokenization compiled to a deterministic automaton over tokens.

Construction.  Start from one state whose arcs are the base bytes, all looping.
Take the merges in rank order; for a merge ``u v`` every path ``p -u-> s -v-> r``
becomes ``p -uv-> r`` and the path through ``v`` is taken away, which needs a copy
of ``s`` that only ``u`` enters (the *merge gadget*).  All arcs with one label
enter one state, so the automaton is two tables:

* ``target[label]`` - the state that the label's arcs enter;
* ``arcs[label, state]`` - one bit: may the label leave that state.

When all merges are in, a byte string has exactly one accepted segmentation and it
is the one byte-pair encoding makes, so encoding needs no merge ranks any more: it
walks positions from left to right and follows the arcs that spell the bytes.
Decoding emits the labels of the arcs.

Columns of equal bits are stored once, so the table is a few MB to tens of MB; its
size depends on the vocabulary alone, never on the data.
"""

from __future__ import annotations

import array
import json

import numpy as np

#: Words of like length under which each walks alone.
FEW = 150
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, mapped to their bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_byte_bpe(path: str) -> tuple[list[bytes | None], list[tuple[int, int, int]], dict[str, int]]:
    """(bytes of each id, merges as (left, right, joined) ids, added strings) of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels: list[bytes | None] = [None] * (max([*vocab.values(), *added.values()]) + 1)
    for token, k in vocab.items():
        if token not in added:
            labels[k] = bytes(alphabet[c] for c in token)
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return labels, merges, added


#: Closes a word where the vocabulary marks the ends of words; no UTF-8 text holds this byte.
END = b"\xff"


def read_word_bpe(path: str) -> tuple[list[bytes | None], list[tuple[int, int, int]]]:
    """(bytes of each id, merges) of a vocabulary that marks a word's last symbol, the mark as END.

    Tokens of bytes that no UTF-8 text holds are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    vocab, mark = model["vocab"], model["end_of_word_suffix"]
    labels: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        stem = token.removesuffix(mark)
        data = bytes(alphabet[c] for c in stem) if all(c in alphabet for c in stem) else END
        if END not in data:
            labels[k] = data + (END if stem != token else b"")
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return labels, [m for m in merges if all(labels[k] is not None for k in m)]


class TokenAutomaton:
    """Encoder and decoder for byte strings that were split beforehand (*words*)."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]]):
        self.labels, self._tables = labels, None
        made = {m[2] for m in merges}
        base = [k for k, b in enumerate(labels) if b is not None and len(b.removesuffix(END)) == 1 and k not in made]
        self._sizes = np.array([len(b) if b else 0 for b in labels], np.int64)
        self._build(base, merges)
        self._compile_trie()

    @classmethod
    def load(cls, path: str) -> TokenAutomaton:
        labels, merges, added = read_byte_bpe(path)
        out = cls(labels, merges)
        for text, k in added.items():
            out.labels[k] = text.encode()
        return out

    @classmethod
    def load_words(cls, path: str) -> TokenAutomaton:
        return cls(*read_word_bpe(path))

    def _build(self, base: list[int], merges: list[tuple[int, int, int]]) -> None:
        n, width = len(self.labels), 64
        bits = np.zeros((n, width), np.uint8)  # state bits of each label
        target, entering = np.zeros(n, np.int64), [len(base)]  # labels that enter each state
        bits[base, 0] = 1
        for u, v, uv in merges:
            s, r = int(target[u]), int(target[v])
            if not bits[v, s >> 3] >> (s & 7) & 1:
                continue  # no such path: the merge can never apply
            if entering[s] > 1 or r == s:  # of a doubled label the joined one still enters the old state
                new = len(entering)
                if new >= 8 * width:
                    bits, width = np.concatenate([bits, np.zeros_like(bits)], axis=1), 2 * width
                bits[:, new >> 3] |= (bits[:, s >> 3] >> np.uint8(s & 7) & np.uint8(1)) << np.uint8(new & 7)
                entering[s] -= 1
                entering.append(1)
                target[u], s = new, new
            bits[v, s >> 3] &= 255 ^ (1 << (s & 7))
            bits[uv] = bits[u]
            target[uv] = r
            entering[r] += 1
        self.n_states, self.target = len(entering), target.astype(np.int32)
        bits = np.ascontiguousarray(bits[:, : (self.n_states + 7) // 8])
        # equal rows (labels) are kept once
        kept: dict[bytes, int] = {}
        self.row = np.array([kept.setdefault(x.tobytes(), len(kept)) for x in bits], np.int32)
        first = np.zeros(len(kept), np.int64)
        first[self.row[::-1]] = np.arange(n)[::-1]
        self.bits = bits[first]

    def _compile_trie(self) -> None:
        """Transitions (node, byte) -> node of the labels' trie, in one open-addressed table."""
        nodes: dict[int, int] = {}
        ends, count = {}, 1
        for k, b in enumerate(self.labels):
            if b is None:
                continue
            at = 0
            for x in b:
                key = at << 8 | x
                if (to := nodes.get(key)) is None:
                    to = nodes[key] = count
                    count += 1
                at = to
            ends[at] = k
        self.ends = np.full(count, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.shift = np.uint64(64 - max(4, (8 * len(nodes)).bit_length()))
        self.keys, self.vals = np.full(1 << (64 - int(self.shift)), -1, np.int32), np.zeros(1 << (64 - int(self.shift)), np.int32)
        todo, vals = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        at, self.probes = self._slot(todo), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(todo), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.vals[at[put]] = todo[put], vals[put]
            todo, vals, at = todo[~put], vals[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after a byte, -1 where the trie has none."""
        key = node << 8 | byte
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.vals[at], -1)
        more = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            got = self.keys[at[more]]
            hit = got == key[more]
            out[more[hit]] = self.vals[at[more[hit]]]
            more = more[~hit & (got != -1)]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  Words of like length advance together, position by position; where
        there are few of a length, each walks alone."""
        out: list = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        lo = 0
        while lo < len(order):  # words of like length share a table of bounded size
            hi = int(np.searchsorted(sizes, 2 * max(1, sizes[lo]) + 8, side="right"))
            hi = max(lo + 1, min(hi, lo + 4_000_000 // int(sizes[hi - 1] + 1)))
            part = order[lo:hi].tolist()
            if len(part) < FEW:
                for i in part:
                    out[i] = self.walk(words[i])
            else:
                flat, counts = self._encode([words[i] for i in part], sizes[lo:hi])
                values, at = flat.tolist(), 0
                for i, n in zip(part, counts.tolist(), strict=True):
                    out[i] = values[at : at + n]
                    at += n
            lo = hi
        return out

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _plain(self):
        """The tables in forms for single look-ups; made once in each worker."""
        if self._tables is None:
            used = np.flatnonzero(self.keys != -1)
            steps = dict(zip(self.keys[used].tolist(), self.vals[used].tolist(), strict=True))
            arcs = memoryview(np.ascontiguousarray(self.bits)).cast("B")
            self._tables = steps, memoryview(self.ends), memoryview(self.row.astype(np.int64) * self.bits.shape[1]), memoryview(self.target), arcs
        return self._tables

    def walk(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by some microseconds a byte."""
        steps, ends, rows, target, arcs = self._plain()
        n = len(word)
        last = array.array("i", [-1]) * (n + 1)  # last label of the only accepted path to each position
        find = steps.get
        for j in range(n):
            if j and last[j] < 0:
                continue
            state = target[last[j]] if j else 0
            byte, bit = state >> 3, state & 7
            node, i = find(word[j]), j + 1
            while node is not None:
                k = ends[node]
                if k >= 0 and arcs[rows[k] + byte] >> bit & 1:
                    last[i] = k
                if i == n:
                    break
                node = find(node << 8 | word[i])
                i += 1
        out, at, labels = [], n, self.labels
        while at > 0:
            out.append(last[at])
            at -= len(labels[last[at]])
        out.reverse()
        return out

    def _encode(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's)."""
        n, most = len(words), int(sizes.max(initial=0))
        text = np.zeros((most, n), np.uint8)  # position-major: one step reads one row
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text[np.arange(len(flat)) - np.repeat(starts, sizes), np.repeat(np.arange(n), sizes)] = flat
        last = np.full((most + 1, n), -1, np.int32)  # last label of the only accepted path to each position
        for j in range(most):
            who = np.flatnonzero(sizes > j) if j == 0 else np.flatnonzero((sizes > j) & (last[j] >= 0))
            state = np.zeros(len(who), np.int64) if j == 0 else self.target[last[j, who]]
            node = np.zeros(len(who), np.int64)
            for i in range(j, most):
                if i > j:
                    live = sizes[who] > i
                    if not live.all():
                        who, state, node = who[live], state[live], node[live]
                if not len(who):
                    break
                node = self._step(node, text[i, who].astype(np.int64))
                live = node >= 0
                if not live.all():
                    who, state, node = who[live], state[live], node[live]
                if not len(who):
                    break
                label = self.ends[node]
                end = np.flatnonzero(label >= 0)
                k, s = label[end], state[end]
                ok = self.bits[self.row[k], s >> 3] >> (s & 7).astype(np.uint8) & 1 != 0
                last[i + 1, who[end[ok]]] = k[ok]
        # back along the accepted paths, all words together
        at, who, steps = sizes.copy(), np.flatnonzero(sizes > 0), []
        counts = np.zeros(n, np.int64)
        while len(who):
            k = last[at[who], who]
            steps.append((who, k))
            counts[who] += 1
            at[who] -= self._sizes[k]
            who = who[at[who] > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), np.int32)
        for back, (who, k) in enumerate(steps, 1):
            flat[ends[who] - back] = k
        return flat, counts

    def decode(self, ids) -> bytes:
        """The labels of the arcs, one after the other."""
        labels = self.labels
        return b"".join([labels[k] for k in ids])
