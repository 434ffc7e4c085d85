import hashlib
import random
import tracemalloc
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import bpe_codec, common, edit_kernels, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, words

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd():
    random.seed(3)
    parts = ["a", "the", "  ", " ", "\n", "\t", "<|endoftext|>", "'s", "é", "\x1c", "中", "12", "$", "don't", "\r\n", ".", "😀", "İ", "Σ", "ing!"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(500)] + ["", None, " ", "  ", "a ", " a"]


def frame(spark, rows):
    """Rows with an extra column that clashes with names used inside."""
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))


def test_tokens_equal_the_library(odd):
    path = words.public_path("byte_bpe_50k.json")
    t = words.tokenizer(path)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in odd]
    assert token_counts.counts_of(pa.array(odd, pa.string()), path).tolist() == [len(x) for x in ids]
    codec = bpe_codec.Codec(path, bpe_codec.compiled(path))
    n, shown, text = codec.digests(pa.array(odd, pa.string()))
    assert n == [len(x) for x in ids]
    assert shown == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert text == [hashlib.sha256((x or "").encode()).hexdigest() for x in odd]


def test_packing(spark, odd):
    path = words.public_path("word_bpe_49k.json")
    t = words.tokenizer(path)
    docs = frame(spark, [*enumerate(odd), (600, "word " * 5000), (None, "x")])
    rows = packing.pack_documents(docs, path).collect()
    size = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size[600] == 5001 and all(size[i] == len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(odd))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_pieces_are_those_of_the_library(spark):
    path = words.public_path("word_bpe_49k.json")
    t = words.tokenizer(path)
    random.seed(4)
    texts = ["word " * 3000, "many other words, and 12 signs! " * 900, "x" * 50_000, "the cat " * 511 + "sat", "", None, "".join(random.choice("abcdefg") for _ in range(30_000))]
    rows = packing.pack_documents(frame(spark, list(enumerate(texts))), path).collect()
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k): (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("least", [1, 90])
def test_exchange_comes_near_the_optimum(spark, monkeypatch, least):
    """Sizes that fill sequences exactly, dealt over many partitions."""
    monkeypatch.setattr(packing, "PIECES", 60)
    random.seed(6)
    sizes = []
    for _ in range(150):
        left = 256
        while left:
            n = min(left, random.randint(least, 160))
            n = left if left - n < least else n
            sizes.append(n)
            left -= n
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows, 256).collect()
    assert sorted(r.length for r in got) == sorted(sizes) and len({r.doc_id for r in got}) == len(sizes)
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 256
    assert 150 <= len(used) <= (152 if least == 1 else 165)  # 150 is the optimum


def test_a_lone_long_word_walks_as_the_library_does():
    path = words.public_path("byte_bpe_50k.json")
    t, automaton = words.tokenizer(path), bpe_codec.compiled(path)
    random.seed(12)
    for x in ("x" * 300_000, "".join(random.choice("abcdefghij") for _ in range(300_000)), "é" * 5000, "ing" * 1000, "中文" * 4000):
        assert automaton.encode_words([x.encode()])[0] == t.encode(x, add_special_tokens=False).ids


def test_lower_bound_is_one():
    assert packing.lower_bound(np.array([1025] * 5), 2048) == 5
    assert packing.lower_bound(np.array([1024] * 4), 2048) == 2


def test_suffix_dedup_against_brute_force(spark):
    random.seed(2)
    base = ["".join(random.choice(["ab ", "the ", "é", "xyz", "\n"]) for _ in range(200)) for _ in range(4)]
    docs = [(i, "".join(b[(a := random.randint(0, 100)) : a + random.randint(20, 300)] for b in random.choices(base, k=3))) for i in range(60)]
    docs += [(90, ""), (91, None), (92, "z" * 500), (93, "a" * 99)]
    seen, want = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.report(frame(spark, docs)).collect()}
    assert got == want


def test_exact_dedup(spark):
    rows = [(1, "A"), (2, "a"), (2, "a"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "q")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert kept == Counter([2, 3, 4, 6, None])
    assert {r.group_size for r in got if r.doc_id in (1, 2)} == {3}
    assert exact_dedup.keep_distinct(frame(spark, rows)).count() == 5


def test_a_later_batch_meets_the_index(spark, tmp_path):
    """Brute force over batches: a text is kept once, by the batch that brought it first; a batch that runs again gets the same."""
    at, seen = str(tmp_path / "index"), {}
    batches = {"a": [(1, "A"), (2, "a"), (3, "b"), (4, None)], "b": [(5, "B"), (6, "c"), (7, "C"), (8, "")], "c": [(9, "a"), (10, "d"), (None, "c"), (None, "e")]}
    for turn in ("a", "b", "a", "c", "b"):
        rows, want = batches[turn], []
        norm = [(t or "").lower() for _, t in rows]
        for (i, _), t in zip(rows, norm, strict=True):
            best = max((j for (j, _), u in zip(rows, norm, strict=True) if u == t and j is not None), default=None)
            own, keep = seen.setdefault(t, (turn, best))
            want.append((i, keep, norm.count(t), own == turn and i == keep))
        got = exact_dedup.exact_dedup(frame(spark, rows), at, turn).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(want)
        kept = Counter(r.doc_id for r in exact_dedup.keep_distinct(frame(spark, rows), at, turn).collect())
        assert kept == Counter(i for i, _, _, k in want if k)
    assert spark.read.parquet(at).count() == len(seen)


def test_counts_come_from_the_cache(spark, tmp_path, monkeypatch):
    path, at, encoded = words.public_path("byte_bpe_50k.json"), str(tmp_path / "cache"), spark.sparkContext.accumulator(0)
    real = token_counts._encoder

    def counting(p):
        def run(batches):
            for b in real(p)(batches):
                encoded.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(token_counts, "_encoder", counting)
    t = words.tokenizer(path)
    version = token_counts.version_of(path)
    for name, rows, misses in ((version, [(1, "one"), (2, "two"), (3, "two"), (4, None)], 3), (version, [(5, "two"), (6, "three"), (7, "")], 1), (version, [(5, "two"), (6, "three")], 0), ("another", [(5, "two"), (8, "four")], 2), (version, [(8, "four")], 1)):
        monkeypatch.setattr(token_counts, "version_of", lambda p, name=name: name)
        before = encoded.value
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, rows), path, at).collect()}
        assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows}
        assert encoded.value - before == misses
    assert spark.read.parquet(at).count() == 7


def test_jaccard(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, a + " tail"), (3, a.upper()), (4, "other text of few words here"), (5, None), (6, "x"), (7, "x")]
    got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 1), 7: (6, 1)}
    assert sorted(r.doc_id for r in jaccard_join.keep_one(frame(spark, rows)).collect()) == [1, 4, 5, 6]


def test_lines(spark):
    line = " ".join(f"word{i}" for i in range(80))
    rows = [(1, f"{line}\n\nshort"), (2, f"{line} more\nshort\nown line"), (3, None)]
    got = {r.doc_id: (r.n_lines, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1][1] == f"{line}\n\nshort" and "own line" in got[2][1] and "short" not in got[2][1]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_edit_distances_against_plain_recurrence():
    random.seed(11)
    pairs = [("kitten", "sitting"), ("", "abc"), ("same", "same")]
    for _ in range(900):
        a = "".join(random.choice("abcdé中") for _ in range(random.choice([0, 1, 3, 10, 63, 64, 65, 128, 130, 200])))
        b = list(a)
        for _ in range(random.choice([0, 1, 5, 40])):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randint(0, 2)] = random.choice(["", "z", "xy"])
        pairs.append((a, "".join(b)) if random.random() < 0.5 else ("".join(b), a))
    want = [_levenshtein(a, b) for a, b in pairs]
    assert edit_kernels.edit_distances(pairs).tolist() == want
    assert [edit_kernels.edit_distance(a, b) for a, b in pairs] == want


def test_quality(spark):
    good, bad = "the cat sat on the mat and it was good to see. ", "BUY!! NOW!! $$$ ### %%% &&& WOW!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(200)] + [(900, None), (901, "")]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    scored = quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 2 == 1) for r in scored if r.doc_id < 200)
    judged = quality_rules.judge(docs, labels).collect()
    assert len(judged) == len(rows) and all(r.base_failed and not r.kept for r in judged if r.doc_id >= 900)


def test_quality_rules_against_brute_force(spark):
    random.seed(9)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "é", "$5", "#x", "<b>", "|"]
    rows = []
    for i in range(120):
        ws = random.choices(vocabulary[:150] if i % 3 else vocabulary, k=random.choice([0, 3, 9, 10, 40, 80]))
        if i % 5 == 0 and len(ws) > 20:
            ws[10:10] = ws[:8]
        text = "".join(w + random.choice([" ", " ", "\n", "\t", "\x0b", "  "]) for w in ws)
        rows.append((i, text + ("\n" + text if i % 7 == 0 else "")))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "\u00a0 a\u2003b")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    space = re.compile("[ \t-\r]+")
    ws_of = {i: [w for w in space.split(t or "") if w] for i, t in rows}
    size = quality_rules.BUCKETS

    def grams(ws):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(x) % size for x in h] + [size + signed(x) % size for x in two]

    trusted = {i for i in range(120) if i % 3 > 0 and zlib.crc32(str(i).encode()) % 4 != 2}
    raw = Counter(g for ws in ws_of.values() for g in grams(ws))
    target = Counter(g for i in trusted for g in grams(ws_of[i]))
    weight = {}
    for lo in (0, size):
        t, r = (sum(n for g, n in c.items() if lo <= g < lo + size) for c in (target, raw))
        weight |= {g: np.log((target[g] + 0.5) / (t + 0.5 * size)) - np.log((n + 0.5) / (r + 0.5 * size)) for g, n in raw.items() if lo <= g < lo + size}
    llr = {i: float(np.mean([weight[g] for g in grams(ws)])) if ws else 0.0 for i, ws in ws_of.items()}
    least = np.mean([llr[i] for i in trusted if len(ws_of[i]) >= 10]) - quality_rules.MARGIN
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    for i, t in rows:
        t, ws = t or "", ws_of[i]
        windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        twice = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if space.sub("", x)]
        base = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert np.isclose(r.llr, llr[i]) and r.kept == (not r.base_failed and llr[i] >= least)


def test_language(spark):
    rows = [(i, ("the and of with " if i % 2 else "der und die mit ") * (1 + i % 7), "en" if i % 2 else "de") for i in range(100)]
    odd = [(200, None, "en"), (201, "12 %", "de"), (202, "\u00bd \u00b2 \u2460 \u2169", "en"), (203, "_", "de")]  # numerals are no letters
    docs = spark.createDataFrame([*rows, *odd], SCHEMA + ", lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i, _, _ in odd) and all(got[i][0] == x and 0 < got[i][1] <= 1 for i, _, x in rows)


def test_language_model_against_plain_counts(spark):
    """Log-probabilities of hashed n-grams, counted one by one."""
    rows = [(i, ("the and of with " if i % 3 else "der und die mit ") * (1 + i % 7), "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = language_id.fit(docs)
    learnt = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    size = language_id.BUCKETS

    def grams(t):
        flat = np.array([ord(c) for c in t.lower()], np.uint32)
        return [int(h[k]) for n, h in language_id._hashes(flat) for k in range(len(t) - n + 1)]

    for k, lang in enumerate(("de", "en")):
        own = [t for t, x in learnt if x == lang]
        assert model.langs[k] == lang and np.isclose(model.priors[k], np.log(len(own) / len(learnt)))
        seen = Counter(h for t in own for h in grams(t))
        for part in range(3):
            total = sum(n for h, n in seen.items() if h // size == part)
            want = {h: np.log((n + 0.5) / (total + 0.5 * size)) for h, n in seen.items() if h // size == part}
            assert all(np.isclose(model.logs[k, h], v, atol=1e-5) for h, v in want.items())
    for t in ("the die", "mit with of", "a"):
        logs = model.priors + np.array([sum(float(model.logs[k, h]) for h in grams(t)) for k in (0, 1)])
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        names, scores = model.predict([t])
        assert names == [model.langs[int(p.argmax())]] and np.isclose(scores[0], p.max(), atol=1e-4)


def test_short_lines_that_are_similar_share_a_key():
    random.seed(8)
    for n in range(4, line_dedup.EXACT):
        for _ in range(60):
            a = "".join(random.choice("abcé ") for _ in range(n))
            b = list(a)
            for _ in range(n // 5):
                k = random.randrange(len(b) + 1)
                b[k : k + random.randint(0, 1)] = random.choice(["", "x", "yé"[random.randint(0, 1)]])
            b = "".join(b)
            if a != b and max(len(a), len(b)) < line_dedup.EXACT and line_dedup.similar([(a, b)])[0]:
                assert set(line_dedup.short_keys(a).tolist()) & set(line_dedup.short_keys(b).tolist()), (a, b)


def test_lines_against_brute_force(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 8)))
    lines = []
    for n in (2, 3, 6, 10, 20, 40, 60, 100) * 4:
        ws = [word() for _ in range(n)]
        lines.append(" ".join(ws))
        k = random.randrange(n)
        lines.append(" ".join([*ws[:k], ws[k][:-1] + "z", *ws[k + 1 :]]))  # one letter of one word
        if n > 9:
            lines.append(" ".join([*ws[: k // 2], word(), *ws[k // 2 + 1 :]]))  # another word
    label = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if label[i] != label[j] and line_dedup.similar([(a, lines[j])])[0]:
                least, most = sorted((label[i], label[j]))
                label = [least if x == most else x for x in label]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {i: int(label[i] != i) for i in range(len(lines))}


def test_lines_leave_no_scratch_that_is_not_read(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    rows = [(i, "\n".join(" ".join([*words, str(i), *words[::-1], str(k)]) for k in range(3)) + "\nsingle") for i in range(200)]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, root = spark.conf.get(key, None), Path(common.scratch_path(spark, "x").removeprefix("file://")).parent
    found = lambda: set(root.glob("*"))
    there = found()
    got = line_dedup.dedup_lines(frame(spark, rows))
    left = {p.name.rpartition("-")[0] for p in found() - there}
    assert {"lines", "known-lines"} <= left and not left & {"line-classes", "distinct-lines", "meetings", "met", "passing", "line-links", "rooted", "stays"}
    assert sum(r.n_removed for r in got.collect()) == 798 and spark.conf.get(key, None) == before  # one "single" and one of the similar lines stay


def test_dealt_keys_come_back_with_their_lines(spark):
    r = np.random.default_rng(3)
    lines, want = [], {}
    for k, at in enumerate([*range(70_000), *range(1 << 33, (1 << 33) + 500)]):  # more than a row of the shuffle can number, and a gap
        blocks = r.integers(0, 1 << 20, 3) << 27 | 5
        lines.append((at, blocks))
        for b in blocks.tolist():
            want.setdefault(b & (1 << 8 * line_dedup.KEY) - 1, []).append(at)
    own = np.repeat(np.arange(len(lines)), 3)
    keys = line_dedup._packed_keys(own, np.concatenate([b for _, b in lines]), len(lines))
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in lines]), keys], ["id", "keys"])
    got = {}
    dealt = [batch.slice(at, 9_000) for at in range(0, len(lines), 9_000)]
    parts = {}
    for b in line_dedup._dealer(7)(iter(dealt)):
        for k in range(b.num_rows):
            parts.setdefault(b.column(0)[k].as_py(), []).append(b.slice(k, 1))
    assert len(parts) > 1
    for rows in parts.values():
        for b in line_dedup._meetings(iter(rows)):
            for key, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(key, []).append(line)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if len(v) > 1}


def test_edit_distances_up_to_a_bound(monkeypatch):
    random.seed(12)
    pairs = []
    for n in [5, 63, 64, 65, 128, 129, 300, 700] * 40:
        a = "".join(random.choice("abcdefgh é中") for _ in range(n))
        b = list(a)
        for _ in range(random.choice([0, 1, n // 10, n // 5, n // 4])):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randint(0, 2)] = random.choice(["", "z", "abcdefgh" * random.choice([0, 0, 4])])
        pairs.append((a, "".join(b)))
    want = edit_kernels.edit_distances(pairs)
    for few in (0, edit_kernels.FEW, 1 << 30):  # all together, and each alone
        monkeypatch.setattr(edit_kernels, "FEW", few)
        for share in (0.05, 0.2, 0.5):
            enough = np.array([share * max(len(a), len(b)) for a, b in pairs]) + 1e-9
            assert ((edit_kernels.edit_distances(pairs, enough) <= enough) == (want <= enough)).all()
    assert 40 < (want <= 0.2 * np.array([max(len(a), len(b)) for a, b in pairs])).sum() < 280


def test_a_pair_of_lines_is_compared_once(monkeypatch):
    a, b = (" ".join(f"{x}{k} word{k}" for k in range(20)) for x in "ab")
    n = 12  # blocks that both lines have
    columns = {"key": range(n), "u": [0] * n, "v": [0] * n, "block": [0] * n}
    rows = [{k: list(v)[i] for k, v in columns.items()} | {"id": at, "n": len(x), "s1": 0, "s2": 0, "line": x} for i in range(n) for at, x in enumerate((a, b))]
    seen = []
    monkeypatch.setattr(line_dedup, "similar", lambda pairs: seen.extend(pairs) or np.zeros(len(pairs), bool))
    assert list(line_dedup._verify(iter([pa.RecordBatch.from_pylist(rows)]))) == [] and len(seen) == 1


def test_simhashes_hold_the_counts_of_few_lines(monkeypatch):
    random.seed(13)
    lines = [" ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(random.randint(1, 12))).encode() for _ in range(20_000)]
    tracemalloc.start()
    got = line_dedup.simhashes(lines)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70e6  # the counts of all lines take 82 MB
    some = [*lines[:40], b"".join(lines[:90]), b"x", b"".join(lines[50:400])]
    whole = line_dedup.simhashes(some)
    assert (whole[:40] == got[:40]).all()
    for piece in (300, 1000, 2048):
        monkeypatch.setattr(line_dedup, "PIECE", piece)  # long lines come in pieces
        assert (line_dedup.simhashes(some) == whole).all()
