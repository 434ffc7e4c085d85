"""The pipeline against a brute-force version of its stages."""

import random
import zlib
from itertools import combinations

import numpy as np

import corpus_pipeline
from wayfold.llm import packing, quality_classifier, words


def corpus():
    rng = random.Random(8)
    vocabulary = ["river", "stone", "garden", "letter", "winter", "market", "bridge", "silent", "the", "of", "and", "walked", "slowly", "é", "across", "toward"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "."]) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "###", "NOW", "WOW!!", "100%", "&&&", "FREE"]) for _ in range(n))
    rows, shared = [], prose(60)
    for i in range(80):
        rows.append((i, junk(40 + i) if i % 4 == 3 else prose(60 + i)))
    good = [t for i, t in rows if i % 4 != 3]
    rows += [(100 + k, t.upper() if k == 1 else t) for k, t in enumerate(good[:4])]  # copies
    rows += [(120 + k, t + " tail") for k, t in enumerate(good[2:8])]  # near copies
    rows += [(140 + k, f"{prose(50)} {shared} {prose(70)}") for k in range(6)]  # a common passage
    return rows


def survivors(rows, quality):
    """(doc_id, text) that enter the packing."""
    d = len(quality_classifier.NAMES)
    x = {i: np.array(quality_classifier.statistics(t)) for i, t in rows}
    learnt = {0: [], 1: []}
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learnt[quality[i]].append(x[i])
    model = quality_classifier.Discriminant.fit({k: (len(v), np.sum(v, axis=0), np.array(v).T @ np.array(v)) for k, v in learnt.items()})
    rows = [(i, t) for i, t in rows if model.scores(x[i].reshape(1, d))[0] >= 0.7]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {t.translate(upper): i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in sorted(rows) if last[t.translate(upper)] == i]
    ws = {i: t.translate(upper).split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ws.items()}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    rows, seen, out = [(i, t) for i, t in rows if root[i] == i], set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        out.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    quality = {i: int("$" not in t and "NOW" not in t) for i, t in rows}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = words.tokenizer(words.public_path(packing.VOCABULARY))
    want = {}
    for i, t in survivors(rows, quality):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[i] = (0, len(ids), zlib.crc32(ids.tobytes()))
    assert len(want) < len(rows) - 25 and {140, 141} <= set(want)
    assert {r.doc_id: (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
