"""The Jaccard join against brute force where groups are larger than a block."""

import random

import numpy as np
import pytest

from wayfold.llm import jaccard_join as jj


def corpus():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, passage, texts = words(120), words(60), []
    for _ in range(600):  # near copies of one text, some too far from it
        t = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3])):
            t[k] = f"e{rng.randrange(10**6)}"
        texts.append(t)
    texts += [words(rng.randrange(10, 60)) + passage + words(rng.randrange(5, 40)) for _ in range(500)]  # a common passage
    chain = words(100)
    for _ in range(300):  # each is similar to its neighbours only
        texts.append(list(chain))
        chain = chain[1:] + words(1)
    texts += [words(50) for _ in range(100)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    return texts


def brute(texts):
    """(least id of the group, number of links, similarity) by exact sets."""
    sets, place = [], {}
    for t in texts:
        w = t.split()
        sets.append({place.setdefault(tuple(w[k : k + 5]), len(place)) for k in range(max(1, len(w) - 4))})
    x = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        x[k, list(s)] = 1
    both, n = (x @ x.T).astype(int), x.sum(axis=1).astype(int)
    close = 10 * both >= 8 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(close, False)
    label = np.arange(len(sets))
    while True:
        new = np.minimum(label, np.where(close, label[None, :], len(sets)).min(axis=1))
        if (new == label).all():
            return label.tolist(), close.sum(axis=1).tolist()
        label = new


@pytest.fixture(scope="module")
def case():
    texts = corpus()
    return texts, *brute(texts)


def test_links_of_large_groups(spark, case):
    texts, label, links = case
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.class_id, r.n_links) for r in jj.similarity_classes(docs).collect()}
    found, all_links = sum(got[k][1] for k in got), sum(links)
    assert found >= 0.999 * all_links
    assert got == {k: (label[k], links[k]) for k in range(len(texts))}  # at this seed none is missed


def test_one_of_each_large_group_stays(spark, case):
    texts, label, _ = case
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in jj.keep_one(docs).collect()) == sorted(set(label))


def test_missed_pairs_are_rarer_than_the_bound():
    runs = jj.runs_needed()
    assert jj.missed(runs) <= 1 - jj.RECALL < jj.missed(runs - 1)
