"""Near copies by five-word Jaccard similarity, against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from llm.conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm import jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("copies, cell, block", [(3, 32, 512), (60, 8, 16)])
def test_near_copies_are_the_jaccard_groups(make, monkeypatch, copies, cell, block):
    """Copies with one to six words changed lie on both sides of 0.8; many of one text fill large bands."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(copies), ["", None, "one two", "One  two", "one two three"]
    for k in range(240 // copies):
        base = prose(700 + k, rng.randint(40, 300))
        texts += [base, *(edited(rng, base, rng.randint(1, 6)) for _ in range(copies))]
    want = brute_groups(texts)
    got = {r["doc_id"] for r in P.drop_near_copies(None, make([(i, t, "en", "a") for i, t in enumerate(texts)]), "").collect()}
    assert got == set(want)
    pairs = [(i, w) for i, w in enumerate(want) if i != w]
    assert len(pairs) > 50


@pytest.mark.parametrize("cell, block", [(32, 512), (4, 8)])
def test_simhash_grid_links_near_copies_without_bands(make, monkeypatch, cell, block):
    """With bands that no two sets share, each pair within three bits and of the similarity is still linked."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "band_keys", lambda h: np.resize(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64), 24))
    rng, texts = random.Random(4), []
    for k in range(30):
        base = prose(800 + k, rng.randint(150, 400))
        texts += [base, *(edited(rng, base, rng.randint(1, 4)) for _ in range(9))]
    sets = [jaccard.shingle_set(t) for t in texts]
    prints = [jaccard._majority(jaccard._bits(h), len(h)) for h in sets]
    want = brute_groups(texts)
    rows = make([(i, t, "en", "a") for i, t in enumerate(texts)])
    root = {r["doc_id"]: r["root"] for r in jaccard.near_copies(rows, F.xxhash64("doc_id", "text"), keep=(F.col("doc_id"),)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    near = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert 50 < len(near) < len(pairs)
    assert all(root[i] == root[j] for i, j in near)
    assert all(want[i] == want[j] for i in root for j in root if root[i] == root[j])
