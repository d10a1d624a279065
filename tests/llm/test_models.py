"""Language model, toxicity, language identification, mixing: brute force, invariants, held-out rows."""

import base64
import itertools
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.conftest import prose
from pyspark.sql import functions as F

from barloom.llm import hmm, language, mixing, toxicity
from barloom.llm.text import lower_words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def small_model(states=3, words=4):
    rng = np.random.default_rng(1)
    n = hmm.SUFFIXES + 1 + words
    model = hmm.Model(10, 5, [bytes([97 + i]) for i in range(words)], np.zeros(n), np.zeros(n), np.zeros(n))
    model.start, model.move = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states)
    model.emit = rng.dirichlet(np.ones(n), states).T
    return model


def brute_likelihood(model, codes):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(codes)):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for (a, b), c in zip(itertools.pairwise(path), codes[1:], strict=True):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
    return total


def test_forward_is_the_sum_over_paths():
    model, rng = small_model(), np.random.default_rng(2)
    texts = [rng.integers(0, len(model.emit), n).astype(np.int32) for n in (1, 5, 2, 5, 3)]
    got = hmm._Steps(texts).likelihoods(model)
    assert np.allclose(10**got, [brute_likelihood(model, t) for t in texts])


def test_baum_welch_counts_are_posteriors():
    model = small_model()
    codes = np.array([0, 3, 3, 7], np.int32)
    start, move, emit = hmm._Steps([codes, codes[:1]]).counts(model, float)
    assert np.isclose(start.sum(), 2) and np.isclose(move.sum(), 3) and np.isclose(emit.sum(), 5)
    whole = brute_likelihood(model, codes)
    want = np.zeros_like(move)
    for path in itertools.product(range(3), repeat=4):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for (a, b), c in zip(itertools.pairwise(path), codes[1:], strict=True):
            p *= model.move[a, b] * model.emit[c, b]
        for a, b in itertools.pairwise(path):
            want[a, b] += p / whole
    assert np.allclose(move, want)


def two_tongues(n, seed=0):
    """Texts of one of two vocabularies each."""
    words = [[w + end for w in prose(k, 60, "abcdefgh").split()] for k, end in ((70, "an"), (71, "ur"))]
    rng = random.Random(seed)
    return [" ".join(rng.choice(words[i % 2]) for _ in range(40)) for i in range(n)]


def base(rows, learn):
    counts = Counter(w for i, t in rows if learn(i) for w in [*(t or "").lower().encode().split(), b""])
    n, v = sum(counts.values()), len(counts)
    return n, {i: (sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), len(words), sum(counts[w] > 0 for w in words)) for i, t in rows for words in [[*(t or "").lower().encode().split(), b""]]}


def test_hmm_beats_its_base_on_held_out_texts(make, monkeypatch):
    monkeypatch.setattr(hmm, "LEAN", 10.0)
    rows = list(enumerate(two_tongues(120)))
    got = hmm.fit_and_score(make([(i, t, None, None) for i, t in rows]), F.col("doc_id") % 5 != 1).collect()
    n, want = base(rows, lambda i: i % 5 != 1)
    for r in got:
        assert r["train_tokens"] == n and (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][1:]
        assert np.isclose(r["base_score"], want[r["doc_id"]][0])
    held_out = [r for r in got if r["doc_id"] % 5 == 1]
    assert all(r["score"] > r["base_score"] + 5 for r in held_out)


def test_another_round_explains_more(make, monkeypatch):
    monkeypatch.setattr(hmm, "LEAN", 1.0)
    docs = make([(i, t, None, None) for i, t in enumerate(two_tongues(60))])
    counts = hmm.count_words(docs)
    model = hmm.vocabulary(counts)
    coded = hmm.encode(docs, model, F.lit(True))
    hmm.begin(model, *hmm._neighbours(coded, model))
    totals = []
    for _ in range(3):
        totals.append(hmm.score(coded, model, counts).agg(F.sum("score")).first()[0])
        hmm.baum_welch(coded, model)
    assert totals == sorted(totals)


def test_rare_words_meet_their_counts(make, monkeypatch):
    """Words without a class of their own come by the join; the base is the same."""
    monkeypatch.setattr(hmm, "COMMON", 100)
    rows = list(enumerate(two_tongues(40)))
    docs = make([(i, t, None, None) for i, t in rows])
    model = hmm.vocabulary(hmm.count_words(docs.where("doc_id % 5 != 1")))
    assert 0 < len(model.words) < model.distinct - 10
    n, want = base(rows, lambda i: i % 5 != 1)
    for r in hmm.fit_and_score(docs, F.col("doc_id") % 5 != 1).collect():
        assert np.isclose(r["base_score"], want[r["doc_id"]][0]) and r["n_known"] == want[r["doc_id"]][2]


def test_hmm_of_odd_rows(odd, odd_rows, none):
    got = hmm.fit_and_score(odd, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.fit_and_score(none, F.lit(True)).count() == 0
    untaught = hmm.fit_and_score(odd, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and np.isclose(r["base_score"], 0) for r in untaught)


def insults(n, seed):
    rng = random.Random(seed)
    bad = ["zorgul", "plinket", "vranto", "mubbel", "skorf"]
    for i in range(n):
        words = prose(1000 + seed * n + i, rng.randint(30, 80)).split()
        if toxic := i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "!"]))
        yield " ".join(words), int(toxic)


def test_toxicity_on_held_out_texts(make, spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(insults(400, 1))]
    docs = make([(i, t, None, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 300] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.train(docs, labels, F.col("doc_id") < 300)).where("doc_id >= 300").collect()
    assert all((r["toxicity"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in got)


def test_toxicity_of_odd_rows(odd, odd_rows, none, spark):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, toxicity.train(odd, labels)).count() == len(odd_rows)
    assert toxicity.train(odd, labels.where("toxic = 0")) is None
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert {r["toxicity"] for r in toxicity.scored(odd, None).collect()} == {0.0}


def test_copies_do_not_mark_a_class():
    text = prose(1, 90)
    near = [text.replace(text.split()[k], "changed", 1) for k in range(20)]
    assert len(toxicity.distinct_texts([text, *near, prose(2, 90), text])) < 4


@lru_cache
def pieces():
    """Every piece of the vocabulary file and its number, in the order of the bytes."""
    with open(PATH, "rb") as f:
        found = {base64.b64decode(x.split()[0]) for x in f} | {bytes([b]) for b in range(256)}
    return {p: k for k, p in enumerate(sorted(found), 1)}


def brute_word(word, log_p):
    """log of the sum over all segmentations, in logarithms throughout; any piece of the vocabulary counts."""
    a = np.full(len(word) + 1, -np.inf)
    a[0] = 0
    longest = max(map(len, pieces()))
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if (k := pieces().get(word[i:j])) is not None:
                a[j] = np.logaddexp(a[j], a[i] + log_p[k])
    return a[-1]


WORDS = [b" der", " größte".encode(), b" internationalisation", b" " + b"x" * 200, " 日本語の文章は空白なしで書かれるので一つの語がとても長くなることがある".encode() * 3, b" " + b"-" * 700, b" a", b" " + bytes(range(33, 120)) * 4]


def test_forward_sums_all_segmentations_of_whole_words():
    n, longest, keys, slots = language.vocabulary(PATH)
    assert n == len(pieces()) and longest == max(map(len, pieces())) > 12

    def number(piece):
        h = np.uint64(0)
        for b in piece:
            h = language._step(h, np.uint64(b))
        return int(language._numbers(np.array([h]), keys, slots)[0])

    assert all(number(p) == k for p, k in list(pieces().items())[::97]) and number(b"zzzzqqqq") == 0 and number(b" internationa") != 0
    log_p = np.log(np.random.default_rng(0).random((n + 1, 2)) ** 9 / n)  # some pieces all but impossible
    log_p[0] = -np.inf
    got = language.word_scores(WORDS, log_p, PATH)
    assert got == pytest.approx(np.array([[brute_word(w, log_p[:, k]) for k in (0, 1)] for w in WORDS]))


def test_expected_counts_of_all_segmentations(monkeypatch):
    """Pieces weighted by their lengths cover each word once; counts are the gradient of the likelihood."""
    monkeypatch.setattr(language, "KEPT", 100)
    n = len(pieces())
    p = np.random.default_rng(1).random((n + 1, 2)) ** 4 / n
    p[0] = 0
    lang, weight = np.array([0, 1] * (len(WORDS) // 2)), np.arange(1.0, len(WORDS) + 1)
    counts, likelihood = language.expected_counts(WORDS, lang, weight, p, PATH)
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    assert likelihood == pytest.approx(sum(m * brute_word(w, log_p[:, k]) for w, k, m in zip(WORDS, lang, weight, strict=True)))
    lengths = np.array([0, *map(len, pieces())])
    assert lengths @ counts == pytest.approx([sum(m * len(w) for w, k, m in zip(WORDS, lang, weight, strict=True) if k == side) for side in (0, 1)])
    for piece in (b" international", b"xx", b"--------", b"r"):
        for k in (0, 1):
            more = p.copy()
            more[pieces()[piece], k] *= 1 + 1e-6
            _, up = language.expected_counts(WORDS, lang, weight, more, PATH)
            assert (up - likelihood) / 1e-6 == pytest.approx(counts[pieces()[piece], k], rel=1e-2, abs=1e-2)


def test_rounds_raise_the_likelihood(make):
    docs = make([(i, t, "ab"[i % 2], None) for i, t in enumerate(two_tongues(40))])
    words = [(b" " + w, "ab".index(r["lang"])) for r in docs.collect() for w in language.lower_words(r["text"])]
    known = sorted({w for w, _ in words})
    reached = []
    for rounds in (1, 2, 4, language.ROUNDS):
        langs, log_p = language.train(docs, PATH, F.lit(True), rounds=rounds)
        per_word = dict(zip(known, language.word_scores(known, log_p, PATH), strict=True))
        reached.append(sum(per_word[w][k] for w, k in words))
    assert langs == ["a", "b"] and reached == sorted(reached) and reached[-1] > reached[0] + 100


def test_languages_on_held_out_texts(make):
    rows = [(i, t, "ab"[i % 2], None) for i, t in enumerate(two_tongues(60))]
    docs = make([(i, t, None if i % 7 == 0 else k, s) for i, t, k, s in rows])
    got = language.identify(docs, language.train(docs, PATH, F.col("doc_id") % 3 != 1), PATH).where("doc_id % 3 = 1").collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] and 0.5 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(odd, odd_rows, none):
    # a word of 50,000 bytes is walked byte by byte in every round: two will do
    got = language.identify(odd, language.train(odd, PATH, F.lit(True), rounds=2), PATH).collect()
    assert {(r["lang_pred"], r["score"]) for r in got if r["text"] is None or not any(map(str.isalpha, r["text"]))} == {("und", 0.0)}
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "ja", "und"} and len(got) == len(odd_rows)
    assert language.identify(none, language.train(none, PATH, F.lit(True)), PATH).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(odd, PATH, F.lit(False)), PATH).collect()} == {"und"}


def test_knapsack_against_all_sums():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 12, rng.integers(1, 8)))
        counts, budget = rng.integers(1, 4, len(lengths)), int(rng.integers(0, 40))
        taken = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert (taken <= counts).all() and (lengths * taken).sum() == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0, 1.7, 2.9, 3.0])
def test_budgets_are_met(share):
    rng = np.random.default_rng(2)
    lengths, total = np.arange(1, 3000), 0
    counts = rng.integers(1, 30, len(lengths))
    total = (lengths * counts).sum()
    copies, more = mixing.fit_budget(lengths, counts, share * total, capacity=500)
    assert (more <= counts).all() and copies + (more > 0).any() <= 3
    assert abs(copies * total + (lengths * more).sum() - share * total) <= 1


def brute_targets(sizes):
    """Fill by weight, fix what is full at three times its size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(make):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 5 + ["a", "b", "é", "z", None])
        rows.append((i, prose(i, 0 if i % 90 == 0 else rng.randint(1, 60)) if i % 100 else None, None, source))
    docs = make(rows + [(2000, prose(1, 30), None, "tiny")])
    got = mixing.mix(docs, keep=("doc_id", "source")).collect()
    again = mixing.mix(docs.repartition(7), keep=("doc_id", "source")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == 901
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for r in got:
        assert np.isclose(r["target"], want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)


def test_mix_of_odd_rows(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and all(r["copies"] <= 3 for r in got)
    assert mixing.mix(none).count() == 0


def test_columns_are_cut_as_texts_are(odd_rows):
    texts = [r[1] for r in odd_rows] + [" A\x1c\x85b\t\nÀÉ  Ab ", "\x0b\x0c", " x Y z", "a\x00b  A"]
    lengths, found = hmm._cut(pa.array(texts, pa.string()))
    assert lengths.tolist() == [len(lower_words(t)) for t in texts]
    assert found.to_pylist() == [w for t in texts for w in lower_words(t)]


def test_a_word_is_scored_once_for_all_slices(monkeypatch):
    asked, score = [], language.word_scores
    monkeypatch.setattr(language, "word_scores", lambda words, *rest: asked.extend(words) or score(words, *rest))
    n = language.vocabulary(PATH)[0]
    log_p = np.log(np.vstack([np.full((1, 2), 1e-300), np.random.default_rng(3).dirichlet(np.ones(n), 2).T]))
    known, slices = language._Known(log_p, PATH), [[WORDS[:4], WORDS[2:5]], [[]], [WORDS[1:6], WORDS[:1]]]
    for texts in slices:
        rows = known.scored(texts)
        for words, own in zip(texts, rows, strict=True):
            if words:
                np.testing.assert_allclose(known.scores[own], score(words, log_p, PATH))
    assert sorted(asked) == sorted(set(WORDS[:6]))
    monkeypatch.setattr(language, "HELD", 0)
    known.scored([WORDS[:2]])
    assert list(known.index) == list(dict.fromkeys(WORDS[:2]))
