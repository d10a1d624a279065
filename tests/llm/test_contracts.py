"""The registered queries against a plain computation of their contract columns, over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from barloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def answer(spark, name, docs, columns):
    df = queries.queries()[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got) == set(docs) and df.count() == len(docs)
    return got


def test_op1_base(spark, docs):
    got = answer(spark, "op1_hmm_scoring", docs, "doc_id held_out n_tokens n_known train_tokens base_score score")
    tokens = {d: [*WORD.findall(lower(r["text"])), None] for d, r in docs.items()}
    counts = Counter(t for d, ts in tokens.items() if fold(d, 5) != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for d, r in got.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 5) == 1, len(tokens[d]), sum(counts[t] > 0 for t in tokens[d]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)


def test_op2_fingerprints_and_components(spark, docs):
    got = answer(spark, "op2_simhash", docs, "doc_id fingerprint component_id")
    prints = {}
    for d, r in docs.items():
        words = WORD.findall(lower(r["text"]))
        parts = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
        hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


def test_op4_removed_bytes(spark, docs):
    got = answer(spark, "op4_suffix_dedup", docs, "doc_id n_bytes n_removed n_spans kept_sha256")
    seen = set()
    for d in sorted(docs):
        data = (docs[d]["text"] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            part = data[i : i + 100]
            if part in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(part)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op5_measures(spark, docs):
    got = answer(spark, "op5_quality_rules", docs, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")
    for d, r in got.items():
        text = docs[d]["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and failed)


def test_op6_fold_and_range(spark, docs):
    got = answer(spark, "op6_toxicity", docs, "doc_id held_out score predicted")
    for d, r in got.items():
        assert r.held_out == (fold(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op7_edited_texts(spark, docs):
    got = answer(spark, "op7_weighted_sampling", docs, "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next")
    ids, prints = sorted(docs), defaultdict(set)
    for d, following in zip(ids, ids[1:] + ids[:1]):
        text, after = docs[d]["text"] or "", docs[following]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1) and (r.fingerprint == got[following].fingerprint) <= (r.near_next == 1)
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op8_targets(spark, docs):
    got = answer(spark, "op8_mix_sources", docs, "doc_id size source_size target taken")
    sizes, source_of = {d: len(WORD.findall(r["text"] or "")) for d, r in docs.items()}, {d: r["source"] for d, r in docs.items()}
    whole = Counter()
    for d, n in sizes.items():
        whole[source_of[d]] += n
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, left = {}, float(sum(whole.values()))
    while True:
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * whole[s]]
        if not over:
            break
        for s in over:
            capped[s] = 3.0 * whole[s]
            left -= capped[s]
    target, taken = capped | share, Counter()
    for d, r in got.items():
        s = source_of[d]
        assert (r["size"], r.source_size) == (sizes[d], whole[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * sizes[d]
        taken[s] += r.taken
    for s in order:  # all documents as often as they fit, and the largest sum of some of them that still does
        rounds = int(target[s] // whole[s])
        sums = 1
        for d in docs:
            sums |= sums << sizes[d] if source_of[d] == s else 0
        assert taken[s] == rounds * whole[s] + max(x for x in range(sums.bit_length()) if sums >> x & 1 and x <= target[s] - rounds * whole[s])
    assert {d: r.taken for d, r in answer(spark, "op8_mix_sources", docs, "taken").items()} == {d: r.taken for d, r in got.items()}


def test_op9_folds_and_accuracy(spark, docs):
    got = answer(spark, "op9_language", docs, "doc_id held_out lang_pred score")
    known = {r["lang"] for d, r in docs.items() if fold(d, 3) != 1 and r["lang"] is not None}
    tested = []
    for d, r in got.items():
        text = docs[d]["text"]
        assert r.held_out == (fold(d, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in known | {"und"}
        if r.held_out and docs[d]["lang"] in known:
            tested.append(r.lang_pred == docs[d]["lang"])
    assert sum(tested) >= 0.9 * len(tested)
