import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import clustering, private, queries, ranked
from barloom.llm.text import table
from tests.llm.conftest import CLASHES, prose

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_search(docs, items, k):
    found = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = set()
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            own = [t for t in set(TERM.findall(lowered(text))) if t in c]
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])}
    return out


def test_search_is_as_brute_force_on_the_whole_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    found = queries.op11_ranked_search(spark, SMALL)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert {tuple(r) for r in found.collect()} == brute_search(docs, items, 50)


def test_search_of_odd_rows_in_many_small_segments(spark, odd, odd_rows, none, monkeypatch):
    items = [(1, odd_rows[5][1]), (1, odd_rows[5][1]), (1, "one TEXT"), (2, None), (None, "日本語"), (3, "nowhere at all"), (4, odd_rows[10][1][:900])]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("taken"))
    want = brute_search([(i, t) for i, t, *_ in odd_rows], [(i, t) for i, t in items], 5)
    index = ranked.build(odd.repartition(5))
    assert {tuple(r) for r in ranked.search(index, asked, 5).collect()} == want
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 3)
    assert {tuple(r) for r in ranked.search(index, asked, 5).collect()} == want
    assert ranked.search(ranked.build(none), asked, 5).count() == 0
    assert ranked.search(index, asked.limit(0), 5).count() == 0


def test_a_segment_ends_at_its_bound(spark, make, monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", 7)
    rows = [(i, prose(i % 9, 30), "en", "a") for i in range(100)]
    index = ranked.build(make(rows).coalesce(1))
    assert ranked.SEGMENT_DOCS == 7 and index.n_docs == 100
    asked = [(q, prose(q, 12)) for q in range(9)]
    got = {tuple(r) for r in ranked.search(index, spark.createDataFrame(asked, "item_id long, text string"), 10).collect()}
    assert got == brute_search([r[:2] for r in rows], asked, 10)


@pytest.mark.parametrize("seed", range(20))
def test_intervals_give_the_best_of_a_segment(seed, monkeypatch):
    monkeypatch.setattr(ranked, "FRONT", 4)
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    places = [np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)) for _ in range(6)]
    impacts = [rng.integers(1, 5, len(p)) for p in places]
    tables = ranked.Tables.of(places, impacts, n)
    own, weights = np.array([4, 0, 5]), np.array([3, 1, 2])
    dense = np.zeros(n, np.int64)
    for i, w in zip(own, weights, strict=True):
        dense[places[i]] += w * impacts[i]
    where, score = ranked.best(tables, own, weights, 5)
    assert len(set(where.tolist())) == len(where) and (dense[where] == score).all()
    cut = np.sort(dense)[::-1][: 5][-1]
    assert set(np.flatnonzero((dense >= max(1, cut)))) == set(where)


# the contract's patterns, as they stand
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c.isdigit() and c.isascii()]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], private.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(300))
def test_plain_spans_are_the_patterns_matches(seed):
    rng = np.random.default_rng(seed)
    pieces = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "+1", "12", "4111111111111111", "4111-1111 1111 1111", "255", "256.1.1.1", "1.2.3.4", "(555) 200-1234", "é", "_", "%", "\n", "٣", "1.", ")", "7"]
    text = "".join(rng.choice(pieces, int(rng.integers(1, 40))))
    assert private.ordered(private.plain_spans(text)) == brute_plain(text)


DISGUISED = [
    ("email", "john (at) example (dot) com"),
    ("email", "bob [at] mail [dot] example [dot] net"),
    ("email", "jane at example dot org"),
    ("email", "jane.doe at example.org"),
    ("email", "juan arroba ejemplo punto es"),
    ("email", "jo​hn@exam​ple.com"),
    ("email", "аlice@ехаmple.com"),
    ("email", "alice＠example．com"),
    ("phone", "plus one five five five one two three four five six seven"),
    ("phone", "＋1 (555) 200-1234"),
    ("phone", "five five five one two three four five six eight"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "4111–1111–1111–1111"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "192(dot)168(dot)0(dot)1"),
]


@pytest.mark.parametrize("kind, shown", DISGUISED)
def test_disguises_map_back_to_the_characters_they_came_from(kind, shown):
    text = f"Été \U0001f600 zuerst, {shown}; thé end"
    found = [(k, text[a:b]) for k, a, b in private.disguised_spans(text)]
    assert found == [(kind, shown)]
    assert private.plain_spans(text) == brute_plain(text)


@pytest.mark.parametrize(
    "text",
    [
        "", "visit us at example.com", "look at this. And dot the one two three", "x at 10 dot 5", "un un un un un un un un un un un un un",
        "Иван дома. нет @ и точка", "the dot com years at home", "m² and 1.2.3.4²", "call +1 (555) 200-1234 or bob@example.com, one two three four",
    ],
)
def test_clean_texts_gain_nothing(text):
    assert set(private.disguised_spans(text)) <= set(private.plain_spans(text))


def test_rewriting_twice_maps_back_through_both():
    text = "a​[at]b​ (dot) co"
    stages = private.transduced(text)
    assert stages[-1].text == "a@b.co"
    assert private.disguised_spans(text) == [("email", 0, len(text))]


def test_personal_data_as_registered(spark, odd, odd_rows, none):
    got = {r["doc_id"]: r for r in queries.op12_personal_data(spark, SMALL).collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        want = brute_plain(text or "")
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == kind for k, *_ in want) for kind in PLAIN)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == joined or set(joined.split(",")) <= set(r["spans"].split(",")) | {""}
    found = private.find(odd)
    assert found.columns == ["doc_id", "plain", "added"] and found.count() == len(odd_rows)
    assert private.find(none).count() == 0


def test_long_runs_take_linear_time():
    for run in ("x" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "+" + "1 " * 100_000, "one " * 50_000, "(at) " * 40_000):
        private.plain_spans(run)
        private.disguised_spans(run)


# ---- clusters ------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = [c for c, _ in assign()]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, *a) for (i, _), a in zip(kept, assign(), strict=True)), key=str), centroids


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(i % 7, 1, 8).astype(np.float32)]) for i in range(300)]
    same = rows[3][1]
    rows += [(None, same), (None, rows[9][1]), (2**60 + 1, same), (7, same), (7, same), (400, None), (401, []), (402, same[:7]), (403, [None, *same[1:]]), (404, [float("nan"), *same[1:]]), (405, [float("inf"), *same[1:]])]
    rows += [(1000 + i, same) for i in range(300)]
    table_ = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("taken") for c in (*CLASHES, "v", "id", "cluster", "distance", "place", "deal")})
    found = clustering.cluster(table_, n_clusters=11, rounds=5, dims=8)
    want, centroids = brute_clusters(rows, 11, 5, 8)
    assert found.centroids == centroids
    assert sorted((tuple(r) for r in found.assigned.collect()), key=str) == want
    assert found.assigned.columns == ["vec_id", "cluster", "distance"]


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0] * 4), (2, [2.0] * 4), (3, [1e38] * 4)]
    found = clustering.cluster(spark.createDataFrame(rows, VECTORS), n_clusters=9, rounds=2, dims=4)
    assert len(found.centroids) == 3 and {r["distance"] for r in found.assigned.collect()} == {0}
    assert max(max(c) for c in found.centroids) == clustering.LARGEST
    empty = clustering.cluster(spark.createDataFrame([], VECTORS), n_clusters=9, rounds=2, dims=4)
    assert empty.centroids == [] and empty.assigned.count() == 0 and empty.totals().count() == 0


def test_neighbours_on_the_curve_are_neighbours_in_space():
    side = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = clustering.hilbert_keys(side, 3)
    assert len(set(keys)) == 512
    walk = side[sorted(range(512), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("seed", range(20))
def test_the_nearest_centroid_is_always_a_candidate(seed):
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-50, 50, (30, 5)) // (1 + seed % 5) + 20, rng.integers(-100, 100, (25, 5))
    near = clustering.candidates(v.min(0), v.max(0), c)
    exact = ((v[:, None] - c[None]) ** 2).sum(2)
    assert set(exact.argmin(1)) <= set(near.tolist())
    at, d = clustering.nearest(v, c[near])
    assert (near[at] == exact.argmin(1)).all() and (d == exact.min(1)).all()
    big = clustering.nearest(v * (1 << 20), c * (1 << 20))
    assert (big[0] == exact.argmin(1)).all() and (big[1] == exact.min(1) << 40).all()


def test_clusters_as_registered(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()]
    want, centroids = brute_clusters(rows, 40, 5)
    got = queries.op13_clustering(spark, SMALL).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    for r in got:
        assert r["inertia"] == sum(d for *_, d in want)
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
