"""SimHash classes, repeated passages, weighted sampling: against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm.conftest import prose
from pyspark.sql import functions as F

from barloom.llm import cws, graph, simhash, suffixes


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, distance=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= distance):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 50, 33_000])
def test_fingerprints(n):
    text = prose(n, n, "aBcé").replace("c", "\x1c")
    assert simhash.fingerprint(text) == brute_print(text)


def test_near_copies(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex_of(F.col("fp")).alias("fp"), "component_id").collect()
    prints = [brute_print(t) for _, t, _, _ in odd_rows]
    ids = [i for i, _, _, _ in odd_rows]
    assert Counter(map(tuple, got)) == Counter(zip(ids, (f"{p:016x}" for p in prints), brute_classes(ids, prints), strict=True))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("flips", [1, 4, 6])
def test_large_cells(spark, flips):
    """One cluster of thousands of different fingerprints around a centre, and strangers."""
    rng, found = random.Random(flips), set()
    while len(found) < 3000:
        p = 0x0123456789ABCDEF
        for b in rng.sample(range(64), rng.randint(0, flips)):
            p ^= 1 << b
        found.add(p)
        if flips == 1 or rng.random() < 0.1:
            found.add(rng.getrandbits(64))
    prints = sorted(found)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = dict(simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(prints))] == brute_classes(range(len(prints)), prints)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(500)]
    for segment in (1, 2, 4, 8):
        rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(simhash.embed(F.col("a"), segment).bitwiseXOR(simhash.embed(F.col("b"), segment))).alias("d"))
        for a, b, d in rows.collect():
            counts = [[(x >> s & ((1 << segment) - 1)).bit_count() for s in range(0, 64, segment)] for x in (a, b)]
            assert d == sum(abs(p - q) for p, q in zip(*counts, strict=True)) <= (a ^ b).bit_count()


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_cells_cover_every_pair(n):
    rng = random.Random(0)
    masks = [m % (1 << 64) for m in simhash.cell_masks(n)]
    for _ in range(200):
        off = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & off for m in masks)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(101)}, **{i: 1000 for i in range(1000, 1400)}, 2000: 2000, 2001: 2000}


def brute_spans(rows):
    seen, out = set(), []
    for own, text in sorted(rows):
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((own, len(text), runs, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return Counter(out)


def spans_of(df, block_bytes):
    return Counter((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.repeated_spans(df, block_bytes=block_bytes).collect())


def test_repeated_passages(make):
    rng = random.Random(3)
    passages = [prose(100 + k, rng.randint(15, 50)) for k in range(6)]
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.35 and rows:
            text = "".join("Z" if rng.random() < 0.005 else c for c in rng.choice(rows)[1])
        elif kind < 0.7:
            text = prose(i, rng.randint(0, 40)) + rng.choice(passages) + prose(i + 500, rng.randint(0, 30)) + rng.choice(passages)
        else:
            text = rng.choice(["a" * rng.randint(90, 300), "ab" * rng.randint(40, 150), prose(i, rng.randint(0, 120))])
        rows.append((i // 2 if i < 10 else i, text))
    want = brute_spans([(i, t.encode()) for i, t in rows])
    df = make([(i, t, None, None) for i, t in rows])
    assert spans_of(df, 3000) == want == spans_of(df, 1 << 20)


def test_spans_of_odd_rows(odd, odd_rows, none):
    want = brute_spans([(-(1 << 63) if i is None else i, (t or "").encode()) for i, t, _, _ in odd_rows])
    assert spans_of(odd, 20_000) == want
    assert suffixes.repeated_spans(none).count() == 0


def test_texts_beyond_a_chunk():
    """Windows are the same, however a text is cut into chunks."""
    text = prose(8, 250_000).encode()
    assert len(text) > 1 << 20
    st = suffixes.stretches([b"", text[:50], text])
    assert (st.doc == 2).all()
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(st.first, st.last, strict=True)])
    assert (starts == np.arange(len(text) - 99)).all()


def test_family_is_logarithmic():
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.choice(600, 100, replace=False) for _ in range(40)]).astype(np.uint64)
    b = rng.integers(0, 2, 4000).astype(np.uint64)
    n = np.arange(4000)
    family = suffixes.Family(a, b, rng.permutation(4000), n // 100, n.astype(np.int32))
    for part in np.split(n, 40):
        family.add(part)
        assert len(family.levels) <= 8
    first = {}
    for k in n:
        key = (a[k], b[k])
        first[key] = min(first.get(key, (1 << 60, 0)), (family.order[k], k))
    assert [bool(family.copy[k]) for k in n] == [first[a[k], b[k]][1] != k for k in n]
    several = {x for x in a if {0, 1} <= set(b[a == x].tolist())}
    assert all(family.mixed[k] == (a[k] in several) for k in n if not family.copy[k])


def weighted(text):
    words = (text or "").split(" ")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(x, y):
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def test_collision_rate_is_generalised_jaccard(spark):
    """One bin, the same weights under many other names: equal samples at the rate of the similarity."""
    x, y = [1] * 5 + [2] * 1 + [3] * 4, [1] * 2 + [2] * 3 + [4] * 2 + [3] * 4
    want = jaccard(Counter(x), Counter(y))
    rows = [([t + 10 * k for t in x], [t + 10 * k for t in y]) for k in range(2000)]
    sides = spark.createDataFrame(rows, "x array<long>, y array<long>")
    got = sides.agg(F.avg((cws.signature(F.col("x"), 1) == cws.signature(F.col("y"), 1)).cast("int"))).first()[0]
    assert abs(got - want) < 4 * np.sqrt(want * (1 - want) / 2000)


def test_likeness_follows_the_similarity(make):
    base = prose(1, 900).split(" ")
    rows = [(k, " ".join(base[: 100 * k] + prose(50 + k, 900 - 100 * k).split(" ")), None, None) for k in range(10)]
    got = {r["doc_id"]: r["signature"] for r in cws.fingerprints(make(rows)).collect()}
    near = make(rows).sparkSession.createDataFrame([(k, got[k], got[9]) for k in range(10)], "k int, a array<long>, b array<long>").select("k", cws.likeness(F.col("a"), F.col("b")).alias("s"))
    for k, s in near.collect():
        assert abs(s - jaccard(weighted(rows[k][1]), weighted(rows[9][1]))) < 0.17


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    got = cws.fingerprints(odd).collect()
    order = sorted((-(1 << 63) if i is None else i, t or "") for i, t, _, _ in odd_rows)
    want = Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[None if i == -(1 << 63) else i, len(t), t[: len(t) - half] + after[:half]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    assert len({tuple(r["signature"]) for r in got if r["doc_id"] in (4, 5)}) == 1
    assert cws.fingerprints(none).count() == 0


def test_neighbours_across_blocks(make):
    rows = [(k * 7, f"text {k}", None, None) for k in range(50)]
    got = {r["order"]: r["next_text"] for r in cws.followed(make(rows), block_rows=6).where("not guest").collect()}
    assert got == {k * 7: f"text {(k + 1) % 50}" for k in range(50)}


def test_fingerprints_run_no_python(make):
    plan = cws.fingerprints(make([(1, "a b", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
