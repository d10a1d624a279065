"""Tokeniser, quality rules, line dedup: against the library itself, naive counts and SQL."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, lines, supervision

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("size", [1, 3, 40])
def test_pieces_end_where_matches_end(size):
    enc, rng = bpe.encoding(PATH, PATTERN), random.Random(size)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b's", "12", " ", "  ", "\n", "\t", "\xa0", "　", "!", "é", "\x1c", "'ll", "日"]) for _ in range(rng.randint(0, 60)))
        parts = list(bpe.pieces(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_round_trip(odd, odd_rows, none):
    enc = bpe.encoding(PATH, PATTERN)
    got = bpe.encode(odd, PATH, PATTERN).collect()
    assert len(got) == len(odd_rows)
    want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(none, PATH, PATTERN).count() == 0


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_measures(odd, odd_rows):
    texts = [t for _, t, _, _ in odd_rows] + ["a b c a b c d", "x\nx\n\n \nx", "a a a a", "#1 <b> |\x85| \x1cq", "a b\na b\r\na b"]
    for t in texts:
        assert supervision.measure(t)[:5] == naive(t)
    got = supervision.keep(odd)
    assert Counter((r[0], *r[1:6]) for r in got.select("doc_id", *supervision.COUNTS[:5]).collect()) == Counter((i, *naive(t)) for i, t, _, _ in odd_rows)
    assert got.where("base_failed and kept").count() == 0


def test_quality_of_an_empty_table(none):
    assert supervision.keep(none).count() == 0


def test_rules_learn_their_accuracy():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    hit = np.array([0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((20_000, 4)) < np.where(good[:, None], 0.02, hit), supervision.BAD, supervision.ABSTAIN)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table = supervision.fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02
    assert np.allclose(table[:, supervision.BAD, 0], hit, atol=0.04)
    kept = supervision.posterior(patterns, prior, table)[inverse.ravel()] >= 0.5
    assert (kept == good).mean() > 0.97


def brute_lines(rows, ratio):
    host_pages, seen = Counter(h or "" for h, _ in rows), Counter()
    for h, t in rows:
        seen.update({(h or "", x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    often = {k for k, n in seen.items() if n > 1 and n > ratio * host_pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" ")) not in often) for h, t in rows]


def test_lines_of_a_site(make, none):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host = rng.choice(["hot", "hot", "hot", "b", "c", None, f"rare{i}"])
        text = "\n".join(rng.choice(["menu", " menu ", "", "imprint", f"own {i}", f"line {rng.randrange(60)}", "é"]) for _ in range(rng.randint(0, 8)))
        rows.append((host, None if i % 50 == 0 else text))
    docs = make([(i, t, None, h) for i, (h, t) in enumerate(rows)]).withColumn("_drop", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(docs, F.col("source"), ratio=0.2).collect()}
    want = brute_lines(rows, 0.2)
    assert [got[i]["text"] for i in range(len(rows))] == want
    for i, (_, t) in enumerate(rows):
        n = 0 if t is None else len(t.split("\n"))
        assert got[i]["n_lines"] == n and (got[i]["n_dropped"] > 0) == (want[i] != t)
    assert lines.drop_boilerplate(none, F.col("source")).count() == 0


def test_line_dedup_keeps_rows(odd, odd_rows):
    assert lines.drop_boilerplate(odd, F.col("source")).count() == len(odd_rows)


def test_visible_lines(spark):
    html = "<html><script>var x = '<p>';</script><p>One &amp; <b>two</b></p><!-- <p>no</p> --><DIV class='a'>three</DIV></html>"
    got = spark.range(1).select(lines.visible_lines(F.lit(html)).alias("t"), lines.host_of(F.lit("HTTPS://me@WWW.Site.example:80/x")).alias("h"), lines.host_of(F.lit("no url")).alias("n")).first()
    assert [x for x in got["t"].split("\n") if x] == ["One & two", "three"]
    assert (got["h"], got["n"]) == ("www.site.example", "")


def test_digests_of_the_registered_query(spark):
    from barloom.llm import queries

    enc = bpe.encoding(PATH, PATTERN)
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op3_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_line_dedup_query_against_sql(spark):
    from oracle import connect

    from barloom.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op10_line_dedup(spark, sf)
    want = connect(sf).execute(queries.oracle_sql()["op10_line_dedup"])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())
