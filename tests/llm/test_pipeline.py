"""The pipeline on a small corpus against a plain Python version of each stage."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from llm.conftest import prose, table
from llm.test_models import brute_targets
from llm.test_near_copies import brute_groups
from llm.test_text_operators import brute_lines

import corpus_pipeline as P
from barloom.llm import bpe, queries

BAD = ["zorgul", "plinket", "vranto", "mubbel"]


def corpus():
    rng, rows = random.Random(9), []
    for i in range(320):
        words = prose(2000 + i, rng.randint(25, 60)).split()
        if i % 6 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = "\n".join([" ".join(words[:10]), *(["subscribe here"] if i % 4 == 1 else []), " ".join(words[10:])])
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c", None])))
    for i in range(320, 360):
        rows.append((i, rows[(i - 320) * 3 + 1][1] + rng.choice(["", " ", "\n"]), "en", rng.choice("ab")))
    return [*rows, (None, None, None, None), (400, "", "en", "b"), (401, None, "en", "b"), (401, rows[2][1], "en", "a"), (2, rows[2][1], "en", rows[2][3])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(320)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage gets and gives."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    for name in list(stages)[:-1]:
        assert tuple(stages[name][1][0].asDict()) == P.COLUMNS


def test_toxic_documents_go_and_others_stay(stages):
    before, after = stages["toxicity"]
    clean = [r for r in before if not any(w in (r["text"] or "").split() for w in BAD)]
    assert Counter(after) == Counter(clean)


def test_boilerplate_lines_go(stages):
    before, after = stages["line dedup"]
    want = brute_lines([(r["source"], r["text"]) for r in before], P.LINE_RATIO)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after) == Counter((r["doc_id"], t, r["n_chars"] if t == r["text"] else len(t)) for r, t in zip(before, want, strict=True))
    assert any("subscribe here" in (r["text"] or "") for r in before)
    assert not any("subscribe here" in (r["text"] or "") for r in after if r["source"] == "a")


def test_one_of_each_group_stays(stages):
    before, after = stages["SimHash near-dedup"]
    groups = {}
    for r, c in zip(before, brute_groups([r["text"] for r in before]), strict=True):
        groups.setdefault(c, []).append(r)
    assert len(after) == len(groups) < len(before)
    for members in groups.values():
        kept = [r for r in after if r in members]
        assert len(kept) == 1 and kept[0]["doc_id"] == min((r["doc_id"] for r in members if r["doc_id"] is not None), default=None)


def test_sources_meet_their_targets(stages):
    before, after = stages["mixing"]
    sizes, taken, times = Counter(), Counter(), Counter(after)
    for r in before:
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in after:
        taken[r["source"]] += len(r["text"].split())
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert set(after) <= set(before) and max(times.values()) <= 3


def test_every_row_of_the_mix_is_encoded(stages):
    before, after = stages["byte-level BPE"]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in after) == want


def test_run_is_the_stages_in_order(spark, folder, stages):
    assert Counter(map(tuple, ((r["doc_id"], r["n_tokens"]) for r in P.run(spark, folder).collect()))) == Counter((r["doc_id"], r["n_tokens"]) for r in stages["byte-level BPE"][1])


def test_stages_on_an_empty_table(spark, none, folder):
    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        docs = docs if docs.columns == list(P.COLUMNS) else none


def test_stages_with_other_columns(spark, odd, folder):
    for _, stage in P.STAGES[:4]:
        assert stage(spark, odd, folder).columns == list(P.COLUMNS)


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_operators():
    import re
    from pathlib import Path

    import barloom

    for p in Path(barloom.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"barloom\.llm|corpus_pipeline", p.read_text()), p
