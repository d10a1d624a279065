"""The line stage in sources of few documents."""

import corpus_pipeline as P
from llm.conftest import prose


def test_ratio_decides_in_small_sources(make):
    """Six documents of one source and thirty of another with a common line, and lines of their own."""
    rows = [(i, f"{prose(900 + i, 12)}\nsubscribe here\n{prose(950 + i, 12)}", "en", "small" if i < 6 else "larger") for i in range(36)]
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(None, make(rows), "").collect()}
    assert got == {i: t.replace("\nsubscribe here", "") for i, t, _, _ in rows}
