"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains. The rules are taken as independent given the unseen
quality of a document; expectation-maximisation over the counts of vote patterns estimates how
often each rule gives each vote to good and to bad documents, and a document is kept by its
posterior probability of being good. Counts of patterns are at most 3 ** rules numbers, whatever
the size of the corpus, and every document is counted."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain_words", "n_upper", "n_letters", "n_shouts", "n_digits", "n_symbol_words", "n_ended_lines", "n_distinct_words")

_ALL = bytes(range(256))
_WHITE, _SYMBOLS, _DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word without a letter: neither A-Z, a-z nor a byte of a character beyond ASCII.
_NO_LETTER = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")

#: A word that holds a symbol, and the ends of a line that closes a sentence.
_SYMBOL_WORD = re.compile(rb"[^\s#*$%&|<>]*[#*$%&|<>]\S*")
_ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", '"', ")", "\u201d", "\u2026", "\u3002"))

#: Votes of a rule.
BAD, ABSTAIN, GOOD = 0, 1, 2

#: name: (measure, bound beyond which it votes bad, bound up to which it votes good). The side on
#: which a rule votes bad is the side of its first bound; between the two it abstains.
RULES: dict[str, tuple[str, float, float]] = {
    "length": ("n_words", 50, 100),
    "short_words": ("word_chars / n_words", 2.5, 3.2),
    "long_words": ("word_chars / n_words", 11.0, 8.5),
    "symbols": ("n_symbols / n_words", 0.1, 0.02),
    "symbol_words": ("n_symbol_words / n_words", 0.1, 0.02),
    "line_ends": ("n_ended_lines / n_lines", 0.4, 0.8),
    "plain_words": ("n_plain_words / n_words", 0.8, 0.93),
    "upper_case": ("n_upper / greatest(n_letters, 1)", 0.3, 0.1),
    "shouts": ("n_shouts / n_words", 0.1, 0.02),
    "dup_lines": ("n_dup_lines / n_lines", 0.34, 0.05),
    "repeats": ("n_repeat_words / n_words", 0.5, 0.1),
    "variety": ("n_distinct_words / sqrt(n_words)", 4.0, 6.0),
    "digits": ("n_digits / word_chars", 0.2, 0.05),
}


def _count(raw: bytes, kinds: bytes) -> int:
    return len(raw.translate(None, _ALL.translate(None, kinds)))


def _repeat_words(found: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, each counted once."""
    windows = list(zip(found, found[1:], found[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = bytearray(len(found))
    for i, w in enumerate(windows):
        if w in often:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS; upper case and letters are counted within ASCII."""
    text = text or ""
    raw, found = text.encode("utf-8", "replace"), words(text)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    upper, symbols = _count(raw, _UPPER), _count(raw, _SYMBOLS)
    return (
        len(found),
        len(text) - _count(raw, _WHITE),
        symbols,
        len(lines) - len(set(lines)),
        _repeat_words(found),
        len(lines),
        len(found) - len(_NO_LETTER.findall(raw)),
        upper,
        upper + _count(raw, _UPPER.lower()),
        raw.count(b"!"),
        _count(raw, _DIGITS),
        len(_SYMBOL_WORD.findall(raw)) if symbols else 0,
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        len(set(found)),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the COUNTS as long) for each row. A null text counts as empty: all zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure(t) for t in batch[text_col]], columns=list(COUNTS), dtype="int64")
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    # ids pass through pandas as text, so that a null id stays null beside integers
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias(id_col), text_col)
    return rows.mapInPandas(run, f"`{id_col}` string, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn(id_col, F.col(id_col).cast(kind))


def vote(rule: tuple[str, float, float]) -> Column:
    """BAD, ABSTAIN or GOOD. A document without words has no shares: its rules abstain, but length."""
    share, bad, good = rule
    x = F.expr(share if share == "n_words" else f"CASE WHEN n_words > 0 THEN {share} END")
    is_bad, is_good = (x < bad, x >= good) if bad < good else (x > bad, x <= good)
    return F.when(is_bad, BAD).when(is_good, GOOD).otherwise(ABSTAIN)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, measures, votes, quality, base_failed, kept) for each row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows; such a row is
    not kept. Any other is kept if its posterior probability of being good reaches the threshold."""
    judged = judge(measures(docs, id_col, text_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good, and table[rule, vote, class] of vote probabilities, by expectation-maximisation.

    patterns: one row per distinct pattern, one column per rule. Starts from "any bad vote is bad",
    so that class 1 is the good one; a pseudo-count of one document per vote keeps every
    probability above zero."""
    votes = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    # the start of all-must-pass filtering, from which the estimates then depart
    good = np.where((patterns == BAD).any(1), 0.05, 0.95)
    prior, table = 0.5, np.full((patterns.shape[1], 3, 2), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([1 - good, good], axis=1) * counts[:, None]
        prior = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("prv,pc->rvc", votes, weight) + 1
        table /= table.sum(axis=1, keepdims=True)
        new = posterior(patterns, prior, table)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern."""
    logs = np.log(table)[np.arange(patterns.shape[1])[None, :], patterns].sum(1) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def judge(measured: DataFrame, rules: dict[str, tuple[str, float, float]] = RULES) -> DataFrame:
    """measured with vote_<rule>, pattern and quality (posterior probability of good).

    Only the distinct patterns and their counts, at most 3 ** rules rows, meet on the driver; the
    posteriors come back as a table of that bound. An empty table gives an empty table."""
    voted = measured.withColumns({f"vote_{name}": vote(rule) for name, rule in rules.items()})
    voted = voted.withColumn("pattern", F.concat(*(F.col(f"vote_{name}").cast("string") for name in rules)))
    seen = sorted(voted.groupBy("pattern").count().collect())
    if not seen:
        return voted.withColumn("quality", F.lit(0.0))
    patterns = np.array([[int(v) for v in r["pattern"]] for r in seen])
    good = posterior(patterns, *fit(patterns, np.array([r["count"] for r in seen], float)))
    known = voted.sparkSession.createDataFrame([(r["pattern"], float(g)) for r, g in zip(seen, good, strict=True)], "pattern string, quality double")
    return voted.join(F.broadcast(known), "pattern")
