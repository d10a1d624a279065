"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; a text is scored by
the product over its words. Piece probabilities come from expectation-maximisation: expected counts
over all segmentations of the training words, from equal pieces on until the likelihood stops
rising. The tokeniser itself is neither trained nor run. Every single byte is a piece, so every text
has a score.

Words are whole, however long: the recursion looks as far ahead as pieces reach, through the hashes of
their prefixes, and is rescaled as it goes. The work is done once for each distinct word, of a
batch or of the training texts, for all words of about a length at once."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import lower_words, sliced, written

#: Pseudo-count of a piece in a language.
PRIOR = 0.1
#: Training ends when a round adds less than this share to the log likelihood, or after so many rounds.
GAIN, ROUNDS = 1e-2, 20
#: Bytes of the words that are worked on together, and distinct words that a task counts before it sends them on.
CHUNK, COUNTED = 1 << 18, 100_000
#: Bytes of the words whose scores a task remembers from slice to slice; of so many words it forgets them, as past COUNTED.
HELD = 8 << 20
#: The product of as many probabilities as such a word has bytes is no less than a double holds: it needs no rescaling.
SHORT = 20
#: Words up to this length keep their pieces between the two directions of training; longer ones find them twice.
KEPT = 512
_BITS = 20


@lru_cache(2)
def vocabulary(path: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(number of pieces, length of the longest, hashes by slot, numbers by slot) of a rank file.

    A table of open addressing over the 64-bit hashes of the pieces and all their prefixes; a prefix that is
    no piece has number -1, an empty slot 0."""
    with open(path, "rb") as f:
        pieces = sorted({base64.b64decode(line.split()[0]) for line in f if line.strip()} | {bytes([b]) for b in range(256)})
    number: dict[int, int] = {}
    for k, piece in enumerate(pieces, 1):
        h = np.uint64(0)
        for b in piece:
            h = _step(h, np.uint64(b))
            number.setdefault(int(h), -1)
        number[int(h)] = k
    keys, numbers = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
    for h, k in number.items():
        slot = h >> (64 - _BITS)
        while numbers[slot]:
            slot = (slot + 1) & ((1 << _BITS) - 1)
        keys[slot], numbers[slot] = h, k
    return len(pieces), max(map(len, pieces)), keys, numbers


def _step(h, byte):
    """The hash of a string with one byte more."""
    with np.errstate(over="ignore"):
        h = (h ^ (byte + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _numbers(h: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Numbers of hashes, -1 for a prefix, 0 where there is none; follows the probe sequence of the table."""
    slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
    out = np.where(keys[slot] == h, numbers[slot], 0)
    open_ = np.flatnonzero((out == 0) & (numbers[slot] != 0))
    while len(open_):
        slot[open_] = (slot[open_] + 1) & ((1 << _BITS) - 1)
        out[open_] = np.where(keys[slot[open_]] == h[open_], numbers[slot[open_]], 0)
        open_ = open_[(out[open_] == 0) & (numbers[slot[open_]] != 0)]
    return out


def chunks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, bytes padded with zeros, lengths) of some words at a time, of lengths within a quarter of each other."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        shortest, end = len(words[order[at]]), at
        while end < len(order) and len(words[order[end]]) <= max(shortest, shortest * 5 // 4) and (end == at or (end + 1 - at) * len(words[order[end]]) <= CHUNK):
            end += 1
        own = [words[i] for i in order[at:end]]
        n = len(own[-1])
        chars = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in own), np.uint8).reshape(len(own), n)
        yield np.array(order[at:end]), chars, np.array([len(w) for w in own])
        at = end


def _pieces(chars: np.ndarray, lengths: np.ndarray, start: int, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, rows, piece numbers) of the pieces that begin at start, for as long as some row's bytes are a prefix of one."""
    _, _, keys, numbers = vocabulary(path)
    rows = np.flatnonzero(lengths > start)
    h, end = np.zeros(len(rows), np.uint64), start
    while len(rows):
        h = _step(h, chars[rows, end].astype(np.uint64))
        end += 1
        found = _numbers(h, keys, numbers)
        if (hit := found > 0).any():
            yield end, rows[hit], found[hit]
        on = (found != 0) & (lengths[rows] > end)
        rows, h = rows[on], h[on]


#: A recursion whose value falls under LOW is multiplied by UP, with all that lies ahead of it.
_LOW, _UP = 1e-150, 1e150


def _rescaled(now: np.ndarray, ahead: np.ndarray, scale: np.ndarray) -> None:
    """Lifts what has become small, in place; scale keeps the logarithm. now is part of ahead, along its first axis.
    Where something far larger lies ahead, what is small adds nothing that a double could hold."""
    small = (now < _LOW) & (now > 0)
    if small.any():
        lift = small & (ahead.max(axis=0) < 1e-100)
        ahead *= np.where(lift, _UP, 1.0)
        scale -= np.where(lift, np.log(_UP), 0.0)


def word_scores(words: list[bytes], log_p: np.ndarray, path: str) -> np.ndarray:
    """log P(word | language), by the forward algorithm over a window as wide as the longest piece. log_p:
    row 0 and a row per piece, a column per language; row 0 is minus infinity."""
    p, wide = np.exp(log_p), vocabulary(path)[1] + 1
    out = np.zeros((len(words), p.shape[1]))
    for ids, chars, lengths in chunks(words):
        n = chars.shape[1]
        if n <= SHORT:
            alpha = np.zeros((n + 1, len(ids), p.shape[1]))
            alpha[0] = 1
            for start in range(n):
                for end, rows, found in _pieces(chars, lengths, start, path):
                    alpha[end, rows] += alpha[start, rows] * p[found]
            out[ids] = np.log(alpha[lengths, np.arange(len(ids))])
            continue
        size = min(wide, n + 1)
        window = np.zeros((size, len(ids), p.shape[1]))
        window[0] = 1
        scale = np.zeros((len(ids), p.shape[1]))
        for start in range(n + 1):
            now = window[start % size]
            if (over := lengths == start).any():
                out[ids[over]] = np.log(now[over]) + scale[over]
            if start < n:
                _rescaled(now, window, scale)
                for end, rows, found in _pieces(chars, lengths, start, path):
                    window[end % size, rows] += now[rows] * p[found]
                now[:] = 0
    return out


def expected_counts(words: list[bytes], lang: np.ndarray, weight: np.ndarray, p: np.ndarray, path: str) -> tuple[np.ndarray, float]:
    """(expected piece counts by language, log likelihood) of words of the languages lang (columns of p), each
    so often as weight says, under the piece probabilities p (row 0: no piece)."""
    total, likelihood = np.zeros(p.shape), 0.0
    for ids, chars, lengths in chunks(words):
        n, rows_of, own = chars.shape[1], np.arange(len(ids)), lang[ids]
        if n <= SHORT:
            known = [(start, end, rows, found, p[found, own[rows]]) for start in range(n) for end, rows, found in _pieces(chars, lengths, start, path)]
            alpha, beta = np.zeros((n + 1, len(ids))), np.zeros((n + 1, len(ids)))
            alpha[0] = beta[lengths, rows_of] = 1
            for start, end, rows, _, q in known:
                alpha[end, rows] += alpha[start, rows] * q
            # from the last start down; the pieces of one start in any order
            for start, end, rows, _, q in reversed(known):
                beta[start, rows] += beta[end, rows] * q
            whole = alpha[lengths, rows_of]
            likelihood += float((weight[ids] * np.log(whole)).sum())
            each = weight[ids] / whole
            at = np.concatenate([found * p.shape[1] + own[rows] for _, _, rows, found, _ in known])
            share = np.concatenate([alpha[start, rows] * q * beta[end, rows] * each[rows] for start, end, rows, _, q in known])
            total += np.bincount(at, share, total.size).reshape(total.shape)
            continue
        kept = [list(_pieces(chars, lengths, start, path)) for start in range(n)] if n <= KEPT else None
        pieces = kept.__getitem__ if kept else lambda start: _pieces(chars, lengths, start, path)  # noqa: B023
        wide = vocabulary(path)[1] + 1
        alpha, beta = np.zeros((n + 1, len(ids))), np.zeros((n + 1, len(ids)))
        up, down = np.zeros((n + 1, len(ids))), np.zeros((n + 1, len(ids)))
        alpha[0], scale = 1, np.zeros(len(ids))
        for start in range(n):
            _rescaled(alpha[start], alpha[start : start + wide], scale)
            up[start] = scale
            for end, rows, found in pieces(start):
                alpha[end, rows] += alpha[start, rows] * p[found, own[rows]]
        up[n] = scale
        whole, at_end = alpha[lengths, rows_of], up[lengths, rows_of]
        likelihood += float((weight[ids] * (np.log(whole) + at_end)).sum())
        beta[lengths, rows_of], scale = 1, np.zeros(len(ids))
        for start in range(n - 1, -1, -1):
            for end, rows, found in pieces(start):
                # both sides in the scale of this start
                beta[start, rows] += beta[end, rows] * np.exp(down[end, rows] - scale[rows]) * p[found, own[rows]]
            small = (beta[start] < _LOW) & (beta[start] > 0)
            beta[start] *= np.where(small, _UP, 1.0)
            scale = scale - np.where(small, np.log(_UP), 0.0)
            down[start] = scale
            for end, rows, found in pieces(start):
                share = np.exp(np.log(alpha[start, rows]) + up[start, rows] + np.log(p[found, own[rows]]) + np.log(np.maximum(beta[end, rows], 1e-300)) + down[end, rows] - np.log(whole[rows]) - at_end[rows])
                np.add.at(total, (found, own[rows]), share * weight[ids[rows]])
    return total, likelihood


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text): how often each language has each word, with a space before it as in running
    text. A language without words has one row without a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: dict[str, Counter]) -> pa.RecordBatch:
            langs, words = [], []
            for lang, own in found.items():
                langs += [lang] * (len(own) + 1)
                words += [*own, None]
            n = [x for own in found.values() for x in (*own.values(), 0)]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        found: dict[str, Counter] = {}
        for batch in sliced(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(lower_words(text.as_py()))
            if sum(map(len, found.values())) > COUNTED:
                yield out(found)
                found = {}
        yield out(found)

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.withColumn("word", F.concat(F.lit(b" "), "word"))


def train(docs: DataFrame, path: str, where: Column, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log_p) from the rows of docs with a language that pass where.

    The words are counted once and written; each round of expectation-maximisation reads that table. What a
    round sends to the driver is a number for each piece of the vocabulary and language. A null or empty
    text teaches its language nothing but that it exists; rows that repeat count each; other columns are
    not read; an empty table gives no language. Words are counted whole, however long."""
    rows = docs.where(where & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = written(_counted(rows), "language-words")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    n_pieces = vocabulary(path)[0]
    p = np.full((n_pieces + 1, len(langs)), 1.0 / n_pieces)
    p[0] = 0
    before = -np.inf
    for _ in range(rounds if langs else 0):
        shared = docs.sparkSession.sparkContext.broadcast(p)  # pieces x languages, whatever the corpus

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            p, total, likelihood = shared.value, 0.0, 0.0
            for batch in batches:
                lang = batch["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()
                got, gain = expected_counts(list(batch["word"]), lang, batch["n"].to_numpy(float), p, path)
                total, likelihood = total + got, likelihood + gain
            if isinstance(total, np.ndarray):
                piece, lang = np.nonzero(total)
                yield pd.DataFrame({"lang": np.append(lang, 0), "piece": np.append(piece, 0), "n": np.append(total[piece, lang], likelihood)})

        sums = counted.where("word is not null").mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        none = sums["piece"] == 0  # the likelihood stands in the row of no piece
        likelihood = float(sums["n"][none].sum())
        table = np.zeros(p.shape)
        table[sums["piece"][~none], sums["lang"][~none]] = sums["n"][~none]
        table[1:] += PRIOR
        p = table / table.sum(0, keepdims=True)
        if likelihood - before < GAIN * abs(likelihood):
            break
        before = likelihood
    with np.errstate(divide="ignore"):
        return langs, np.log(p)


class _Known:
    """Word scores that a task keeps from slice to slice; past COUNTED words or HELD bytes it begins anew."""

    def __init__(self, log_p: np.ndarray, path: str):
        self.log_p, self.path = log_p, path
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.scores, self.held = np.empty((0, self.log_p.shape[1])), 0

    def scored(self, texts: list[list[bytes]]) -> list[list[int]]:
        """Rows of scores for the words of each text."""
        if len(self.index) > COUNTED or self.held > HELD:
            self._forget()
        index = self.index
        rows = [[index.setdefault(w, len(index)) for w in words] for words in texts]
        fresh = list(islice(index, len(self.scores), None))
        if fresh:
            self.held += sum(map(len, fresh))
            self.scores = np.concatenate([self.scores, word_scores(fresh, self.log_p, self.path)])
        return rows


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language among those learnt,
    all alike before. und with score 0 for a null text, one without a letter, and if nothing was
    learnt. Equally likely languages give the first in order. Whole texts are scored, whole words too. Rows
    that repeat are scored alike; columns named lang_pred or score are replaced; an empty table
    gives an empty table."""
    langs, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)  # pieces x languages, whatever the corpus
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value, path)
        for batch in sliced(batches, at):
            texts = [t.as_py() for t in batch.column(at)]
            per_text = known.scored([[b" " + w for w in lower_words(t)] for t in texts]) if langs else texts
            found, score = [], []
            for text, own in zip(texts, per_text, strict=True):
                if not langs or text is None or not any(map(str.isalpha, text)):
                    found.append("und")
                    score.append(0.0)
                    continue
                total = known.scores[own].sum(0)
                best = int(total.argmax())
                found.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield batch.append_column("lang_pred", pa.array(found, pa.string())).append_column("score", pa.array(score, pa.float64()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
