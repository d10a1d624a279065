"""A hidden Markov language model of words.

States emit word classes, and a class emits a word: P(word | state) = P(class | state) P(word | class).
A word that is at least one in COMMON of the training tokens is a class of its own (so there are at
most COMMON of those, in a corpus of any size); any other word falls in one of SUFFIXES classes by its
last bytes, in which it is weighed by its own count, counted over the whole corpus. Baum-Welch
counts of states, transitions and classes are summed over partitions; the model that the driver holds
has that fixed bound. Counts of all other words stay in a table, and meet the texts by a join.

The scaled forward recursion gives the exact likelihood, for all texts of a batch side by side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import lower_words, written
from barloom.session import cut_lineage

STATES, ROUNDS = 8, 2
COMMON, SUFFIXES, SUFFIX_BYTES = 1 << 19, 1 << 14, 4
#: Tokens of texts that are held at once, and words that a worker remembers the class of.
BATCH_TOKENS, REMEMBERED = 600_000, 500_000
#: Clusters of classes whose neighbour counts start the states, half of them the commonest words.
CLUSTERS = 256
#: Pseudo-tokens with which a state's emissions lean on those of the corpus.
LEAN = 1000.0
#: The end of a text, as a token. No word is empty.
END = b""


def suffix_class(word: bytes) -> int:
    """1 to SUFFIXES; class 0 is the end."""
    return 1 + xxhash.xxh32_intdigest(word[-SUFFIX_BYTES:]) % SUFFIXES


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words): lower_words() for a whole column."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = parts.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(found), 0)  # white space at either end leaves an empty word there
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts)), found.filter(real)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, suffix, n): how often each token occurs, the end of each text included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": list(seen), "suffix": [suffix_class(w) for w in seen], "n": list(seen.values())})

        for batch in batches:
            for text in batch[text_col]:
                seen.update(lower_words(text))
                seen[END] += 1
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text_col).mapInPandas(run, "word binary, suffix int, n long").groupBy("word", "suffix").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """words[i] is class SUFFIXES + 1 + i. Tables have a row per class; logs are to the base of ten."""

    tokens: int
    distinct: int
    words: list[bytes]
    count: np.ndarray  # of the end and of the words with a class of their own, in class order, else 0
    class_count: np.ndarray
    #: log10 of what P(word | class) is divided by: 0 where the class is the word
    log_norm: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.empty(0))
    move: np.ndarray = field(default_factory=lambda: np.empty(0))
    emit: np.ndarray = field(default_factory=lambda: np.empty(0))

    def smoothed(self) -> np.ndarray:
        """Share of each class in the corpus, none at zero."""
        p = self.class_count + 0.5
        return p / p.sum()


class _Classes(dict):
    """Class by word; remembers the suffix class of words it has met."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: SUFFIXES + 1 + i for i, w in enumerate(words)})
        self.room = len(self) + REMEMBERED
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
            self.update({w: SUFFIXES + 1 + i for i, w in enumerate(self.words)})
        self[word] = found = suffix_class(word)
        return found


def vocabulary(counts: DataFrame) -> Model:
    """The classes of a counted corpus. At most COMMON words and SUFFIXES sums reach the driver."""
    tokens, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    tokens, is_end = tokens or 0, F.length("word") == 0
    common = ~is_end & (F.col("n") * COMMON >= tokens)
    own = sorted(((-r["n"], bytes(r["word"])) for r in counts.where(common).select("word", "n").collect()))
    sums = np.zeros((SUFFIXES + 1, 2))
    for r in counts.where(~is_end & ~common).groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[r["suffix"]] = r["n"], r["v"]
    n = np.array([-x for x, _ in own], float)
    norm = np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1))
    norm[0] = 0
    count = np.concatenate([[ends or 0], np.zeros(SUFFIXES), n])
    class_count = np.concatenate([[ends or 0], sums[1:, 0], n])
    return Model(tokens, distinct, [w for _, w in own], count, class_count, np.concatenate([norm, np.zeros(len(n))]))


def encode(docs: DataFrame, model: Model, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """A written table with a row for each row of docs: _row, _learn, id, the columns of keep, n_tokens,
    _codes (classes of its tokens), sums over tokens with a class of their own, and its other words.

    Texts are cut into words once; every later step reads the classes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by COMMON and SUFFIXES
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(id_col), *keep)
    kept = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        classes, log_count, has = _Classes(m.words), np.log10(m.count + 0.5), m.count > 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                lengths, found = _cut(part.column(1))
                found = found.dictionary_encode()
                which, distinct = found.indices.to_numpy(), len(found.dictionary)
                code_of = np.array([classes[w] for w in found.dictionary.to_pylist()], np.int32)
                codes, text = code_of[which], np.repeat(np.arange(len(part)), lengths)
                n = lengths + 1
                offsets = np.concatenate([[0], np.cumsum(n)]).astype("int32")
                flat = np.zeros(offsets[-1], np.int32)  # class 0 ends each text
                flat[np.arange(len(codes)) + text] = codes
                own, here = (flat == 0) | (flat > SUFFIXES), np.repeat(np.arange(len(n)), n)
                logs = np.bincount(here, np.where(own, log_count[flat], 0.0), len(n))
                known = np.bincount(here, own & has[flat], len(n)).astype("int64")
                norm = np.bincount(here, m.log_norm[flat], len(n))
                rare, several = np.unique((text * distinct + which)[codes <= SUFFIXES], return_counts=True)
                ends = np.searchsorted(rare, np.arange(len(part) + 1) * distinct).astype("int32")
                words = pa.ListArray.from_arrays(ends, found.dictionary.take(pa.array(rare % max(distinct, 1))))
                times = pa.ListArray.from_arrays(ends, pa.array(several.astype("int32")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(known), pa.array(logs), pa.array(norm), words, times],
                    names=["_row", *kept, "n_tokens", "_codes", "_known", "_logs", "_norm", "_words", "_times"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return written(rows.mapInArrow(run, schema + ", n_tokens long, _codes array<int>, _known long, _logs double, _norm double, _words array<binary>, _times array<int>"), "hmm")


def _sequences(batches: Iterator[pa.Array]) -> Iterator[list[np.ndarray]]:
    """Class sequences of some texts at a time, in order."""
    codes: list[np.ndarray] = []
    held = 0
    for batch in batches:
        flat, ends = batch.values.to_numpy(), batch.offsets.to_numpy()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            codes.append(flat[a:b])
            held += b - a
            if held >= BATCH_TOKENS:
                yield codes
                codes, held = [], 0
    if codes:
        yield codes


class _Steps:
    """Sequences side by side, longest first: step t of all that reach it is one run of rows."""

    def __init__(self, codes: list[np.ndarray]):
        lengths = np.array([len(c) for c in codes])
        self.order = np.argsort(-lengths, kind="stable")
        by_order = lengths[self.order]
        self.active = len(codes) - np.searchsorted(by_order[::-1], np.arange(by_order[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(codes)), by_order)
        t = np.arange(len(rank)) - np.repeat(np.concatenate([[0], np.cumsum(by_order)[:-1]]), by_order)
        self.codes = np.empty(len(rank), np.int32)
        self.codes[self.at[t] + rank] = np.concatenate([codes[i] for i in self.order])
        self.texts = len(codes)

    def forward(self, model: Model, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables, and the scale of each row: P(token | tokens before)."""
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        start, move = model.start.astype(emit.dtype), model.move.astype(emit.dtype)
        for t in range(len(self.active)):
            here = slice(self.at[t], self.at[t + 1])
            a = start * emit[here] if t == 0 else (alpha[self.at[t - 1] : self.at[t - 1] + self.active[t]] @ move) * emit[here]
            s = a.sum(axis=1)
            np.divide(a, s[:, None], out=alpha[here])
            scale[here] = s
        return alpha, scale

    def likelihoods(self, model: Model) -> np.ndarray:
        """log10 P(class sequence) of each text, in the order given."""
        _, scale = self.forward(model, model.emit[self.codes])
        rank = np.arange(len(scale)) - np.repeat(self.at[:-1], self.active)
        out = np.empty(self.texts)
        out[self.order] = np.bincount(rank, np.log10(scale), self.texts)
        return out

    def counts(self, model: Model, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions by class, of one Baum-Welch step. Scaled numbers are near
        one, so that single precision does; scores are computed in double precision."""
        emit = model.emit[self.codes].astype(kind)
        alpha, scale = self.forward(model, emit)
        emit /= scale[:, None]
        move, moves = model.move.astype(kind), np.zeros_like(model.move)
        later = np.empty((0, len(model.start)), kind)
        for t in range(len(self.active) - 1, -1, -1):
            here = slice(self.at[t], self.at[t + 1])
            beta = np.ones((self.active[t], len(model.start)), kind)
            n = len(later)
            if n:
                beta[:n] = later @ move.T
                moves += alpha[here][:n].T @ later
            alpha[here] *= beta  # from here on the posterior of the states
            later = emit[here] * beta
        by_class = np.stack([np.bincount(self.codes, alpha[:, k], len(model.emit)) for k in range(alpha.shape[1])], axis=1)
        return alpha[: self.texts].sum(0, dtype=float), moves * model.move, by_class


def _neighbours(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each class, counts of neighbouring clusters). Commonest words are clusters of their
    own; other classes share one by a hash, words with the same suffix the same."""
    half = CLUSTERS // 2
    tail = [half + (suffix_class(w) % half) for w in model.words]
    cluster = np.concatenate([[0], half + np.arange(1, SUFFIXES + 1) % half, tail]).astype(np.int64)
    top = min(half - 1, len(model.words))
    cluster[SUFFIXES + 1 : SUFFIXES + 1 + top] = 1 + np.arange(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLUSTERS * CLUSTERS, np.int64)
        for codes in _sequences(b.column(0) for b in batches):
            flat = cluster[np.concatenate(codes)]
            inner = np.ones(len(flat) - 1, bool)
            inner[np.cumsum([len(c) for c in codes])[:-1] - 1] = False
            sums += np.bincount((flat[:-1] * CLUSTERS + flat[1:])[inner], minlength=CLUSTERS * CLUSTERS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"pair": some.astype("int32"), "n": sums[some]})

    rows = coded.select("_codes").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(CLUSTERS * CLUSTERS)
    pairs[rows["pair"].to_numpy(int)] = rows["n"].to_numpy()
    return cluster, pairs.reshape(CLUSTERS, CLUSTERS)


def begin(model: Model, cluster: np.ndarray, pairs: np.ndarray, states: int = STATES, seed: int = 1, tries: int = 4, rounds: int = 150) -> None:
    """Start, moves and emissions that explain the counts of neighbours best, by expectation-maximisation
    over the bounded table of clusters; a class shares its cluster's emissions by its own count."""
    rng, best, total = np.random.default_rng(seed), (-np.inf, None, None), max(pairs.sum(), 1.0)
    share = (pairs.sum(0) + pairs.sum(1) + 1) / (2 * total + CLUSTERS)
    for _ in range(tries):
        emit = share * rng.dirichlet(np.ones(CLUSTERS), states) * CLUSTERS
        emit /= emit.sum(1, keepdims=True)
        joint = np.full((states, states), 0.2 / states**2) + np.eye(states) * 0.8 / states
        for _ in range(rounds):
            odds = pairs / np.maximum(emit.T @ joint @ emit, 1e-300)
            left, right = odds @ (joint @ emit).T, odds.T @ (joint.T @ emit).T
            new = joint * (emit @ odds @ emit.T) + 1e-3
            emit = emit * (left + right).T + 0.01 * share
            emit /= emit.sum(1, keepdims=True)
            joint = new / new.sum()
        fit = float((pairs * np.log(np.maximum(emit.T @ joint @ emit, 1e-300))).sum())
        if fit > best[0]:
            best = fit, joint, emit
    _, joint, emit = best
    within = model.smoothed() / np.maximum(np.bincount(cluster, model.smoothed(), CLUSTERS), 1e-300)[cluster]
    model.start, model.move = joint.sum(1), joint / joint.sum(1, keepdims=True)
    model.emit = _leaning(emit.T[cluster] * within[:, None] * total, model)


def _leaning(counts: np.ndarray, model: Model) -> np.ndarray:
    out = counts + LEAN * model.smoothed()[:, None]
    return out / out.sum(0, keepdims=True)


def baum_welch(coded: DataFrame, model: Model) -> None:
    """One round over all encoded texts: expected counts of each partition are summed, then normalised."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start, move, by_class = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
        for codes in _sequences(b.column(0) for b in batches):
            for total, part in zip((start, move, by_class), _Steps(codes).counts(m), strict=True):
                total += part
        some = np.flatnonzero(by_class.any(axis=1))
        out = np.concatenate([start[None], move, by_class[some]])
        # rows below zero are the starts and the moves
        row = np.concatenate([[-1], -2 - np.arange(k), some]).astype("int32")
        yield pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, np.ascontiguousarray(out.T))], names=["row", *names])

    sums = coded.select("_codes").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    row, n = sums["row"].to_numpy(int), sums[names].to_numpy()
    counts = np.zeros_like(model.emit)
    counts[row[row >= 0]] = n[row >= 0]
    head = {r: x for r, x in zip(row, n, strict=True) if r < 0}
    start = head.get(-1, np.zeros(k)) + 1
    move = np.array([head.get(-2 - i, np.zeros(k)) + 1 for i in range(k)])
    model.start, model.move, model.emit = start / start.sum(), move / move.sum(1, keepdims=True), _leaning(counts, model)


def train(coded: DataFrame, model: Model, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """model with states, learnt from all encoded texts. Without any, every state is the same."""
    begin(model, *_neighbours(coded, model), states)
    for _ in range(rounds):
        baum_welch(coded, model)
    return model


def score(coded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """For each encoded row: id, the columns of keep, n_tokens, n_known, train_tokens, base_score, score.

    Words without a class of their own meet their counts over the corpus by a join, and come back as
    one sum of log10(count + 0.5) for each row."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    narrow = coded.drop("_words", "_times")
    passed = [c for c in narrow.columns if c != "_codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [_Steps(codes).likelihoods(shared.value) for codes in _sequences(iter([batch.column(0)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(like) if like else np.empty(0))], names=[*passed, "_like"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_codes")
    liked = narrow.select("_codes", *passed).mapInArrow(run, schema + ", _like double")
    rare = coded.select("_row", F.explode(F.arrays_zip(F.col("_words").alias("word"), F.col("_times").alias("times"))).alias("w")).select("_row", "w.word", "w.times")
    met = rare.join(counts.select("word", "n"), "word", "left")
    log_n = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    sums = met.groupBy("_row").agg(F.sum(F.col("times") * log_n).alias("_rare"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_seen"))
    out = liked.join(sums, "_row", "left")
    logs = F.col("_logs") + F.coalesce("_rare", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))
    return out.select(
        *passed[2 : passed.index("n_tokens") + 1],
        (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("_like") - F.col("_norm") + F.coalesce("_rare", F.lit(0.0))).alias("score"),
    )


def fit_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Scores of all rows by the model of those that pass learn (null does not).

    A null text is an empty one: the end alone. Rows with equal or null ids stay apart; columns other
    than the id, the text and keep are not read. An empty table gives an empty table."""
    counts = cut_lineage(count_words(docs.where(learn), text_col))
    model = vocabulary(counts)
    coded = encode(docs, model, learn, id_col, text_col, keep)
    return score(coded, train(coded.where("_learn"), model), counts)
