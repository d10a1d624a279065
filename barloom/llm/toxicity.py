"""Toxicity by compression distance.

Two zstandard dictionaries are made, one from toxic and one from ordinary labelled text. A text is
cut into windows of words, each window is compressed with either dictionary, and the window on
which the toxic dictionary saves most bytes decides; what saving is toxic is calibrated on labelled
texts that the dictionaries have not seen.

Words go into the compressor as 16-byte codes. A word outside a dictionary then costs all its bytes
and one inside costs a match, so lengths tell known words apart and not how common their letters
are. Each dictionary holds the words that mark its class, and both hold the words common to both."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import fold, lower_words, sliced

WINDOW, LEVEL, CODE = 16, 3, 16
#: Bounds of the labelled sample that the dictionaries and the threshold are fitted on.
TOXIC_ROWS, ORDINARY_ROWS, LONGEST = 2_000, 6_000, 50_000
#: A word marks a class if its counts differ by this G statistic, and is common in this share of both.
MARK, COMMON = 20.0, 0.05
_EDGES = b".,;:!?\"()'*#$%&|<>-[]{}"


def terms(text: str | None) -> list[bytes]:
    """Words in lower case without the punctuation around them."""
    return [x for w in lower_words(text) if (x := w.strip(_EDGES))]


def windows(text: str | None) -> Iterator[bytes]:
    """The codes of each WINDOW words; one empty window if there are no words."""
    codes = [xxhash.xxh3_128_digest(w) for w in terms(text)]
    for at in range(0, max(1, len(codes)), WINDOW):
        yield b"".join(codes[at : at + WINDOW])


def _g(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """G statistic of a of na documents against b of nb."""
    total, n = a + b, na + nb
    out = np.zeros(len(a))
    for seen, expected in ((a, total * na / n), (b, total * nb / n), (na - a, (n - total) * na / n), (nb - b, (n - total) * nb / n)):
        out += seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))
    return 2 * out


def distinct_texts(texts: Iterable[str]) -> list[str]:
    """The texts without near copies: those that share one of three min-hashes with an earlier one.
    A text that was copied often would otherwise make its own words mark its class."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        found = terms(text)
        h = np.array([xxhash.xxh64_intdigest(b" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))], np.uint64)
        keys = {(k, int((h * np.uint64(odd)).min())) for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))}
        if not keys & seen:
            out.append(text)
        seen |= keys
    return out


@dataclass
class Model:
    """Dictionary contents, the saving at which the score is 0.5, and how steeply it rises there."""

    toxic: bytes
    ordinary: bytes
    threshold: float = 1.0
    slope: float = 1.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def savings(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text, the most bytes that the toxic dictionary saves over the ordinary one in a window."""
        plain, toxic = (c.compress for c in self.compressors())
        return np.array([max(len(plain(w)) - len(toxic(w)) for w in windows(t)) for t in texts], float)

    def score(self, saved: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (saved - self.threshold), -50, 50)))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionary contents from texts of either class; words nearest the end are the cheapest to match."""
    counts = [Counter(w for t in texts for w in set(terms(t))) for texts in (toxic, ordinary)]
    n = [max(1, len(toxic)), max(1, len(ordinary))]
    known = sorted(set(counts[0]) | set(counts[1]))
    a, b = (np.array([c[w] for w in known], float) for c in counts)
    g, side = _g(a, b, *n), a / n[0] - b / n[1]
    common = [w for w, x, y in zip(known, a / n[0], b / n[1], strict=True) if min(x, y) >= COMMON]
    marks = [[known[i] for i in np.flatnonzero((g >= MARK) & (s > 0))] for s in (side, -side)]
    shared, size = set(common), 1 + max(map(len, marks))
    contents = []
    for own in marks:
        own = [w for w in own if w not in shared]
        filler = bytes(CODE * (size - len(own)))  # words of both stand equally far back in either
        contents.append(filler + b"".join(map(xxhash.xxh3_128_digest, own + common)))
    return Model(*contents)


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """A model from labelled texts, in the order given: dictionaries from three of four distinct texts
    of each class, the threshold from the others. None if a class has no text."""
    by_class = [distinct_texts(t for t, y in zip(texts, toxic, strict=True) if y == k) for k in (0, 1)]
    if not all(by_class):
        return None
    learn, check = ([[t for i, t in enumerate(own) if (i % 4 != 3) == part] for own in by_class] for part in (True, False))
    model = dictionaries(learn[1], learn[0])
    ordinary, hit = (model.savings(own) if own else np.array([]) for own in check)
    # the threshold with the best balanced accuracy; of equals, the middle one. Savings are whole bytes.
    cuts = np.arange(1, CODE + 1) - 0.5
    right = [(np.mean(ordinary < c) if len(ordinary) else 1) + (np.mean(hit > c) if len(hit) else 1) for c in cuts]
    best = cuts[np.isclose(right, max(right))]
    model.threshold, model.slope = float(best[len(best) // 2]), 4.0 / CODE * 2
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, where: Column, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, longest: int = LONGEST) -> DataFrame:
    """(text, toxic): the labelled rows of docs that pass where and are least by a hash of the id, up to
    the bounds. An id with several labels is toxic if any says so; null labels and ids are left out,
    as are texts of over `longest` characters, from the sample alone."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where(where & (F.char_length("text") <= longest)).select("doc_id").join(known, "doc_id")
    drawn = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    chosen = drawn[0].union(drawn[1]).distinct()  # at most the bounds
    return docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(toxic_rows + ordinary_rows).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model | None:
    """The model of the labelled documents whose id has a crc32 fold other than 0 of 5 (or where)."""
    where = fold(F.col("doc_id"), 5) != 0 if where is None else where
    rows = labelled_sample(docs, labels, where).collect()
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1). A null text is empty and gets the score of no saving; without a
    model every score is 0. Every text is compressed whole, whatever its length. A column named toxicity is
    replaced; rows that repeat are scored alike; an empty table gives an empty table."""
    rows = docs.drop("toxicity")
    if model is None:
        return rows.withColumn("toxicity", F.lit(0.0))
    at = rows.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            found = model.score(model.savings(t.as_py() for t in batch.column(at)))
            yield batch.append_column("toxicity", pa.array(found, pa.float64()))

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("toxicity", T.DoubleType())]))
