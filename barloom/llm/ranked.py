"""Ranked lexical search over posting lists with range-maximum sparse tables.

The index is made in one pass without a shuffle: each task gathers its documents into segments of
bounded size and writes, for each segment, the list of every term (places of documents, occurrences)
and the documents' ids and lengths. A term in a third of all documents is many lists of one segment.

A search meets the lists of its terms segment by segment. Over each list stands a sparse table of
the largest impact in every run of 2 ** k postings. An interval of documents is bounded by the sum
of what the terms' tables answer for it; the interval with the best bound is split at the document
where its strongest term is largest, that document is scored, and what is left of it and right of
it are intervals again, until no bound reaches the score of the last place. Intervals with the best
bounds are worked on many at a time, so that the answers are array operations.

Documents of a segment stand in the order of their lengths: like lengths have like impacts, which
keeps sums of maxima close to real scores."""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import sliced
from barloom.session import ensure_checkpoint_dir

#: A segment ends at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 3 << 20
#: Terms of the items that are answered at a time, and intervals split at a time.
BLOCK_TERMS, FRONT = 1 << 17, 512
#: Groups in which the segments' answers are ranked before the answers of all.
GROUPS = 64
#: A-Z in lower case, other ASCII letters and digits and all other bytes as they are, the rest a space.
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z (only those) in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


@dataclass
class Index:
    """Where the segments are written: (segment, term, places, counts) for each list, and with a null term
    (segment, ids, counts: the lengths) for the documents. n_docs have a term; n_terms is the sum of lengths."""

    lists: DataFrame
    n_docs: int
    n_terms: int


class _Segment:
    """Documents gathered so far. Terms are numbered as they come, so each is held once."""

    def __init__(self) -> None:
        self.ids, self.number = [], {}
        self.lengths, self.sizes, self.codes, self.counts = array("i"), array("i"), array("i"), array("i")

    def add(self, doc: object, found: list[bytes]) -> None:
        counted, number = Counter(found), self.number
        self.ids.append(doc)
        self.lengths.append(len(found))
        self.sizes.append(len(counted))
        self.codes.extend([number.setdefault(t, len(number)) for t in counted])
        self.counts.extend(counted.values())

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.codes) >= SEGMENT_POSTINGS

    def rows(self, name: str, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each list, documents in the order of their lengths, and the row of the documents."""
        lengths, code, counts = (np.frombuffer(x, np.int32) for x in (self.lengths, self.codes, self.counts))
        order = np.argsort(lengths, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        at = np.repeat(place, np.frombuffer(self.sizes, np.int32))
        listed = np.argsort(code.astype(np.int64) * len(order) + at)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(code)), [len(code) + len(order)]]).astype(np.int32)
        lists = len(self.number)
        docs = pa.array([self.ids[i] for i in order], schema.field("ids").type.value_type)
        columns = [
            pa.array([name] * (lists + 1)),
            pa.array([*self.number, None], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.minimum(offsets, len(code))), pa.array(at[listed])),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([counts[listed], lengths[order]]))),
            pa.ListArray.from_arrays(pa.array([0] * (lists + 1) + [len(docs)], pa.int32()), docs),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every row of docs that has a term, written to the shared folder.

    A null text has no term. Rows with equal or null ids are documents of their own. Very long texts are one
    document with its distinct terms. Other columns are not read. An empty table gives an index without lists."""
    kind = docs.schema[id_col].dataType
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/segments-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held, schema = TaskContext.get().partitionId(), 0, _Segment(), None
        for batch in sliced(batches, 1):
            schema = schema or pa.schema([("segment", pa.string()), ("term", pa.binary()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(batch.schema.field(0).type))])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := terms(text.as_py()):
                    held.add(doc, found)
                if held.full():
                    yield held.rows(f"{task}-{done}", schema)
                    done, held = done + 1, _Segment()
        if held.ids:
            yield held.rows(f"{task}-{done}", schema)

    made = docs.select(id_col, text_col).mapInArrow(run, f"segment string, term binary, places array<int>, counts array<int>, ids array<{kind.simpleString()}>")
    made.write.parquet(path)
    lists = docs.sparkSession.read.parquet(path)
    length = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = lists.where("term IS NULL").agg(F.sum(F.size("counts").cast("long")), F.sum(length)).first()
    return Index(lists, n or 0, total or 0)


@dataclass
class Tables:
    """The lists of one segment one after another, and above them the place of the largest impact in each run of
    2 ** k postings. key: list number * documents + place, ascending."""

    key: np.ndarray
    impact: np.ndarray
    starts: np.ndarray
    n_docs: int
    levels: list[np.ndarray]

    @classmethod
    def of(cls, places: list[np.ndarray], impacts: list[np.ndarray], n_docs: int) -> Tables:
        sizes = np.array([len(p) for p in places], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        key = np.concatenate(places).astype(np.int64) + np.repeat(np.arange(len(sizes)) * n_docs, sizes)
        impact = np.concatenate(impacts)
        levels = [np.arange(len(key), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= sizes.max(initial=0):
            a, half = levels[-1], 1 << (len(levels) - 1)
            left, right = a[:-half], a[half:]
            levels.append(np.where(impact[left] >= impact[right], left, right))
        return cls(key, impact, starts, n_docs, levels)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each low < high, within one list, the posting of the largest impact; for others any posting."""
        size = np.maximum(1, high - low)
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(low.shape, np.int32)
        for k in np.unique(level[high > low]):
            at = np.nonzero((level == k) & (high > low))
            a, b = self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))]
            out[at] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out


def best(tables: Tables, lists: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores): all documents whose score is positive, at least floor, and not under the k-th best one.
    lists: numbers of the item's lists; weights: of their terms."""
    n, rank = tables.n_docs, np.zeros((len(lists), tables.n_docs + 1), np.int32)
    for row, one in zip(rank, lists, strict=True):
        own = slice(tables.starts[one], tables.starts[one + 1])
        row[1:][tables.key[own] - one * n] = 1
    np.cumsum(rank, axis=1, out=rank)
    rank += tables.starts[lists].astype(np.int32)[:, None]

    def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval, and the document where its strongest term is largest."""
        a, b = rank[:, low], rank[:, high]
        at = tables.largest(a, b)
        worth = np.where(b > a, tables.impact[at] * weights[:, None], 0)
        strongest = worth.argmax(0)
        split = tables.key[at[strongest, np.arange(len(low))]] - lists[strongest] * n
        return worth.sum(0), split

    low, high = np.array([0]), np.array([n])
    bound, split = bounded(low, high)
    places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    top, cut = np.zeros(0, np.int64), max(1, floor)
    while len(low):
        if len(low) > FRONT:
            chosen = np.argpartition(-bound, FRONT - 1)[:FRONT]
        else:
            chosen = np.arange(len(low))
        rest = np.ones(len(low), bool)
        rest[chosen] = False
        l, h, s = low[chosen], high[chosen], split[chosen]
        a = rank[:, s]
        holds = rank[:, s + 1] > a
        score = np.where(holds, tables.impact[np.where(holds, a, 0)] * weights[:, None], 0).sum(0)
        good = score >= cut
        places.append(s[good])
        scores.append(score[good])
        top = np.concatenate([top, score[good]])
        if len(top) >= k:
            top = np.partition(top, len(top) - k)[len(top) - k :]
            cut = max(cut, int(top[0]))
        new_low, new_high = np.concatenate([l, s + 1]), np.concatenate([s, h])
        wide = new_low < new_high
        new_low, new_high = new_low[wide], new_high[wide]
        new_bound, new_split = bounded(new_low, new_high)
        low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
        open_ = bound >= cut
        low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
    where, score = np.concatenate(places), np.concatenate(scores)
    keep = score >= cut
    return where[keep], score[keep]


def relative_length(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + (50 * length * n_docs) div n_terms."""
    if 50 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 50 + 50 * lengths.astype(np.int64) * n_docs // n_terms
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in lengths], np.int64)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, some at a time: as many as have BLOCK_TERMS terms, or one."""
    block, size = [], 0
    for row in items.select(item_col, text_col).distinct().toLocalIterator():
        own = sorted(set(terms(row[1])))
        if block and size + len(own) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        if own:
            block.append((row[0], own))
            size += len(own)
    if block:
        yield block


def _answering(asked: list[tuple[int, list[bytes]]], weight: dict[bytes, int], k: int, n_docs: int, n_terms: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Answers the items (number, terms) from the lists and documents of one segment."""

    def answer(segment: pd.DataFrame) -> pd.DataFrame:
        is_docs = segment["term"].isna().to_numpy()
        lengths = np.concatenate(list(segment["counts"][is_docs]))
        ids = [x for own in segment["ids"][is_docs] for x in own]
        share = 20 * relative_length(lengths, n_docs, n_terms)
        places, amounts = list(segment["places"][~is_docs]), list(segment["counts"][~is_docs])
        number = {bytes(t): i for i, t in enumerate(segment["term"][~is_docs])}
        out = []
        if number:
            impacts = [1_000_000_000 * c.astype(np.int64) // (1000 * c.astype(np.int64) + share[p]) for p, c in zip(places, amounts, strict=True)]
            tables = Tables.of(places, impacts, len(lengths))
            for q, own in asked:
                known = [t for t in own if t in number]
                if known:
                    where, score = best(tables, np.array([number[t] for t in known]), np.array([weight[t] for t in known], np.int64), k)
                    out += [(q, ids[p], s) for p, s in zip(where.tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    return answer


def search(index: Index, items: DataFrame, k: int, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(the item's id, rank, the document's id, score): the k best documents of each item, by score and then id
    (null ids last); documents without any of its terms are in none. Equal ranks do not occur.

    A term counts once in an item. An item without terms, or with terms that no document has, gives no row;
    items that are equal in id and text are answered once, items with equal ids and other texts each. Items
    come in blocks of bounded size, each against all segments, and a block's answers are written before the
    next one's. Documents that repeat take a rank each."""
    spark = items.sparkSession
    id_type, item_type = index.lists.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{item_col}` {item_type}, `rank` int, `{id_col}` {id_type}, score long"
    path = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    n_docs, n_terms = index.n_docs, index.n_terms
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(items, item_col, text_col):
        wanted = spark.createDataFrame([(t,) for t in sorted({t for _, own in block for t in own})], "term binary")  # BLOCK_TERMS at most
        lists = index.lists.join(F.broadcast(wanted), "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum(F.size("places").cast("long")).alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(q, [t for t in own if weight.get(t, 0) > 0]) for q, (_, own) in enumerate(block)]

        rows = lists.unionByName(index.lists.where("term IS NULL")).withColumn("ids", F.col("ids").cast("array<string>"))
        found = rows.groupBy("segment").applyInPandas(_answering(asked, weight, k, n_docs, n_terms), "q int, id string, score long").withColumn(id_col, F.col("id").cast(id_type))
        order = (F.col("score").desc(), F.col(id_col).asc_nulls_last())
        some = found.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(GROUPS))).withColumn("n", F.row_number().over(Window.partitionBy("q", "group").orderBy(*order))).where(F.col("n") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q int, `{item_col}` {item_type}")
        ranked.join(names, "q").select(item_col, "rank", id_col, "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
