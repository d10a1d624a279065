"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of WIDTH bytes that also starts earlier in the corpus. Suffixes
are sampled by content: in each window of WIDTH bytes the k-mer with the least hash is its anchor,
so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a
stretch, and the suffix array of a batch of documents lists its stretches by (anchor, digest).

The array is dealt out in shards by anchor. In each shard the batches come in one by one: a new
array is merge-scanned against every level of the family, then joins it as a level of its own, and
levels of equal size merge into one of twice the size, so an entry is merged a logarithmic number of
times. A scan finds
  - stretches equal as a whole to an earlier one: all their windows repeat;
  - anchors with stretches that differ (passages end there). These are cut into pieces of up to PIECE
    windows, at fixed places from the anchor, for a second family: all windows of a piece share its
    core, the anchor of that family. Only pieces whose core has others that differ list their
    windows one by one, for a third family that is keyed by the digest of the window.
Each sees every window that occurs twice, so the result is exact (up to 128-bit digests).

Only the first of equal entries leaves a batch, and an anchor with several digests leaves it once, so
a passage in a third of all documents is one entry for each batch, not one for each copy. Batches
are blocks of documents by hash of the id; all four steps read the same shuffled blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import n_blocks

WIDTH, KMER = 100, 24
_SPAN = WIDTH - KMER + 1
#: Windows of a piece: their starts lie 0 to 15, 16 to 31, ... bytes before the anchor.
PIECE = 16
#: A chunk's positions take the lower bits of the numbers that anchors are chosen by.
_BITS = 20
_CHUNK = 1 << _BITS
_LOWEST = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width numbers, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _kmers(data: bytes) -> np.ndarray:
    """A 64-bit hash of the KMER bytes from each position."""
    n = len(data) - KMER + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        x = word[:n] * _ODD[0] ^ (word[8 : n + 8] * _ODD[1] + _ODD[3])
        x = (x ^ (x >> np.uint64(31))) * _ODD[3] ^ word[16 : n + 16] * _ODD[2]
        x ^= x >> np.uint64(29)
        x *= _ODD[0]
        return x ^ (x >> np.uint64(32))


@dataclass
class Stretches:
    """Runs of windows with one anchor, in order: document, first and last window start in it, place
    of the anchor, its hash, and the digest of all bytes of the windows."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    a: np.ndarray
    b: np.ndarray


def stretches(texts: list[bytes]) -> Stretches:
    """All windows of the texts. A text beyond a chunk is cut into pieces that overlap by a window; a
    stretch that is cut with it differs from its uncut copies, and is then settled window by window."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    held: list[tuple[int, int, bytes]] = []  # document, offset of the piece, piece
    size = 0

    def flush() -> None:
        data = b"".join(piece for _, _, piece in held)
        if not data:
            return
        lengths = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(lengths) - lengths
        x = _kmers(data)
        least = _least((x >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(x), dtype=np.uint64), _SPAN)
        piece = np.repeat(np.arange(len(held)), lengths - WIDTH + 1)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(lengths - WIDTH + 1) - (lengths - WIDTH + 1), lengths - WIDTH + 1) + begin[piece]
        at = (least[start] & np.uint64(_CHUNK - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
        end = np.concatenate([new[1:], [len(piece)]]) - 1
        a, b, own = start[new], start[end], piece[new]
        digest = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(a.tolist(), (b + WIDTH).tolist(), strict=True)), np.uint64, len(a))
        shift = np.array([offset for _, offset, _ in held])[own] - begin[own]
        for column, values in zip(out, (np.array([d for d, _, _ in held])[own], a + shift, b + shift, at[new] + shift, x[at[new]], digest), strict=True):
            column.append(values)

    for i, text in enumerate(texts):
        for offset in range(0, len(text) - WIDTH + 1, _CHUNK - WIDTH):
            piece = text[offset : offset + _CHUNK - 1]
            if len(piece) < WIDTH:
                break
            if size + len(piece) >= _CHUNK:
                flush()
                held, size = [], 0
            held.append((i, offset, piece))
            size += len(piece)
            if offset + len(piece) == len(text):
                break
    flush()
    return Stretches(*(np.concatenate(c) if c else np.array([], np.uint64 if k > 3 else np.int64) for k, c in enumerate(out)))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, the last of them first to vary; True where a new group of the first two starts)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
    return order, new


class Entries:
    """What a batch lists in a family: anchors (a) and digests (b) in order of place.

    copy: equal to an earlier one here. mixed: first of its digest, at an anchor that has several."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        by, new = _groups(a, b, np.arange(len(a)))
        self.copy = np.ones(len(a), bool)
        self.copy[by[new]] = False
        firsts = by[new]
        anchors, inverse, times = np.unique(a[firsts], return_inverse=True, return_counts=True)
        self.mixed = np.zeros(len(a), bool)
        self.mixed[firsts[times[inverse] > 1]] = True
        self.marks = anchors[times > 1]

    def sent(self, order: np.ndarray) -> dict[str, np.ndarray]:
        """One entry per digest where the anchor has one, and a mark for each anchor that has several."""
        k, marks = np.flatnonzero(~self.copy & ~self.mixed), self.marks
        return {
            "a": np.concatenate([self.a[k], marks]),
            "b": np.concatenate([self.b[k], np.zeros(len(marks), np.uint64)]),
            "order": np.concatenate([order[k], np.zeros(len(marks), np.int64)]),
            "at": np.concatenate([k, np.full(len(marks), -1)]).astype(np.int32),
        }


class Block:
    """The documents of a batch in order of (id, text), and the entries that they list."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["order", "text"], ignore_index=True)
        self.order, self.texts = rows["order"].to_numpy(), list(rows["text"])
        self.st = stretches(self.texts)
        self.stretches = Entries(self.st.a, self.st.b)

    def _digest(self, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        texts = self.texts
        parts = zip(doc.tolist(), begin.tolist(), end.tolist(), seed.tolist(), strict=True)
        return np.fromiter((xxhash.xxh3_64_intdigest(texts[d][i:j], s) for d, i, j, s in parts), np.uint64, len(doc))

    def list_pieces(self, mixed: np.ndarray) -> None:
        """Pieces of the stretches whose anchor has several: those known here and those reported."""
        st, k = self.st, np.flatnonzero(self.stretches.mixed | mixed)
        near, far = (st.place[k] - st.last[k]) // PIECE, (st.place[k] - st.first[k]) // PIECE
        n = far - near + 1
        own = np.repeat(k, n)
        which = np.repeat(far, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        close = st.place[own] - which * PIECE  # the start nearest to the anchor
        self.doc, self.first, self.last = st.doc[own], np.maximum(st.first[own], close - PIECE + 1), np.minimum(st.last[own], close)
        core = self._digest(self.doc, close, close - PIECE + 1 + WIDTH, which)
        self.pieces = Entries(core, self._digest(self.doc, self.first, self.last + WIDTH, st.place[own] - self.first))

    def list_windows(self, mixed: np.ndarray) -> None:
        """Every window of the pieces whose core has several."""
        k = np.flatnonzero(self.pieces.mixed | mixed)
        n = self.last[k] - self.first[k] + 1
        self.window_doc = np.repeat(self.doc[k], n)
        self.start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        raw = b"".join(xxhash.xxh3_128_digest(self.texts[d][p : p + WIDTH]) for d, p in zip(self.window_doc.tolist(), self.start.tolist(), strict=True))
        self.windows = Entries(*np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2).T)


class Family:
    """Levels of entries (a, b, order, block, at) sorted by (a, b), at most one of each size class."""

    def __init__(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, block: np.ndarray, at: np.ndarray):
        self.a, self.b, self.order, self.block, self.at = a, b, order, block, at
        self.copy, self.mixed = np.zeros(len(a), bool), np.zeros(len(a), bool)
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> None:
        """Takes in the entries numbered in batch: scan all levels, then merge those of equal size."""
        run = batch[np.lexsort((self.b[batch], self.a[batch]))]
        for level in self.levels:
            self._scan(run, level)
        while self.levels and len(self.levels[-1]).bit_length() <= len(run).bit_length():
            both = np.concatenate([self.levels.pop(), run])
            both = both[~self.copy[both]]
            run = both[np.lexsort((self.b[both], self.a[both]))]
        self.levels.append(run)

    def _scan(self, run: np.ndarray, level: np.ndarray) -> None:
        """Marks what of the two is equal to an earlier entry, and anchors (a) with several digests (b)."""
        if not len(run) or not len(level):
            return
        a, b = self.a[run], self.a[level]
        spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
        back = np.minimum(np.searchsorted(a, b), len(a) - 1)
        met = np.concatenate([run[b[spot] == a], level[a[back] == b]])
        marks = self.at[met] < 0
        by, new = _groups(self.a[met], self.b[met], marks, self.order[met], self.block[met], self.at[met])
        met, marks = met[by], marks[by]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        later = ~new & ~marks
        self.copy[met[later]] = True
        anchor = np.cumsum(np.concatenate([[True], self.a[met][1:] != self.a[met][:-1]])) - 1 if len(met) else group
        several = np.bincount(anchor[first], minlength=1) > 1
        several |= np.bincount(anchor, marks, len(several)) > 0
        self.mixed[met[several[anchor]]] = True


def _packed(block: int, shards: int, entries: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row for each shard that gets entries: their columns as bytes."""
    shard = (entries["a"] % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    ids, cuts = np.unique(shard[by], return_index=True)
    parts = np.split(by, cuts[1:]) if len(ids) else []
    columns = {c: [v[p].tobytes() for p in parts] for c, v in entries.items()}
    return pd.DataFrame({"shard": ids.astype("int32"), "block": np.full(len(ids), block, "int32"), **columns})


_ENTRY = "shard int, block int, a binary, b binary, order binary, at binary"
_REPLY = "block int, kind string, copy binary, mixed binary"


def _answer(kind: str):
    """The shard's part of a family: builds it batch by batch, and answers each block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        column = {c: [np.frombuffer(x, t) for x in rows[c]] for c, t in (("a", np.uint64), ("b", np.uint64), ("order", np.int64), ("at", np.int32))}
        sizes = [len(x) for x in column["a"]]
        family = Family(*(np.concatenate(column[c]) for c in ("a", "b", "order")), np.repeat(rows["block"].to_numpy(), sizes), np.concatenate(column["at"]))
        parts = np.split(np.arange(sum(sizes)), np.cumsum(sizes)[:-1])
        for part in parts:
            family.add(part)
        out = []
        for block, part in zip(rows["block"], parts, strict=True):
            own = part[family.at[part] >= 0]
            copy, mixed = own[family.copy[own]], own[family.mixed[own] & ~family.copy[own]]
            if len(copy) or len(mixed):
                out.append((block, kind, family.at[copy].tobytes(), family.at[mixed].tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "copy", "mixed"])

    return run


def _marked(replies: pd.DataFrame, kind: str, column: str, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for x in replies.loc[replies["kind"] == kind, column]:
        out[np.frombuffer(x, np.int32)] = True
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """For each row: id, n_bytes, spans (array of start and end, maximal and in order), kept (binary).

    Earlier is a smaller id (null least), then a smaller text among rows of one id, then a smaller
    start; of rows equal in both, one counts as first. A null text has no bytes; texts of fewer than
    WIDTH bytes stay whole. Spans are judged on the input and may overlap in what made them."""
    blocks = n_blocks(docs, text_col, block_bytes)
    shards = 1 + blocks // 8
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    dealt = docs.select(order.alias("order"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("order"), F.lit(blocks)).cast("int"))

    def listed(rows: pd.DataFrame, replies: pd.DataFrame, kinds: int) -> Block:
        """The block with the entries of as many families as kinds."""
        block = Block(rows)
        if kinds > 1:
            block.list_pieces(_marked(replies, "stretch", "mixed", len(block.st.doc)))
        if kinds > 2:
            block.list_windows(_marked(replies, "piece", "mixed", len(block.doc)))
        return block

    def send_stretches(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows)
        return _packed(int(rows["block"].iloc[0]), shards, block.stretches.sent(block.order[block.st.doc]))

    def send_pieces(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = listed(rows, replies, 2)
        return _packed(int(rows["block"].iloc[0]), shards, block.pieces.sent(block.order[block.doc]))

    def send_windows(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = listed(rows, replies, 3)
        return _packed(int(rows["block"].iloc[0]), shards, block.windows.sent(block.order[block.window_doc]))

    def cut(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = listed(rows, replies, 3)
        length = np.array([len(t) for t in block.texts])
        begin = np.cumsum(length) - length
        change = np.zeros(length.sum() + 1, np.int32)
        for kind, own, doc, first, last in (("stretch", block.stretches, block.st.doc, block.st.first, block.st.last), ("piece", block.pieces, block.doc, block.first, block.last), ("window", block.windows, block.window_doc, block.start, block.start)):
            k = own.copy | _marked(replies, kind, "copy", len(doc))
            np.add.at(change, begin[doc[k]] + first[k], 1)
            np.add.at(change, begin[doc[k]] + last[k] + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for text, own, at in zip(block.texts, block.order, begin, strict=True):
            here = np.zeros(len(text) + 2, np.int8)
            here[1:-1] = gone[at : at + len(text)]
            edges = np.flatnonzero(np.diff(here)).reshape(-1, 2).tolist()
            stops = [0, *(x for e in edges for x in e), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True))
            out.append((own, len(text), [{"start": a, "end": b} for a, b in edges], kept))
        return pd.DataFrame(out, columns=["order", "n_bytes", "spans", "kept"])

    by_block = dealt.groupBy("block")

    def answers(entries: DataFrame, kind: str) -> DataFrame:
        return entries.groupBy("shard").applyInPandas(_answer(kind), _REPLY).repartition("block")

    def beside(replies: DataFrame, step, schema: str) -> DataFrame:
        """step on each block with the replies to it. A reply has a block, so only replies can lack."""
        return by_block.cogroup(replies.groupBy("block")).applyInPandas(step, schema)

    replies = answers(by_block.applyInPandas(send_stretches, _ENTRY), "stretch")
    replies = replies.union(answers(beside(replies, send_pieces, _ENTRY), "piece"))
    replies = replies.union(answers(beside(replies, send_windows, _ENTRY), "window"))
    out = beside(replies, cut, "order long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    doc_id = F.when(F.col("order") != _LOWEST, F.col("order")).cast(docs.schema[id_col].dataType)
    return out.select(doc_id.alias(id_col), "n_bytes", "spans", "kept")
