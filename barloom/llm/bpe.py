"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each match of the split pattern is merged on its own, so a text may be cut wherever a match
is sure to end; long texts go through the library in such pieces and memory stays bounded.
Decoding joins the bytes of the ids, so that ids which end inside a character decode exactly."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from barloom.llm.text import sliced

#: The characters that \s matches in the split pattern (Unicode White_Space). Fixed values.
_S = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where a match always ends: after anything else before white space, and before the last of
#: several white-space characters (it may join what follows; those before it never do).
_SAFE = re.compile(f"(?<=[^{_S}])(?=[{_S}])|(?<=[{_S}])(?=[{_S}][^{_S}])")


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in pieces of at least size characters that end at safe boundaries."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>, decoded binary) for each row of docs.

    path: the rank file, at the same place on every executor (it belongs to an installed package).
    A null text is empty: no ids, no bytes. Rows with equal or null ids stay rows of their own;
    other columns are not read. Very long texts are encoded whole, in pieces; a batch goes through in slices of a
    few MB of text. An empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in sliced(batches, 1):  # ids and bytes of one slice at a time
            offsets, parts, decoded = [0], [], []
            for text in batch.column(1):
                n, raw = offsets[-1], []
                for piece in pieces(text.as_py() or ""):
                    ids = enc.encode_to_numpy(piece, disallowed_special=())
                    raw.append(enc.decode_bytes(ids.tolist()))
                    parts.append(ids.astype(np.int32))
                    n += len(ids)
                offsets.append(n)
                decoded.append(b"".join(raw))
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
