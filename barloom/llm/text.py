"""What the corpus operators share: words, folds, table reading, block counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8. bytes.split() cuts at exactly the characters that WORD excludes."""
    return (text or "").encode("utf-8", "replace").split()


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z (only those) in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def n_blocks(docs: DataFrame, text_col: str = "text", block_bytes: int = 8 << 20) -> int:
    """How many blocks of about block_bytes of text each the table makes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: columns and compression that a checkpoint
    lacks, and like it there for every executor, whichever is lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes of that column: a worker then holds the results of one slice,
    whatever a batch has. A longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)
