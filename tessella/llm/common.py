"""What the text operators share: pieces of Arrow batches, reads, hash draws, free names; durable tables from the engine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.durable import shared_dir, stash

__all__ = ["SPACE", "WORD", "batches_of", "free_names", "id_crc", "read", "shared_dir", "stash", "unit_hash"]

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
ROWS, BYTES = 256, 4 << 20  # of one piece of a batch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batches_of(batches: Iterable[pa.RecordBatch], text: int | str | None, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of at most so many rows and, in the text column, bytes; a longer text is a piece of its own.

    Spark bounds the batches themselves in rows and bytes; no setting of the session is touched.
    """
    for batch in batches:
        if text is None:
            ends = range(rows, batch.num_rows + rows, rows)
        else:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends, at = [], 0
            while at < batch.num_rows:
                base = upto[at - 1] if at else 0
                at = max(at + 1, min(at + rows, int(np.searchsorted(upto, base + size, "right"))))
                ends.append(at)
        at = 0
        for end in ends:
            if end > at and at < batch.num_rows:
                yield batch.slice(at, end - at)
            at = end


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where df has such a column already (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def unit_hash(*cols: Column) -> Column:
    """A draw from (0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
