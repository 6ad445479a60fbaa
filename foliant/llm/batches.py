"""Arrow batches in Python workers: streaming of sorted groups, and text access."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """At most ``rows`` rows of ``df``, which has one for each value of ``keys``: those with the smallest hashes.

    The rows are counted first, and hashes far above the wanted share filtered out where they are
    read. So what meets in one task to be cut exactly is about the sample, however many tasks read.
    """
    h, bits = F.xxhash64(F.lit(17), *keys), 40
    total = df.count()
    if total > rows:
        share = 1.2 * rows / total + 200 / total
        df = df.where(F.pmod(h, F.lit(1 << bits)) < F.lit(int(share * (1 << bits)) + 1))
    return df.orderBy(F.pmod(h, F.lit(1 << bits)), *keys).limit(rows)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``.

    Each table holds one or more complete groups, so that small groups are handled together;
    only the group at the end of a batch is carried over.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k)
            same &= np.asarray(pc.equal(c[1:], c[:-1]).fill_null(False)) if batch.num_rows > 1 else same
        cuts = np.flatnonzero(~same) + 1
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(cuts):
            yield pa.Table.from_batches([*rest, batch.slice(0, int(cuts[-1]))])
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Start of each group in a table sorted by ``keys``, and the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
