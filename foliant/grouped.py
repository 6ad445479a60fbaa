"""Folds over the ordered rows of groups, on Arrow batches.

A window gives each row its place in its group. So a group's rows stand together, in order, and a
1 marks where it begins; where the rows are dealt by the group already, nothing is shuffled
again. Python sees whole batches: neither a call nor a frame is made for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: From a group's columns to places in it (or any place, for new rows) and further columns.
Fold = Callable[[Mapping[str, np.ndarray]], tuple[Sequence[int], Mapping[str, Sequence]]]

#: From columns of many groups that are as long as each other, a row of each array for a group, to which of
#: their rows stay, and further columns (by row and place).
Together = Callable[[Mapping[str, np.ndarray]], tuple[np.ndarray, Mapping[str, np.ndarray]]]

#: Longest groups that are folded together.
SHORT = 32
_PLACE = "__place"


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of complete groups, and where each group begins; the last group is carried over."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(_PLACE).to_numpy() == 1)
        if not len(starts):
            rest.append(batch)
            continue
        cut = int(starts[-1])
        whole = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
        rest = [batch.slice(cut)]
        yield from _with_starts(whole)
    if rest:
        yield from _with_starts(pa.Table.from_batches(rest).combine_chunks())


def _with_starts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in table.to_batches():
        yield batch, np.flatnonzero(batch.column(_PLACE).to_numpy() == 1)


def fold_groups(df: DataFrame, key: str, order: Sequence[str | Column], reads: Sequence[str], keeps: Sequence[str], fold: Fold, adds: Mapping[str, str], together: Together | None = None) -> DataFrame:
    """Columns ``keeps`` of the rows that ``fold`` names, with its columns ``adds`` (name: type).

    ``fold`` sees the columns ``reads`` of one group in ``order``. A null key is a group. ``together``, where
    it is given, does the same for a batch's groups of one length, up to ``SHORT`` rows.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(*order)).alias(_PLACE)
    used = list(dict.fromkeys([key, *keeps, *reads]))
    kinds = dict(df.dtypes)
    types = {n: to_arrow_type(_parse_datatype_string(t)) for n, t in adds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches):
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in reads}
            at: list[np.ndarray] = []
            more: dict[str, list] = {n: [] for n in adds}
            sizes = np.diff(starts, append=batch.num_rows)
            for n in np.unique(sizes[sizes <= SHORT]).tolist() if together else []:
                rows = starts[sizes == n][:, None] + np.arange(n)
                stay, values = together({c: v[rows] for c, v in columns.items()})
                at.append(rows[stay])
                for name in more:
                    more[name].extend(values[name][stay].tolist())
            single = sizes > SHORT if together else np.ones(len(starts), bool)
            for a, b in zip(starts[single].tolist(), (starts + sizes)[single].tolist(), strict=True):
                places, values = fold({c: v[a:b] for c, v in columns.items()})
                if len(places):
                    at.append(np.asarray(places, np.int64) + a)
                    for n in more:
                        more[n].extend(values[n])
            rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            out = [batch.column(c).take(rows) for c in keeps] + [pa.array(more[n], types[n]) for n in adds]
            yield pa.RecordBatch.from_arrays(out, [*keeps, *adds])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keeps), *(f"`{n}` {t}" for n, t in adds.items())])
    return df.select(*used, place).mapInArrow(run, schema)
