"""Quality classifier: boosted trees over statistics of the whole text.

Fitting reads at most ``sample_rows`` labelled rows, those with the smallest hash of their id;
only their statistics reach the driver. Scoring reads every row once, without a shuffle.
Null texts count as empty. Labels that are null are left out; a document with several labels
counts as good if one of them is, and of rows that repeat an id one is learnt from. Without labels
of both kinds all scores are equal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import bounded_sample
from foliant.llm.trees import Forest, fit

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 20_000
_STATS = 26

_byte = np.arange(256)
_CLASSES = np.stack([
    (_byte >= 65) & (_byte <= 90),
    (_byte >= 97) & (_byte <= 122),
    (_byte >= 48) & (_byte <= 57),
    np.isin(_byte, [9, 11, 12, 13, 32]),
    _byte == 10,
    np.isin(_byte, list(b".,;:?'\"()-")),
    np.isin(_byte, list(b"!")),
    np.isin(_byte, list(b"#$%&*@^~=+")),
    np.isin(_byte, list(b"|<>{}[]\\/_`")),
    _byte >= 128,
]).astype(np.float64)


def statistics(text: str) -> list[float]:
    """Statistics of one text: sizes, kinds of characters, words, lines and repetition."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data) or 1
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (_CLASSES @ histogram) / n
    p = histogram[histogram > 0] / n
    words = data.split()
    count = len(words) or 1
    counts = Counter(words)
    top = counts.most_common(3)
    letters = sum(map(len, words)) / count
    lines = [x for x in data.split(b"\n") if x]
    line_counts = Counter(lines)
    last = Counter(w[-1:] for w in words)
    symbol_ends = sum(v for c, v in last.items() if c in b"!#$%&*|" and c) / count
    stop_ends = sum(v for c, v in last.items() if c in b".,;:?" and c) / count
    single = sum(1 for w in words if len(w) == 1) / count
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), *shares.tolist(),
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
        letters, len(counts) / count, top[0][1] / count if top else 0.0, sum(v for _, v in top) / count,
        symbol_ends, stop_ends, single,
        len(lines) / count, len(line_counts) / (len(lines) or 1), max(line_counts.values(), default=0) / (len(lines) or 1),
        sum(len(x) * (v - 1) for x, v in line_counts.items()) / n, max(map(len, words), default=0) / n,
    ]


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, by a checksum of the id; never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py() or "") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "stats"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on ``docs`` that have a ``label`` and aren't held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = bounded_sample(known, sample_rows, ["doc_id"])
    # sample_rows bounds the side that is broadcast and, a row for each id, what is collected
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = texts.select("doc_id", "label", "text").mapInArrow(_stats, "doc_id long, label int, stats array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("label", "stats")).alias("x")).select("x.*").toPandas()
    if not len(found):
        return fit(np.zeros((0, _STATS)), np.zeros(0))
    x, y = np.stack(found["stats"].to_numpy()), found["label"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])  # rows come in any order; a fit adds in one
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, into: str = "score") -> DataFrame:
    """Add ``into``, the probability that a text is good; a column of that name is replaced."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        return pa.array(forest.score(np.array([statistics(t.as_py() or "") for t in column])))

    return docs.withColumn(into, scored("text"))
