"""Models behind one interface: a batch of binary inputs in, a list of JSON results out.

A model is made once in each Python worker and sees Arrow batches. Real detectors, OCR and
chat models aren't part of this repository; ``MockModel`` gives fixed results for tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, Model] = {}
_known: dict[str, Callable[..., Model]] = {}


class Model:
    """Subclasses say what ``execute`` gives for each input; ``params`` are those of the call."""

    def execute(self, inputs: Sequence[bytes], params: dict) -> list[dict]:
        raise NotImplementedError


class MockModel(Model):
    """The size and a digest of each input."""

    def execute(self, inputs: Sequence[bytes], params: dict) -> list[dict]:
        return [{"bytes": len(x), "digest": hashlib.md5(x).hexdigest(), **params} for x in inputs]


def register(name: str, make: Callable[..., Model]) -> None:
    _known[name] = make


def create(name: str) -> Model:
    if name not in _known:
        raise KeyError(f"no model named {name}")
    if name not in _made:
        _made[name] = _known[name]()
    return _made[name]


register("mock", MockModel)


def apply(df: DataFrame, make: Callable[[], Model], content: str = "content", into: str = "result", params: dict | None = None, batch: int = 10) -> DataFrame:
    """Add ``into``, the model's result for each row as JSON; null inputs give null."""
    args = params or {}

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        model = make()
        inputs = column.to_pylist()
        some = [i for i, x in enumerate(inputs) if x is not None]
        out: list[str | None] = [None] * len(inputs)
        for at in range(0, len(some), batch):
            part = some[at : at + batch]
            for i, r in zip(part, model.execute([inputs[i] for i in part], args), strict=True):
                out[i] = json.dumps(r, sort_keys=True)
        return pa.array(out, pa.string())

    return df.withColumn(into, run(F.col(content)))


def as_function(spark: SparkSession, name: str, make: Callable[[], Model]) -> None:
    """Make a model callable from SQL under a name."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else json.dumps(make().execute([x], {})[0], sort_keys=True) for x in column.to_pylist()], pa.string())

    spark.udf.register(name, run)
