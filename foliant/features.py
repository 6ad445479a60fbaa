"""Named plug-ins: transforms of a DataFrame that a parse applies by name."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import key_value

Feature = Callable[[DataFrame], DataFrame]
_features: dict[str, Feature] = {}


def register(name: str) -> Callable[[Feature], Feature]:
    def add(f: Feature) -> Feature:
        _features[name] = f
        return f

    return add


def apply(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Apply features in order; an unknown name is a warning."""
    for name in names:
        if name in _features:
            df = df.transform(_features[name])
        else:
            warnings.warn(f"no feature named {name}", stacklevel=2)
    return df


@register("kv")
def key_values(lines: DataFrame) -> DataFrame:
    """Add ``kv`` (key, value) to lines with a label; at least two in a document make a region."""
    from pyspark.sql import Window as W

    kv = key_value(F.col("text"))
    n = F.count(kv).over(W.partitionBy("doc_id"))
    return lines.withColumn("kv", F.when(n >= 2, kv))


@register("drop_other")
def drop_other(objects: DataFrame) -> DataFrame:
    return objects.where(F.coalesce(F.col("type") != "other_text", F.lit(True)))
