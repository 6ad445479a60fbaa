"""Texts that repeat themselves, as models that run on do: periods, suffixes, lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPE = pa.struct([("unit_length", pa.int32()), ("times", pa.int32())])


def common_starts(s: str) -> list[int]:
    """For each place, how many characters from there equal the string's first ones; in linear time."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def suffix_unit(s: str, least: int, times: int) -> tuple[int, int] | None:
    """Length of the shortest unit of at least ``least`` characters that the text ends in ``times`` times
    or more, and how often it does; None without one."""
    back = common_starts(s[::-1])
    for u in range(least, len(s) // times + 1):
        if back[u] >= (times - 1) * u:
            return u, back[u] // u + 1
    return None


def repeated_suffixes(df: DataFrame, text: str = "text", least: int = 10, times: int = 10) -> DataFrame:
    """Add unit_length and times of each text's repeated suffix, null without one."""

    @F.arrow_udf("struct<unit_length:int,times:int>")
    def found(column: pa.Array) -> pa.Array:
        units = (suffix_unit(t.as_py() or "", least, times) for t in column)
        return pa.array([None if x is None else {"unit_length": x[0], "times": x[1]} for x in units], _TYPE)

    return df.withColumn("__u", found(text)).withColumns({"unit_length": F.col("__u")["unit_length"], "times": F.col("__u")["times"]}).drop("__u")


def truncated(df: DataFrame, text: str = "text", long: int = 3000, share: float = 0.5, least: int = 10, times: int = 10) -> DataFrame:
    """Long texts that mostly repeat one suffix keep it once; other texts stay as they are."""
    found = repeated_suffixes(df, text, least, times)
    whole = F.col("unit_length") * F.col("times")
    cut = (F.length(text) >= long) & (whole > share * F.length(text))
    kept = F.substring(F.col(text), F.lit(1), F.length(text) - whole + F.col("unit_length"))
    return found.withColumn(text, F.when(cut, kept).otherwise(F.col(text))).drop("unit_length", "times")
