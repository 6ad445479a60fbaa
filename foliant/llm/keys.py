"""Keys of documents where ids are null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import materialize


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc, doc_id, text, and whether ``doc`` is just the id.

    Where ids are null or repeat, ``doc`` is a number in the order of (id, digest of the text),
    nulls first: rows that repeat both share it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text"), True
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    names = rows.select(F.col("doc_id").alias("d"), digest.alias("s")).distinct().repartitionByRange("d", "s").sortWithinPartitions("d", "s")
    names = materialize(names.withColumn("doc", F.monotonically_increasing_id()))
    return rows.join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (digest == F.col("s"))).select("doc", "doc_id", "text"), False
