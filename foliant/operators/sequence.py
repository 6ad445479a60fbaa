"""Ordered operators by group: runs, blocks, chains, clusters, gaps, merged intervals, splits.

All are windows partitioned by a group (a document, a page); where a group is a document, its
rows are as many as its lines, and skew is that of document lengths.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], starts: Column, into: str = "island") -> DataFrame:
    """Number the stretches of rows (from 1) that begin where ``starts`` holds."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("__s", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(into, F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], style: Column, into: str = "run") -> DataFrame:
    """Number the stretches of equal ``style``."""
    w = W.partitionBy(*group).orderBy(*order)
    named = df.withColumn("__v", style)
    first = F.row_number().over(w) == 1
    marked = named.withColumn("__n", first | ~F.col("__v").eqNullSafe(F.lag("__v").over(w)))
    return islands(marked, group, order, F.col("__n"), into).drop("__v", "__n")


def line_blocks(lines: DataFrame, group: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Add ``block``: a line opens one where the gap above it exceeds so many heights of the line before."""
    order = [F.desc("y1"), F.col("x0"), F.col("line_no")]
    w = W.partitionBy(*group).orderBy(*order)
    gap, h = F.lag("y0").over(w) - F.col("y1"), F.lag("y1").over(w) - F.lag("y0").over(w)
    return islands(lines.withColumn("__n", gap > h * factor), group, order, F.col("__n"), "block").drop("__n")


def cluster_by_last(df: DataFrame, group: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """group, cluster, n, mean of values each within a tolerance of the one before."""
    w = W.partitionBy(*group).orderBy(value)
    marked = df.withColumn("__n", F.col(value) - F.lag(value).over(w) > tolerance)
    return islands(marked, group, [value], F.col("__n"), "cluster").groupBy(*group, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def cluster_by_first(df: DataFrame, group: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """group and clusters (array of arrays): values within a tolerance of their cluster's first.

    Not gaps and islands: each value depends on where its cluster began, so a fold over the
    sorted values of the group decides.
    """
    start = F.array().cast("array<array<double>>")
    def step(done, v):
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (v - last[0] <= tolerance)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(v))))).otherwise(F.concat(done, F.array(F.array(v))))
    values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    return df.groupBy(*group).agg(values.alias("__v")).select(*group, F.aggregate("__v", start, lambda a, v: F.when(F.size(a) > 0, step(a, v)).otherwise(F.array(F.array(v)))).alias("clusters"))


def merge_intervals(df: DataFrame, group: Sequence[str], lo: str, hi: str, gap: float = 0) -> DataFrame:
    """group, island, n, lo, hi: intervals joined where the next begins within ``gap`` of the end so far."""
    w = W.partitionBy(*group).orderBy(lo, hi)
    end = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__n", F.col(lo) > end + gap)
    return islands(marked, group, [lo, hi], F.col("__n")).groupBy(*group, "island").agg(F.count("*").alias("n"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def gaps(df: DataFrame, group: Sequence[str], lo: str, hi: str, least: float = 3) -> DataFrame:
    """group, gap_start, gap_end: empty stretches between intervals, at least so wide."""
    merged = merge_intervals(df, group, lo, hi)
    after = F.lead("lo").over(W.partitionBy(*group).orderBy("island"))
    return merged.select(*group, F.col("hi").alias("gap_start"), after.alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= least)


def subtract_intervals(whole: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """What is left of one interval (lo, hi) of each group without the intervals of ``parts``."""
    w = whole.select(*group, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    inside = parts.join(w, list(group)).select(*group, F.greatest("lo", "__lo").alias("lo"), F.least("hi", "__hi").alias("hi")).where("lo < hi")
    ends = w.select(*group, F.col("__lo").alias("lo"), F.col("__lo").alias("hi")).unionByName(w.select(*group, F.col("__hi").alias("lo"), F.col("__hi").alias("hi")))
    return gaps(inside.unionByName(ends), group, "lo", "hi", 1e-12)


def widest_gap(df: DataFrame, group: Sequence[str], lo: str, hi: str, least: float = 6) -> DataFrame:
    """group, gap_start, gap_end of the widest gap, the leftmost of equals."""
    g = gaps(df, group, lo, hi, least)
    key = F.struct((F.col("gap_end") - F.col("gap_start")).alias("w"), (-F.col("gap_start")).alias("s"))
    return g.groupBy(*group).agg(F.max_by(F.struct("gap_start", "gap_end"), key).alias("g")).select(*group, "g.*")


def chains(df: DataFrame, group: Sequence[str], order: Sequence[str], joins: Column, into: str = "chain") -> DataFrame:
    """Number chains of rows; a row joins its predecessor where ``joins`` holds."""
    return islands(df, group, order, ~F.coalesce(joins, F.lit(False)), into)


def continuity(lines: DataFrame, page_width: int) -> DataFrame:
    """Add ``score``, how far a line goes on from the one before it on its document.

    A full line before +2, else -3; equal starts +2; equal heights +1; no full stop before +1,
    else -2; an indented line -2. ``joins`` tells whether 6 is reached with the scene's 0 or 2.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    before = F.lag(F.struct("x0", "y0", "x1", "y1", "text", "page_no")).over(w)
    full = before["x1"] >= 0.9 * page_width
    scene = F.when(before["page_no"] == F.col("page_no"), 0).when(before["page_no"] + 1 == F.col("page_no"), 2)
    score = (
        scene
        + F.when(full, 2).otherwise(-3)
        + F.when(F.abs(before["x0"] - F.col("x0")) <= 5, 2).otherwise(0)
        + F.when(before["y1"] - before["y0"] == F.col("y1") - F.col("y0"), 1).otherwise(0)
        + F.when(before["text"].rlike(r"[.!?;:]$"), -2).otherwise(1)
        + F.when(F.col("text").rlike(r"^\s{2,}"), -2).otherwise(0)
    )
    return lines.withColumn("score", score).withColumn("joins", F.coalesce(F.col("score") >= F.when(scene == 2, 7).otherwise(6), F.lit(False)))


def merge_scene(a_page: Column, b_page: Column, same_section: Column, a_column: Column, b_column: Column, columns: Column, first_page: Column, narrow: Column) -> Column:
    """How two texts that follow each other stand: same_column or next_column of a page, page_same_column or
    page_next_column over a page break; null for others, for first pages and for narrow texts. (WIN-09)"""
    here, next_ = a_page == b_page, a_page + 1 == b_page
    turned = (a_column + 1 == columns) & (b_column == 0)
    return F.when(
        same_section & a_column.isNotNull() & b_column.isNotNull(),
        F.when(here & ~first_page & ~narrow, F.when(a_column == b_column, "same_column").when(a_column + 1 == b_column, "next_column"))
        .when(next_ & (a_column == 0) & (b_column == 0) & (columns == 1), "page_same_column")
        .when(next_ & turned, "page_next_column"),
    )


def continuity_score(scene: Column, full: Column, aligned: Column, alike: Column, stop: Column, indent_a: Column, indent_b: Column) -> Column:
    """How far a text goes on in the next one, by what is known of their ends. (WIN-07)"""
    yes = lambda c, a, b=0: F.when(c, a).otherwise(b)
    over_page = scene == "page_next_column"
    return yes(scene != "same_column", 2) + yes(full, 2, -3) + yes(aligned, 2) + yes(alike, 1) + yes(stop, -2, 1) + yes(indent_b, -2) + yes(indent_a & indent_b, -2) + yes(over_page, 1)


def goes_on(scene: Column, score: Column) -> Column:
    """Whether a score reaches its scene's threshold. (WIN-08)"""
    return F.coalesce(score >= F.when(scene == "page_next_column", 7).otherwise(6), F.lit(False)) & scene.isNotNull()


def balanced_split(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], parts: int, into: str = "part") -> DataFrame:
    """Number ``parts`` shares of each group whose sizes differ by one at most."""
    return df.withColumn(into, F.ntile(parts).over(W.partitionBy(*group).orderBy(*order)))


def seeded_split(df: DataFrame, group: Sequence[str], key: str, ratio: float, seed: int) -> DataFrame:
    """Add ``validation`` for an exact share of each group (1 at least, and not all), drawn by a hash."""
    w = W.partitionBy(*group)
    n = F.count("*").over(w)
    take = F.least(F.greatest(F.bround(n * ratio), F.lit(1)), n - 1)
    return df.withColumn("validation", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)) <= take)


def head_tail_sample(df: DataFrame, group: Sequence[str], order: Sequence[str], limit: int, head: int, tail: int) -> DataFrame:
    """At most ``limit`` rows of each group: first, last, and evenly spaced ones between."""
    w = W.partitionBy(*group)
    rows = df.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    middle = limit - head - tail
    inner = F.col("__n") - head - tail
    at = F.col("__i") - head
    spaced = F.floor((at + 1) * middle / inner) > F.floor(at * middle / inner)
    keep = (F.col("__n") <= limit) | (F.col("__i") < head) | (F.col("__i") >= F.col("__n") - tail) | spaced
    return rows.where(keep).drop("__n", "__i")


def admit(waiting: DataFrame, caps: dict[int, int], capacity: int) -> DataFrame:
    """The tasks that may start: first come first served within each priority's cap, then the capacity.

    Rows have priority, arrival and id. Each priority's first rows are kept in every task and merged,
    so no task sorts all rows of a priority. (SRT-16)
    """
    parts = [waiting.where(F.col("priority") == p).orderBy("arrival", "id").limit(n) for p, n in caps.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("arrival", "id").limit(capacity)


def fair_share(running: DataFrame, capacity: int) -> DataFrame:
    """job, item, admitted: of each job's items in order, as many as an even share of the capacity, rounded
    up, are in flight. (STM-01, STM-02)"""
    share = -(-capacity // max(1, running.select("job").distinct().count()))
    n = F.row_number().over(W.partitionBy("job").orderBy("at", "item"))
    return running.select("job", "item", (n <= share).alias("admitted"))


def siblings(df: DataFrame, parent: str, order: str, key: str) -> DataFrame:
    """Add prev_id and next_id among the children of a parent."""
    w = W.partitionBy(parent).orderBy(order)
    return df.withColumns({"prev_id": F.lag(key).over(w), "next_id": F.lead(key).over(w)})


def distinct_in_order(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """The first row of each value of a group."""
    n = F.row_number().over(W.partitionBy(*group, value).orderBy(order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def multiset_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)
