"""Figures about pages and documents, their symptoms, and repeated content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import content_length


def page_quality(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, objects, chars, texts and empty, of lines with a text."""
    n = content_length(F.col("text"))
    return lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("objects"), F.sum(n).alias("chars"), F.count_if(n > 0).alias("texts")).withColumn("empty", F.col("chars") == 0)


def document_quality(pages: DataFrame) -> DataFrame:
    """doc_id, pages, empty_pages, objects, chars and avg_chars (a page)."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("empty").alias("empty_pages"), F.sum("objects").alias("objects"), F.sum("chars").alias("chars"))
    return out.withColumn("avg_chars", F.round(F.col("chars") / F.col("pages"), 2))


def symptoms(docs: DataFrame) -> DataFrame:
    """doc_id, symptom: a row for each threshold that a document's figures pass."""
    found = [
        ("empty_pages", F.col("empty_pages") / F.col("pages") >= 0.3),
        ("few_chars", F.col("avg_chars") < 80),
        ("no_objects", F.col("objects") == 0),
        ("no_text", F.col("chars") < 200),
    ]
    named = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in found]))
    return docs.select("doc_id", F.explode(named).alias("symptom"))


def repeated_lines(lines: DataFrame, times: int = 3) -> DataFrame:
    """doc_id, lines, most (how often its most common line comes), of documents where that is often."""
    per = lines.where(F.length("text") > 0).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.max("n").alias("most")).where(F.col("most") >= times)


def dominant_line(text: Column, share: float = 0.8, times: int = 3) -> Column:
    """A text whose lines are mostly one line becomes that line; without a shuffle.

    The lines are sorted and their runs counted in one pass; of equally common ones the largest counts.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("at"), F.lit(0).alias("run"), F.lit(0).alias("n"), none.alias("line"))

    def count(a: Column, x: Column) -> Column:
        run = F.when(a["at"].eqNullSafe(x), a["run"] + 1).otherwise(1)
        more = run >= a["n"]
        return F.struct(x.alias("at"), run.alias("run"), F.when(more, run).otherwise(a["n"]).alias("n"), F.when(more, x).otherwise(a["line"]).alias("line"))

    return F.aggregate(F.array_sort(lines), start, count, lambda a: F.when((a["n"] >= times) & (a["n"] >= share * F.size(lines)), a["line"]).otherwise(text))


def rule_score(issues: DataFrame, penalties: dict[str, int]) -> DataFrame:
    """doc_id, score: 100 less each kind of issue's penalty once, not below 0."""
    cost = F.create_map(*[F.lit(v) for kv in penalties.items() for v in kv])
    per = issues.select("doc_id", "issue").distinct()
    return per.groupBy("doc_id").agg(F.greatest(F.lit(0), 100 - F.sum(F.coalesce(cost[F.col("issue")], F.lit(0)))).alias("score"))


def body_size(objects: DataFrame, group: str, obj: str, value: str) -> DataFrame:
    """group, size: the median over objects of their medians."""
    return objects.groupBy(group, obj).agg(F.median(value).alias("m")).groupBy(group).agg(F.median("m").alias("size"))


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, spread: the largest distance from the group's median."""
    m = F.median(value).over(W.partitionBy(group))
    return df.select(group, F.abs(F.col(value) - m).alias("d")).groupBy(group).agg(F.max("d").alias("spread"))


def keyword_scores(lines: DataFrame, keywords: dict[str, int], least: int) -> DataFrame:
    """doc_id, score: weights of the distinct keywords found, where they reach ``least``.

    The keywords are literals of the plan: one scan, one partial aggregation.
    """
    hits = [F.max(F.when(F.col("text").contains(k), w).otherwise(0)) for k, w in keywords.items()]
    total = sum(hits[1:], hits[0])
    return lines.groupBy("doc_id").agg(total.alias("score")).where(F.col("score") >= least)


def keyword_hits(lines: DataFrame, patterns: list[str], least: int) -> DataFrame:
    """doc_id, hits: how many distinct patterns are found, where that is at least ``least``."""
    hits = [F.max(F.col("text").rlike(p).cast("int")) for p in patterns]
    return lines.groupBy("doc_id").agg(sum(hits[1:], hits[0]).alias("hits")).where(F.col("hits") >= least)


def region_score(lines: DataFrame, group: str, is_pair: Column, key: str, value: str, page_width: float) -> DataFrame:
    """group, score: how much a region looks like keys and values: how many pairs, their share of the lines,
    how well keys and values stand below each other, and whether keys stand left of values. (AGG-12)"""
    middle = lines.groupBy(group).agg(F.count("*").alias("__n"), F.count_if(is_pair).alias("__k"), F.percentile(key, F.lit(0.5)).alias("__mk"), F.percentile(value, F.lit(0.5)).alias("__mv"))
    spread = lines.join(middle, group).groupBy(group, "__n", "__k", "__mk", "__mv").agg((F.max(F.abs(F.col(key) - F.col("__mk"))) + F.max(F.abs(F.col(value) - F.col("__mv")))).alias("__s"))
    count, share = F.least(F.col("__k") / 8, F.lit(1.0)), F.col("__k") / F.greatest("__n", F.lit(1))
    aligned = F.greatest(F.lit(0.0), 1 - F.col("__s") / max(page_width * 0.25, 1))
    ordered = F.when(F.col("__mk") < F.col("__mv"), 1.0).otherwise(0.4)
    return spread.select(group, (count * 0.35 + share * 0.25 + aligned * 0.25 + ordered * 0.15).alias("score"))


def job_progress(items: DataFrame, job: str, item: str, done: Column, failed: Column) -> DataFrame:
    """job, items, done, last, failed: how far each job is. (STM-03, STM-10)"""
    return items.groupBy(job).agg(F.count("*").alias("items"), F.count_if(done).alias("done"), F.max(item).alias("last"), F.count_if(failed).alias("failed"))


def pattern_stats(rows: DataFrame, text: Column, patterns: Sequence[str]) -> DataFrame:
    """pattern, hits, misses: all patterns are counted in one pass over the rows. (AGG-17)"""
    counts = [c for i, p in enumerate(patterns) for c in (F.count_if(text.rlike(p)).alias(f"h{i}"), F.count_if(~text.rlike(p)).alias(f"m{i}"))]
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("misses")) for i, p in enumerate(patterns)))
    return rows.agg(*counts).select(F.explode(each).alias("s")).select("s.*")
