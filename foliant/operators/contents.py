"""Tables of contents: where they are, wrapped lines, levels, and the headings they point to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import title_forms, title_score
from foliant.grouped import fold_groups

PAGE_REF = r"(\.{2,}|…|\s)\s*\d{1,4}\s*$"
HEADING = r"(?i)^\s*(table of\s+)?contents\s*$|^\s*目\s*录\s*$"


def has_page_ref(text: Column) -> Column:
    return text.rlike(PAGE_REF)


def contents_ranges(lines: DataFrame, item: Column, ref: Column, items: int = 3, refs: int = 2) -> DataFrame:
    """doc_id, first_page, last_page: pages in a row that hold enough items and page references."""
    per = lines.groupBy("doc_id", "page_no").agg(F.count_if(item).alias("i"), F.count_if(ref).alias("r")).where((F.col("i") >= items) & (F.col("r") >= refs))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))
    return per.withColumn("__k", F.col("page_no") - n).groupBy("doc_id", "__k").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("__k")


def joined_lines(lines: DataFrame, ends: Column, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """group, item, first_line, text: lines joined until one ends an item, by a count of the ends before."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("__e", ends.cast("int")).withColumn("item", F.coalesce(F.sum("__e").over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("text").alias("t"))))
    return marked.groupBy(group, "item").agg(F.min(order).alias("first_line"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def below_unnumbered(items: DataFrame, numbered: Column, level: Column, group: str = "doc_id", order: str = "seq") -> DataFrame:
    """Add ``level``: numbered items that follow an unnumbered item stand one level below their own."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.max(F.when(~numbered, 1)).over(w), F.lit(0))
    return items.withColumn("level", F.when(numbered, level + after).otherwise(F.lit(1)))


def seen_before(items: DataFrame, wanted: Column, value: Column, group: str = "doc_id", order: str = "seq") -> DataFrame:
    """Add ``seen``: whether an earlier item of the group has the value that this one wants."""
    w = W.partitionBy(group, "__v").orderBy(order, "__own")
    both = items.select("*", F.explode(F.array(F.struct(wanted.alias("v"), F.lit(1).alias("own")), F.struct(value.alias("v"), F.lit(0).alias("own")))).alias("__x"))
    both = both.select("*", F.col("__x.v").alias("__v"), F.col("__x.own").alias("__own")).drop("__x")
    before = F.max(F.when(F.col("__own") == 0, 1)).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    strictly = F.min(F.when(F.col("__own") == 0, F.col(order))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) < F.col(order)
    return both.withColumn("seen", F.coalesce((before == 1) & strictly, F.lit(False))).where("__own = 1").drop("__v", "__own")


def look_back(items: DataFrame, found: Column, stops: Column, most: int = 8, group: str = "doc_id", order: str = "seq") -> DataFrame:
    """Add ``parent``: the nearest of at most ``most`` earlier items that is found before one that stops."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(-most, -1)
    hit, stop = F.max(F.when(found, F.col(order))).over(w), F.max(F.when(stops & ~found, F.col(order))).over(w)
    return items.withColumn("parent", F.when(hit > F.coalesce(stop, F.lit(-1)), hit))


def _heads(forms: Column) -> Column:
    """Hashes of the first three characters of both ``title_forms``, and of those after the first character, and
    whether a form is shorter, but not empty."""
    head = lambda c, at: F.hash(F.substring(c, at, 3))
    short = lambda c: F.length(c).between(1, 2)
    plain, bare = forms["plain"], forms["bare"]
    return F.struct(head(plain, 1).alias("p"), head(plain, 2).alias("pt"), head(bare, 1).alias("b"), head(bare, 2).alias("bt"), (short(plain) | short(bare)).alias("short"))


def _may_match(a: Column, b: Column) -> Column:
    """Whether ``title_score`` can be above 0 by the ``_heads`` of both: texts that are equal, begin with each other or
    are so but for a first character have a head in common, or one of them is short."""
    common = [a[x] == b[y] for k in "pb" for x in (k, f"{k}t") for y in (k, f"{k}t")]
    return reduce(Column.__or__, common, a["short"] | b["short"])


def title_scores(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a document's contents items and texts, with ``score``; forms are made before the join, and only
    pairs that have a head in common are compared. (STR-37)"""
    own = items.withColumn("__t", title_forms(F.col("title"))).withColumn("__th", _heads(F.col("__t")))
    other = texts.withColumn("__s", title_forms(F.col("text"))).withColumn("__sh", _heads(F.col("__s")))
    score = F.when(_may_match(F.col("__sh"), F.col("__th")), title_score(F.col("__s"), F.col("__t"))).otherwise(0)
    return own.join(other, "doc_id").withColumn("score", score).drop("__s", "__t", "__sh", "__th")


def title_matches(items: DataFrame, texts: DataFrame, least: int = 70) -> DataFrame:
    """doc_id, item, seq, score: the text that each contents item stands for. (JON-13, TRE-17, TRE-18)

    In order, an item takes the best text after that of the item before: the first of equals, or the
    first with 100 or more. The same page adds 5, one at most 3 away 2. ``items`` (doc_id, item, title,
    page), ``texts`` (doc_id, seq, text, page_no). Candidates are scored by joins within a document;
    only the choice is a fold.
    """
    near = F.abs(F.col("page_no") - F.col("page"))
    bonus = F.coalesce(F.when(near == 0, 5).when(near <= 3, 2), F.lit(0))
    scored = title_scores(items, texts).where("score > 0").withColumn("score", F.col("score") + bonus)
    met = scored.where(F.col("score") >= least)

    def fold(p):
        item, seq, scores = p["item"].tolist(), p["seq"].tolist(), p["score"].tolist()
        chosen, start, i = [], None, 0
        while i < len(item):
            best, j = None, i
            while j < len(item) and item[j] == item[i]:
                free = start is None or seq[j] > start
                if free and (best is None or scores[best] < 100) and (best is None or scores[j] > scores[best]):
                    best = j
                j += 1
            if best is not None:
                chosen.append(best)
                start = seq[best]
            i = j
        return chosen, {}

    return fold_groups(met.select("doc_id", "item", "seq", "score"), "doc_id", ["item", "seq"], ["item", "seq", "score"], ["doc_id", "item", "seq", "score"], fold, {})


def contents_heading_at(objects: DataFrame, heading: Column, first: int = 5) -> DataFrame:
    """doc_id, page_no, seq: the first of a page's first objects that is a heading of contents. (LAY-16)"""
    place = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("seq"))
    return objects.withColumn("__p", place).where((F.col("__p") <= first) & heading).groupBy("doc_id", "page_no").agg(F.min("seq").alias("seq"))


def attach(objects: DataFrame, ranges: DataFrame, group: str = "doc_id", at: str = "seq") -> DataFrame:
    """Add the start of the range that each object lies in, null outside of all. Ranges don't overlap:
    a union with them and a running last value, so no range join is needed."""
    marks = ranges.select(group, F.col("start").alias("__at"), F.struct("start", "end").alias("__r"))
    rows = objects.withColumn("__at", F.col(at)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(group).orderBy("__at", F.col("__r").isNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last("__r", ignorenulls=True).over(w)
    rows = rows.withColumn("__l", last).where(F.col("__r").isNull())
    return rows.withColumn("chapter", F.when(F.col("__l")["end"] >= F.col("__at"), F.col("__l")["start"])).drop("__at", "__r", "__l")
