"""What goes on over pages: tables that continue, sections of columns, chapters by rules, key-value regions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import canonical, key_value
from foliant.operators.sequence import chains, islands


def table_chains(tables: DataFrame, group: str, order: str, page: str, width: float = 10) -> DataFrame:
    """Add ``chain``: a table goes on from the one before it if it stands on the same or the next page
    and both have nearly the same edges."""
    w = W.partitionBy(group).orderBy(order)
    before = F.lag(F.struct(F.col(page).alias("p"), "x0", "x1")).over(w)
    goes_on = (F.col(page) - before["p"]).between(0, 1) & (F.abs(before["x0"] - F.col("x0")) < width) & (F.abs(before["x1"] - F.col("x1")) < width)
    return chains(tables.withColumn("__j", goes_on), [group], [order], F.col("__j")).drop("__j")


def serial_seams(cells: DataFrame, chain: str, order: str, text: str = "text") -> DataFrame:
    """Add ``merged`` to the first column's cells of a chain: a blank cell belongs to the number before
    it; where most cells are numbers, any other text does, too."""
    w = W.partitionBy(chain)
    number = F.col(text).rlike(r"^\s*\d+\s*$")
    serial = F.count_if(number).over(w) * 2 > F.count("*").over(w)
    before = F.lag(text).over(w.orderBy(order))
    return cells.withColumn("merged", F.when(before.isNull(), False).when(number, False).otherwise((F.trim(text) == "") | serial))


def sections(objects: DataFrame, middle: Column, group: str = "page_id") -> DataFrame:
    """Add ``columns`` (1 or 2) and ``section``: objects beside the middle stand in two columns, those
    across it in one; a section is a stretch, from the top down, of one kind."""
    two = (F.col("x1") <= middle) | (F.col("x0") >= middle)
    order = [F.desc("y1"), F.col("obj_id")]
    w = W.partitionBy(group).orderBy(*order)
    marked = objects.withColumn("columns", F.when(two, 2).otherwise(1))
    marked = marked.withColumn("__n", ~F.col("columns").eqNullSafe(F.lag("columns").over(w)))
    return islands(marked, [group], order, F.col("__n"), "section").drop("__n")


def section_starts(sections: DataFrame, group: str, order: Sequence[str], gap: float = 200) -> DataFrame:
    """Add ``start``: the first section of a page opens a page if the one before left so much room at
    its bottom, else it is continuous."""
    w = W.partitionBy(group).orderBy(*order)
    before = F.lag(F.struct("page_no", "y0")).over(w)
    return sections.withColumn("start", F.when(before.isNull() | ((before["page_no"] != F.col("page_no")) & (before["y0"] >= gap)), "page").otherwise("continuous"))


def outline_matches(outline: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, node, seq: the first text of the outline node's page that says the same, or differs in its
    first character only where it has five at least."""
    plain = F.lower(canonical(F.col("title")))
    a = outline.select("doc_id", "page_no", "node", plain.alias("t"))
    b = texts.select("doc_id", "page_no", "seq", F.lower(canonical(F.col("text"))).alias("u"))
    rest = lambda c: F.substring(c, F.lit(2), F.length(c))
    same = (F.col("t") == F.col("u")) | ((F.length("t") >= 5) & (F.length("t") == F.length("u")) & (rest(F.col("t")) == rest(F.col("u"))))
    return a.join(b, ["doc_id", "page_no"]).where(same).groupBy("doc_id", "node").agg(F.min("seq").alias("seq"))


def page_range(first: Column, last: Column, pages: Column) -> Column:
    """(first, last) within a document: negative numbers count from its end, 0 is open; null if empty."""
    lo = F.when(first < 0, pages + first + 1).when(first == 0, 1).otherwise(first)
    hi = F.when(last < 0, pages + last + 1).when(last == 0, pages).otherwise(last)
    lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, pages)
    return F.when(lo <= hi, F.struct(lo.alias("first"), hi.alias("last")))


def chapters_by_titles(texts: DataFrame, rules: Sequence[tuple[str, str]], group: str = "doc_id", order: str = "seq") -> DataFrame:
    """group, rule, start, end: a rule's chapter begins at the first text that matches it and ends before
    the next chapter's start. The rules are literals of the plan."""
    found = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules])
    hits = texts.select(group, order, F.explode(F.array_compact(found)).alias("rule"))
    starts = hits.groupBy(group, "rule").agg(F.min(order).alias("start"))
    starts = starts.groupBy(group, "start").agg(F.min("rule").alias("rule"))
    ends = texts.groupBy(group).agg(F.max(order).alias("__last"))
    after = F.lead("start").over(W.partitionBy(group).orderBy("start"))
    out = starts.withColumn("__e", after - 1).join(ends, group)
    return out.select(group, "rule", "start", F.coalesce("__e", "__last").alias("end"))


def normalized_chapters(chapters: DataFrame, last: Column, group: str = "doc_id") -> DataFrame:
    """Chapters in order without repeats of a start; each ends before the next one starts."""
    w = W.partitionBy(group).orderBy("start")
    one = chapters.withColumn("__last", last).groupBy(group, "start").agg(F.max("end").alias("end"), F.max("__last").alias("__last"))
    bound = F.coalesce(F.lead("start").over(w) - 1, F.col("__last"))
    return one.withColumn("__b", bound).select(group, "start", F.least(F.coalesce("end", "__b"), "__b").alias("end")).where(F.col("end") >= F.col("start"))


def key_value_rows(lines: DataFrame, group: Sequence[str], order: str, least: int = 2) -> DataFrame:
    """group, entry, key, value: labelled lines with the lines that go on from them, until the next label,
    in groups with enough labels."""
    kv = key_value(F.col("text"))
    marked = lines.withColumn("__kv", kv).withColumn("__n", F.col("__kv").isNotNull())
    numbered = islands(marked, group, [order], F.col("__n"), "entry")
    w = W.partitionBy(*group)
    labels = F.count("__kv").over(w)
    first = F.min(F.when(F.col("__kv").isNotNull(), F.col("entry"))).over(w)
    numbered = numbered.withColumns({"__l": labels, "__f": first}).where((F.col("__l") >= least) & (F.col("entry") >= F.col("__f")))
    value = F.coalesce(F.col("__kv")["value"], F.trim("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"), F.col("__kv")["key"].alias("k"))))
    per = numbered.groupBy(*group, "entry").agg(parts.alias("p"))
    return per.select(*group, "entry", F.col("p")[0]["k"].alias("key"), F.array_join(F.transform("p", lambda x: x["v"]), " ").alias("value"))


def refine(propose: Callable, evaluate: Callable, threshold: float = 90, patience: int = 2, most: int = 10):
    """Propose and score until a score is reached, ``patience`` rounds bring nothing better, or ``most``
    rounds are over. ``propose`` sees the best proposal, its score and issues. Gives the best and its score."""
    best, best_score, issues, idle = None, float("-inf"), None, 0
    for _ in range(most):
        proposal = propose(best, best_score, issues)
        score, found = evaluate(proposal)
        if score > best_score:
            best, best_score, issues, idle = proposal, score, found, 0
        else:
            idle += 1
        if best_score >= threshold or idle >= patience:
            break
    return best, best_score
