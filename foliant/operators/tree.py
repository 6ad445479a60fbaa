"""Headings, contents and chapter trees as adjacency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.grouped import fold_groups
from foliant.runtime import materialize


def parents(items: DataFrame, group: str = "doc_id", order: str = "seq", level: str = "level", deepest: int | None = None) -> DataFrame:
    """Add ``parent``: the last earlier item of a smaller level; null at the top. (TRE-15)

    One window for each level instead of a stack: the last item of a level so far, forgotten
    where a smaller level came after it, is the larger of two running maxima. ``deepest`` is the
    largest level; where it isn't given, it is looked up first.
    """
    if deepest is None:
        deepest = items.agg(F.max(level)).first()[0] or 1
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(1, deepest)]
    parent = F.lit(None).cast(dict(items.dtypes)[order])
    for k in range(2, deepest + 1):
        parent = F.when(F.col(level) == k, F.greatest(F.lit(None).cast("long"), *last[: k - 1])).otherwise(parent)
    return items.withColumn("parent", parent)


def chapter_ranges(marks: DataFrame, ends: DataFrame, group: str = "doc_id", at: str = "seq") -> DataFrame:
    """group, start, end of chapters: from a heading to the next one or the group's end.

    ``ends`` has a row for each group, with ``last``.
    """
    after = F.lead(at).over(W.partitionBy(group).orderBy(at))
    rows = marks.select(group, F.col(at).alias("start"), (after - 1).alias("end"))
    return rows.join(ends.select(group, "last"), group).select(group, "start", F.coalesce("end", "last").alias("end"))


def fill_gaps(ranges: DataFrame, ends: DataFrame, group: str = "doc_id") -> DataFrame:
    """group, start, end, filler: ranges, and body chapters for what no range covers."""
    w = W.partitionBy(group).orderBy("start")
    before = F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    gap = ranges.select(group, (before + 1).alias("s"), (F.col("start") - 1).alias("e"), "start", "end").select(group, F.explode(F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.lit(False).alias("filler")), F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit(True).alias("filler")))).alias("x")).select(group, "x.*").where("start <= end")
    done = ranges.groupBy(group).agg(F.max("end").alias("done"))
    tail = ends.join(done, group, "left").select(group, (F.coalesce("done", F.lit(-1)) + 1).alias("start"), F.col("last").alias("end"), F.lit(True).alias("filler")).where("start <= end")
    return gap.unionByName(tail)


def depths(nodes: DataFrame) -> DataFrame:
    """node_id, depth (a root has 0) of rows (node_id, parent_id), by doubling: a join on the node for each
    doubling of the longest path, until no node looks up any more."""
    state = nodes.select("node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    while True:
        state = materialize(state)
        if state.where("up is not null").isEmpty():
            return state.select("node_id", "depth")
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = state.join(above, "up", "left").select("node_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))


def in_depth_first_order(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``number``, from 0: a node's place when each is followed by its children. (WIN-14, TRE-02, TRE-03)

    ``path`` has the places of a node's ancestors and its own as an array of numbers, which orders
    like a walk through the tree.
    """
    return nodes.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("path")) - 1)


def expanded(nodes: DataFrame, group: Column) -> DataFrame:
    """Nodes without the groups: their children hang on the group's parent, and keep their order. (TRE-25)

    Rows (doc_id, node_id, parent_id, path); groups within groups are taken out at once if they are marked.
    """
    marked = materialize(nodes.withColumn("__g", F.coalesce(group, F.lit(False))))
    up = marked.where("__g").select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("__up"))
    # a group's parent may be a group: hooks of groups alone are followed, each round twice as far
    while True:
        over = up.select("doc_id", F.col("parent_id").alias("__up"), F.col("__up").alias("__top"), F.lit(True).alias("__m"))
        moved = up.join(over, ["doc_id", "__up"], "left")
        moved = materialize(moved.select("doc_id", "parent_id", F.when(F.col("__m"), F.col("__top")).otherwise(F.col("__up")).alias("__up"), "__m"))
        if moved.where("__m").isEmpty():
            break
        up = moved.drop("__m")
    out = marked.where("not __g").join(up.withColumn("__m", F.lit(True)), ["doc_id", "parent_id"], "left")
    return out.withColumn("parent_id", F.when(F.col("__m"), F.col("__up")).otherwise(F.col("parent_id"))).select(*nodes.columns)


def node_of(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Objects with the node that they belong to, null for none; ``nodes`` has (doc_id, node_id, objects). (TRE-06)"""
    held = nodes.select("doc_id", "node_id", F.explode("objects").alias("obj_id"))
    return objects.join(held, ["doc_id", "obj_id"], "left")


def is_ancestor(path: Column, other: Column) -> Column:
    """Of paths such as 1/4/9."""
    return other.startswith(F.concat(path, F.lit("/")))


def toc_item(text: Column) -> Column:
    """(no, title, page, level) of a contents line; null where it has no page number."""
    line = r"(?U)^\s*(\d+(?:\.\d+)*)?\.?\s*(.*?)[\s.·…]*(\d+)\s*$"
    no, title, page = (F.regexp_extract(text, line, i) for i in (1, 2, 3))
    level = F.when(no == "", 1).otherwise(F.size(F.split(no, r"\.")))
    return F.when(page != "", F.struct(no.alias("no"), title.alias("title"), page.cast("int").alias("page"), level.alias("level")))


def infer_levels(headings: DataFrame, group: str = "doc_id", order: str = "seq", style: str = "style") -> DataFrame:
    """Add ``level``: a style that is open on the stack keeps its level, a new one goes a level deeper.

    A fold: each heading's level depends on the stack that those before it left. It reads the
    headings of one document at a time, in order.
    """

    def fold(rows):
        stack: list[str] = []
        levels = []
        for s in rows[style]:
            if s in stack:
                del stack[stack.index(s) + 1 :]
            else:
                stack.append(s)
            levels.append(len(stack))
        return range(len(levels)), {"level": levels}

    return fold_groups(headings, group, [order], [style], headings.columns, fold, {"level": "int"})


def markdown_headings(text: str | Column, deepest: int = 6) -> Column:
    """Array of (level, title, line) of a Markdown text's headings."""
    lines = F.split(F.col(text) if isinstance(text, str) else text, "\n")
    found = F.transform(lines, lambda x, i: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s+(.*)$", 1)).alias("level"), F.regexp_extract(x, r"^(#{1,6})\s+(.*)$", 2).alias("title"), i.alias("line")))
    return F.filter(found, lambda h: (h["level"] > 0) & (h["level"] <= deepest))


def tree_markdown(nodes: DataFrame, group: str = "doc_id") -> DataFrame:
    """group, markdown of rows (group, seq, level, title, body) in order."""
    head = F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), F.col("title"))
    block = F.concat_ws("\n\n", F.when(F.col("title").isNotNull(), head), F.nullif(F.col("body"), F.lit("")))
    return nodes.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))

