"""Tables from places on pages: by ruling lines where there are any, else by gaps between words.

Words and rules are rows (path, page, x0, y0, x1, y1 [, text]), y downwards; a page is the largest thing one task sorts.
Rows with a null among these, or with a blank text, take no part. A page without rows in either has no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.tables import is_valid

#: Points within which two rules are one, and two baselines too.
SNAP = 2.0
#: A gap wider than this many heights of a word parts two cells.
GAP = 1.0
#: Lines further apart than this many heights belong to different tables.
LEADING = 2.5
PAGE = ["path", "page"]


def _islands(rows: DataFrame, keys: list[str], low: str, high: str, slack: float, name: str) -> DataFrame:
    """Numbers the stretches of a line that the intervals [low, high] cover, gaps up to slack included, in order."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_fresh", (before.isNull() | (F.col(low) > before + slack)).cast("int"))
    return fresh.withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def _whole(marks: DataFrame) -> DataFrame:
    return marks.dropna(subset=[*PAGE, "x0", "y0", "x1", "y1"])


def _assembled(cells: DataFrame, table: list[str], method: str) -> DataFrame:
    """cells (path, page, *table, row, col, n_cols, text) as rows path, page, table_index, data, method: empty rows go, the
    rest are numbered within the file by page and place, if they pass for tables."""
    filled = cells.groupBy(*PAGE, *table, "row").agg(F.first("n_cols").alias("n"), F.map_from_arrays(F.collect_list("col"), F.collect_list("text")).alias("m"))
    line = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit("")))
    rows = filled.groupBy(*PAGE, *table).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("cells")))), lambda r: r["cells"]).alias("data"))
    order = Window.partitionBy("path").orderBy("page", *table)
    return rows.where(is_valid(F.col("data"))).select("path", "page", F.row_number().over(order).cast("int").alias("table_index"), "data", F.lit(method).alias("method"))


def _texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words that share the keys as one text: by line, then from left to right."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))), lambda w: w["text"])
    return words.groupBy(*keys).agg(F.array_join(said, " ").alias("text"))


def _lines(words: DataFrame) -> DataFrame:
    """Words with the number of their line: baselines within SNAP of the one before are one line."""
    order = Window.partitionBy(*PAGE).orderBy("y1", "x0")
    moved = (F.col("y1") - F.lag("y1").over(order) > SNAP).cast("int")
    return _whole(words).where(F.trim("text") != "").withColumn("line", F.coalesce(F.sum(moved).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int"))


def by_gaps(words: DataFrame) -> DataFrame:
    """Tables without rules. Words of a line with no gap over GAP heights between them are a cell; lines of two cells or
    more that follow each other are a table; its columns are the stretches that its cells cover. Cells of a line in one
    column are joined by a space."""
    row = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1")
    apart = (F.col("x0") - F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)) > GAP * (F.col("y1") - F.col("y0"))).cast("int")
    parted = _lines(words).withColumn("cell", F.coalesce(F.sum(apart).over(row.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    lines = parted.groupBy(*PAGE, "line").agg(F.max("cell").alias("last"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max(F.col("y1") - F.col("y0")).alias("high"))
    order = Window.partitionBy(*PAGE).orderBy("line")
    ends = (F.col("last") == 0) | F.lag("last").over(order).isNull() | (F.lag("last").over(order) == 0) | (F.col("top") - F.lag("bottom").over(order) > LEADING * F.col("high"))
    blocks = lines.withColumn("table", F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("last > 0")
    inside = parted.join(blocks.select(*PAGE, "line", "table"), [*PAGE, "line"])
    columns = _islands(inside.groupBy(*PAGE, "table", "line", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")), [*PAGE, "table"], "x0", "x1", 0.0, "col")
    width = columns.groupBy(*PAGE, "table").agg(F.max("col").alias("n_cols"))
    placed = inside.join(columns.select(*PAGE, "table", "line", "cell", "col"), [*PAGE, "table", "line", "cell"])
    cells = _texts(placed.withColumn("row", F.col("line")), [*PAGE, "table", "row", "col"]).join(width, [*PAGE, "table"])
    return _assembled(cells, ["table"], "stream")


def _edges(rules: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """For each table the sorted places of its rules in one direction, those within SNAP as one."""
    at = _islands(rules, [*PAGE, "table", "part"], low, high, SNAP, "_n")
    each = at.groupBy(*PAGE, "table", "part", "_n").agg(F.avg((F.col(low) + F.col(high)) / 2).alias("v"))
    return each.groupBy(*PAGE, "table", "part").agg(F.sort_array(F.collect_list("v")).alias(name))


def _slot(edges: str, value: Column) -> Column:
    """Between which edges a value lies, from 1; 0 and the number of edges are outside."""
    return F.size(F.filter(F.col(edges), lambda e: e <= value))


def by_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Tables whose cells are ruled. Rules that overlap downwards, then across, are one table; its columns and rows lie
    between neighbouring rules, and a word is in the cell that has its middle. The text of a merged cell stays in the
    cells of the grid over which it is printed."""
    bands = _islands(_whole(rules), PAGE, "y0", "y1", SNAP, "table")
    parts = _islands(bands, [*PAGE, "table"], "x0", "x1", SNAP, "part")
    upright = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
    grid = _edges(parts.where(upright), "x0", "x1", "xs").join(_edges(parts.where(~upright), "y0", "y1", "ys"), [*PAGE, "table", "part"]).where("size(xs) >= 3 AND size(ys) >= 3")
    middle = ((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    near = _lines(words).join(grid, PAGE).withColumns({"col": _slot("xs", middle[0]), "row": _slot("ys", middle[1]), "n_cols": F.size("xs") - 1})
    inside = near.where("col BETWEEN 1 AND n_cols AND row BETWEEN 1 AND size(ys) - 1")
    return _assembled(_texts(inside, [*PAGE, "table", "part", "row", "col", "n_cols"]), ["table", "part"], "lattice")


def tables(words: DataFrame, rules: DataFrame) -> DataFrame:
    """path, page, table_index (from 1 within the file), data (header first), method. A file that has a ruled table is read
    by rules alone, any other by gaps."""
    ruled = by_rules(words, rules)
    return ruled.unionByName(by_gaps(words).join(ruled.select("path").distinct(), "path", "left_anti"))
