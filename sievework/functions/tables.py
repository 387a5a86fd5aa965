"""Extracted tables (array<array<string>>, header first) in their stored forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(data: Column) -> Column:
    """At least three rows and two columns, something in it, rows about as wide as the first."""
    width = F.size(F.element_at(data, 1))
    some = F.exists(data, lambda row: F.exists(row, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(data) >= 3) & (width >= 2) & some & F.forall(data, lambda row: F.abs(F.size(row) - width) <= 1)


def split_header(data: Column) -> Column:
    """Struct of headers and rows."""
    return F.struct(F.try_element_at(data, F.lit(1)).alias("headers"), F.slice(data, F.lit(2), F.greatest(F.size(data), F.lit(1))).alias("rows"))


def as_json(table: Column) -> Column:
    return F.to_json(table)


def _cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def markdown(headers: Column, rows: Column) -> Column:
    """Header, rule and body as a pipe table; '' without rows and headers."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, _cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when((F.size(headers) <= 0) & (F.size(rows) <= 0), "").otherwise(F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n"))


def flat_text(headers: Column, rows: Column) -> Column:
    """'Header: value' of each filled cell under a filled header, a line for each row; without headers the filled cells."""
    filled = lambda c: F.trim(_cell(c)) != ""

    def line(row: Column) -> Column:
        n = F.least(F.size(headers), F.size(row))
        pairs = F.filter(F.arrays_zip(F.slice(headers, F.lit(1), n).alias("h"), F.slice(row, F.lit(1), n).alias("v")), lambda p: filled(p["h"]) & filled(p["v"]))
        named = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["v"])), ", ")
        return F.when(F.size(headers) > 0, named).otherwise(F.array_join(F.filter(row, filled), ", "))

    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def facts(headers: Column, rows: Column, method: Column, accuracy: Column, page: Column) -> Column:
    return F.struct(F.size(rows).alias("row_count"), F.size(headers).alias("col_count"), headers.alias("headers"), method.alias("method"), accuracy.alias("accuracy"), page.alias("page"))
