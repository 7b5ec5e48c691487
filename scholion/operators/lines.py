"""Texts as ordered lines: blocks under headings, islands of like lines, capture between marks.

Each text is one row, so lines are numbered and grouped inside it by array functions or by windows partitioned by
the text; texts never meet in one partition by accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import let


def explode_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: lines between line feeds, counted from 1."""
    return rows.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__p", "line")).select(key, (F.col("__p") + 1).alias("line_no"), "line")


def blocks(rows: DataFrame, key: str, text: str, head: str) -> DataFrame:
    """``key, block, lines``: the lines of each block of a text; a line that matches ``head`` opens one, lines before the first are block 0.

    The text is split before its heads inside its row: no text is shuffled and no window needed.
    """
    pieces = F.split(F.col(text), rf"(?dm)(?<=\n)(?=(?:{head})$)", -1)
    # The line feed before the next head parts the lines; it belongs to none of them.
    own = let(pieces, lambda ps: F.transform(ps, lambda p, i: F.split(F.when(i < F.size(ps) - 1, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p), "\n", -1)))
    first = F.col(text).rlike(rf"(?d)\A(?:{head})(?:\n|\z)").cast("int")
    t = rows.select(key, first.alias("__f"), F.posexplode(own).alias("__p", "lines"))
    return t.select(key, (F.col("__p") + F.col("__f")).cast("long").alias("block"), "lines")


def islands(lines: DataFrame, key: str, like: Column, order: str = "line_no") -> DataFrame:
    """Maximal runs of rows that hold ``like``: first and last place and length."""
    w = Window.partitionBy(key).orderBy(order)
    t = lines.withColumn("__r", F.row_number().over(w)).where(like)
    t = t.withColumn("__g", F.col("__r") - F.row_number().over(w))
    return t.groupBy(key, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__g")


def between(text: Column, start: str, stop: str) -> Column:
    """The text after the first match of ``start`` and before the next of ``stop`` (or the end)."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)(?:{start})(.*?)(?:{stop}|\z)", 1))
