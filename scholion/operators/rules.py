"""Categories by keyword rules, and rows joined by prefixes and near names, without theta joins over two large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import text


def _touches(word: str):
    return lambda t: t.contains(word) | F.lit(word).contains(t)


def categories(rows: DataFrame, key: str, tags: str, title: str, rules: Sequence[tuple[str, Sequence[str]]], none: str = "inbox") -> DataFrame:
    """``key, category``: the rule with most points, of equal ones the earlier.

    Two points for each tag that contains a keyword of the rule or is contained in it, one for each keyword in the
    title. Rules are a short configured list and become expressions; rows without tags are in no category.
    """
    low = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.lower(t))
    named = F.lower(text(title))
    scored = []
    for at, (category, keywords) in enumerate(rules):
        points = F.lit(0)
        for k in keywords:
            w = k.lower()
            points = points + 2 * F.size(F.filter("__tags", _touches(w))) + F.col("__title").contains(w).cast("int")
        scored.append(F.struct(points.alias("points"), F.lit(-at).alias("order"), F.lit(category).alias("category")))
    t = rows.select(F.col(key), low.alias("__tags"), named.alias("__title")).withColumn("__best", F.array_max(F.array(*scored)))
    chosen = F.when((F.size("__tags") > 0) & (F.col("__best.points") > 0), F.col("__best.category")).otherwise(F.lit(none))
    return t.select(key, chosen.alias("category"))


def prefix_join(rows: DataFrame, key: str, text_col: str, prefixes: DataFrame, prefix_col: str, least: int = 12) -> DataFrame:
    """(key, prefix) of the rows that start with a prefix; an empty prefix starts nothing.

    Prefixes of ``least`` characters and more are joined by equality of their first ``least`` and then tested; shorter
    ones are joined by equality of as many characters as they have, one length after the other.
    """
    # The lengths that occur, at most ``least`` numbers.
    sizes = sorted(r[0] for r in prefixes.select(F.least(F.length(prefix_col), F.lit(least)).alias("n")).where("n > 0").distinct().collect())
    heads = F.array(*[F.when(F.length("__t") >= n, F.substring("__t", 1, n)) for n in sizes]) if sizes else F.array().cast("array<string>")
    a = rows.select(F.col(key), F.col(text_col).alias("__t")).withColumn("__h", F.explode(heads)).where("__h is not null")
    b = prefixes.select(F.col(prefix_col)).where(F.length(prefix_col) >= 1).distinct().withColumn("__h", F.substring(prefix_col, 1, least))
    return a.join(b, "__h").where(F.col("__t").startswith(F.col(prefix_col))).select(key, prefix_col)


def lookup_index(notes: DataFrame, stem: str, order: str) -> DataFrame:
    """``key, stem``: a note under its stem, each number of seven figures or more in it, and its preprint suffix; of equal keys the last note counts."""
    s = text(stem)
    numbers = F.regexp_extract_all(s, F.lit(r"(\d{7,})"), F.lit(1))
    suffix = F.regexp_extract(s, r"(\d{4}\.\d{2}\.\d{2}\.\d{6,})", 1)
    dashed = F.translate(suffix, ".", "-")
    keys = F.array_distinct(F.filter(F.concat(F.array(s), numbers, F.array(suffix, dashed)), lambda k: k != ""))
    exploded = notes.select(F.explode(keys).alias("key"), F.col(stem).alias("stem"), F.col(order).alias("__o"))
    return exploded.groupBy("key").agg(F.max_by("stem", "__o").alias("stem"))


def near_name(candidate: Column, known: Column) -> Column:
    """Equal names, or a known name of more than three characters that makes up half of the candidate and stands in it."""
    return (candidate == known) | ((F.length(known) > 3) & candidate.contains(known) & (F.length(known) >= 0.5 * F.length(candidate)))
