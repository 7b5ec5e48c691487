"""De-duplication, history, order, top-k and buckets by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import text


def paper_id() -> Column:
    """The first of id, pmid, doi and url that is not empty."""
    return F.coalesce(*[F.when(text(c) != "", text(c)) for c in ("id", "pmid", "doi", "url")])


def firsts(rows: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """The smallest ``order`` of each key: a hash aggregate over the key and one number.

    A key that fills a third of the table reaches its reducer as one row a task.
    """
    return rows.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias(order)).select(order)


def first_of_each(rows: DataFrame, keys: Sequence[Column], order: str, among: DataFrame | None = None) -> DataFrame:
    """The row with the smallest ``order`` (unique) of each key; ``among`` is the table the firsts are looked for in, where ``rows`` was derived from it at a price.

    Only keys and numbers are aggregated; the rows are joined with the firsts by the number alone.
    """
    return rows.join(firsts(rows if among is None else among, keys, order), order, "left_semi")


def paper_key() -> list[Column]:
    return [text("source"), text("doi"), text("pmid"), F.lower(F.trim(text("title")))]


def drop_known(rows: DataFrame, history: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is not in the history (anti-join on the id)."""
    seen = history.select(F.col("id").alias("__seen")).where("__seen is not null and __seen <> ''").distinct()
    return rows.withColumn("__key", key).join(seen, F.col("__key") == F.col("__seen"), "left_anti").drop("__key")


def order_papers(matched: str = "matched", points: str = "points", date: str = "date", tie: str = "entry_id") -> list[Column]:
    """Matches first, more matches first, then score and date text, all falling; ties by arrival."""
    n = F.size(F.coalesce(F.col(matched), F.array().cast("array<string>")))
    return [n.desc(), F.col(points).desc(), text(date).desc(), F.col(tie).asc()]


def top_k(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def buckets(ranked: DataFrame, by: Sequence[str], order: Sequence[Column], points: str, least: int, must: float = 0.3, worth: float = 0.4, labels: Sequence[str] = ("must", "worth", "skip")) -> DataFrame:
    """Buckets by rank within each group: the top share if good enough, then the next share of what is left.

    Groups are reports: selections of bounded size made before (see ``top_k``), one window partition each.
    """
    group = Window.partitionBy(*by)
    t = ranked.withColumns({"rank": F.row_number().over(group.orderBy(*order)), "__n": F.count("*").over(group)})
    share = lambda f: F.ceil(F.round(F.col("__n") * f, 9))
    t = t.withColumns({"__must": share(must), "__worth": F.least(share(worth), F.col("__n") - share(must))})
    t = t.withColumn("__top", (F.col("rank") <= F.col("__must")) & (F.col(points) >= least))
    # What is no must moves up: its place among the rest is its rank less the musts before it.
    t = t.withColumn("__place", F.col("rank") - F.sum(F.col("__top").cast("int")).over(group.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.col("__top"), F.lit(labels[0])).when(F.col("__place") <= F.col("__worth"), F.lit(labels[1])).otherwise(F.lit(labels[2]))
    return t.withColumn("bucket", label).drop("__n", "__must", "__worth", "__top", "__place")


def update_history(history: DataFrame, papers: DataFrame, today: str, keep_days: int) -> DataFrame:
    """id, date, title, source: papers not yet known join with today's date, known ones keep the earlier date, old ones go.

    A paper's key is its id, else its DOI, else its address.

    Dates are texts and compared as such; undated entries are dropped with the old ones.
    """
    own = F.trim(F.coalesce(*[F.when(text(c) != "", text(c)) for c in ("id", "doi", "url")], F.lit("")))
    known = history.select("entry_id", F.trim(text("id")).alias("id"), text("date").alias("date"), text("title").alias("title"), text("source").alias("source")).where("id <> ''")
    new = papers.select("entry_id", own.alias("id"), F.lit(today).alias("date"), text("title").alias("title"), text("source").alias("source")).where("id <> ''")
    # Of a repeated id the last row of the history and the first of the papers count; numbers are aggregated, not rows.
    span = known.select("id", F.col("entry_id").alias("k"), F.lit(None).cast("long").alias("n")).unionByName(new.select("id", F.lit(None).cast("long").alias("k"), F.col("entry_id").alias("n")))
    chosen = span.groupBy("id").agg(F.max("k").alias("k"), F.min("n").alias("n"))
    picks = chosen.select(F.coalesce("k", "n").alias("entry_id"), F.col("k").isNotNull().alias("__old"), F.col("n").isNotNull().alias("__seen"))
    rows = known.withColumn("__k", F.lit(True)).unionByName(new.withColumn("__k", F.lit(False)))
    t = rows.join(picks, (rows["entry_id"] == picks["entry_id"]) & (rows["__k"] == picks["__old"]))
    kept = F.when(F.col("__old") & F.col("__seen") & (F.col("date") > today), F.lit(today)).otherwise(F.col("date"))
    out = t.select("id", kept.alias("date"), "title", "source")
    return out.where(F.col("date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), keep_days), "yyyy-MM-dd"))
