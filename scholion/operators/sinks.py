"""Reports, audit tables and status records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import clean_title, excerpt, text, unique_ci


def audit_column(rows: DataFrame, bucket: Column, detail: Column) -> DataFrame:
    """One long table of rejected rows (bucket, entry_id, title, source, date, detail) from one pass over rows whose bucket is an expression; rows without a bucket were kept."""
    t = rows.withColumn("bucket", bucket).where("bucket is not null")
    return t.select("bucket", "entry_id", text("title").alias("title"), text("source").alias("source"), text("date").alias("date"), detail.cast("string").alias("detail"))


def write_audit(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("bucket").parquet(path)


def links(url: str = "url", pdf: str = "pdf") -> Column:
    """Markdown links of a paper, those that are there."""
    link = lambda label, c: F.when(text(c) != "", F.concat(F.lit(f"[{label}]("), text(c), F.lit(")")))
    return F.concat_ws(" | ", link("page", url), link("PDF", pdf))


def report_lines(ranked: DataFrame, by: str) -> DataFrame:
    """``by, rank, lines``: the Markdown entry of each ranked paper."""
    words = F.array_join(unique_ci(F.concat(F.coalesce("matched", F.array().cast("array<string>")), F.coalesce("boosted", F.array().cast("array<string>")))), ", ")
    entry = F.concat_ws("\n", F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), clean_title("title")), F.concat(F.lit("- score: "), F.col("points").cast("string")), F.when(words != "", F.concat(F.lit("- keywords: "), words)), F.when(links() != "", F.concat(F.lit("- links: "), links())), F.when(text("abstract") != "", F.concat(F.lit("> "), excerpt("abstract"))))
    return ranked.select(by, "bucket", "rank", entry.alias("lines"))


def split_table(ranked: DataFrame, by: str, separator: str = " · ") -> DataFrame:
    """``by, bucket, entries``: titles of each bucket in order. Buckets are of a report's size."""
    entry = F.struct("rank", clean_title("title").alias("t"))
    return ranked.groupBy(by, "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["t"]), separator).alias("entries"))


def write_report(lines: DataFrame, by: str, path: str) -> None:
    """A Markdown file for each report, entries in order; reports are written in parallel, one to a task."""
    ordered = lines.repartition(by).sortWithinPartitions(by, "rank")
    ordered.select(by, F.col("lines").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def status(run: str, window_end: str, days: int, rows: int, errors: int) -> str:
    """The status record of a run as JSON: success, unless nothing was found while sources failed."""
    state = "failed" if errors and not rows else "success"
    return json.dumps({"run": run, "status": state, "window_end": window_end, "days": days, "top_count": rows, "source_fetch_error_count": errors})


def require_ready(record: str, window_end: str, days: int, rows: int, run: str) -> None:
    """Raises unless the status record is a success without source errors for this run, window and number of rows."""
    got = json.loads(record)
    wrong = [k for k, v in {"status": "success", "window_end": window_end, "days": days, "source_fetch_error_count": 0, "top_count": rows, "run": run}.items() if got.get(k) != v]
    if wrong:
        raise RuntimeError("not ready: " + ", ".join(f"{k} is {got.get(k)!r}" for k in wrong))
