"""Papers with what their pages hold, and the choice between several texts of one paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions import html
from scholion.functions.text import strip_tags, text
from scholion.operators import evidence

#: A page with fewer characters is not read.
LEAST_PAGE = 200


def enrich(papers: DataFrame, key: str, page: str = "page", abstract: str = "abstract") -> DataFrame:
    """``key`` with figure_url, section_headers, captions, method_summary, has_real_world and source of the facts.

    A page of at least 200 characters is read; papers without one keep empty fields, and the flag is read from the
    abstract. One projection: no shuffle, no UDF.
    """
    read = F.length(text(page)) >= LEAST_PAGE
    own = F.when(read, F.col(page))
    return papers.select(
        key,
        html.figure_url(own).alias("figure_url"),
        html.headings(own).alias("section_headers"),
        html.captions(own).alias("captions"),
        html.method_summary(own).alias("method_summary"),
        html.real_world(F.concat_ws(" ", strip_tags(own), text(abstract))).alias("has_real_world"),
        F.when(read, "page").otherwise("abstract").alias("read_from"),
    )


def better_text(first: Column | str, second: Column | str) -> Column:
    """Of two texts the one that is more of an article (see ``evidence.text_quality``), of equal ones the first; empty where neither is one."""
    a, b = evidence.text_quality(first), evidence.text_quality(second)
    return F.when((a < 0) & (b < 0), "").when(a >= b, text(first)).otherwise(text(second))


def acquisition(existing: Column | str, kind: Column | str, has_text: Column, has_pdf: Column) -> Column:
    """How a record was got: what it says itself where that names an interface, else by its kind of source."""
    own = F.trim(text(existing))
    named = F.lower(own).rlike("api|xml|openalex|crossref")
    with_pdf = F.when(has_pdf & ~F.lower(own).contains("pdf"), F.concat(own, F.lit(" + PDF"))).otherwise(F.when(has_pdf, own).otherwise(F.regexp_replace(own, r"(?i)\s*\+\s*pdf[^+]*$", "")))
    return (
        F.when(named, with_pdf)
        .when(text(kind) == "local_pdf", "local PDF")
        .when(text(kind) == "pdf_url", "PDF")
        .when(text(kind) == "web_url", F.when(has_pdf, "page + PDF").otherwise("page"))
        .when(has_pdf, F.when(own != "", own).otherwise("PDF"))
        .when(has_text, F.when(own != "", own).otherwise("page"))
        .otherwise(own)
    )


def run_guards(runs: DataFrame) -> DataFrame:
    """The runs (run, status, expected_end, window_end, errors, expected, rows) with what keeps each from being used: empty for those that are ready."""
    faults = F.array(
        F.when(F.col("status") != "success", "status"), F.when(F.col("window_end") != F.col("expected_end"), "window"), F.when(F.col("errors") > 0, "errors"), F.when(F.col("rows") != F.col("expected"), "rows"),
    )
    return runs.withColumn("faults", F.array_join(F.filter(faults, lambda f: f.isNotNull()), ","))
