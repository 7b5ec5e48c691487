"""Queries of the nested-record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.operators import nested
from scholion.session import table

CHILD = ["child", "parent_id", "pos", "sub_pos"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = nested.xml_children(table(spark, sf_dir, "pubmed_raw"), "raw_id", "payload").select(CHILD)
    figures = nested.array_children(table(spark, sf_dir, "reader_records"), "record_id", "figure_items", "figure").select(CHILD)
    return articles.unionByName(figures)


def p6_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.xml_tables(table(spark, sf_dir, "pubmed_raw"), "raw_id", "payload")["author"]


def p6_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.xml_tables(table(spark, sf_dir, "pubmed_raw"), "raw_id", "payload")["abstract"]


def p6_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.array_children(table(spark, sf_dir, "reader_records"), "record_id", "figure_items", "figure")
    return rows.select("parent_id", "pos", "item_index", "item_label", "item_caption", "item_source")


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_authors, p6_abstracts, p6_figures)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_figures": """
            SELECT record_id AS parent_id, CAST(i AS INTEGER) AS pos, figure_items[i]."index" AS item_index, figure_items[i].label AS item_label,
                   figure_items[i].caption AS item_caption, figure_items[i].source AS item_source
            FROM reader_records, range(1, 200) AS r(i) WHERE i <= len(figure_items)
        """,
    }
