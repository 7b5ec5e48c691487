"""The pN_ queries of the operators in this folder, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import boilerplate, canonical, history, leaks, mojibake, packing, residue, subjects
from scholion.session import spread, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "reader_records").select("record_id", "title", "abstract", "full_text", "summary_mode"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_rows(table(spark, sf_dir, "papers"), "entry_id", "journal", table(spark, sf_dir, "journal_quartiles"), "journal_id", "journal")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.find_page_lines(_records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.known_works(table(spark, sf_dir, "history"), table(spark, sf_dir, "papers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_records(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_use(p7_containers(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.find_subjects(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), table(spark, sf_dir, "subjects"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "reader_records")).select("record_id", "title", "summary_mode")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").select("journal")
    both = papers.unionByName(table(spark, sf_dir, "reader_records").select("journal"))
    return canonical.map_values(both, "journal", table(spark, sf_dir, "journal_quartiles"), "journal_id", "journal")


def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(_records(spark, sf_dir).select("record_id", "full_text")).select("record_id", "main_text")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["title", "abstract", "full_text"]
    return mojibake.repair(_records(spark, sf_dir).select("record_id", *fields), fields)


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_found(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n_docs"))
    names = table(spark, sf_dir, "subjects").select("subject_id", "subject")
    return names.join(found, "subject_id", "left").select("subject_id", "subject", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def queries() -> dict:
    found = (p1_found, p2_found, p3_found, p4_found, p5_found, p7_containers, p8_found, p9_found)
    more = (p1_kept, p2_values, p3_main_text, p5_restored, p7_use, p9_composition)
    return {f.__name__: f for f in (*found, *more)}


def oracle_sql() -> dict[str, str]:
    """None: no operator of this folder is expressible in SQL; tests/llm checks them against brute force and round trips."""
    return {}
