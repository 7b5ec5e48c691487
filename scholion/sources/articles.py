"""Article records and notes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.text import bibliographic_date, display_text, text

_A = "MedlineCitation/Article"


def _x(payload: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.xpath_string(payload, F.lit(f"/PubmedArticle/{path}")), F.lit("")))


def _xs(payload: Column, path: str) -> Column:
    return F.xpath(payload, F.lit(f"/PubmedArticle/{path}"))


def _date(payload: Column, path: str) -> Column:
    return bibliographic_date(*(_x(payload, f"{path}/{p}") for p in ("Year", "Month", "Day")))


def article_fields(records: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """The scalar fields of an article record: identifiers, title, journal, dates, keywords; missing ones are empty.

    The first of the electronic date, the journal's date and the entry date that is there is the date. Records that
    are not well-formed give empty fields.
    """
    p = F.col(payload_col)
    good = F.regexp_replace(F.coalesce(p, F.lit("<PubmedArticle/>")), r"^\s*<\?xml[^>]*\?>", "")
    t = records.select(F.col(id_col), F.when(F.trim(good) == "", F.lit("<PubmedArticle/>")).otherwise(good).alias("__p"))
    p = F.col("__p")
    dates = F.array(_date(p, f"{_A}/ArticleDate[1]"), _date(p, f"{_A}/Journal/JournalIssue/PubDate"), _date(p, "PubmedData/History/PubMedPubDate[@PubStatus='entrez']"))
    candidates = F.array_distinct(F.filter(dates, lambda d: d != ""))
    return t.select(
        id_col,
        _x(p, "MedlineCitation/PMID").alias("pmid"),
        _x(p, "PubmedData/ArticleIdList/ArticleId[@IdType='doi']").alias("doi"),
        _x(p, "PubmedData/ArticleIdList/ArticleId[@IdType='pmc']").alias("pmc_id"),
        display_text(_x(p, f"{_A}/ArticleTitle")).alias("title"),
        _x(p, f"{_A}/Journal/Title").alias("journal"),
        F.coalesce(F.try_element_at(candidates, F.lit(1)), F.lit("")).alias("date"),
        candidates.alias("date_candidates"),
        F.filter(F.transform(_xs(p, "MedlineCitation/KeywordList/Keyword/text()"), lambda k: F.trim(k)), lambda k: k != "").alias("keywords"),
    )


def abstracts(records: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """``id, abstract``: the parts of each abstract in order, joined by spaces, each behind its label."""
    from scholion.operators.nested import xml_children

    parts = xml_children(records, id_col, payload_col).where("child = 'abstract'")
    label, body = F.trim(text(F.element_at("leaves", "@Label"))), F.trim(text(F.element_at("leaves", ".")))
    t = parts.select(F.col("parent_id").alias(id_col), "pos", F.when(label != "", F.concat(label, F.lit(": "), body)).otherwise(body).alias("part")).where(body != "")
    # The parts of one record are few and lie in one task; the aggregate keeps their order.
    return t.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), " ").alias("abstract"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, stem, content, front``: Markdown notes below a folder, hidden and backup files left out, the front matter as a map."""
    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    t = t.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    t = t.withColumn("stem", F.regexp_replace(F.url_decode(name), r"\.md$", "")).where(~F.col("path").rlike(r"/\.[^/]") & ~F.col("path").contains(".bak-"))
    block = F.regexp_extract("content", r"(?s)\A---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: s.rlike(r"^[\w-]+\s*:"))
    keys = F.transform(lines, lambda s: F.trim(F.substring_index(s, ":", 1)))
    values = F.transform(lines, lambda s: F.btrim(F.regexp_replace(F.substring(s, F.locate(":", s) + 1, F.lit(2**20)), r"\s+#.*$", ""), F.lit(" \"'")))
    pairs = F.arrays_zip(keys, values)
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["0"]) == i + 1)
    return t.withColumn("front", F.map_from_arrays(F.transform(first, lambda p: p["0"]), F.transform(first, lambda p: p["1"])))


def quartiles(reference: DataFrame) -> DataFrame:
    """The journal list under its normal key; rows without a quartile stay out, of equal keys the last counts."""
    from scholion.functions.text import journal_key

    t = reference.where("journal is not null and quartile is not null").withColumn("key", journal_key("journal")).where("key <> ''")
    return t.groupBy("key").agg(F.max_by(F.struct("journal", "quartile", "top", "open_access"), "journal_id").alias("r")).select("key", "r.*")
