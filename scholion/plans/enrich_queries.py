"""Queries of source formats, enrichment, notes, indexes and guards; with their SQL.

Where a source's format is not among the tables, the query writes a record in that format from a row and reads it
back; the SQL gives the row's own fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from scholion.functions import formats as fm, text as tx
from scholion.operators import enrich, evidence, lines, rules
from scholion.plans import reader_queries as rq, sql
from scholion.session import table

_Q: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        _Q[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle
        return f

    return add


_sq = sql.squash
_text = "'[<>&]'"
_esc = lambda c: F.replace(F.replace(F.replace(tx.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
#: Characters that XML cannot hold are left out of the records written.
_legal = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
_lsq = lambda c: _sq(f"regexp_replace(coalesce({c}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")


@query(f"""SELECT record_id, {_lsq('title')} AS title, {_lsq('abstract')} AS abstract, concat_ws(chr(10), 'Results', nullif({_lsq('abstract')}, ''), nullif({_lsq('journal')}, '')) AS body FROM reader_records""")
def jats_articles(spark, sf):
    t = table(spark, sf, "reader_records").select("record_id", *[_legal(_esc(c)).alias(c) for c in ("title", "abstract", "journal")])
    doc = F.concat(
        F.lit("<?xml version='1.0'?><article><front><article-meta><title-group><article-title>"), "title", F.lit("</article-title></title-group><abstract><p>"), "abstract",
        F.lit("</p></abstract></article-meta></front><body><sec><title>Results</title><p>"), "abstract", F.lit("</p><fig><caption><p>not this</p></caption></fig><table-wrap><p>nor this</p></table-wrap></sec><sec><p>"), "journal",
        F.lit("</p></sec><ack><p>thanks</p></ack></body><back><ref-list><p>x</p></ref-list></back></article>"),
    )
    t = t.select("record_id", doc.alias("x"))
    return t.select("record_id", fm.jats_title("x").alias("title"), fm.jats_abstract("x").alias("abstract"), fm.jats_body("x").alias("body"))


@query(f"""SELECT entry_id, '2501.' || lpad(CAST(entry_id % 100000 AS VARCHAR), 5, '0') AS id, {_lsq('title')} AS title, CAST(batch_date AS VARCHAR) AS day, {_lsq('authors')} AS authors FROM papers""")
def feed_entries(spark, sf):
    t = table(spark, sf, "papers")
    number = F.lpad((F.col("entry_id") % 100000).cast("string"), 5, "0")
    doc = F.concat(F.lit("<entry><id>http://arxiv.example/abs/2501."), number, F.lit("v1</id><title> "), _legal(_esc("title")), F.lit("\n</title><summary>s</summary><published>"), F.col("batch_date").cast("string"), F.lit("T00:00:00Z</published><author><name>"), _legal(_esc("authors")), F.lit("</name></author></entry>"))
    got = t.select("entry_id", fm.feed_entry(doc).alias("e"))
    return got.select("entry_id", "e.id", "e.title", "e.day", F.array_join("e.authors", "|").alias("authors"))


@query("""SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN '2024-03-07' WHEN 1 THEN '2023-11' WHEN 2 THEN '2022' ELSE '' END AS day FROM papers""")
def metadata_days(spark, sf):
    doc = F.expr("""CASE entry_id % 4 WHEN 0 THEN '{"message": {"issued": {"date-parts": [[2021]]}, "published-print": {"date-parts": [[2024, 3, 7]]}}}' WHEN 1 THEN '{"message": {"published-print": {"date-parts": [[null]]}, "published-online": {"date-parts": [[2023, 11]]}}}'
        WHEN 2 THEN '{"message": {"issued": {"date-parts": [[2022]]}, "title": ["x"]}}' ELSE 'no json' END""")
    return table(spark, sf, "papers").select("entry_id", fm.metadata_day(doc).alias("day"))


@query("SELECT entry_id, CASE WHEN entry_id % 5 + 1 <= entry_id % 3 + 1 THEN entry_id % 5 + 1 ELSE entry_id % 3 + 1 END AS version FROM papers")
def preprint_versions(spark, sf):
    versions = F.expr("transform(sequence(1, entry_id % 3 + 1), v -> named_struct('version', v, 'title', title))")
    return table(spark, sf, "papers").select("entry_id", fm.chosen_version(versions, F.col("entry_id") % 5 + 1)["version"].alias("version"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE len(json_keys(props)) END AS n FROM events WHERE props IS NOT NULL")
def embedded_objects(spark, sf):
    said = F.when(F.col("event_id") % 3 == 2, "no object { here").otherwise(F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n``` done")))
    got = fm.embedded_object(said)
    return table(spark, sf, "events").where("props is not null").select("event_id", F.json_array_length(F.to_json(F.json_object_keys(F.to_json(got)))).cast("long").alias("n"))


@query("""SELECT doc_id, doc_id % 6 IN (0, 4) AS figure, doc_id % 6 = 5 AS pdf FROM documents""")
def binary_checks(spark, sf):
    # A large PNG, a small one, one that says it is a page, a short JPEG, a long JPEG, a PDF.
    data = F.expr("""CASE doc_id % 6 WHEN 0 THEN concat(unhex('89504E470D0A1A0A0000000D4948445200000400000000C8'), cast(repeat('x', 6000) AS binary)) WHEN 1 THEN concat(unhex('89504E470D0A1A0A0000000D494844520000006400000064'), cast(repeat('x', 6000) AS binary))
        WHEN 2 THEN concat(unhex('89504E470D0A1A0A0000000D4948445200000400000004C8'), cast(repeat('x', 6000) AS binary)) WHEN 3 THEN unhex('FFD8FF00') WHEN 4 THEN concat(unhex('FFD8FF00'), cast(repeat('x', 6000) AS binary)) ELSE concat(cast('%PDF-1.4' AS binary), cast(repeat('x', 6000) AS binary)) END""")
    kind = F.when(F.col("doc_id") % 6 == 2, "text/html").otherwise("image/png")
    return table(spark, sf, "documents").select("doc_id", fm.is_figure(data, kind).alias("figure"), fm.is_usable_pdf(data).alias("pdf"))


@query("""SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN 'a|b, c|d' WHEN 1 THEN 'x # y' WHEN 2 THEN 'v' ELSE '' END AS items FROM papers""")
def front_values(spark, sf):
    value = F.expr("""CASE entry_id % 4 WHEN 0 THEN '[a, "b, c", \\'d\\'] # some' WHEN 1 THEN '"x # y"' WHEN 2 THEN ' v # note' ELSE '[]' END""")
    return table(spark, sf, "papers").select("entry_id", F.array_join(fm.front_value(value), "|").alias("items"))


# Enrichment.

_living = sql.contains_any("lower(coalesce(abstract, ''))", ("patient", "clinical trial", "cohort study", "human subject", "in vivo", "animal model", "mouse model", "rat model", "field study", "field collection", "wild population", "natural population", "museum specimen"))


@query(f"""SELECT record_id, CASE WHEN record_id % 4 = 0 THEN '' ELSE 'Results|Materials and Methods' END AS headings, CASE WHEN record_id % 4 = 0 THEN '' ELSE 'https://img.example/f1.png' END AS figure_url,
 {_living} AS living, CASE WHEN record_id % 4 = 0 THEN 'abstract' ELSE 'page' END AS read_from FROM {rq._SAFE}""")
def enriched_records(spark, sf):
    t = table(spark, sf, "reader_records").where("not rlike(concat_ws(' ', abstract, array_join(affiliations, ' '), array_join(authors, ' '), array_join(transform(figure_items, f -> coalesce(f.caption, '')), ' ')), '[<>&\"\\']')")
    page = F.concat(F.lit("<html><body><img src='/logo.png'><h2>1 Results</h2><p>"), tx.text("abstract"), F.lit("</p><img alt='x' src='//img.example/f1.png'><h3>2.1 Materials and Methods</h3><p>"), F.rpad(F.lit("We weighed jars. "), 200, "We weighed jars. "), F.lit("</p></body></html>"))
    t = t.select("record_id", "abstract", F.when(F.col("record_id") % 4 == 0, F.lit("<html>short</html>")).otherwise(page).alias("page"))
    got = enrich.enrich(t, "record_id")
    return got.select("record_id", F.array_join("section_headers", "|").alias("headings"), "figure_url", F.col("has_real_world").alias("living"), "read_from")


_blocked = lambda c: sql.contains_any(f"lower({_sq(f'substring({_sq(c)}, 1, 4000)')})", evidence.BLOCKED)
_wall = lambda c: f"({sql.contains_any(f'lower(substring({_sq(c)}, 1, 6000))', evidence.COOKIE)} AND NOT {sql.contains_any(f'lower(substring({_sq(c)}, 1, 6000))', evidence.ARTICLE)})"
_quality = lambda c: f"CASE WHEN {_sq(c)} = '' OR {_blocked(c)} OR {_wall(c)} THEN -1 ELSE length({_sq(c)}) + 4000 * {sql.section_hits(_sq(c))} END"


@query(f"WITH q AS (SELECT record_id, full_text, abstract, {_quality('full_text')} AS a, {_quality('abstract')} AS b FROM reader_records) SELECT record_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, length(CASE WHEN a < 0 AND b < 0 THEN '' WHEN a >= b THEN coalesce(full_text, '') ELSE coalesce(abstract, '') END) AS n FROM q")
def better_texts(spark, sf):
    return table(spark, sf, "reader_records").select("record_id", evidence.text_quality("full_text").alias("a"), evidence.text_quality("abstract").alias("b"), F.length(enrich.better_text("full_text", "abstract")).cast("long").alias("n"))


@query("""SELECT record_id, CASE WHEN regexp_matches(lower(p), 'api|xml|openalex|crossref') THEN CASE WHEN pdf AND NOT contains(lower(p), 'pdf') THEN p || ' + PDF' ELSE p END WHEN source_kind = 'web' THEN CASE WHEN pdf THEN 'page + PDF' ELSE 'page' END
 WHEN source_kind = 'pdf' THEN 'local PDF' WHEN pdf THEN coalesce(nullif(p, ''), 'PDF') WHEN coalesce(full_text, '') <> '' THEN coalesce(nullif(p, ''), 'page') ELSE p END AS got FROM (SELECT *, trim(coalesce(acquisition_path, '')) AS p, record_id % 3 = 0 AS pdf FROM reader_records)""")
def acquisition_paths(spark, sf):
    kind = F.when(F.col("source_kind") == "web", "web_url").when(F.col("source_kind") == "pdf", "local_pdf").otherwise(F.col("source_kind"))
    return table(spark, sf, "reader_records").select("record_id", enrich.acquisition("acquisition_path", kind, tx.text("full_text") != "", F.col("record_id") % 3 == 0).alias("got"))


@query("""WITH r AS (SELECT batch_date, count(*) AS rows, count(CASE WHEN coalesce(id, '') = '' THEN 1 END) AS errors, count(DISTINCT entry_id) AS expected, CAST(max(fetched_at) AS DATE) AS window_end FROM papers GROUP BY batch_date)
SELECT batch_date, concat_ws(',', CASE WHEN rows = 0 AND errors > 0 THEN 'status' END, CASE WHEN window_end <> batch_date THEN 'window' END, CASE WHEN errors > 0 THEN 'errors' END, CASE WHEN rows <> expected THEN 'rows' END) AS faults FROM r""")
def run_guards(spark, sf):
    runs = table(spark, sf, "papers").groupBy("batch_date").agg(
        F.count("*").alias("rows"), F.count(F.when(tx.text("id") == "", 1)).alias("errors"), F.count_distinct("entry_id").alias("expected"), F.to_date(F.max("fetched_at")).alias("window_end")
    )
    runs = runs.withColumn("status", F.when((F.col("rows") == 0) & (F.col("errors") > 0), "failed").otherwise("success")).withColumn("expected_end", F.col("batch_date"))
    return enrich.run_guards(runs).select("batch_date", "faults")


# Lines, notes and indexes.


@query(f"SELECT entry_id, {_sq('abstract')} AS abstract, {_sq('''array_to_string(coalesce(keywords, []), '; ')''')} AS keywords FROM papers WHERE NOT regexp_matches(lower(coalesce(abstract, '')), 'keywords|introduction|abstract')")
def captured_sections(spark, sf):
    t = table(spark, sf, "papers").where("not rlike(lower(coalesce(abstract, '')), 'keywords|introduction|abstract')")
    words = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), "; ")
    paper = F.concat(F.lit("A title\nABSTRACT: "), tx.text("abstract"), F.lit("\nKeywords: "), words, F.lit("\n\n1 Introduction\nMore."))
    got = lambda start, stop: tx.squash(lines.between(paper, start, stop))
    return t.select("entry_id", got(r"\babstract\b\s*:?", r"\n\s*keywords\b").alias("abstract"), got(r"\n\s*keywords\s*:", r"\n\s*\n|\n\s*1 Introduction").alias("keywords"))


@query(f"""SELECT record_id, concat_ws(chr(10), '---', 'title: "' || replace({_sq('title')}, '"', '\\"') || '"', CASE WHEN {_sq('doi')} <> '' THEN 'doi: ' || {_sq('doi')} END, 'tags: [' || array_to_string(coalesce(keywords, []), ', ') || ']', '---', '',
 '# ' || {_sq('title')}, '', '## Abstract', {_sq('abstract')}) AS note FROM reader_records""")
def notes(spark, sf):
    title, doi = tx.squash("title"), tx.squash("doi")
    front = [F.lit("---"), F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')), F.when(doi != "", F.concat(F.lit("doi: "), doi)), F.concat(F.lit("tags: ["), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", "), F.lit("]")), F.lit("---")]
    body = [F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.lit("## Abstract"), tx.squash("abstract")]
    return table(spark, sf, "reader_records").select("record_id", F.concat_ws("\n", *front, *body).alias("note"))


@query("""WITH n AS (SELECT r_name, n_name, count(s_suppkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name AS folder, '# ' || r_name || chr(10) || string_agg('- [[' || n_name || ']] (' || n || ')', chr(10) ORDER BY n_name) AS page FROM n GROUP BY r_name""")
def index_pages(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct("n_name", F.concat(F.lit("- [["), "n_name", F.lit("]] ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")).alias("line"))
    # An index page lists the folders of one folder: as many as a directory holds.
    page = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n")
    return n.groupBy(F.col("r_name").alias("folder")).agg(F.concat(F.lit("# "), F.first("r_name"), F.lit("\n"), page).alias("page"))


@query("""SELECT p.entry_id, min(h.entry_id) AS note FROM papers p LEFT JOIN history h ON length(p.title) >= 30 AND length(h.title) >= 30 AND starts_with(h.title, substring(p.title, 1, 30)) GROUP BY p.entry_id""")
def linked_notes(spark, sf):
    p = table(spark, sf, "papers").select("entry_id", F.when(F.length("title") >= 30, F.substring("title", 1, 30)).alias("prefix"))
    found = rules.prefix_join(table(spark, sf, "history"), "entry_id", "title", p.select("prefix"), "prefix", 30).groupBy("prefix").agg(F.min("entry_id").alias("note"))
    return p.join(found, "prefix", "left").select("entry_id", "note")


@query("SELECT batch_date, count(*) AS n, '# ' || CAST(batch_date AS VARCHAR) || ': ' || count(*) || ' papers, ' || count(CASE WHEN coalesce(score, 0) >= 4 THEN 1 END) || ' strong' AS header FROM papers GROUP BY batch_date")
def report_headers(spark, sf):
    t = table(spark, sf, "papers").groupBy("batch_date").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce("score", F.lit(0)) >= 4, 1)).alias("s"))
    return t.select("batch_date", "n", F.concat(F.lit("# "), F.col("batch_date").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" papers, "), F.col("s").cast("string"), F.lit(" strong")).alias("header"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
