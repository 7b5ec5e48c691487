"""Queries of the record, figure and rule operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from scholion.functions import html, records, text as tx
from scholion.operators import evidence, rules
from scholion.plans import sql
from scholion.plans.triage_queries import _full
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


_v = "trim(coalesce({v}, ''))"
_DOI = f"""CASE WHEN regexp_matches({_v}, '^https?://(dx\\.)?doi\\.org/.') THEN 'x' WHEN regexp_matches({_v}, '^10\\.\\d{{{{4,9}}}}/\\S') THEN 'x' WHEN regexp_matches({_v}, '(?i)/doi/(abs/|full/|pdf/)?10\\.\\d{{{{4,9}}}}/[^\\s?#"'']') THEN 'x' ELSE '' END"""
_KIND = f"""CASE WHEN regexp_matches(lower({_v}), '^https?://') THEN CASE WHEN contains({_v}, 'pubmed.ncbi.nlm.nih.gov') THEN 'pubmed_url' WHEN contains({_v}, 'pmc.ncbi.nlm.nih.gov') THEN 'pmc_url'
 WHEN ends_with(lower({_v}), '.pdf') THEN 'pdf_url' WHEN regexp_matches(lower({_v}), 'oup\\.com|pnas\\.org|sciencedirect\\.com|nature\\.com|wiley\\.com|springer\\.com') THEN 'web_url' WHEN {_DOI} <> '' THEN 'doi' ELSE 'web_url' END
 WHEN {_DOI} <> '' THEN 'doi' WHEN regexp_matches(lower({_v}), '[^/]\\.pdf$') THEN 'local_pdf' ELSE 'web_url' END"""


@query(f"SELECT entry_id, {_KIND.format(v='id')} AS id_kind, {_KIND.format(v='pdf')} AS pdf_kind, {_KIND.format(v='url')} AS url_kind FROM papers")
def source_kinds(spark, sf):
    return table(spark, sf, "papers").select("entry_id", *[records.source_kind(c).alias(f"{c}_kind") for c in ("id", "pdf", "url")])


@query("""SELECT entry_id, CASE WHEN regexp_matches(lower(trim(coalesce(doi, ''))), '^10\\.(1016|1006|1053|1054|1067|1078|1383)/') THEN ''
 WHEN regexp_matches(lower(coalesce(source, '')), 'biorxiv|medrxiv|preprint') AND regexp_matches(coalesce(doi, ''), '10\\.1101/\\S+') THEN 'https://www.biorxiv.org/content/10.1101/' || regexp_extract(trim(doi), '10\\.1101/(\\S+)', 1)
 WHEN trim(coalesce(pmc_id, '')) <> '' THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || regexp_replace(trim(pmc_id), '(?i)^PMC', '') || '/'
 WHEN regexp_matches(trim(coalesce(id, '')), '^[0-9]+$') THEN 'https://europepmc.org/article/MED/' || trim(id) ELSE '' END AS page FROM papers""")
def page_urls(spark, sf):
    return table(spark, sf, "papers").select("entry_id", records.page_url().alias("page"))


@query("""SELECT doi_prefix, count(*) AS n FROM (SELECT split_part(regexp_extract(coalesce(doi, ''), '(10\\.\\d{4,9}/\\S+)', 1), '/', 1) AS doi_prefix FROM papers) GROUP BY 1""")
def doi_prefixes(spark, sf):
    prefix = F.element_at(F.split(F.regexp_extract(tx.text("doi"), r"(10\.\d{4,9}/\S+)", 1), "/"), 1)
    return table(spark, sf, "papers").groupBy(prefix.alias("doi_prefix")).agg(F.count("*").alias("n"))


_ITEMS = "WITH i AS (SELECT record_id, unnest(figure_items) AS f, generate_subscripts(figure_items, 1) AS pos FROM reader_records WHERE figure_items IS NOT NULL)"


@query(_ITEMS + """, p AS (SELECT record_id, pos, f, lower(coalesce(f.src, '') || ' ' || coalesce(f.href, '')) AS a, lower(coalesce(f.caption, '') || ' ' || coalesce(f.alt, '')) AS w FROM i)
SELECT record_id, CAST(pos AS INTEGER) AS pos, CAST(
 CASE WHEN regexp_matches(a, '(^|[-_/])(fig(ure)?[-_]?0?1|f0?1|gr1)(\\.|[-_/]|$)') THEN 220 WHEN regexp_matches(a, '[a-z0-9]+f0?1\\.(jpe?g|png|webp|gif)') THEN 180
      WHEN regexp_matches(w, '^\\s*(fig(ure)?\\.?\\s*1\\b|1[.)])') THEN 120 WHEN regexp_matches(w, '\\bfig(ure)?\\.?\\s*1\\b') THEN 35 ELSE 0 END
 + CASE WHEN regexp_matches(a, '(^|[-_/])(fig(ure)?[-_]?[2-9]|f[2-9]|gr[2-9])(\\.|[-_/]|$)|[a-z0-9]+f[2-9]\\.(jpe?g|png|webp|gif)') THEN -120 ELSE 0 END
 + CASE WHEN regexp_matches(a || ' ' || w, 'graphical abstract|ga1\\.|[-_/]fa\\.|unfig') THEN -90 ELSE 0 END + CASE WHEN contains(a, '/view-large/figure/') THEN 100 ELSE 0 END
 + CASE WHEN regexp_matches(a || ' ' || w, 'logo|spinner|icon|avatar|advert') THEN -200 ELSE 0 END + CASE WHEN f.source IN ('figure', 'dom_figure', 'dom_view_large') THEN 20 ELSE 0 END AS INTEGER) AS points FROM p""")
def figure_scores(spark, sf):
    t = table(spark, sf, "reader_records").select("record_id", F.posexplode("figure_items").alias("p", "f"))
    return t.select("record_id", (F.col("p") + 1).alias("pos"), records.figure_points(F.col("f")).alias("points"))


_POINTS = _ITEMS + """, p AS (SELECT record_id, pos, f, lower(coalesce(f.src, '') || ' ' || coalesce(f.href, '')) AS a, lower(coalesce(f.caption, '') || ' ' || coalesce(f.alt, '')) AS w FROM i)
SELECT record_id, CAST(pos AS INTEGER) AS pos, CAST(
 CASE WHEN regexp_matches(a, '(^|[-_/])(fig(ure)?[-_]?0?1|f0?1|gr1)(\\.|[-_/]|$)') THEN 220 WHEN regexp_matches(a, '[a-z0-9]+f0?1\\.(jpe?g|png|webp|gif)') THEN 180
      WHEN regexp_matches(w, '^\\s*(fig(ure)?\\.?\\s*1\\b|1[.)])') THEN 120 WHEN regexp_matches(w, '\\bfig(ure)?\\.?\\s*1\\b') THEN 35 ELSE 0 END
 + CASE WHEN regexp_matches(a, '(^|[-_/])(fig(ure)?[-_]?[2-9]|f[2-9]|gr[2-9])(\\.|[-_/]|$)|[a-z0-9]+f[2-9]\\.(jpe?g|png|webp|gif)') THEN -120 ELSE 0 END
 + CASE WHEN regexp_matches(a || ' ' || w, 'graphical abstract|ga1\\.|[-_/]fa\\.|unfig') THEN -90 ELSE 0 END + CASE WHEN contains(a, '/view-large/figure/') THEN 100 ELSE 0 END
 + CASE WHEN regexp_matches(a || ' ' || w, 'logo|spinner|icon|avatar|advert') THEN -200 ELSE 0 END + CASE WHEN f.source IN ('figure', 'dom_figure', 'dom_view_large') THEN 20 ELSE 0 END AS INTEGER) AS points, f FROM p"""


@query(f"""WITH s AS ({_POINTS}), k AS (SELECT record_id, pos, points, coalesce(nullif(f.source_url, ''), nullif(f.src, ''), nullif(f.path, '')) AS address FROM s),
d AS (SELECT * FROM k WHERE address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, address ORDER BY points DESC, pos) = 1)
SELECT record_id, pos, points, address FROM d QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY points DESC, pos) <= 3""")
def top_figures(spark, sf):
    present = lambda f, c: F.when(F.coalesce(f[c], F.lit("")) != "", f[c])
    item = lambda f, i: F.struct((-records.figure_points(f)).alias("worst"), (i + 1).alias("pos"), F.coalesce(*[present(f, c) for c in ("source_url", "src", "path")]).alias("address"))
    # The figures of a record are a short list, sorted inside the row; of an address the best comes first.
    ranked = F.array_sort(F.filter(F.transform(F.col("figure_items"), item), lambda k: k["address"].isNotNull()))
    once = F.filter(ranked, lambda k, i: F.array_position(F.transform(ranked, lambda o: o["address"]), k["address"]) == i + 1)
    t = table(spark, sf, "reader_records").select("record_id", F.explode(F.slice(once, 1, 3)).alias("k"))
    return t.select("record_id", "k.pos", (-F.col("k.worst")).alias("points"), "k.address")


@query(f"""WITH c AS (SELECT record_id, list_filter(list_transform(coalesce(figure_items, []), lambda i: {sql.squash("coalesce(nullif(i.caption, ''), i.alt)")}), lambda s: s <> '') AS s FROM reader_records)
SELECT record_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i)[1:3], chr(10)) AS said FROM c""")
def figure_takeaways(spark, sf):
    return table(spark, sf, "reader_records").select("record_id", F.array_join(records.takeaways(F.col("figure_items")), "\n").alias("said"))


_RULES = (("sensory", ("taste", "sensory", "neural")), ("plants", ("seed", "crop", "plant", "root")), ("care", ("tumour", "clinical", "therapy")), ("genes", ("gene", "genome", "haplotype")), ("people", ("prevalence", "population", "outbreak")))
_points = lambda ks: " + ".join(f"2 * len(list_filter(tags, lambda t: contains(t, '{k}') OR contains('{k}', t))) + CAST(contains(title, '{k}') AS INTEGER)" for k in ks)


@query(f"""WITH p AS (SELECT entry_id, list_transform(coalesce(keywords, []), lambda k: lower(k)) AS tags, lower(coalesce(title, '')) AS title FROM papers),
s AS (SELECT entry_id, tags, list_sort([{', '.join(f"struct_pack(p := {_points(k)}, o := {-i}, c := '{c}')" for i, (c, k) in enumerate(_RULES))}])[-1] AS b FROM p)
SELECT entry_id, CASE WHEN len(tags) > 0 AND b.p > 0 THEN b.c ELSE 'inbox' END AS category FROM s""")
def categories(spark, sf):
    return rules.categories(table(spark, sf, "papers"), "entry_id", "keywords", "title", _RULES)


@query("SELECT DISTINCT h.entry_id, p.prefix FROM history h JOIN (SELECT DISTINCT substring(title, 1, 40) AS prefix FROM papers WHERE length(title) >= 40) p ON starts_with(h.title, p.prefix)")
def title_prefixes(spark, sf):
    prefixes = table(spark, sf, "papers").where(F.length("title") >= 40).select(F.substring("title", 1, 40).alias("prefix"))
    return rules.prefix_join(table(spark, sf, "history"), "entry_id", "title", prefixes, "prefix", 20)


@query("""WITH k AS (SELECT DISTINCT unnest(list_concat([coalesce(url, '')], regexp_extract_all(coalesce(url, ''), '\\d{7,}'))) AS key, url, entry_id FROM papers WHERE coalesce(url, '') <> '')
SELECT key, max_by(url, entry_id) AS stem FROM k WHERE key <> '' GROUP BY key""")
def note_index(spark, sf):
    return rules.lookup_index(table(spark, sf, "papers").where(tx.text("url") != ""), "url", "entry_id")


@query(f"SELECT record_id, CAST(CASE WHEN {_full} THEN 100000 ELSE 0 END + length({sql.squash('full_text')}) + 5000 * least(len(coalesce(figure_items, [])), 4) + 500 * least(len(coalesce(section_headers, [])), 10) + CASE WHEN {sql.squash('title')} <> '' THEN 2000 ELSE 0 END AS INTEGER) AS quality FROM reader_records")
def snapshot_quality(spark, sf):
    r = table(spark, sf, "reader_records")
    return r.select("record_id", evidence.snapshot_quality("title", "full_text", F.col("figure_items"), F.col("section_headers")).alias("quality"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN printf('%.2f', n_chars / 1024.0) || ' KB' ELSE printf('%.2f', n_chars / 1048576.0) || ' MB' END AS size FROM documents")
def document_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", records.byte_text("n_chars").alias("size"))


@query("""SELECT entry_id, CASE WHEN trim(coalesce(date, '')) = '' THEN 'empty' WHEN regexp_matches(trim(date), '^-?\\d+$') THEN 'int' WHEN regexp_matches(trim(date), '^-?\\d+\\.\\d+$') THEN 'float' WHEN lower(trim(date)) IN ('true', 'false') THEN 'bool' ELSE 'text' END AS kind FROM papers""")
def scalar_kinds(spark, sf):
    return table(spark, sf, "papers").select("entry_id", records.scalar_kind("date").alias("kind"))


@query("SELECT doc_id, contains(lower(text), 'patient') OR contains(lower(text), 'clinical trial') OR contains(lower(text), 'cohort study') OR contains(lower(text), 'human subject') OR contains(lower(text), 'in vivo') OR contains(lower(text), 'animal model') OR contains(lower(text), 'mouse model') OR contains(lower(text), 'rat model') OR contains(lower(text), 'field study') OR contains(lower(text), 'field collection') OR contains(lower(text), 'wild population') OR contains(lower(text), 'natural population') OR contains(lower(text), 'museum specimen') AS living FROM documents")
def real_world_evidence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", html.real_world("text").alias("living"))


@query(f"WITH t AS (SELECT doc_id, {sql.squash('text')} AS s FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(s, '[.!?。！？] ')) AS INTEGER) AS breaks FROM t")
def sentence_breaks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(tx.squash("text"), F.lit("[.!?。！？] ")).alias("breaks"))


@query("SELECT entry_id, list_filter(string_split(authors, ','), lambda a: trim(a) <> '')[1] AS first_author, CAST(len(list_filter(string_split(coalesce(authors, ''), ','), lambda a: trim(a) <> '')) AS INTEGER) AS n FROM papers")
def author_lists(spark, sf):
    names = F.filter(F.split(tx.text("authors"), ","), lambda a: F.trim(a) != "")
    return table(spark, sf, "papers").select("entry_id", F.try_element_at(names, F.lit(1)).alias("first_author"), F.size(names).alias("n"))


@query(f"SELECT record_id, {sql.contains_any('lower(' + sql.squash('title') + ')', evidence.NO_TITLE)} AS none, CASE WHEN {sql.squash('full_text')} = '' THEN 'abstract' ELSE 'full' END AS branch FROM reader_records")
def enrichment_branches(spark, sf):
    title = F.lower(tx.squash("title"))
    none = F.lit(False)
    for t in evidence.NO_TITLE:
        none = none | title.contains(t)
    return table(spark, sf, "reader_records").select("record_id", none.alias("none"), F.when(tx.squash("full_text") == "", "abstract").otherwise("full").alias("branch"))


@query(f"""WITH p AS (SELECT entry_id, source, list_transform(coalesce(keywords, []), lambda k: lower(k)) AS tags, lower(coalesce(title, '')) AS title FROM papers),
s AS (SELECT entry_id, source, tags, list_sort([{', '.join(f"struct_pack(p := {_points(k)}, o := {-i}, c := '{c}')" for i, (c, k) in enumerate(_RULES))}])[-1] AS b FROM p)
SELECT source, CASE WHEN len(tags) > 0 AND b.p > 0 THEN b.c ELSE 'inbox' END AS category, count(*) AS n FROM s GROUP BY 1, 2""")
def distribution(spark, sf):
    papers = table(spark, sf, "papers")
    # The key carries the source along, so that no join is needed to count by it.
    found = rules.categories(papers.withColumn("key", F.struct("source", "entry_id")), "key", "keywords", "title", _RULES)
    return found.groupBy(F.col("key.source").alias("source"), "category").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) SELECT key, count(*) AS n FROM k GROUP BY key""")
def json_keys(spark, sf):
    keys = F.explode(F.json_object_keys("props"))
    return table(spark, sf, "events").where("props is not null").select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
