"""Queries of the reader's operators: titles, sentences, addresses, pages, notes, library tables; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions import html, publishers as pub, reader as rd, records, text as tx
from scholion.operators import dates
from scholion.plans import sql
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


def _papers(spark, sf) -> DataFrame:
    return table(spark, sf, "papers")


def _records(spark, sf) -> DataFrame:
    return table(spark, sf, "reader_records")


_sq = sql.squash
_list = lambda values: "(" + ", ".join(map(sql.quoted, values)) + ")"

# Titles, sentences, names.


@query(f"SELECT record_id, CASE WHEN lower({_sq('title')}) IN {_list(rd.NO_TITLES)} THEN '' ELSE {_sq('title')} END AS title FROM reader_records")
def record_titles(spark, sf):
    return _records(spark, sf).select("record_id", rd.record_title("title").alias("title"))


_parts = lambda c: f"list_filter(regexp_split_to_array(regexp_replace({_sq(c)}, '([.!?。！？]) ', '\\1\x01', 'g'), '\x01'), lambda s: s <> '')"


@query(f"SELECT entry_id, coalesce({_parts('abstract')}[1], '') AS first, array_to_string({_parts('abstract')}[1:4], '|') AS chunks FROM papers")
def first_sentences(spark, sf):
    return _papers(spark, sf).select("entry_id", tx.first_sentence("abstract").alias("first"), F.array_join(rd.chunks("abstract", 4), "|").alias("chunks"))


@query(f"""SELECT entry_id, array_to_string(list_filter({_parts('abstract')}[1:4], lambda s: NOT (length(s) < 18 AND lower(s) IN {_list(rd.HEADINGS)}) AND NOT (regexp_full_match(s, '[A-Z0-9 ,:;()-]+') AND length(s) <= 40))[1:2], '|') AS said FROM papers""")
def article_sentences(spark, sf):
    return _papers(spark, sf).select("entry_id", F.array_join(rd.article_sentences("abstract", 2), "|").alias("said"))


@query(f"SELECT entry_id, CASE WHEN {_sq('title')} = '' THEN 'What core question does this study ask?' ELSE regexp_replace({_sq('title')}, '[.?!]+$', '') || '?' END AS question FROM papers")
def title_questions(spark, sf):
    return _papers(spark, sf).select("entry_id", rd.asked("title").alias("question"))


@query(f"""WITH k AS (SELECT record_id, list_filter(list_transform(coalesce(keywords, []), lambda k: {_sq('k')}), lambda k: k <> '')[1:3] AS k FROM reader_records)
SELECT record_id, CASE WHEN len(k) = 0 THEN '- No evidence available.' ELSE array_to_string(list_transform(k, lambda x: '- ' || x), chr(10)) END AS said FROM k""")
def keyword_bullets(spark, sf):
    return _records(spark, sf).select("record_id", tx.bullets(F.coalesce("keywords", F.array().cast("array<string>")), 3, "- No evidence available.").alias("said"))


_tidy = lambda c: f"array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda s: regexp_replace(regexp_replace(s, '[ \\t]+', ' ', 'g'), '^{sql.SPACE}+|{sql.SPACE}+$', '', 'g')), lambda s: s <> ''), chr(10))"


@query(f"SELECT record_id, {_tidy('full_text')} AS lines FROM reader_records")
def structured_text(spark, sf):
    return _records(spark, sf).select("record_id", rd.tidy_lines("full_text").alias("lines"))


_nn = f"""trim(substring({_sq("regexp_replace(coalesce(title, ''), '[\\\\/:*\"<>|]', ' ', 'g')")}, 1, 110), ' .')"""
_tp = f"trim(regexp_replace(regexp_replace(coalesce(title, ''), '{sql.INVISIBLE.replace('x{FEFF}', 'x{200B}')}+', '', 'g'), '{sql.SPACE}+', ' ', 'g'), ' .;:,')"


@query(f"""SELECT record_id, CASE WHEN {_nn} = '' THEN 'untitled' ELSE {_nn} END AS name, trim(substring({_sq(f"regexp_replace({_tp}, '[:*?\"<>|]', ' ', 'g')")}, 1, 60)) AS prefix FROM reader_records""")
def note_names(spark, sf):
    return _records(spark, sf).select("record_id", rd.note_name("title").alias("name"), rd.title_prefix("title").alias("prefix"))


_marks = " + ".join(f"(length(t) - length(replace(t, '{m}', '')))" for m in rd.MARKERS)


@query(f"WITH r AS (SELECT record_id, coalesce(full_text, '') || coalesce(title, '') AS t FROM reader_records) SELECT record_id, ({_marks}) >= 4 OR ((contains(t, '锟') OR contains(t, '�')) AND length(regexp_replace(t, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) > 8) AS wrong FROM r")
def wrongly_decoded(spark, sf):
    return _records(spark, sf).select("record_id", rd.wrongly_decoded(F.concat(tx.text("full_text"), tx.text("title"))).alias("wrong"))


@query("""WITH k AS (SELECT record_id, list_filter(coalesce(keywords, []), lambda k: k IS NOT NULL) AS k FROM reader_records)
SELECT record_id, CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(list_transform(k, lambda x: '- [[' || x || ']]'), chr(10)) END AS concepts FROM k""")
def concept_lines(spark, sf):
    linked = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit("[["), k, F.lit("]]")))
    return _records(spark, sf).select("record_id", rd.concept_lines(F.when(F.col("record_id") % 2 == 0, F.array_join(linked, " - ")).otherwise(F.array_join(linked, "  "))).alias("concepts"))


_LINE = "CASE record_id % 5 WHEN 0 THEN '- Finding: ' WHEN 1 THEN '2) basis ： ' WHEN 2 THEN '* ' WHEN 3 THEN '** caption: ' ELSE '' END || coalesce(title, '')"


@query(f"""SELECT record_id, CASE record_id % 5 WHEN 0 THEN CASE WHEN {_sq('title')} = '' THEN '' ELSE 'finding' END WHEN 1 THEN CASE WHEN {_sq('title')} = '' THEN '' ELSE 'basis' END ELSE '' END AS label,
 CASE record_id % 5 WHEN 0 THEN CASE WHEN {_sq('title')} = '' THEN 'Finding:' ELSE {_sq('title')} END WHEN 1 THEN CASE WHEN {_sq('title')} = '' THEN 'basis ：' ELSE {_sq('title')} END
 WHEN 2 THEN CASE WHEN {_sq('title')} = '' THEN '*' ELSE {_sq('title')} END WHEN 3 THEN {_sq("'** caption: ' || coalesce(title, '')")} ELSE regexp_replace({_sq('title')}, '^([-•] |\\d+[.)] )', '') END AS said FROM reader_records""")
def section_line_labels(spark, sf):
    label, said = rd.section_line(F.expr(_LINE))
    return _records(spark, sf).select("record_id", label.alias("label"), said.alias("said"))


@query(f"""WITH l AS (SELECT record_id, list_filter([{_sq("'Summary_mode: ' || coalesce(summary_mode, '')")}, {_sq('title')}, {_sq('journal')}, {_sq('title')}], lambda s: s <> '' AND NOT regexp_matches(lower(s), '^({'|'.join(rd.DUMP_FIELDS)})\\s*[:：]')) AS l FROM reader_records)
SELECT record_id, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), chr(10)) AS lines FROM l""")
def sanitised_lines(spark, sf):
    lines = F.array(F.concat(F.lit("Summary_mode: "), tx.text("summary_mode")), tx.text("title"), tx.text("journal"), tx.text("title"))
    return _records(spark, sf).select("record_id", F.array_join(rd.section_lines(F.transform(lines, tx.squash)), "\n").alias("lines"))


@query(f"""SELECT record_id, {_sq("'证据层级 is ' || replace(coalesce(summary_mode, ''), '{{summary_mode}}', '{{证据层级}}') || ', 网页落地页 ' || coalesce(web_url, '') || ' 材料'")} AS said FROM reader_records""")
def plain_terms(spark, sf):
    said = F.concat(F.lit("`summary_mode` is "), tx.text("summary_mode"), F.lit(", WEB_URL "), tx.text("web_url"), F.lit(" json"))
    return _records(spark, sf).select("record_id", rd.plain_terms(said).alias("said"))


_row = lambda k, c: f"CASE WHEN {_tidy(c)} NOT IN ('', '-', '无', 'N/A') THEN '| {k} | ' || replace({_tidy(c)}, chr(10), '<br>') || ' |' END"


@query(f"""SELECT record_id, concat_ws(chr(10), '| Key | Value |', '| --- | --- |', {_row('Title', 'title')}, {_row('Journal', 'journal')}, {_row('DOI', 'doi')}) AS facts,
 coalesce(nullif(concat_ws(chr(10), CASE WHEN {_sq('web_url')} <> '' THEN '- page: ' || {_sq('web_url')} END, CASE WHEN {_sq('pmid')} <> '' THEN '- PMID: ' || {_sq('pmid')} END), ''), '-') AS sources FROM reader_records""")
def metadata_tables(spark, sf):
    facts = rd.metadata_table([("Title", F.col("title")), ("Journal", F.col("journal")), ("DOI", F.col("doi"))])
    return _records(spark, sf).select("record_id", facts.alias("facts"), rd.sources_list([("page", F.col("web_url")), ("PMID", F.col("pmid"))]).alias("sources"))


_at = lambda w: f"CASE WHEN instr(t, '{w}') > 3001 THEN instr(t, '{w}') - 1 END"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' Terms of Use and more' WHEN 1 THEN ' Export citation here' ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, t, least({', '.join(map(_at, rd.SHELL))}) AS n FROM d) SELECT doc_id, {_sq("substring(t, 1, coalesce(n, length(t)))")} AS text FROM c""")
def without_shell(spark, sf):
    tail = F.expr("CASE doc_id % 3 WHEN 0 THEN ' Terms of Use and more' WHEN 1 THEN ' Export citation here' ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", rd.without_shell(F.concat(tx.text("text"), tail)).alias("text"))


@query(f"""SELECT record_id, {_sq("'before ' || coalesce(abstract, '') || ' after'")} AS text FROM reader_records""")
def without_markup(spark, sf):
    dressed = F.concat(F.lit("before ![a figure](x.png) <!-- a\ncomment -->"), tx.text("abstract"), F.lit(" <IMG src='x'> ```\ncode\n``` after"))
    return _records(spark, sf).select("record_id", rd.without_markup(dressed).alias("text"))


_last = f"regexp_extract({_sq('k')}, '[^ ]+$')"
_odd = f"({' OR '.join(f'''ends_with(lower({_last}), '{e}')''' for e in ('ss', 'us', 'is'))})"


@query(f"""WITH t AS (SELECT DISTINCT unnest(keywords) AS k FROM papers)
SELECT k AS keyword, CASE WHEN length({_last}) >= 4 AND ends_with(lower({_last}), 's') AND NOT {_odd} THEN left({_sq('k')}, length({_sq('k')}) - 1) WHEN length({_last}) >= 3 AND NOT {_odd} THEN {_sq('k')} || 's' END AS other FROM t WHERE {_sq('k')} <> ''""")
def keyword_variants(spark, sf):
    words = _papers(spark, sf).select(F.explode("keywords").alias("keyword")).where(tx.squash("keyword") != "").distinct()
    return words.select("keyword", F.try_element_at(rd.keyword_forms("keyword"), F.lit(2)).alias("other"))


@query(r"""SELECT entry_id, trim(regexp_replace(trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(trim('2) ' || coalesce(affiliations, '') || ' 3,†'), '^[\d,†‡∗*§¶∥ ]+[)\].]?\s*', ''), '\s*[\d,†‡∗*§¶]+$', ''), '{', ''), '}', ''), '\s+', ' ', 'g')), '(?i)\s+intern$', ''), '.,;:- ') AS affiliation FROM papers""")
def clean_affiliations(spark, sf):
    return _papers(spark, sf).select("entry_id", rd.affiliation(F.concat(F.lit("2) "), tx.text("affiliations"), F.lit(" 3,†"))).alias("affiliation"))


@query("""SELECT record_id, CASE WHEN len(affiliations) > 0 THEN array_to_string(list_transform(affiliations, lambda a, i: i || ' ' || a), '|') ELSE '' END AS parts FROM reader_records""")
def numbered_affiliations(spark, sf):
    numbered = F.transform(F.coalesce("affiliations", F.array().cast("array<string>")), lambda a, i: F.concat((i + 1).cast("string"), F.lit(" "), a))
    line = F.when(F.col("record_id") % 2 == 0, F.array_join(numbered, ", ")).otherwise(F.array_join(numbered, " "))
    return _records(spark, sf).select("record_id", F.array_join(rd.numbered_parts(line), "|").alias("parts"))


@query("SELECT entry_id, len(coalesce(matched_keywords, [])) > 0 OR len(coalesce(matched_boost_keywords, [])) > 0 AS main FROM papers")
def primary_papers(spark, sf):
    n = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    return _papers(spark, sf).select("entry_id", ((n("matched_keywords") > 0) | (n("matched_boost_keywords") > 0)).alias("main"))


@query("SELECT record_id, array_to_string(list_filter(list_transform(CASE WHEN record_id % 3 = 0 THEN string_split(array_to_string(coalesce(authors, []), '; '), ';') ELSE [array_to_string(coalesce(authors, []), '-')] END, lambda p: trim(p)), lambda p: p <> ''), '|') AS names FROM reader_records")
def preprint_authors(spark, sf):
    line = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ")
    other = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "-")
    return _records(spark, sf).select("record_id", F.array_join(tx.split_authors(F.when(F.col("record_id") % 3 == 0, line).otherwise(other)), "|").alias("names"))


@query(f"""WITH a AS (SELECT record_id, list_filter(list_transform(list_concat(coalesce(authors, []), ['x@y.example', 'ORCID 0000', '12', 'https://z.example']), lambda s: {_sq('s')}), lambda s: s <> '' AND NOT regexp_matches(lower(s), '@|orcid|https?:|www\\.') AND length(s) <= 80 AND regexp_matches(s, '\\p{{L}}')) AS a FROM reader_records)
SELECT record_id, array_to_string(list_filter(a, lambda s, i: list_position(list_transform(a, lambda u: lower(u)), lower(s)) = i), '|') AS names FROM a""")
def author_candidates(spark, sf):
    found = F.concat(F.coalesce("authors", F.array().cast("array<string>")), F.array(*[F.lit(v) for v in ("x@y.example", "ORCID 0000", "12", "https://z.example")]))
    return _records(spark, sf).select("record_id", F.array_join(tx.author_candidates(found), "|").alias("names"))


@query(r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '([A-Za-z])-\s+([A-Za-z])', '\1\2', 'g'), '" + sql.SPACE + r"+', ' ', 'g')), '­', '', 'g') AS text FROM documents")
def repaired_breaks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.repair_breaks("text").alias("text"))


@query(f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '{sql.SPACE}', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) / length(regexp_replace(text, '{sql.SPACE}', '', 'g')) END AS share FROM documents")
def han_shares(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.cjk_share("text").alias("share"))


_stem = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 4 THEN left(w, length(w) - {len(e)})" for e in ("ing", "ers", "er", "ed", "es", "s")) + " ELSE w END"


@query(f"SELECT entry_id, array_to_string(list_transform(list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z][A-Za-z-]{{2,}}'), lambda w: lower(w)), lambda w: {_stem}), ' ') AS stems FROM papers")
def profile_stems(spark, sf):
    return _papers(spark, sf).select("entry_id", F.array_join(F.transform(tx.words3("title"), tx.profile_stem), " ").alias("stems"))


@query("SELECT entry_id, array_to_string(list_filter(list_transform(CASE WHEN contains(w, ',') THEN regexp_split_to_array(w, '[,，;；\\n]+') ELSE regexp_split_to_array(w, '\\s+') END, lambda p: trim(p)), lambda p: p <> ''), '|') AS words FROM (SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN array_to_string(coalesce(keywords, []), ', ') ELSE array_to_string(coalesce(keywords, []), ' ') END AS w FROM papers)")
def override_keywords(spark, sf):
    none = F.array().cast("array<string>")
    typed = F.when(F.col("entry_id") % 2 == 0, F.array_join(F.coalesce("keywords", none), ", ")).otherwise(F.array_join(F.coalesce("keywords", none), " "))
    return _papers(spark, sf).select("entry_id", F.array_join(tx.split_override(typed), "|").alias("words"))


@query("SELECT entry_id, concat_ws('-', nullif(y, ''), m, nullif(d, '')) AS day FROM (SELECT entry_id, split_part(x, '-', 1) AS y, CASE split_part(x, '-', 2) WHEN '' THEN NULL WHEN '03' THEN '03' ELSE split_part(x, '-', 2) END AS m, split_part(x, '-', 3) AS d FROM (SELECT entry_id, coalesce(date, '') AS x FROM papers)) WHERE y <> '' UNION ALL SELECT entry_id, '' FROM papers WHERE split_part(coalesce(date, ''), '-', 1) = ''")
def bibliographic_dates(spark, sf):
    part = lambda i: F.coalesce(F.try_element_at(F.split(tx.text("date"), "-"), F.lit(i)), F.lit(""))
    month = F.when(part(2) == "03", "Mar").otherwise(part(2))
    return _papers(spark, sf).select("entry_id", tx.bibliographic_date(part(1), month, part(3)).alias("day"))


# Addresses.

#: Addresses of many kinds, in words that both engines read.
_ADDRESS = """CASE entry_id % 12 WHEN 0 THEN 'https://www.nature.com/articles/' || entry_id || '.pdf' WHEN 1 THEN 'https://onlinelibrary.wiley.com/doi/epdf/10.1111/x.' || entry_id
 WHEN 2 THEN 'https://link.springer.com/article/10.1007/s' || entry_id || '?a=1' WHEN 3 THEN 'https://doi.org/10.1093/gbe/' || entry_id WHEN 4 THEN 'https://www.biorxiv.org/content/10.1101/2025.01.' || entry_id || 'v2/full-text'
 WHEN 5 THEN 'https://www.medrxiv.org/content/10.64898/' || entry_id || 'v13' WHEN 6 THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/y' || entry_id WHEN 7 THEN 'https://x.example:8080/doi/pdf/10.1186/z' || entry_id || '?q=2'
 WHEN 8 THEN 'https://x.example/a.full.pdf+html' WHEN 9 THEN 'https://dx.doi.org/10.9999/' || entry_id WHEN 10 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || entry_id ELSE coalesce(url, '') END"""
_A = f"WITH a AS (SELECT entry_id, {_ADDRESS} AS u FROM papers)"


def _addresses(spark, sf) -> DataFrame:
    return _papers(spark, sf).select("entry_id", F.expr(_ADDRESS).alias("u"))


_slugs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pub.SLUGS.items())


@query(_A + f""", n AS (SELECT entry_id, u, ltrim(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), 'w.') AS n FROM a)
SELECT entry_id, CASE WHEN contains(n, 'doi.org') THEN CASE regexp_extract(u, '^https?://[^/]*/(10\\.\\d+)', 1) {_slugs} ELSE 'doi_org' END WHEN n = '' THEN 'generic' ELSE left(regexp_replace(split_part(n, ':', 1), '[^a-z0-9]', '_', 'g'), 40) END AS slug FROM n""")
def publisher_slugs(spark, sf):
    return _addresses(spark, sf).select("entry_id", pub.slug("u").alias("slug"))


@query(_A + """ SELECT entry_id, CASE entry_id % 12 WHEN 0 THEN 'nature' WHEN 1 THEN 'wiley' WHEN 2 THEN 'springer' WHEN 3 THEN 'oup' WHEN 6 THEN 'wiley' WHEN 10 THEN 'pmc' WHEN 7 THEN 'springer' ELSE '' END AS site FROM a""")
def publisher_sites(spark, sf):
    return _addresses(spark, sf).select("entry_id", pub.site(records.doi_from_address("u"), "u").alias("site"))


@query(_A + r""" SELECT entry_id, rtrim(regexp_extract(u, '(?i)(10\.\d{4,9}/[^\s?#"''<>]+)', 1), '.,;)') AS doi, CASE entry_id % 12 WHEN 1 THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/10.1111/x.' || entry_id || '?download=true' WHEN 2 THEN 'https://link.springer.com/content/pdf/10.1007/s' || entry_id || '.pdf'
 WHEN 6 THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/y' || entry_id || '?download=true' WHEN 7 THEN 'https://link.springer.com/content/pdf/10.1186/z' || entry_id || '_reference.pdf' ELSE '' END AS direct FROM a""")
def direct_pdfs(spark, sf):
    return _addresses(spark, sf).select("entry_id", pub.doi_anywhere("u").alias("doi"), pub.direct_pdf("u").alias("direct"))


@query(_A + """ SELECT entry_id, CASE entry_id % 12 WHEN 1 THEN replace(u, '/epdf/', '/pdfdirect/') || '?download=true ' || replace(u, '/epdf/', '/pdfdirect/') || ' ' || replace(u, '/epdf/', '/pdf/') || ' ' || u
 WHEN 6 THEN u || '?download=true ' || u || ' ' || replace(u, '/pdfdirect/', '/pdf/') WHEN 7 THEN replace(u, '/pdf/', '/pdfdirect/') || '&download=true ' || u || ' ' || replace(u, '/pdf/', '/epdf/') WHEN 8 THEN '' ELSE u END AS forms FROM a""")
def pdf_variants(spark, sf):
    return _addresses(spark, sf).select("entry_id", F.array_join(pub.pdf_variants("u"), " ").alias("forms"))


@query("""SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001.jpg https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001.png https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001.gif https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001.webp https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001-m.jpg?x=' || record_id
 WHEN 1 THEN 'https://oup.silverchair-cdn.com/a/f1.jpeg?sig=' || record_id || ' https://oup.silverchair-cdn.com/a/m_f1.jpeg?sig=' || record_id WHEN 2 THEN '' ELSE 'https://x.example/m_1.png' END AS forms FROM reader_records""")
def image_variants(spark, sf):
    src = F.expr("CASE record_id % 4 WHEN 0 THEN 'https://onlinelibrary.wiley.com/cms/asset/a/b-fig-0001-m.jpg?x=' || record_id WHEN 1 THEN 'https://oup.silverchair-cdn.com/a/m_f1.jpeg?sig=' || record_id WHEN 2 THEN ' ' ELSE 'https://x.example/m_1.png' END")
    return _records(spark, sf).select("record_id", F.array_join(pub.image_variants(src), " ").alias("forms"))


@query(_A + """ SELECT entry_id, CASE entry_id % 12 WHEN 4 THEN '10.1101/2025.01.' || entry_id WHEN 5 THEN '10.64898/' || entry_id ELSE '' END AS doi, CASE entry_id % 12 WHEN 4 THEN 'v2' ELSE '' END AS revision,
 entry_id % 12 IN (4, 5) AS preprint, CASE entry_id % 12 WHEN 5 THEN 'medrxiv' ELSE 'biorxiv' END AS server FROM a""")
def preprint_addresses(spark, sf):
    return _addresses(spark, sf).select("entry_id", pub.preprint_doi("u").alias("doi"), pub.preprint_revision("u").alias("revision"), pub.is_preprint(F.lit(""), "u").alias("preprint"), pub.preprint_server("u").alias("server"))


@query("""SELECT coalesce(source, '') AS source, CASE WHEN coalesce(pmc_id, '') <> '' THEN 'pmc.ncbi.nlm.nih.gov' WHEN trim(coalesce(doi, '')) <> '' THEN split_part(trim(doi), '/', 1)
 WHEN regexp_matches(trim(coalesce(url, '')), '^https?://[^/]') THEN regexp_extract(trim(url), '^https?://([^/?#]*)', 1) ELSE 'unknown' END AS publisher, count(*) AS n FROM papers GROUP BY 1, 2""")
def publisher_groups(spark, sf):
    return _papers(spark, sf).groupBy(tx.text("source").alias("source"), pub.publisher_key("pmc_id", "doi", "url").alias("publisher")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, rtrim(regexp_extract(t, '(?i)(10\\.\\d{4,9}/[-._;()/:A-Z0-9]+)', 1), ').,;]') AS doi FROM (SELECT doc_id, substring(coalesce(text, ''), 1, 60) || ' (doi:10.99101/A' || doc_id || ').' AS t FROM documents)")
def dois_in_texts(spark, sf):
    said = F.concat(F.substring(tx.text("text"), 1, 60), F.lit(" (doi:10.99101/A"), F.col("doc_id").cast("string"), F.lit(")."))
    return table(spark, sf, "documents").select("doc_id", tx.doi_in_text(said).alias("doi"))


# Pages: what the extraction finds in a page is what the record says that stands on it.

_none = "CAST(array() AS array<string>)"
_PAGE = f"""concat('<html><head><title>x</title>', array_join(transform(coalesce(authors, {_none}), a -> concat('<meta content="', a, '" name="citation_author">')), ''),
 array_join(transform(coalesce(affiliations, {_none}), a -> concat('<span id="i" class="c aff">, ', a, ';</span>')), ''), '<style>p {{}} <p>not this, for it is a style and not a paragraph at all</p></style></head><body><img alt="l" src="/logo.png">',
 array_join(transform(coalesce(section_headers, {_none}), (h, i) -> concat('<h', 2 + i % 3, ' class="s">', i + 1, '. <b>', h, '</b></h', 2 + i % 3, '>')), ''),
 coalesce(array_join(transform(figure_items, f -> concat('<figure><img class="f" src="', coalesce(f.src, ''), '"><figcaption>', coalesce(f.caption, ''), '</figcaption></figure>')), ''), ''),
 array_join(transform(split(coalesce(abstract, ''), '[.] '), s -> concat('<p class="t">', s, '</p>')), ''), '</body></html>')"""


def _pages(spark, sf) -> DataFrame:
    t = _records(spark, sf).where("not rlike(concat_ws(' ', abstract, array_join(affiliations, ' '), array_join(authors, ' '), array_join(transform(figure_items, f -> coalesce(f.caption, '')), ' ')), '[<>&\"\\']')")
    return t.select("record_id", F.expr(_PAGE).alias("page"))


_SAFE = """reader_records WHERE NOT regexp_matches(concat_ws(' ', abstract, array_to_string(affiliations, ' '), array_to_string(authors, ' '), array_to_string(list_transform(figure_items, lambda f: coalesce(f.caption, '')), ' ')), '[<>&"'']')"""
_strip = lambda c, p: f"list_filter(list_transform({c}, lambda s: {p}), lambda s: s <> '')"


@query(f"SELECT record_id, array_to_string(list_filter(list_transform(coalesce(section_headers, []), lambda h: {_sq('h')}), lambda h: h <> '' AND length(h) < 200)[1:20], '|') AS headings FROM {_SAFE}")
def page_headings(spark, sf):
    return _pages(spark, sf).select("record_id", F.array_join(html.headings("page"), "|").alias("headings"))


@query(f"SELECT record_id, array_to_string(list_filter(list_transform(coalesce(figure_items, []), lambda f: {_sq('f.caption')}), lambda c: length(c) BETWEEN 10 AND 300)[1:8], '|') AS captions FROM {_SAFE}")
def page_captions(spark, sf):
    return _pages(spark, sf).select("record_id", F.array_join(html.captions("page"), "|").alias("captions"))


@query(f"SELECT record_id, coalesce(list_filter(list_transform(coalesce(figure_items, []), lambda f: coalesce(f.src, '')), lambda s: regexp_matches(lower(s), '\\.(png|jpe?g|gif|svg|webp)$'))[1], '') AS figure FROM {_SAFE}")
def page_figures(spark, sf):
    return _pages(spark, sf).select("record_id", html.figure_url("page").alias("figure"))


@query(f"SELECT record_id, array_to_string({_strip('coalesce(authors, [])', 'trim(s)')}, '|') AS authors FROM {_SAFE}")
def page_authors(spark, sf):
    return _pages(spark, sf).select("record_id", F.array_join(html.authors("page"), "|").alias("authors"))


_inst = " OR ".join(f"contains(lower(s), {sql.quoted(w)})" for w in html.INSTITUTION)


@query(f"SELECT record_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(affiliations, []), lambda s: trim({_sq('s')}, ' ,;.')), lambda s: length(s) BETWEEN 6 AND 299 AND ({_inst})))), '|') AS affiliations FROM {_SAFE}")
def page_affiliations(spark, sf):
    return _pages(spark, sf).select("record_id", F.array_join(html.affiliations("page"), "|").alias("affiliations"))


@query(f"SELECT record_id, array_to_string(list_filter(list_transform(string_split(coalesce(abstract, ''), '. '), lambda s: {_sq('s')}), lambda s: length(s) >= 50), '|') AS paragraphs FROM {_SAFE}")
def page_paragraphs(spark, sf):
    return _pages(spark, sf).select("record_id", F.array_join(html.paragraphs("page"), "|").alias("paragraphs"))


@query(f"SELECT record_id, {_sq('abstract')} AS said FROM {_SAFE} AND length({_sq('abstract')}) BETWEEN 80 AND 500")
def page_method_summaries(spark, sf):
    t = _records(spark, sf).where("not rlike(concat_ws(' ', abstract, array_join(affiliations, ' '), array_join(authors, ' '), array_join(transform(figure_items, f -> coalesce(f.caption, '')), ' ')), '[<>&\"\\']')")
    t = t.where(F.length(tx.squash("abstract")).between(80, 500))
    page = F.concat(F.lit("<h2>Introduction</h2><p>Not this.</p><h3>2. Materials and Methods</h3><p>"), tx.text("abstract"), F.lit("</p><h2>Results</h2>Nor this."))
    return t.select("record_id", html.method_summary(page).alias("said"))


@query(f"SELECT record_id, length(a) - length(replace(a, 'n', '')) AS n_n, a AS alt FROM (SELECT record_id, {_sq('title')} AS a FROM reader_records WHERE NOT regexp_matches(coalesce(title, ''), '[\"<>]'))")
def tag_attributes(spark, sf):
    t = _records(spark, sf).where("not rlike(coalesce(title, ''), '[\"<>]')")
    tag = F.concat(F.lit("<img SRC='a.png' alt=\""), tx.squash("title"), F.lit("\" src=\"b.png\">"))
    got = F.coalesce(html.attributes(tag)["alt"], F.lit(""))
    return t.select("record_id", (F.length(got) - F.length(F.replace(got, F.lit("n"), F.lit("")))).cast("long").alias("n_n"), got.alias("alt"))


@query("SELECT doc_id, length(rtrim(text, ' ' || chr(10))) AS n FROM documents WHERE NOT regexp_matches(lower(text), '(?m)^\\s*(references|bibliography|literature cited|参考文献)\\s*$')")
def before_references(spark, sf):
    t = table(spark, sf, "documents").where(r"not rlike(lower(text), '(?m)^\\s*(references|bibliography|literature cited|参考文献)\\s*$')")
    whole = F.rtrim(F.col("text"), F.lit(" \n"))
    return t.select("doc_id", F.length(html.references_cut(F.concat(whole, F.lit("\nReferences\n1. Some work.")))).cast("long").alias("n"))


# Library tables, sets, order and time.


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) >= 12")
def full_collections(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).where("n >= 12")


@query("SELECT o_orderkey, o_orderpriority, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def attachments(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title"))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderpriority", "title")


@query("SELECT DISTINCT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE '%A%'")
def collections_of_items(spark, sf):
    c, n = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").where("n_name like '%A%'").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_nationkey", "n_name").distinct()


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'china' OR contains(lower(n_name), 'china') ORDER BY (lower(n_name) = 'china') DESC, n_nationkey LIMIT 1")
def collection_by_name(spark, sf):
    low = F.lower("n_name")
    return table(spark, sf, "nation").where(low.contains("china")).orderBy((low == "china").desc(), "n_nationkey").limit(1).select("n_nationkey", "n_name")


@query("SELECT r_name, count(DISTINCT n_nationkey) AS n_sub, count(c_custkey) AS n_notes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def folder_counts(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    t = table(spark, sf, "region").select("r_regionkey", "r_name").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return t.groupBy("r_name").agg(F.count("n_nationkey").alias("n_sub"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_notes"))


@query("SELECT trim(pmid, ' ') AS pmid FROM papers WHERE trim(coalesce(pmid, ''), ' ') <> '' UNION SELECT trim(pmid, ' ') FROM history WHERE trim(coalesce(pmid, ''), ' ') <> ''")
def all_pmids(spark, sf):
    own = lambda n: table(spark, sf, n).select(F.trim(tx.text("pmid")).alias("pmid")).where("pmid <> ''")
    return own("papers").union(own("history")).distinct()


@query("SELECT trim(doi, ' ') AS doi FROM papers WHERE trim(coalesce(doi, ''), ' ') <> '' INTERSECT SELECT trim(doi, ' ') FROM history WHERE trim(coalesce(doi, ''), ' ') <> ''")
def common_dois(spark, sf):
    own = lambda n: table(spark, sf, n).select(F.trim(tx.text("doi")).alias("doi")).where("doi <> ''")
    return own("papers").intersect(own("history"))


@query("SELECT doi FROM (SELECT trim(doi, ' ') AS doi FROM papers WHERE trim(coalesce(doi, ''), ' ') <> '' EXCEPT SELECT trim(doi, ' ') FROM history WHERE trim(coalesce(doi, ''), ' ') <> '')")
def new_dois(spark, sf):
    own = lambda n: table(spark, sf, n).select(F.trim(tx.text("doi")).alias("doi")).where("doi <> ''")
    return own("papers").subtract(own("history"))


@query("SELECT entry_id, least(4, greatest(1, coalesce(try_cast(cas_quartile AS INTEGER), 4))) AS quartile FROM papers")
def clamped_quartiles(spark, sf):
    return _papers(spark, sf).select("entry_id", F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce(F.col("cas_quartile").try_cast("int"), F.lit(4)))).alias("quartile"))


@query("SELECT entry_id, instr(lower(coalesce(abstract, '')), 'relied') AS first_at, CASE coalesce(source, '') WHEN 'biorxiv' THEN 'preprint' WHEN 'medrxiv' THEN 'preprint' WHEN 'pubmed' THEN 'index' ELSE 'other' END AS family FROM papers")
def positions_and_families(spark, sf):
    families = F.create_map(*[F.lit(v) for pair in {"biorxiv": "preprint", "medrxiv": "preprint", "pubmed": "index"}.items() for v in pair])
    return _papers(spark, sf).select("entry_id", F.locate("relied", F.lower(tx.text("abstract"))).cast("long").alias("first_at"), F.coalesce(families[tx.text("source")], F.lit("other")).alias("family"))


@query("SELECT entry_id, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(date, ''), coalesce(title, ''), entry_id) AS INTEGER) AS place FROM history QUALIFY place <= 50")
def history_order(spark, sf):
    from pyspark.sql import Window

    # The report shows the head of each source: a rank that is cut before the sort of the whole (a group limit).
    w = Window.partitionBy("source").orderBy(tx.text("date"), tx.text("title"), "entry_id")
    return table(spark, sf, "history").withColumn("place", F.row_number().over(w)).where("place <= 50").select("entry_id", "place")


@query("SELECT source, count(*) AS n, count(CASE WHEN coalesce(doi, '') = '' THEN 1 END) AS n_no_doi, count(CASE WHEN coalesce(abstract, '') = '' THEN 1 END) AS n_no_abstract, max(fetched_at) AS last FROM papers GROUP BY source")
def fetch_counters(spark, sf):
    empty = lambda c: F.count(F.when(tx.text(c) == "", 1))
    return _papers(spark, sf).groupBy("source").agg(F.count("*").alias("n"), empty("doi").alias("n_no_doi"), empty("abstract").alias("n_no_abstract"), F.max("fetched_at").alias("last"))


@query("SELECT batch_date, count(*) AS n, count(CASE WHEN CAST(fetched_at AS DATE) > batch_date + INTERVAL 1 DAY THEN 1 END) AS n_late FROM papers GROUP BY batch_date")
def late_rows(spark, sf):
    return _papers(spark, sf).groupBy("batch_date").agg(F.count("*").alias("n"), F.count(F.when(F.to_date("fetched_at") > F.date_add("batch_date", 1), 1)).alias("n_late"))


_MONTHS = dates.months(dates.window_between("2025-03-10", "2025-06-05"))
_plo, _phi = sql.date_range("date")


@query(" UNION ALL ".join(f"SELECT DATE '{w.start}' AS start, count(*) AS n FROM papers WHERE {_plo} IS NOT NULL AND {_plo} <= DATE '{w.end}' AND {_phi} >= DATE '{w.start}'" for w in _MONTHS))
def month_windows(spark, sf):
    lo, hi = dates.day_range("date")
    cuts = F.array(*[F.struct(F.lit(w.start).alias("start"), F.lit(w.end).alias("end")) for w in _MONTHS])
    t = _papers(spark, sf).select(lo.alias("lo"), hi.alias("hi")).where("lo is not null")
    # A paper counts in each month it may belong to; the months are few and stand in the row.
    touched = t.select(F.explode(F.filter(cuts, lambda w: (F.col("lo") <= w["end"]) & (F.col("hi") >= w["start"]))).alias("w"))
    return touched.groupBy(F.col("w.start").alias("start")).agg(F.count("*").alias("n"))


@query("SELECT source, entry_id FROM papers WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(score, 0) DESC, entry_id) <= least(10 * 7, 50)")
def budgeted_sources(spark, sf):
    from pyspark.sql import Window

    days, a_day, cap = 7, 10, 50
    # A budget of so many rows a day and at most the cap: a group limit runs before the shuffle.
    w = Window.partitionBy("source").orderBy(F.coalesce("score", F.lit(0)).desc(), "entry_id")
    return _papers(spark, sf).where("source is not null").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= min(a_day * days, cap)).select("source", "entry_id")


@query(r"""WITH x AS (SELECT raw_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_extract(payload, '(?s)<AuthorList.*?</AuthorList>'), '(?s)<Affiliation>(.*?)</Affiliation>', 1), lambda a: trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))), lambda a: a <> ''))) AS a FROM pubmed_raw)
SELECT raw_id, array_to_string(a, '; ') AS affiliations FROM x WHERE len(a) > 0""")
def article_affiliations(spark, sf):
    from scholion.operators.nested import xml_children

    rows = xml_children(table(spark, sf, "pubmed_raw"), "raw_id", "payload").where("child = 'affiliation'")
    named = rows.select(F.col("parent_id").alias("raw_id"), F.explode(F.map_values("leaves")).alias("a")).select("raw_id", F.trim("a").alias("a")).where("a <> ''")
    return named.groupBy("raw_id").agg(F.array_join(F.array_sort(F.collect_set("a")), "; ").alias("affiliations"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
