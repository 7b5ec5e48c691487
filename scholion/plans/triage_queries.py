"""Queries of the triage operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import text as tx
from scholion.operators import dates, evidence, library, lines, matching, merging, profile, ranking, sinks
from scholion.plans import sql
from scholion.session import spread, table
from scholion.sources import articles

RULES = matching.Rules(
    keywords=("taste perception", "bitter taste perception", "gene dosage", "spatial memory", "tandem repeats", "checkpoint blockade", "seed dormancy", "contact networks", "drought refuges", "antibody repertoires", "hybrid assembly", "loss"),
    boosts=("sensory genomics", "bitter taste", "vaccine boosters", "mice"),
    negatives=("retracted", "wall clock time"),
    rejected_journals=("volcanic dust", "coastal masonry"),
    variants={"antibody repertoires": ("antibody repertoires", "antigen presentation"), "loss": ("loss of function", "copy number losses")},
    min_score=2,
)
WINDOW = dates.window_between("2025-03-01", "2025-09-15")
_Q: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable) -> Callable:
        _Q[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle
        return f

    return add


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "papers")


# Tokens, phrases and scores.


@query(f"SELECT entry_id, array_to_string({sql.tokens('title')}, ' ') AS tokens FROM papers")
def tokens_of_titles(spark, sf):
    return _papers(spark, sf).select("entry_id", F.array_join(tx.norm_tokens("title"), " ").alias("tokens"))


_kw = "array_to_string(coalesce(keywords, []), ' ')"
_BASE = f"""
WITH raw AS (
    SELECT *, {sql.tokens('title')} AS tt, {sql.tokens('abstract')} AS ta, {sql.tokens(_kw)} AS tk, {sql.tokens('journal')} AS tj FROM papers
), tok AS (
    SELECT *, {sql.padded('tt')} AS t, {sql.padded('list_concat(ta, tk)')} AS b, {sql.padded('list_concat(list_concat(tt, ta), tk)')} AS a, {sql.padded('tj')} AS j,
           {sql.padded('list_concat(list_concat(list_concat(tt, ta), tk), tj)')} AS f FROM raw
), hit AS (
    SELECT *, {sql.matches('a', RULES, RULES.keywords)} AS m0, {sql.matches('f', RULES, RULES.boosts)} AS b0, {sql.matches('t', RULES, RULES.keywords)} AS t0,
           {sql.matches('b', RULES, RULES.keywords)} AS o0, len({sql.matches('t', RULES, RULES.boosts)}) AS bt,
           ({' OR '.join(sql.has('j', RULES, k) for k in RULES.rejected_journals)}) AS badj, ({' OR '.join(sql.has('f', RULES, k) for k in RULES.negatives)}) AS neg FROM tok
), kept AS (
    SELECT *, {sql.drop_contained('m0')} AS matched, {sql.drop_contained('b0')} AS boosted, {sql.drop_contained('t0')} AS t1 FROM hit
), part AS (SELECT *, list_filter(o0, lambda k: NOT list_contains(t1, k)) AS o1 FROM kept
), sums AS (SELECT *, 3 * len(t1) + len({sql.drop_contained('o1')}) AS base FROM part
), scored AS (
    SELECT *, CASE WHEN badj THEN 'rejected_journal' WHEN neg THEN 'rejected_negative_keyword' END AS veto,
           CAST(CASE WHEN badj OR neg THEN -999 ELSE base + CASE WHEN base > 0 THEN least(len(boosted), 2) + CASE WHEN bt > 0 THEN 1 ELSE 0 END ELSE 0 END END AS INTEGER) AS points FROM sums
)
"""


def _scored(spark, sf) -> DataFrame:
    columns = ["entry_id", "id", "pmid", "doi", "url", "pdf", "title", "abstract", "keywords", "journal", "source", "date", "batch_date"]
    return matching.score(spread(_papers(spark, sf).select(columns)), RULES)


@query(_BASE + "SELECT entry_id, array_to_string(matched, ';') AS matched, array_to_string(boosted, ';') AS boosted, veto, points FROM scored")
def scores(spark, sf):
    return _scored(spark, sf).select("entry_id", F.array_join("matched", ";").alias("matched"), F.array_join("boosted", ";").alias("boosted"), "veto", "points")


@query(_BASE + f"SELECT entry_id FROM tok WHERE lower(coalesce(source, '')) <> 'pubmed' OR {' OR '.join(sql.has(sql.padded('list_concat(tt, ta)'), RULES, k) for k in (*RULES.keywords, *RULES.boosts))}")
def keyword_prefilter(spark, sf):
    return matching.semi(_papers(spark, sf), RULES).select("entry_id")


@query(_BASE + "SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(matched) AS k FROM scored WHERE points >= 0) GROUP BY k ORDER BY n DESC, k LIMIT 4")
def frequent_keywords(spark, sf):
    t = _scored(spark, sf).where("points >= 0").select(F.explode("matched").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "keyword").limit(4)


@query(f"""WITH t AS (SELECT entry_id, {sql.padded(sql.tokens('abstract'))} AS a FROM papers),
s AS (SELECT k AS phrase, {sql.padded(sql.tokens('k'))} AS p FROM (SELECT DISTINCT unnest(keywords) AS k FROM papers) WHERE len({sql.tokens('k')}) > 0)
SELECT entry_id, phrase FROM t JOIN s ON contains(a, p)""")
def phrase_pairs(spark, sf):
    phrases = _papers(spark, sf).select(F.explode("keywords").alias("phrase")).distinct()
    return matching.pairs(spread(_papers(spark, sf).select("entry_id", "abstract")), "entry_id", "abstract", phrases, "phrase")


@query(f"SELECT entry_id, array_to_string({sql.unique_ci('list_concat(coalesce(matched_keywords, []), coalesce(matched_boost_keywords, []))')}, '; ') AS words FROM papers")
def display_keywords(spark, sf):
    none = F.array().cast("array<string>")
    return _papers(spark, sf).select("entry_id", F.array_join(tx.unique_ci(F.concat(F.coalesce("matched_keywords", none), F.coalesce("matched_boost_keywords", none))), "; ").alias("words"))


# Selection: duplicates, history, order, buckets.

_KEY = "coalesce(source, ''), coalesce(doi, ''), coalesce(pmid, ''), lower(trim(coalesce(title, '')))"
_ID = "coalesce(nullif(id, ''), nullif(pmid, ''), nullif(doi, ''), nullif(url, ''))"


@query(f"SELECT entry_id, title FROM papers QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY entry_id) = 1")
def first_of_duplicates(spark, sf):
    return ranking.first_of_each(_papers(spark, sf), ranking.paper_key(), "entry_id").select("entry_id", "title")


@query(f"WITH p AS (SELECT entry_id, {_ID} AS key FROM papers) SELECT entry_id FROM p WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.id = p.key AND h.id <> '')")
def unknown_to_history(spark, sf):
    return ranking.drop_known(_papers(spark, sf), table(spark, sf, "history"), ranking.paper_id()).select("entry_id")


_SELECTED = _BASE + f"""
, once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY entry_id) = 1
), fresh AS (SELECT * FROM once WHERE {_ID} IS NOT NULL AND {_ID} NOT IN (SELECT id FROM history WHERE id IS NOT NULL AND id <> '') AND points >= {RULES.min_score}
), top AS (SELECT * FROM fresh ORDER BY len(matched) DESC, points DESC, coalesce(date, '') DESC, entry_id LIMIT 100)
"""


def _selected(spark, sf) -> DataFrame:
    # Judged first, so that no abstract is shuffled; the firsts come from a narrow scan of their own.
    narrow = _scored(spark, sf).drop("abstract", "keywords")
    once = ranking.first_of_each(narrow, ranking.paper_key(), "entry_id", _papers(spark, sf))
    fresh = ranking.drop_known(once, table(spark, sf, "history"), ranking.paper_id()).where(ranking.paper_id().isNotNull() & (F.col("points") >= RULES.min_score))
    return ranking.top_k(fresh, ranking.order_papers(), 100)


@query(_SELECTED + "SELECT entry_id, title, points, len(matched) AS n_matched FROM top")
def triage(spark, sf):
    return _selected(spark, sf).select("entry_id", "title", "points", F.size("matched").cast("long").alias("n_matched"))


_RANKED = _SELECTED + """
, pos AS (SELECT *, row_number() OVER (PARTITION BY batch_date ORDER BY len(matched) DESC, points DESC, coalesce(date, '') DESC, entry_id) AS rank, count(*) OVER (PARTITION BY batch_date) AS n FROM top
), cut AS (SELECT *, CAST(ceil(round(n * 0.3, 9)) AS BIGINT) AS m, least(CAST(ceil(round(n * 0.4, 9)) AS BIGINT), n - CAST(ceil(round(n * 0.3, 9)) AS BIGINT)) AS w FROM pos
), tops AS (SELECT *, (rank <= m AND points >= 4) AS is_top FROM cut
), place AS (SELECT *, rank - sum(CASE WHEN is_top THEN 1 ELSE 0 END) OVER (PARTITION BY batch_date ORDER BY rank) AS p FROM tops
), bucketed AS (SELECT *, CASE WHEN is_top THEN 'must' WHEN p <= w THEN 'worth' ELSE 'skip' END AS bucket FROM place)
"""


def _ranked(spark, sf) -> DataFrame:
    return ranking.buckets(_selected(spark, sf), ["batch_date"], ranking.order_papers(), "points", 4)


@query(_RANKED + "SELECT entry_id, batch_date, CAST(rank AS INTEGER) AS rank, bucket FROM bucketed")
def buckets_by_rank(spark, sf):
    return _ranked(spark, sf).select("entry_id", "batch_date", "rank", "bucket")


_clean = f"trim(regexp_replace({sql.squash('title')}, '{sql.INVISIBLE}', '', 'g'), ' .;:,')"


@query(_RANKED + f"SELECT batch_date, bucket, string_agg({_clean}, ' · ' ORDER BY rank) AS entries FROM bucketed GROUP BY batch_date, bucket")
def split_table(spark, sf):
    return sinks.split_table(_ranked(spark, sf), "batch_date")


_words = f"array_to_string({sql.unique_ci('list_concat(matched, boosted)')}, ', ')"
_links = "concat_ws(' | ', CASE WHEN coalesce(url, '') <> '' THEN '[page](' || url || ')' END, CASE WHEN coalesce(pdf, '') <> '' THEN '[PDF](' || pdf || ')' END)"
_marked = f"regexp_split_to_array(regexp_replace({sql.squash('abstract')}, '([.!?]) ', '\\1\x01', 'g'), '\x01')"
_short = f"trim(substring(trim(array_to_string({_marked}[1:2], ' ')), 1, 420))"


@query(_RANKED + f"""SELECT batch_date, bucket, CAST(rank AS INTEGER) AS rank, concat_ws(chr(10), '### ' || rank || '. ' || {_clean}, '- score: ' || points, CASE WHEN {_words} <> '' THEN '- keywords: ' || {_words} END,
 CASE WHEN {_links} <> '' THEN '- links: ' || {_links} END, CASE WHEN coalesce(abstract, '') <> '' THEN '> ' || {_short} END) AS lines FROM bucketed""")
def report(spark, sf):
    ranked = _ranked(spark, sf).join(_papers(spark, sf).select("entry_id", "abstract"), "entry_id")
    return sinks.report_lines(ranked, "batch_date").select("batch_date", "bucket", "rank", "lines")


@query(_BASE + f"""
SELECT veto AS bucket, entry_id, coalesce(title, '') AS title, CAST(points AS VARCHAR) AS detail FROM scored WHERE veto IS NOT NULL
UNION ALL SELECT 'below_min_score', entry_id, coalesce(title, ''), CAST(points AS VARCHAR) FROM scored WHERE veto IS NULL AND points < {RULES.min_score}""")
def filter_audit(spark, sf):
    bucket = F.coalesce("veto", F.when(F.col("points") < RULES.min_score, "below_min_score"))
    return sinks.audit_column(_scored(spark, sf), bucket, F.col("points")).select("bucket", "entry_id", "title", "detail")


_TODAY, _KEEP = "2026-01-20", 730


@query(f"""
WITH k AS (SELECT trim(id) AS id, coalesce(date, '') AS date, coalesce(title, '') AS title, coalesce(source, '') AS source FROM history WHERE trim(coalesce(id, '')) <> '' QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY entry_id DESC) = 1),
u AS (SELECT *, trim(coalesce(nullif(id, ''), nullif(doi, ''), nullif(url, ''), '')) AS key FROM papers),
n AS (SELECT key AS id, '{_TODAY}' AS date, coalesce(title, '') AS title, coalesce(source, '') AS source FROM u WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY entry_id) = 1),
m AS (SELECT coalesce(k.id, n.id) AS id, CASE WHEN k.id IS NULL THEN n.date WHEN n.id IS NOT NULL AND k.date > '{_TODAY}' THEN '{_TODAY}' ELSE k.date END AS date,
             coalesce(k.title, n.title) AS title, coalesce(k.source, n.source) AS source FROM k FULL JOIN n ON k.id = n.id)
SELECT * FROM m WHERE date >= strftime(DATE '{_TODAY}' - INTERVAL {_KEEP} DAY, '%Y-%m-%d')""")
def history_update(spark, sf):
    return ranking.update_history(table(spark, sf, "history"), _papers(spark, sf), _TODAY, _KEEP)


# Dates.

_lo, _hi = sql.date_range("date")


@query(f"SELECT entry_id, {_lo} AS lo, {_hi} AS hi FROM papers")
def date_ranges(spark, sf):
    lo, hi = dates.day_range("date")
    return _papers(spark, sf).select("entry_id", lo.alias("lo"), hi.alias("hi"))


_eff = "trim(CASE WHEN coalesce(date_for_window, '') <> '' THEN date_for_window ELSE coalesce(date, '') END)"
_elo, _ehi = sql.date_range("d")


@query(f"WITH t AS (SELECT entry_id, {_eff} AS d, date FROM papers) SELECT entry_id, CASE WHEN d = '' THEN date ELSE d END AS date FROM t WHERE d = '' OR coalesce({_elo} <= DATE '{WINDOW.end}' AND {_ehi} >= DATE '{WINDOW.start}', true)")
def date_window(spark, sf):
    return dates.in_window(_papers(spark, sf), WINDOW).select("entry_id", "date")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, last_day(o_orderdate::DATE) AS month_end, count(*) AS n FROM orders GROUP BY 1, 2")
def month_bounds(spark, sf):
    t = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month"), F.last_day("o_orderdate").alias("month_end"))
    return t.groupBy("month", "month_end").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, sf):
    t = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, b""")
def event_sessions(spark, sf):
    t = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return t.select("user_id", F.col("w.start").alias("start"), "n")


# Journals.

_raw = sql.display("journal")


@query(f"""WITH r AS (SELECT entry_id, {_raw} AS raw FROM papers)
SELECT entry_id, array_to_string(list_distinct_sorted, '|') AS aliases FROM (
  SELECT entry_id, list_filter([raw, trim(regexp_split_to_array(raw, '\\s+:\\s+|\\s*=\\s*')[1]), trim(split_part(raw, ';', 1))], lambda a, i: a <> '' AND list_position([raw, trim(regexp_split_to_array(raw, '\\s+:\\s+|\\s*=\\s*')[1]), trim(split_part(raw, ';', 1))], a) = i) AS list_distinct_sorted FROM r)""")
def journal_aliases(spark, sf):
    return _papers(spark, sf).select("entry_id", F.array_join(tx.journal_aliases("journal"), "|").alias("aliases"))


_jk = sql.journal_key
_FALL = f"""WITH q AS (SELECT {_jk('journal')} AS key, arg_max(quartile, journal_id) AS quartile FROM journal_quartiles WHERE quartile IS NOT NULL GROUP BY 1),
r AS (SELECT entry_id, {_raw} AS raw FROM papers),
k AS (SELECT entry_id, {_jk('raw')} AS k1, {_jk("regexp_split_to_array(raw, '\\s+:\\s+|\\s*=\\s*')[1]")} AS k2, {_jk("split_part(raw, ';', 1)")} AS k3 FROM r),
f AS (SELECT entry_id, coalesce(a.quartile, b.quartile, c.quartile) AS quartile FROM k LEFT JOIN q a ON a.key = k1 LEFT JOIN q b ON b.key = k2 LEFT JOIN q c ON c.key = k3)
"""


@query(_FALL + "SELECT entry_id, CAST(quartile AS INTEGER) AS quartile FROM f WHERE coalesce(quartile, 99) <= 2")
def journal_quartile(spark, sf):
    q = articles.quartiles(table(spark, sf, "journal_quartiles")).select("key", "quartile")
    keys = F.transform(tx.journal_aliases("journal"), tx.journal_key)
    hit = _papers(spark, sf).select("entry_id", keys.alias("keys"))
    # The list of journals is small: it is looked up once for each alias, and papers are not shuffled. The first hit wins.
    for i in (1, 2, 3):
        own = q.select(F.col("key").alias(f"k{i}"), F.col("quartile").alias(f"q{i}"))
        hit = hit.join(own, F.try_element_at("keys", F.lit(i)) == F.col(f"k{i}"), "left")
    hit = hit.withColumn("quartile", F.coalesce("q1", "q2", "q3"))
    return hit.where(F.coalesce("quartile", F.lit(99)) <= 2).select("entry_id", F.col("quartile").cast("int").alias("quartile"))


@query("SELECT journal, n FROM (SELECT journal, count(*) AS n, min(entry_id) AS f FROM papers WHERE coalesce(journal, '') <> '' GROUP BY journal ORDER BY n DESC, f LIMIT 10) WHERE n >= 2 ORDER BY n DESC, f LIMIT 6")
def preferred_journals(spark, sf):
    t = _papers(spark, sf).where(tx.text("journal") != "").groupBy("journal").agg(F.count("*").alias("n"), F.min("entry_id").alias("f"))
    return t.orderBy(F.desc("n"), "f").limit(10).where("n >= 2").orderBy(F.desc("n"), "f").limit(6).select("journal", "n")


# Texts.


@query(f"SELECT entry_id, {_clean} AS title FROM papers")
def clean_titles(spark, sf):
    return _papers(spark, sf).select("entry_id", tx.clean_title("title").alias("title"))


_fn = f"""trim(substring({sql.squash("regexp_replace(coalesce(title, ''), '[\\\\/:*?\"<>|]', ' ', 'g')")}, 1, 110), ' .')"""


@query(f"SELECT entry_id, CASE WHEN {_fn} = '' THEN 'untitled' ELSE {_fn} END AS name FROM papers")
def file_names(spark, sf):
    return _papers(spark, sf).select("entry_id", tx.safe_filename("title").alias("name"))


@query(f"SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS INTEGER) AS cjk, CAST(len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS INTEGER) AS latin FROM documents")
def script_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.count_cjk("text").alias("cjk"), tx.count_latin_words("text").alias("latin"))


_sent = "regexp_split_to_array(regexp_replace(s, '([.!?]) ', '\\1\x01', 'g'), '\x01')"


@query(f"WITH t AS (SELECT entry_id, {sql.squash('abstract')} AS s FROM papers) SELECT entry_id, trim(substring(trim(array_to_string({_sent}[1:2], ' ')), 1, 420)) AS excerpt FROM t")
def excerpts(spark, sf):
    return _papers(spark, sf).select("entry_id", tx.excerpt("abstract").alias("excerpt"))


@query("SELECT entry_id, rtrim(regexp_extract(coalesce(doi, ''), '(?i)\\b(10\\.\\d{4,9}/[^\\s\"''<>]+)', 1), '.,;)]}') AS found FROM papers")
def doi_candidates(spark, sf):
    return _papers(spark, sf).select("entry_id", tx.find_doi("doi").alias("found"))


@query("""SELECT CASE WHEN coalesce(pmc_id, '') <> '' THEN 'pmc' WHEN trim(coalesce(doi, '')) <> '' THEN split_part(trim(doi), '/', 1)
 WHEN coalesce(url, '') <> '' AND regexp_matches(url, '^[a-zA-Z]+://[^/]+') THEN regexp_extract(url, '^[a-zA-Z]+://([^/]+)', 1) ELSE 'unknown' END AS publisher, count(*) AS n FROM papers GROUP BY 1""")
def publishers(spark, sf):
    doi = F.trim(tx.text("doi"))
    site = F.regexp_extract(tx.text("url"), "^[a-zA-Z]+://([^/]+)", 1)
    key = F.when(tx.text("pmc_id") != "", "pmc").when(doi != "", F.element_at(F.split(doi, "/"), 1)).when(site != "", site).otherwise("unknown")
    return _papers(spark, sf).groupBy(key.alias("publisher")).agg(F.count("*").alias("n"))


@query(f"SELECT record_id, {sql.section_hits('full_text')} AS hits FROM reader_records")
def section_hits(spark, sf):
    return table(spark, sf, "reader_records").select("record_id", evidence.section_hits("full_text").alias("hits"))


_mode = "summary_mode"
_lowt = f"lower({sql.squash('title')})"
_clean_body = sql.squash("full_text")
_hay = lambda n: f"lower({sql.squash(f'''coalesce(title, '') || ' ' || substring(coalesce(full_text, ''), 1, {n})''')})"
_full = f"""(coalesce(full_text, '') <> '' AND NOT {sql.contains_any(_hay(4000), evidence.BLOCKED)} AND NOT ({sql.contains_any(_hay(6000), evidence.COOKIE)} AND NOT {sql.contains_any(_hay(6000), evidence.ARTICLE)})
 AND {_lowt} <> '' AND {_lowt} NOT IN ({', '.join(map(sql.quoted, evidence.NO_TITLE))})
 AND ({sql.section_hits('full_text')} >= 2 OR ({sql.section_hits('full_text')} >= 1 AND length({_clean_body}) >= 4500) OR (length({_clean_body}) >= 6000 AND {sql.contains_any(f'lower({_clean_body})', evidence.RESEARCH)})))"""


@query(f"SELECT record_id, {_full} AS is_full, (({sql.contains_any(f'lower({sql.squash(_mode)})', evidence.FULL_TEXT)} OR lower({sql.squash('acquisition_path')}) IN ('elsevier_api', 'pdf', 'fulltext')) AND coalesce(full_text, '') <> '') OR {_full} AS has_text FROM reader_records")
def full_text_evidence(spark, sf):
    return table(spark, sf, "reader_records").select("record_id", evidence.full_article("title", "full_text").alias("is_full"), evidence.has_full_text("title", "full_text", "summary_mode", "acquisition_path").alias("has_text"))


@query("""
WITH l AS (SELECT record_id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) AS line_no FROM reader_records WHERE full_text IS NOT NULL),
b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(\\d+\\. )?[A-Z][A-Za-z ]{2,30}$') THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY line_no) AS block FROM l)
SELECT record_id, CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM b GROUP BY 1, 2""")
def section_blocks(spark, sf):
    t = table(spark, sf, "reader_records").where("full_text is not null")
    t = lines.blocks(t, "record_id", "full_text", r"(?:\d+\. )?[A-Z][A-Za-z ]{2,30}")
    return t.select("record_id", "block", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + F.length(line)).alias("n_chars"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'click' AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE c)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, k""")
def islands_of_clicks(spark, sf):
    return lines.islands(table(spark, sf, "events"), "user_id", F.col("event_type") == "click", "event_id")


# Profile of a library.

_w = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z-]{{2,}}'), lambda w: lower(w))"
_ng = lambda w, n: f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
_TERMS = f"""
WITH w AS (SELECT entry_id, {_w('title')} AS t, {_w('abstract')} AS a, list_filter(list_transform(coalesce(keywords, []), lambda k: lower({sql.squash('k')})), lambda k: k <> '') AS k FROM papers),
s AS (SELECT entry_id, list_concat(list_concat({_ng('t', 1)}, {_ng('t', 2)}), {_ng('t', 3)}) AS t, list_concat({_ng('a', 2)}, {_ng('a', 3)}) AS a, k FROM w),
u AS (SELECT DISTINCT entry_id, term, max(it) AS it, max(ia) AS ia, max(ik) AS ik FROM (
  SELECT entry_id, unnest(t) AS term, 1 AS it, 0 AS ia, 0 AS ik FROM s UNION ALL SELECT entry_id, unnest(a), 0, 1, 0 FROM s UNION ALL SELECT entry_id, unnest(k), 0, 0, 1 FROM s) GROUP BY entry_id, term),
d AS (SELECT term, count(*) AS docs, CAST(sum(it) AS BIGINT) AS title_docs, CAST(sum(ia) AS BIGINT) AS abstract_docs, CAST(sum(ik) AS BIGINT) AS keyword_docs FROM u GROUP BY term)
"""


@query(_TERMS + "SELECT * FROM d")
def document_frequencies(spark, sf):
    return profile.term_statistics(profile.document_terms(spread(_papers(spark, sf).select("entry_id", "title", "abstract", "keywords")), "entry_id"))


@query(_TERMS + """, sc AS (SELECT *, len(regexp_extract_all(term, '[A-Za-z][A-Za-z-]{2,}')) AS n, (2 * docs + 3 * title_docs + abstract_docs - CASE WHEN list_has_any(string_split(term, ' '), ['using', 'study']) THEN 1 ELSE 0 END) * CASE WHEN len(regexp_extract_all(term, '[A-Za-z][A-Za-z-]{2,}')) >= 2 THEN 1.5 ELSE 1.0 END AS score FROM d)
SELECT term, docs, CAST(score AS DOUBLE) AS score FROM sc WHERE (docs >= 2 OR title_docs >= 1 OR abstract_docs >= 1) AND (n <> 1 OR title_docs > 0 OR keyword_docs > 0) ORDER BY score DESC, docs DESC, title_docs DESC, abstract_docs DESC, term LIMIT 80""")
def profile_ranking(spark, sf):
    stats = profile.term_statistics(profile.document_terms(spread(_papers(spark, sf).select("entry_id", "title", "abstract", "keywords")), "entry_id"))
    scored = profile.score_terms(stats, penalties=("using", "study"))
    return scored.orderBy(*profile.rank_terms(scored)).limit(80).select("term", "docs", "score")


@query()
def profile_terms(spark, sf):
    stats = profile.term_statistics(profile.document_terms(spread(_papers(spark, sf).select("entry_id", "title", "abstract", "keywords")), "entry_id"))
    return profile.diverse_terms(profile.score_terms(stats, penalties=("using", "study")))


@query()
def method_names(spark, sf):
    return profile.frequent_names(table(spark, sf, "documents").withColumn("title", F.lit("")), "doc_id", "text", "title", stop=("DNA", "RNA"))


# Merging and library tables.

@query(f"""WITH b AS (SELECT pmid, unnest(min_by(struct_pack(journal := journal, doi := doi, title := title), struct_pack(w := -coalesce(score, 0), o := entry_id))) FROM papers WHERE pmid IS NOT NULL GROUP BY pmid)
SELECT r.record_id, coalesce(nullif(r.journal, ''), nullif(b.journal, ''), r.journal) AS journal, coalesce(nullif(r.doi, ''), nullif(b.doi, ''), r.doi) AS doi, coalesce(nullif(b.title, ''), nullif(r.title, ''), r.title) AS title
FROM reader_records r LEFT JOIN b ON r.pmid = b.pmid""")
def merged_records(spark, sf):
    other = merging.best(_papers(spark, sf).select("pmid", "journal", "doi", "title", "score", "entry_id"), "pmid", F.col("score"), F.col("entry_id")).select("pmid", "journal", "doi", "title")
    base = table(spark, sf, "reader_records").select("record_id", "pmid", "journal", "doi", "title")
    return merging.merge(base, other, "pmid", prefer_new=False, always_new=("title",)).select("record_id", "journal", "doi", "title")


@query("SELECT pmid, arg_min(entry_id, struct_pack(w := -coalesce(score, 0), o := entry_id)) AS entry_id FROM papers WHERE pmid IS NOT NULL GROUP BY pmid")
def best_candidate(spark, sf):
    return merging.best(_papers(spark, sf).select("pmid", "entry_id", "score"), "pmid", F.col("score"), F.col("entry_id")).select("pmid", "entry_id")


@query("SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def eav_pivot(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"))
    values = p.unpivot("p_partkey", ["name", "brand", "size"], "field", "value")
    return library.pivot_values(values, "p_partkey", "field", "value", ["name", "brand", "size"])


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def collection_counts(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT entry_id, title FROM papers WHERE title LIKE '%taste%' ORDER BY entry_id DESC LIMIT 20")
def title_search(spark, sf):
    return _papers(spark, sf).where(F.col("title").like("%taste%")).orderBy(F.desc("entry_id")).limit(20).select("entry_id", "title")


_NODES = "SELECT 'r' || r_regionkey AS n, NULL AS p, r_name AS t FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier"


def _nodes(spark, sf) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    return r.unionByName(n).unionByName(s)


@query(f"WITH RECURSIVE nodes AS ({_NODES}), walk(node, root, depth, path) AS (SELECT n, n, 0, t FROM nodes WHERE p IS NULL UNION ALL SELECT c.n, w.root, w.depth + 1, w.path || '/' || c.t FROM walk w JOIN nodes c ON c.p = w.node) SELECT * FROM walk")
def tree_paths(spark, sf):
    return library.tree_paths(spark, _nodes(spark, sf), "node", "parent", "name")


@query(f"WITH RECURSIVE nodes AS ({_NODES}), below(a, n) AS (SELECT n, n FROM nodes UNION ALL SELECT b.a, c.n FROM below b JOIN nodes c ON c.p = b.n) SELECT a AS ancestor, count(*) AS n FROM below GROUP BY a")
def subtree_counts(spark, sf):
    return library.descendants(spark, _nodes(spark, sf), "node", "parent").groupBy("ancestor").agg(F.count("*").alias("n"))


# Article records.


@query()
def article_fields(spark, sf):
    t = articles.article_fields(spread(table(spark, sf, "pubmed_raw").select("raw_id", "payload")))
    return t.select("raw_id", "pmid", "doi", "title", "journal", "date", F.size("keywords").alias("n_keywords"))


@query()
def article_abstracts(spark, sf):
    return articles.abstracts(spread(table(spark, sf, "pubmed_raw").select("raw_id", "payload")))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
