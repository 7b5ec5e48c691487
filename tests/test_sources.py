import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from scholion.operators import matching
from scholion.sources import articles, library_db, paged
from scholion.streaming import incremental


def test_paged_source(spark, tmp_path):
    items = [{"title": f"T{i}", "doi": f"10.1/{i % 240}", "server": "bioRxiv", "version": "1", "category": "Ecology" if i % 2 else "genetics", "authors": "A B; C D", "date": "2025-01-01", "abstract": "x"} for i in range(250)]
    items[3]["title"], items[4]["doi"] = "", None
    for s in range(0, 250, 100):
        (tmp_path / f"{s}.json").write_text(json.dumps({"total": 250, "items": items[s : s + 100]}))
    pages = paged.read_pages(spark, str(tmp_path))
    assert pages.count() == 250 and paged.read_pages(spark, str(tmp_path), limit=120).count() == 120
    rows = paged.preprint_rows(pages)
    assert rows.count() == 240 and rows.where("id = 'biorxiv:10.1/0v1'").first()["position"] == 0
    assert rows.first()["authors"] == "A B, C D"
    assert {r[0] for r in paged.preprint_rows(pages, ("ecology",)).select("category").distinct().collect()} == {"Ecology"}


def test_retries():
    calls = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        paged.retried(fail)
    assert len(calls) == 3

    def gone():
        calls.append(1)
        raise FileNotFoundError

    with pytest.raises(FileNotFoundError):
        paged.retried(gone)
    assert len(calls) == 4


def test_query_chunks():
    terms = paged.query_terms([f"long keyword {i}" for i in range(80)] + ["mice", "mice", ' "x" '])
    chunks = paged.query_chunks(terms, 500)
    assert len(chunks) > 1 and all(len(c) <= 500 for c in chunks) and " OR ".join(chunks) == " OR ".join(terms)
    assert '"long keyword 1"[Title/Abstract]' in terms and terms.count("mice[Title/Abstract]") == 1


def test_inverted_abstract(spark):
    df = spark.createDataFrame([('{"the": [0, 2], "cat": [1], "mat": [3]}',), (None,), ("{}",)], "j string")
    assert [r[0] for r in df.select(paged.inverted_abstract("j")).collect()] == ["the cat the mat", "", ""]


ARTICLE = """<PubmedArticle><MedlineCitation><PMID> 7 </PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2025</Year><Month>Aug</Month></PubDate></JournalIssue></Journal><ArticleTitle>A <i>title</i>.</ArticleTitle>
<Abstract><AbstractText Label="AIM">One.</AbstractText><AbstractText></AbstractText><AbstractText>Two.</AbstractText></Abstract><ArticleDate><Year>2025</Year><Month>07</Month><Day>3</Day></ArticleDate></Article><KeywordList><Keyword>k</Keyword><Keyword> </Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_articles(spark):
    df = spark.createDataFrame([(1, ARTICLE), (2, None), (3, "")], "raw_id long, payload string")
    got = {r["raw_id"]: r for r in articles.article_fields(df).collect()}
    r = got[1]
    assert (r["pmid"], r["doi"], r["title"], r["journal"], r["date"], r["date_candidates"], r["keywords"]) == ("7", "10.1/x", "A title", "J", "2025-07-3", ["2025-07-3", "2025-08"], ["k"])
    assert got[2]["pmid"] == "" and got[3]["keywords"] == []
    assert [tuple(x) for x in articles.abstracts(df).collect()] == [(1, "AIM: One. Two.")]


def test_quartiles(spark):
    df = spark.createDataFrame([(1, "Taste & Smell", 2, None, "Y"), (2, "TASTE AND SMELL", 3, "N", ""), (3, "X", None, None, None), (4, None, 1, None, None)], "journal_id int, journal string, quartile int, top string, open_access string")
    assert [(r["key"], r["quartile"]) for r in articles.quartiles(df).collect()] == [("TASTE AND SMELL", 3)]


def test_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "n 1.md").write_text("---\ntitle: \"T\"\ntags: x # c\ntitle: again\n---\nbody")
    (tmp_path / "a" / "n.bak-1.md").write_text("x")
    (tmp_path / ".hidden" / "h.md").write_text("x")
    (tmp_path / "plain.md").write_text("no front matter")
    got = {r["stem"]: r["front"] for r in articles.notes(spark, str(tmp_path)).collect()}
    assert got == {"n 1": {"title": "T", "tags": "x"}, "plain": {}}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "item data" (id INTEGER, name TEXT, size REAL)')
        db.executemany('INSERT INTO "item data" VALUES (?, ?, ?)', [(i, f"n{i}" if i % 3 else None, i / 2) for i in range(1000)])
        db.execute("CREATE TABLE empty (id INTEGER)")
    df = library_db.read_sqlite(spark, path, "item data")
    assert df.count() == 1000 and df.where("name is null").count() == 334 and dict(df.dtypes)["size"] == "double"
    assert library_db.read_sqlite(spark, path, "empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        library_db.read_sqlite(spark, path, "none").count()


def test_incremental_run(spark, tmp_path):
    schema = "id string, title string, abstract string, keywords array<string>, journal string, at timestamp"
    rows = [("a", "Mice", "x", None, "J", "2025-01-01 10:00:00"), ("b", "Rats", "x", None, "J", "2025-01-01 11:00:00")]
    again = [("a", "Mice", "x", None, "J", "2025-01-02 10:00:00"), ("c", "More mice", "x", None, "J", "2025-01-02 11:00:00")]
    for k, part in enumerate((rows, again)):
        spark.createDataFrame(part, "id string, title string, abstract string, keywords array<string>, journal string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rules = matching.Rules(keywords=("mice",), min_score=1)
    out = str(tmp_path / "out")
    incremental.run_batches(incremental.scored(incremental.first_seen(stream, "id", "at"), rules), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "c"]
    counts = []
    incremental.run_batches(incremental.daily_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), "at", "journal"), lambda df, n: counts.append(df.count()), str(tmp_path / "ck2"))
    assert counts
    sessions = []
    incremental.run_batches(incremental.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), "at", "journal"), lambda df, n: sessions.append(df.count()), str(tmp_path / "ck3"))
    assert sessions


def test_batches_are_split_around_bad_records(spark):
    def fetch(ids):
        if "13" in ids:
            raise ValueError("bad")
        return [(i, f"item {i}") for i in ids if i != "7"]

    ids = spark.createDataFrame([(str(i),) for i in range(40)] + [(None,), ("1",)], "id string").repartition(3)
    got = {r["id"]: (r["item"], r["kind"]) for r in paged.fetch_batches(ids, fetch, size=8).collect()}
    assert len(got) == 40 and got["13"] == (None, "error") and got["7"] == (None, "missing") and got["12"] == ("item 12", "ok")
    assert paged.fetch_batches(ids.limit(0), fetch).count() == 0


def test_windows_recover_day_by_day(spark):
    def fetch(start, end):
        if start != end or start == "2025-01-03":
            raise TimeoutError
        return [("x", start), (f"p{start[-1]}", "i")]

    from scholion.operators.dates import window_between

    rows = paged.read_windows(spark, [window_between("2025-01-01", "2025-01-04"), window_between("2025-01-06", "2025-01-06")], fetch).collect()
    assert sorted((r["id"] or "", r["start"], r["kind"]) for r in rows) == [("", "2025-01-03", "timeout"), ("p1", "2025-01-01", "ok"), ("p2", "2025-01-02", "ok"), ("p4", "2025-01-04", "ok"), ("p6", "2025-01-06", "ok"), ("x", "2025-01-01", "ok")]
    assert paged.read_windows(spark, [], fetch).count() == 0


def test_kinds_and_budgets():
    def broken():
        raise OSError

    assert paged.fetched(lambda: 1) == (1, "ok") and paged.fetched(lambda: open("/nowhere/x")) == (None, "missing") and paged.fetched(broken, tries=1) == (None, "error")
    assert paged.fetched(lambda: json.loads("{"))[1] == "json"
    assert [paged.budget(*a) for a in ((300, 1, 3000), (300, 30, 3000), (300, 30, 0), (0, 5, 10))] == [300, 3000, 9000, 0]
