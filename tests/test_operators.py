import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from scholion.functions.text import norm_tokens_py
from scholion.operators import dates, evidence, library, lines, matching, merging, nested, profile, ranking, sinks


def test_windows():
    w = dates.window("2025-3-21", 3)
    assert (w.start, w.end, w.days) == (date(2025, 3, 19), date(2025, 3, 21), 3)
    assert [m.start.day for m in dates.months(dates.window_between("2025-01-30", "2025-03-02"))] == [30, 1, 1]
    for bad in (lambda: dates.window("2025-01-01", 0), lambda: dates.window_between("2025-02-01", "2025-01-01"), lambda: dates.parse_day("")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    "value, lo, hi",
    [("2025", "2025-01-01", "2025-12-31"), ("2025-02", "2025-02-01", "2025-02-28"), ("2024-12", "2024-12-01", "2024-12-31"), ("2025-08-7", "2025-08-07", "2025-08-07"), ("2025-02-30", None, None), ("2025-Summer", None, None), ("", None, None), (None, None, None), ("0", None, None), ("2025-13", None, None)],
)
def test_day_ranges(spark, value, lo, hi):
    a, b = dates.day_range("d")
    r = spark.createDataFrame([(value,)], "d string").select(a.alias("a"), b.alias("b"), dates.overlaps("d", dates.window("2025-02-10")).alias("o")).first()
    assert (str(r["a"]) if r["a"] else None, str(r["b"]) if r["b"] else None) == (lo, hi)
    assert r["o"] == (lo is None or lo <= "2025-02-10" <= hi)


RULES = matching.Rules(keywords=("taste perception", "bitter taste perception", "mice"), boosts=("bitter taste", "taste letters"), negatives=("retracted",), rejected_journals=("dust",), variants={"mice": ("mouse", "mice")})
PAPER = "title string, abstract string, keywords array<string>, journal string"


def plain_score(p):
    pad = lambda x: f" {' '.join(norm_tokens_py(x))} "
    title, journal = pad(p[0]), pad(p[3])
    body = pad((p[1] or "") + " , " + " ".join(p[2] or []))
    full = title + body[1:] + journal[1:]
    has = lambda t, k: any(f" {v} " in t for v in RULES.phrases(k))

    def reduce(ks):
        return [k for k in ks if not any(len(norm_tokens_py(o)) > len(norm_tokens_py(k)) and pad(k) in pad(o) for o in ks)]

    if any(has(journal, j) for j in RULES.rejected_journals) or any(has(full, n) for n in RULES.negatives):
        return -999
    t = reduce([k for k in RULES.keywords if has(title, k)])
    a = reduce([k for k in RULES.keywords if k not in t and has(body, k)])
    base = 3 * len(t) + len(a)
    boosts = reduce([k for k in RULES.boosts if has(full, k)])
    return base + (min(len(boosts), 2) + any(has(title, k) for k in RULES.boosts) if base else 0)


def test_scores_against_a_plain_version(spark):
    papers = [
        ("Bitter taste perceptions in mouse", "About mice", ["x"], "Taste Letters"), ("Nothing", "bitter taste perception", None, "J"), ("Taste perception", "bitter taste", [], "Volcanic Dust"), ("Mice", "retracted", None, None), (None, None, None, None),
        ("Bitter", "taste perception", None, "J"), ("x", "y", ["mouse"], "Taste Letters"), ("Bitter taste", "", None, "J"), ("taste perception and bitter taste perception", "", None, "J"),
    ]
    got = [r["points"] for r in matching.score(spark.createDataFrame(papers, PAPER), RULES).collect()]
    assert got == [plain_score(p) for p in papers]
    assert matching.score(spark.createDataFrame([], PAPER), RULES).count() == 0
    matched = matching.score(spark.createDataFrame(papers[:1], PAPER), RULES).first()
    assert matched["matched"] == ["bitter taste perception", "mice"] and matched["boosted"] == ["bitter taste", "taste letters"]


def test_phrase_pairs_equal_the_cross_test(spark):
    texts = [(1, "Bitter tastes of mice"), (2, None), (3, "mice, mice")]
    phrases = [("bitter taste",), ("mice",), ("of",), (None,), ("",)]
    got = matching.pairs(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(phrases, "p string"), "p")
    assert sorted(map(tuple, got.collect())) == [(1, "bitter taste"), (1, "mice"), (1, "of"), (3, "mice")]


@pytest.mark.parametrize("most_broadcast", [matching.MOST_BROADCAST, 0])
def test_phrase_pairs_never_broadcast_the_runs_of_the_texts(spark, tmp_path, most_broadcast):
    # The table of phrases is the larger file, so that sizes of files speak for the texts; two rows share an id.
    spark.createDataFrame([(i // 2, f"Bitter tastes of mice, of w{i} v{i}") for i in range(40)], "id int, t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(f"W{i} v{i}", f"{i * 7919:x}" * 40) for i in range(3000)] + [("mice", ""), ("of mice", ""), ("Mice!", "")], "p string, more string").coalesce(1).write.parquet(f"{tmp_path}/p")
    df = matching.pairs(spark.read.parquet(f"{tmp_path}/t"), "id", "t", spark.read.parquet(f"{tmp_path}/p"), "p", most_broadcast=most_broadcast)
    assert sorted(map(tuple, df.collect())) == sorted((i // 2, p) for i in range(40) for p in ("mice", "of mice", "Mice!", f"W{i} v{i}"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (most_broadcast > 0) and ("SortMergeJoin" in plan) == (most_broadcast == 0)


def test_runs_without_the_hash_of_a_phrase_are_not_shuffled(spark):
    grams = spark.createDataFrame([(i, f"w{i}") for i in range(2000)], "id int, __gram string")
    keyed = spark.createDataFrame([(f"w{i}",) for i in range(0, 2000, 100)] + [(f"v{i}",) for i in range(200)], "__gram string")
    kept = {r["id"] for r in matching._possible(grams, keyed, 220).collect()}
    assert kept >= set(range(0, 2000, 100)) and len(kept) < 200


@pytest.mark.parametrize("scores", [[], [5], [1], [5, 5], [5, 1, 5], [9, 8, 7, 3, 2, 1, 1, 1, 1, 1], [1] * 7, list(range(30, 0, -1))])
def test_buckets(spark, scores):
    n = len(scores)
    must, worth = math.ceil(n * 0.3), math.ceil(n * 0.4)
    worth = min(worth, n - must)
    top = [i for i in range(must) if scores[i] >= 4]
    rest = [i for i in range(n) if i not in top]
    want = {i: "must" for i in top} | {i: "worth" for i in rest[:worth]} | {i: "skip" for i in rest[worth:]}
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "g int, i int, s int")
    got = {r["i"]: r["bucket"] for r in ranking.buckets(df, ["g"], [F.col("i")], "s", 4).collect()}
    assert got == want


def test_duplicates_and_history(spark):
    rows = [(1, "a", "10.1/x", "", "T", "pubmed"), (2, "a", "10.1/x", "", " t ", "pubmed"), (3, "b", "10.1/x", "", "T", "biorxiv"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "entry_id int, id string, doi string, pmid string, title string, source string").withColumn("url", F.lit(""))
    once = ranking.first_of_each(df, ranking.paper_key(), "entry_id")
    assert sorted(r["entry_id"] for r in once.collect()) == [1, 3, 4] and once.columns == df.columns
    seen = spark.createDataFrame([("b",), ("",), (None,)], "id string")
    assert sorted(r["entry_id"] for r in ranking.drop_known(once, seen, ranking.paper_id()).collect()) == [1, 4]


def test_history_update(spark):
    old = [("a", "2025-01-01", "A", "s"), ("b", "2025-03-01", "B", "s"), ("c", "", "C", "s"), ("d", "2026-01-01", "D", "s"), (None, "2025-03-01", "E", "s"), ("k", "2025-02-13", "K", "s")]
    new = [("d", "D2", "s"), ("e", "E", "s"), ("e", "E", "s"), ("", "F", "s")]
    old = [(i, *r) for i, r in enumerate(old)]
    new = [(100 + i, r[0], None, None, *r[1:]) for i, r in enumerate(new)] + [(200, "", " 10.1/x ", "u", "G", "s"), (201, None, "", "https://x.example/h", "H", None), (202, " b ", None, None, "B2", "s")]
    got = ranking.update_history(spark.createDataFrame(old, "entry_id long, id string, date string, title string, source string"), spark.createDataFrame(new, "entry_id long, id string, doi string, url string, title string, source string"), "2025-03-15", 30)
    assert sorted(map(tuple, got.collect())) == [
        ("10.1/x", "2025-03-15", "G", "s"), ("b", "2025-03-01", "B", "s"), ("d", "2025-03-15", "D", "s"), ("e", "2025-03-15", "E", "s"), ("https://x.example/h", "2025-03-15", "H", ""), ("k", "2025-02-13", "K", "s"),
    ]


def test_prefilter_and_admission(spark):
    rules = matching.Rules(keywords=("seed dormancy",), boosts=("mice",))
    rows = [(1, "pubmed", "Seed dormancies", None), (2, "pubmed", "x", "work on mice"), (3, "pubmed", "x", "y"), (4, "biorxiv", "x", "y"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "i int, source string, title string, abstract string")
    assert sorted(r["i"] for r in matching.semi(df, rules).collect()) == [1, 2, 4, 5]
    assert matching.semi(df, matching.Rules()).count() == 5
    stats = [("taste", 1, 1, 0, 0), ("seed", 1, 0, 0, 1), ("root", 3, 0, 0, 0), ("kelp bed", 1, 0, 1, 0), ("kelp sea", 1, 0, 0, 1), ("gene x", 2, 0, 0, 0), ("mice", 2, 1, 0, 0)]
    got = profile.score_terms(spark.createDataFrame(stats, "term string, docs long, title_docs long, abstract_docs long, keyword_docs long"), blacklist=("mice",))
    assert {r["term"]: r["score"] for r in got.collect()} == {"taste": 5.0, "kelp bed": 4.5}


def test_firsts_and_best_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", None), (4, None, 5), (5, "b", 0)], "i long, k string, w int")
    assert sorted(r["i"] for r in ranking.first_of_each(df, [F.col("k")], "i").collect()) == [1, 2, 4]
    assert sorted((r["k"], r["i"]) for r in merging.best(df, "k", F.col("w"), F.col("i")).collect()) == [("a", 1), ("b", 2)]
    assert merging.best(df.limit(0), "k", F.col("w"), F.col("i")).count() == 0


def test_evidence(spark):
    rows = [("T", "Introduction\nx\nMethods\ny"), ("Just a moment", "Introduction Methods"), ("T", "Methods: x"), ("", "Introduction Methods"), ("T", None), ("T", "We manage cookies here")]
    got = spark.createDataFrame(rows, "t string, b string").select(evidence.full_article("t", "b").alias("f"), evidence.section_hits("b").alias("h"), evidence.text_quality("b").alias("q")).collect()
    assert [r["f"] for r in got] == [True, False, False, False, False, False]
    assert [r["h"] for r in got][:3] == [2, 2, 0] and got[4]["q"] == -1 and got[5]["q"] == -1


def test_merge(spark):
    base = spark.createDataFrame([(1, "p", "", [], "old"), (2, None, "x", ["a"], "o"), (3, "q", None, ["a"], "")], "r int, k string, t string, l array<string>, f string")
    extra = spark.createDataFrame([("p", "T", ["b", "c"], "new", 5), ("q", "", [], "n", None), (None, "no", ["z"], "no", 1)], "k string, t string, l array<string>, f string, extra int")
    got = {r["r"]: tuple(r)[2:] for r in merging.merge(base, extra, "k", prefer_new=False, always_new=("f",)).collect()}
    assert got == {1: ("T", ["b", "c"], "new", 5), 2: ("x", ["a"], "o", None), 3: (None, ["a"], "n", None)}
    assert merging.merge(base, extra, "k").where("r = 1").first()["t"] == "T"
    rows = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 3), (None, 9, 4)], "k string, w int, i int")
    assert [tuple(r) for r in merging.best(rows, "k", F.col("w"), F.col("i")).collect()] == [("a", 3, 2)]


def test_library(spark):
    values = spark.createDataFrame([(1, "t", "A"), (1, "d", "2020"), (2, "t", "B"), (2, "x", "y")], "i int, f string, v string")
    assert sorted(map(tuple, library.pivot_values(values, "i", "f", "v", ["t", "d"]).collect())) == [(1, "A", "2020"), (2, "B", None)]
    assert {r["i"]: r["attributes"] for r in library.attribute_map(values, "i", "f", "v").collect()}[1] == {"d": "2020", "t": "A"}
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "b"), (5, 6, "loop"), (6, 5, "loop")], "n int, p int, t string")
    paths = library.tree_paths(spark, nodes, "n", "p", "t")
    assert {r["n"]: r["path"] for r in paths.collect()} == {1: "a", 2: "a/b", 3: "a/b/c", 4: "b"}
    assert library.unique_leaf(paths, F.lit("c"), "n").first()["n"] == 3
    assert library.unique_leaf(paths, F.lit("a/b"), "n").first()["n"] == 2
    t = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert library.insert_absent(t, spark.createDataFrame([(2, "z"), (3, "z"), (3, "z")], "k int, v string"), ["k"]).count() == 3
    assert library.delete_rows(t, spark.createDataFrame([(1,)], "k int")).count() == 1


def test_lines(spark):
    df = spark.createDataFrame([(1, "x\nIntro\na\nb\nEnd\nc"), (2, None), (3, "")], "r int, t string")
    exploded = lines.explode_lines(df, "r", "t")
    got = lines.blocks(df.unionByName(spark.createDataFrame([(4, "Intro\n\nEnd\n"), (5, "End\nEnd")], "r int, t string")), "r", "t", "[A-Z][a-z]*")
    have = {(r["r"], r["block"]): r["lines"] for r in got.collect()}
    assert have == {(1, 0): ["x"], (1, 1): ["Intro", "a", "b"], (1, 2): ["End", "c"], (3, 0): [""], (4, 1): ["Intro", ""], (4, 2): ["End", ""], (5, 1): ["End"], (5, 2): ["End"]}
    runs = lines.islands(exploded, "r", F.length("line") == 1).where("r = 1").orderBy("first").collect()
    assert [(r["first"], r["last"], r["n"]) for r in runs] == [(1, 1, 1), (3, 4, 2), (6, 6, 1)]
    assert spark.createDataFrame([("Title Abstract: the text Keywords: a",)], "t string").select(lines.between(F.col("t"), "abstract:", "keywords:")).first()[0] == "the text"


def test_profile(spark):
    docs = [(1, "Bitter taste receptors", "bitter taste receptors in mice", ["Taste"]), (2, "Bitter taste", "other words here", None), (3, None, None, None)]
    terms = profile.document_terms(spark.createDataFrame(docs, "d int, title string, abstract string, keywords array<string>"), "d")
    stats = {r["term"]: r for r in profile.term_statistics(terms).collect()}
    assert (stats["bitter taste"]["docs"], stats["bitter taste"]["title_docs"], stats["bitter taste"]["abstract_docs"]) == (2, 2, 1)
    scored = profile.score_terms(profile.term_statistics(terms))
    assert {r["term"]: r["score"] for r in scored.collect()}["bitter taste"] == 16.5
    chosen = [r["term"] for r in profile.diverse_terms(scored, 5).collect()]
    assert chosen[0] == "bitter taste" and "taste" not in chosen


def test_method_names(spark):
    t = "AlphaFold2 and AlphaFold2 use DNA DNA DNA, BLAST once, GraphNet twice GraphNet, Cell-Ranger Cell-Ranger."
    got = profile.frequent_names(spark.createDataFrame([(1, t, "A GraphNet study"), (2, None, None)], "d int, text string, title string"), "d", "text", "title", stop=("DNA",))
    assert [(r["name"], r["n"]) for r in got.collect()] == [("AlphaFold2", 4), ("Cell-Ranger", 2)]


XML = """<?xml version="1.0"?><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText Label="A">One <b>two</b></AbstractText><AbstractText/></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>L</LastName><AffiliationInfo><Affiliation>X</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>Y &amp; Z</Affiliation></AffiliationInfo><Identifier Source="O">i</Identifier></Author>
<!-- <Author>no</Author> --><Author><CollectiveName>C</CollectiveName></Author></AuthorList></Article><OtherAbstract><AbstractText>no</AbstractText></OtherAbstract></MedlineCitation></PubmedArticle>"""


def test_nested_records(spark):
    rows = [(1, XML), (1, XML), (2, None), (3, ""), (4, "<PubmedArticle><broken"), (5, "<PubmedArticle/>")]
    df = spark.createDataFrame(rows, "raw_id long, payload string").withColumn("parent_id", F.lit("clash")).withColumn("pos", F.lit(9))
    got = [tuple(r) for r in nested.xml_children(df, "raw_id", "payload").select("child", "parent_id", "pos", "sub_pos").collect()]
    once = [("author", 1, 1, 0), ("author", 1, 2, 0), ("affiliation", 1, 1, 1), ("affiliation", 1, 1, 2), ("identifier", 1, 1, 1), ("abstract", 1, 1, 0), ("abstract", 1, 2, 0)]
    assert sorted(got) == sorted(once * 2)
    tables = nested.xml_tables(df.limit(1), "raw_id", "payload")
    assert [r["affiliation"] for r in tables["affiliation"].orderBy("sub_pos").collect()] == ["X", "Y & Z"]
    assert [(r["text"], r["label"]) for r in tables["abstract"].orderBy("pos").collect()] == [("One two", "A"), ("", None)]
    assert [r["last_name"] for r in tables["author"].orderBy("pos").collect()] == ["L", None]
    assert [r["parent_id"] for r in nested.errors(df, "raw_id", "payload").collect()] == [4]
    assert nested.xml_triples(df.limit(1), "raw_id", "payload").where("path = '@Source'").first()["value"] == "O"
    assert nested.xml_children(df.limit(0), "raw_id", "payload").count() == 0


def test_nested_arrays(spark):
    kind = "record_id long, items array<struct<index: int, label: string>>, pos int"
    df = spark.createDataFrame([(1, [(None, None), (2, "x")], 0), (2, None, 0), (3, [], 0)], kind)
    got = [(r["parent_id"], r["pos"], r["item_index"]) for r in nested.array_children(df, "record_id", "items", "figure").orderBy("pos").collect()]
    assert got == [(1, 1, None), (1, 2, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "T.", "s", None, "u", "", "A sentence. More. Third.", ["k"], ["K", "b"], 5, "must", 1, "g")], "entry_id int, title string, source string, date string, url string, pdf string, abstract string, matched array<string>, boosted array<string>, points int, bucket string, rank int, g string")
    line = sinks.report_lines(df, "g").first()["lines"]
    assert line.split("\n") == ["### 1. T", "- score: 5", "- keywords: k, b", "- links: [page](u)", "> A sentence. More."]
    sinks.write_report(sinks.report_lines(df, "g"), "g", str(tmp_path / "r"))
    assert (tmp_path / "r" / "g=g").exists()
    bucket = F.when(F.col("points") > 3, "low")
    sinks.write_audit(sinks.audit_column(df.unionByName(df.withColumn("points", F.lit(1))), bucket, F.col("points")), str(tmp_path / "a"))
    assert [(r["bucket"], r["detail"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()] == [("low", "5")]


def test_status():
    ok = sinks.status("r1", "2025-03-21", 3, 0, 0)
    sinks.require_ready(ok, "2025-03-21", 3, 0, "r1")
    assert json.loads(sinks.status("r1", "2025-03-21", 3, 0, 2))["status"] == "failed"
    for wrong in ((ok, "2025-03-22", 3, 0, "r1"), (ok, "2025-03-21", 3, 1, "r1"), (sinks.status("r1", "2025-03-21", 3, 5, 1), "2025-03-21", 3, 5, "r1")):
        with pytest.raises(RuntimeError):
            sinks.require_ready(*wrong)


def test_repeated_leaves_are_kept_and_groups_derived(spark):
    one = "<R><L><A><N>x</N><F>1</F><F>2</F></A><A><N>y</N></A></L><K>k</K></R>"
    rows = [(1, one), (2, "<R><L><A><N>z</N></A></L><K>a</K><K>b</K></R>"), (3, None), (4, "<R"), (5, "")]
    df = spark.createDataFrame(rows, "id long, payload string").withColumn("child", F.lit("clash"))
    groups = nested.derived_groups(df, "id", "payload")
    assert [(g.name, g.path, g.within) for g in groups] == [("K", "R/K", None), ("A", "R/L/A", None), ("F", "R/L/A/F", "A")] or sorted((g.name, g.path, g.within) for g in groups) == [("A", "R/L/A", None), ("F", "R/L/A/F", "A"), ("K", "R/K", None)]
    got = sorted((r["parent_id"], r["child"], r["pos"], r["sub_pos"], r["leaves"]["."]) for r in nested.xml_children(df, "id", "payload", groups).collect())
    assert [g for g in got if g[1] == "F"] == [(1, "F", 1, 1, "1"), (1, "F", 1, 2, "2")]
    assert [g[4] for g in got if g[1] == "K"] == ["k", "a", "b"] and [g[4] for g in got if g[1] == "A"] == ["x12", "y", "z"]
    own = (nested.Group("a", "R/L/A", (("F", "f"),)),)
    kept = nested.xml_children(df, "id", "payload", own).where("parent_id = 1 and pos = 1").first()["leaves"]
    assert kept == {"F": "1", "F#2": "2"}
    assert nested.derived_groups(df.limit(0), "id", "payload") == ()
