import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.functions import html, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "word, want",
    [("studies", "study"), ("species", "specie"), ("series", "serie"), ("diseases", "diseas"), ("disease", "disease"), ("analyses", "analys"), ("analysis", "analysis"), ("virus", "virus"), ("viruses", "virus"), ("process", "process"), ("processes", "process"), ("niches", "nich"), ("boxes", "box"), ("lenses", "lens"), ("DNA", "dna"), ("TAS2R38", "tas2r38"), ("genes", "gene"), ("ties", "tie"), ("gas", "gas"), ("its", "its")],
)
def test_plural_endings(spark, word, want):
    assert one(spark, text.norm_tokens("w"), w=word) == [want]
    assert text.norm_tokens_py(word) == [want]


@pytest.mark.parametrize("value", ["", None, "é中文—", "  ", "ÉCI β‑catenin's x-ray", "KKg"])
def test_tokens_are_ascii_runs(spark, value):
    assert one(spark, text.norm_tokens("w"), w=value) == text.norm_tokens_py(value)


def test_tokens_on_driver_and_cluster_agree(spark):
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text("aeisxzchuny -S9é", max_size=14), min_size=20, max_size=20))
    def check(values):
        rows = spark.createDataFrame([(v,) for v in values], "w string").select("w", text.norm_tokens("w").alias("t")).collect()
        assert all(r["t"] == text.norm_tokens_py(r["w"]) for r in rows)

    check()


def test_unique_and_contained(spark):
    assert one(spark, text.unique_ci(F.col("a")), a=[" Taste  A", "taste a", "", "B", None]) == ["Taste A", "B"]
    assert one(spark, text.unique_cs(F.col("a")), a=["a", "A", "a "]) == ["a", "A"]
    assert one(spark, text.drop_contained(F.col("a")), a=["taste", "bitter tastes", "Bitter taste perception", "mice", "taste"]) == ["Bitter taste perception", "mice"]


def test_names_and_titles(spark):
    assert one(spark, text.clean_title("t"), t=" A​ title . ; ") == "A title"
    assert one(spark, text.safe_filename("t"), t='a/b: "c" ?') == "a b c"
    assert one(spark, text.safe_filename("t"), t=None) == "untitled"
    assert one(spark, text.split_authors("t"), t="A B; C D") == ["A B", "C D"]
    assert one(spark, text.split_authors("t"), t="A B and C D") == ["A B", "C D"]
    assert one(spark, text.author_candidates(F.col("a")), a=["A B", "x@y.z", "https://orcid.example/1", "1234", "a b"]) == ["A B"]
    assert one(spark, text.split_override("t"), t="bitter taste, mice；rats") == ["bitter taste", "mice", "rats"]
    assert one(spark, text.split_override("t"), t=" mice  rats ") == ["mice", "rats"]


@pytest.mark.parametrize("y, m, d, want", [("2025", "Aug", "7", "2025-08-7"), ("2025", "8", "", "2025-08"), ("2025", "", "7", "2025-7"), ("2025", "Summer", "", "2025-Summer"), ("", "8", "7", ""), (None, None, None, "")])
def test_bibliographic_dates(spark, y, m, d, want):
    assert one(spark, text.bibliographic_date(F.col("y"), F.col("m"), F.col("d")), y=y, m=m, d=d) == want


def test_journals(spark):
    assert one(spark, text.journal_aliases("j"), j="Current biology : CB; new") == ["Current biology : CB; new", "Current biology", "Current biology : CB"]
    assert one(spark, text.journal_key("j"), j="Taste & Smell (Online)") == "TASTE AND SMELL"


def test_sentences(spark):
    s = "One is here. Two is there! 三个。 Four?"
    assert one(spark, text.first_sentence("s"), s=s) == "One is here."
    assert one(spark, text.excerpt("s"), s=s) == "One is here. Two is there!"
    assert one(spark, text.question("s"), s="Why?? ") == "Why?"
    assert one(spark, text.bullets(F.col("a"), 1, "none"), a=["x", "y"]) == "- x"
    assert one(spark, text.bullets(F.col("a"), 1, "none"), a=[]) == "none"


def test_counts_and_stems(spark):
    assert one(spark, text.count_cjk("s"), s="中文 abc") == 2
    assert one(spark, text.count_latin_words("s"), s="an abc de fghi") == 2
    assert one(spark, text.cjk_share("s"), s="中 a") == 0.5
    got = one(spark, F.transform(text.words3("s"), text.profile_stem), s="binding binders tasted genes is DNA")
    assert got == ["bind", "bind", "tast", "gene", "dna"]
    assert one(spark, text.ngrams(F.col("a"), (1, 2)), a=["x", "y", "x"]) == ["x", "y", "x y", "y x"]
    assert one(spark, text.ngrams(F.col("a"), (3,)), a=["x"]) == []


def test_identifiers(spark):
    assert one(spark, text.find_doi("s"), s="see https://doi.example/10.1234/ab.c), x") == "10.1234/ab.c"
    assert one(spark, text.preprint_version("s"), s="10.1101/2024.01.01v3") == "3"
    assert one(spark, text.host("s"), s="https://www.Site.example:8080/x") == "site.example"


PAGE = """<html><head><meta name="citation_author" content="A B"><meta content="C D" name="citation_author">
<meta name="citation_author_institution" content="University X"><script>var x = "<p>this is no paragraph of the text but of a script, really</p>";</script></head>
<body><h2>1. Introduction</h2><p>Short.</p><p>This paragraph has more than fifty characters, so it is kept &amp; read.</p>
<h2>2. Materials and Methods</h2><p>We did much. We did more of it than anyone had done before in this field of study [3].</p><h3>Download citation BibTeX Zotero</h3>
<img class="x" src="//img.example/logo.png"><img src="//img.example/f1.jpg"><figcaption>Ten chars.</figcaption><figcaption>Short</figcaption><span class="aff">Department of Y, Z;</span></body></html>"""


def test_html(spark):
    assert one(spark, html.authors("h"), h=PAGE) == ["A B", "C D"]
    assert one(spark, html.authors("h"), h='{"author": {"name": "E F"}}') == ["E F"]
    assert one(spark, html.headings("h"), h=PAGE) == ["Introduction", "Materials and Methods"]
    assert one(spark, html.captions("h"), h=PAGE) == ["Ten chars."]
    assert one(spark, html.figure_url("h"), h=PAGE) == "https://img.example/f1.jpg"
    assert one(spark, html.affiliations("h"), h=PAGE) == ["Department of Y, Z", "University X"]
    assert one(spark, html.paragraphs("h"), h=PAGE)[0].endswith("kept & read.")
    assert len(one(spark, html.paragraphs("h"), h=PAGE)) == 2
    assert one(spark, html.method_summary("h"), h=PAGE).startswith("We did much.")
    assert one(spark, html.attributes("h"), h='<img SRC="a" alt=\'b\' src="c">') == {"src": "a", "alt": "b"}
    assert one(spark, html.references_cut("h"), h="x" * 100 + "\nReferences\n1. y") == "x" * 100
    assert one(spark, html.real_world("h"), h="In vivo work") is True
    for f in (html.authors, html.headings, html.captions, html.paragraphs, html.affiliations):
        assert one(spark, f("h"), h=None) == []


def test_repair_breaks(spark):
    assert one(spark, text.repair_breaks("s"), s="ﬁnd-\n ings  here") == "findings here"
    assert re.fullmatch(r"\S+", one(spark, text.strip_tags("s"), s="<b>A</b><b>B</b>"))
