import pytest
from pyspark.sql import functions as F

from scholion.functions import formats as fm
from scholion.operators import enrich


def one(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column.alias("r")).first()["r"]


ARTICLE = "<?xml version='1.0'?><article><front><article-meta><title-group><article-title>A <i>b</i> c</article-title></title-group><abstract><p>x</p></abstract></article-meta></front><body><sec><title>R</title><p>one</p><fig><caption><p>cap</p></caption></fig><ack><p>no</p></ack></sec></body></article>"


def test_archive_articles_and_feeds(spark):
    assert one(spark, fm.jats_title("v"), ARTICLE) == "A b c" and one(spark, fm.jats_abstract("v"), ARTICLE) == "x"
    assert one(spark, fm.jats_body("v"), ARTICLE) == "R\none" and one(spark, fm.jats_captions("v"), ARTICLE) == ["cap"]
    for f, none in ((fm.jats_title, ""), (fm.jats_abstract, ""), (fm.jats_body, ""), (fm.jats_captions, [])):
        assert one(spark, f("v"), None) == one(spark, f("v"), "  ") == none
    e = one(spark, fm.feed_entry("v"), "<entry><id>http://a/abs/2501.00001v2</id><title> T\n t</title><published>2025-01-02T0</published><author><name>A</name></author><author><name>B</name></author></entry>")
    assert (e["id"], e["title"], e["day"], e["authors"], e["summary"]) == ("2501.00001", "T t", "2025-01-02", ["A", "B"], "")


@pytest.mark.parametrize("v, want", [('{"message": {"issued": {"date-parts": [[2024, 3]]}}}', "2024-03"), ('{"message": {}}', ""), ("no", ""), (None, "")])
def test_metadata_day(spark, v, want):
    assert one(spark, fm.metadata_day("v"), v) == want


@pytest.mark.parametrize("v, want", [("[a, \"b, c\"] # x", ["a", "b, c"]), ("'q # r'", ["q # r"]), ("plain # c", ["plain"]), ("[]", []), ("", []), (None, [])])
def test_front_value(spark, v, want):
    assert one(spark, fm.front_value("v"), v) == want


def test_binary_predicates_without_data(spark):
    df = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"%PDF-1.4" + b"x" * 6000),), (bytearray(b"%PDF <html>" + b"x" * 6000),)], "b binary")
    assert [r[0] for r in df.select(fm.is_usable_pdf("b")).collect()] == [False, False, True, False]
    assert [r[0] for r in df.select(fm.is_figure("b", F.lit("image/png"))).collect()] == [False] * 4


def test_enrichment_without_pages(spark):
    df = spark.createDataFrame([(1, None, "in vivo"), (2, "<p>short</p>", None)], "k int, page string, abstract string").withColumn("captions", F.lit("clash"))
    got = {r["k"]: r for r in enrich.enrich(df, "k").collect()}
    assert got[1]["has_real_world"] and not got[2]["has_real_world"] and got[1]["read_from"] == got[2]["read_from"] == "abstract" and got[1]["captions"] == [] and got[2]["figure_url"] == ""
    assert enrich.enrich(df.limit(0), "k").count() == 0
    texts = spark.createDataFrame([("Methods and results", "x"), (None, None), ("", "y"), ("aa", "bb")], "a string, b string")
    assert [r[0] for r in texts.select(enrich.better_text("a", "b")).collect()] == ["Methods and results", "", "y", "aa"]
