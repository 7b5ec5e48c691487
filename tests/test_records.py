import struct

import pytest
from pyspark.sql import functions as F

from scholion.functions import records
from scholion.operators import rules


def one(spark, column, **values):
    kinds = {str: "string", bytes: "binary", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [("https://doi.org/10.1/x", "10.1/x"), ("10.1234/x", "10.1234/x"), ("https://a.example/doi/full/10.1234/x.y?z", "10.1234/x.y"), ("nothing", ""), (None, "")])
def test_doi_from_address(spark, value, want):
    assert one(spark, records.doi_from_address("v"), v=value) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("10.1234/x", "doi"), ("https://doi.org/10.1234/x", "doi"), ("https://x.example/doi/full/10.1234/x", "doi"), ("https://x.example/a.pdf", "pdf_url"), ("https://x.example/a.pdf?x", "web_url"),
        ("https://pubmed.ncbi.nlm.nih.gov/1/", "pubmed_url"), ("https://pmc.ncbi.nlm.nih.gov/articles/PMC1/", "pmc_url"), ("https://www.nature.com/doi/10.1234/x", "web_url"), ("https://x.example", "web_url"),
        ("a b.PDF", "local_pdf"), (".pdf", "web_url"), ("PMC12", "web_url"), ("", "web_url"), (None, "web_url"),
    ],
)
def test_source_kind(spark, value, want):
    assert one(spark, records.source_kind("v"), v=value) == want


def test_bytes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 20
    width, height = records.png_size("d")
    assert (one(spark, width, d=png), one(spark, height, d=png), one(spark, records.image_kind("d"), d=png)) == (640, 480, "png")
    assert one(spark, records.image_kind("d"), d=b"\xff\xd8\xff\xe0x") == "jpg"
    assert one(spark, records.image_kind("d"), d=b"RIFF\0\0\0\0WEBPx") == "webp"
    assert one(spark, records.image_kind("d"), d=b"<svg>") == "" and one(spark, width, d=b"<svg>") is None
    assert one(spark, records.is_pdf("d"), d=b"%PDF-1.4") is True


@pytest.mark.parametrize("size, want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1664, "1.62 KB"), (3 * 1024**3, "3.00 GB"), (2 * 1024**5, "2048.00 TB")])
def test_byte_text(spark, size, want):
    assert one(spark, records.byte_text("n"), n=size) == want


def test_scalars_and_dois(spark):
    for value, want in ((" 12 ", "int"), ("-1.5", "float"), ("True", "bool"), ("'12'", "text"), ("x", "text"), ("", "empty")):
        assert one(spark, records.scalar_kind("v"), v=value) == want
    for a, b, want in (("10.1093/x/y", "10.1093/X/Y", True), ("10.1093/x/y/7", "10.1093/x/y", True), ("10.1093/x/y/z", "10.1093/x/y", False), ("10.1016/x/7", "10.1016/x", False), ("", "", False)):
        assert one(spark, records.same_doi("a", "b"), a=a, b=b) is want


def test_figures(spark):
    kind = "items array<struct<src: string, href: string, caption: string, alt: string, source: string>>"
    items = [("https://i.example/fig1.jpg", None, "c", None, "figure"), ("https://i.example/fig2.png", None, "", "Figure 1. x", None), (None, "logo.png", None, None, "web"), ("x", None, "c", "d", None)]
    df = spark.createDataFrame([(items,), (None,), ([],)], kind)
    assert [r[0] for r in df.select(F.transform("items", records.figure_points)).collect()][0] == [240, 0, -200, 0]
    assert [r[0] for r in df.select(records.takeaways(F.col("items"))).collect()] == [["c", "Figure 1. x"], [], []]


def test_rules(spark):
    df = spark.createDataFrame([(1, ["Taste"], "seed"), (2, ["seed coat"], None), (3, None, "taste"), (4, ["x"], "nothing"), (5, ["e"], "y")], "k int, tags array<string>, title string")
    got = {r["k"]: r["category"] for r in rules.categories(df, "k", "tags", "title", (("a", ("taste",)), ("b", ("seed",)))).collect()}
    assert got == {1: "a", 2: "b", 3: "inbox", 4: "inbox", 5: "a"}
    rows = spark.createDataFrame([(1, "A long enough title: part"), (2, "short"), (3, None)], "k int, t string")
    prefixes = spark.createDataFrame([("A long enough",), ("A long enough",), ("A long enough t",), ("A long",), (None,)], "p string")
    assert sorted(map(tuple, rules.prefix_join(rows, "k", "t", prefixes, "p").collect())) == [(1, "A long"), (1, "A long enough"), (1, "A long enough t")]
    notes = spark.createDataFrame([("1234567_x", 1), ("y 1234567", 2), (None, 3)], "stem string, o int")
    assert {r["key"]: r["stem"] for r in rules.lookup_index(notes, "stem", "o").collect()} == {"1234567_x": "1234567_x", "y 1234567": "y 1234567", "1234567": "y 1234567"}
    near = lambda a, b: one(spark, rules.near_name(F.col("a"), F.col("b")), a=a, b=b)
    assert near("abcd", "abcd") and near("abcdefg", "abcd") and not near("abcdefghij", "abcd") and not near("abcd", "abc")
