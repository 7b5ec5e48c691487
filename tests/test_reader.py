import pytest

from scholion.functions import publishers as pub
from scholion.functions import reader as rd


def one(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("v, want", [(None, ""), ("", ""), (" Untitled ", ""), ("Loading...", ""), ("A  title", "A title")])
def test_record_title(spark, v, want):
    assert one(spark, rd.record_title("v"), v) == want


def test_texts_of_notes(spark):
    assert one(spark, rd.asked("v"), None) == "What core question does this study ask?"
    assert one(spark, rd.asked("v"), "Why. . so?!") == "Why. . so?"
    assert one(spark, rd.tidy_lines("v"), " a \t b\r\n\r\rc ") == "a b\nc"
    assert one(spark, rd.concept_lines("v"), "[[A]] - [[B]] [[C]]") == "- [[A]]\n- [[B]]\n- [[C]]"
    assert one(spark, rd.concept_lines("v"), None) == ""
    label, said = rd.section_line("v")
    assert [(one(spark, label, x), one(spark, said, x)) for x in ("- Finding: it grows", "**bold** x", "1. Basis： y", None)] == [("finding", "it grows"), ("", "**bold** x"), ("basis", "y"), ("", "")]
    assert one(spark, rd.is_dump("v"), "DOI : 10.1/x") and not one(spark, rd.is_dump("v"), "The doi is")
    assert one(spark, rd.wrongly_decoded("v"), "鍩鐨鏂绗") and not one(spark, rd.wrongly_decoded("v"), None)
    assert one(spark, rd.without_markup("v"), "a ![x](y.png) b <!-- c --> ```d``` e") == "a b e"
    assert one(spark, rd.without_shell("v"), "x" * 3001 + " Terms of Use y") == "x" * 3001
    assert one(spark, rd.without_shell("v"), "Terms of Use " + "x" * 3001 + " Terms of Use") == "Terms of Use " + "x" * 3001 + " Terms of Use"


@pytest.mark.parametrize("v, want", [("gene", ["gene", "genes"]), ("seed bus", ["seed bus"]), ("kelp beds", ["kelp beds", "kelp bed"]), ("", []), (None, []), ("ab", ["ab"]), ("its", ["its", "itss"])])
def test_keyword_forms(spark, v, want):
    assert one(spark, rd.keyword_forms("v"), v) == want


def test_affiliation_lines(spark):
    assert one(spark, rd.affiliation("v"), "1,2) {Foo}  University, intern 3†") == "Foo University,"
    assert one(spark, rd.numbered_parts("v"), "1 Foo University, 2 Bar Institute") == ["1 Foo University", "2 Bar Institute"]
    assert one(spark, rd.numbered_parts("v"), "Uni of A 2 Nvidia 3 Amazon") == ["Uni of A", "2 Nvidia", "3 Amazon"]
    assert one(spark, rd.numbered_parts("v"), None) == [""]


def test_addresses(spark):
    assert one(spark, pub.slug("v"), "https://doi.org/10.1126/science.x") == "science_org" and one(spark, pub.slug("v"), "https://doi.org/10.9/x") == "doi_org"
    assert one(spark, pub.slug("v"), "https://www.nature.com/x") == "nature_com" and one(spark, pub.slug("v"), None) == "generic"
    assert one(spark, pub.pdf_variants("v"), "https://x.example/doi/epdf/1") == ["https://x.example/doi/pdfdirect/1?download=true", "https://x.example/doi/pdfdirect/1", "https://x.example/doi/pdf/1", "https://x.example/doi/epdf/1"]
    assert one(spark, pub.pdf_variants("v"), "https://x.example/a.full.pdf+html") == [] and one(spark, pub.pdf_variants("v"), None) == []
    assert one(spark, pub.image_variants("v"), "https://oup.silverchair-cdn.com/m_f1.jpeg?s") == ["https://oup.silverchair-cdn.com/f1.jpeg?s", "https://oup.silverchair-cdn.com/m_f1.jpeg?s"]
    assert one(spark, pub.preprint_doi("v"), "10.64898/2025v3") == "10.64898/2025" and one(spark, pub.preprint_doi("v"), "https://www.biorxiv.org/content/10.1101/1v2/x") == "10.1101/1"
    assert one(spark, pub.preprint_revision("v"), "https://www.biorxiv.org/content/10.1101/1v2") == "v2" and one(spark, pub.preprint_revision("v"), None) == ""
    assert one(spark, pub.direct_pdf("v"), "https://link.springer.com/article/10.1007/s1") == "https://link.springer.com/content/pdf/10.1007/s1.pdf"
    assert one(spark, pub.site("v", "v"), "10.1093/x") == "oup" and one(spark, pub.site("v", "v"), "https://pmc.ncbi.nlm.nih.gov/x") == "pmc"
