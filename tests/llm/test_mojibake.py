import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.llm.mojibake import find_garbled, garbled, repair, repair_text, restore

SOUND = [
    "Žofie Křížová drew the Þórsnes map at 1 : 3241, cf. § 20.",
    "The naïve estimate of α = 1.21 came from a café survey in Łęczyna; it isn’t robust.",
    "The district names SÃO JULMÃO and Ângrela appear as printed on the map.",
    "Label “IRMÃ Ânia” was kept in capitals on the sheet.",
    "The oldest entry reads “À l’Ânerie, août” and is filed in Lissova.",
    "The Cyrillic label вид опушки was transliterated by the museum.",
    "The Greek term αίσθηση γεύσης is retained.",
    "Żółwik, Đường Vải and İncirlik are sample codes.",
    "The £3 and ¥9 fees were paid; ‰ values are given below.",
    "本研究在Ostrel地区考察了突触可塑性与味觉神经元的关系，共纳入2082例。",
    "Were you looking for “Ångvik survey”?",
    "Rate this article ★★★★☆",
]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(text):
    assert not garbled(text)
    assert repair_text(text) == text


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", SOUND[:2] + SOUND[7:8] + SOUND[10:11])
def test_round_trip(wrong, text):
    raw = text.encode("utf-8")
    bad = "".join(bytes([b]).decode(wrong, "replace") if bytes([b]).decode(wrong, "ignore") else chr(b) for b in raw)
    assert garbled(bad)
    assert repair_text(bad) == text


def test_nested_layers():
    text = "A dose was given at the Hôpital de Bräckmoor; no side effects were noted…"
    bad = text
    for _ in range(2):
        bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode("utf-8"))
    assert repair_text(bad) == text


def test_single_byte_mixups():
    assert repair_text("Señora Ibáñez and Dvořáček".encode("cp1252", "replace").decode("cp1251")).startswith("Señora Ibáñez")
    assert garbled("a cafÈ survey by the naÔve HÙpital")


def test_han_read_as_latin():
    text = "结果显示，黏膜免疫较对照组提高了。"
    assert repair_text(text.encode("gb18030").decode("latin-1")) == text


def test_lost_bytes_are_found_but_not_restored():
    assert restore("The caf� survey") == ("The caf� survey", True)
    assert garbled("drew by Dvo?á?ek and V?n?ur")
    assert garbled("The naïve estimate of ? = 3.21 came from a café survey")
    assert garbled("The Greek term ??????? ?????? is retained in the glossary")
    for bad in ("in draft scaffolds: the ìﬁÛrsnesî survey", "The names S√O JULM√O and ¬ngrela appear", "The Ј40 and Ґ3021 fees were paid", "no side effects were noted\x85", "at 21 ∞C only"):
        assert garbled(bad), bad
    assert not garbled("Is this so ? Yes, it is ! What ???")
    assert not garbled("Is it robust? Yes. Who knows?")
    assert not garbled("see https://x.example/a?b=c and x?")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc déñöüßåÆŁęčΩжи中文。“”’— \n", max_size=60))
def test_repair_never_fails_and_ends(text):
    once = repair_text(text)
    assert repair_text(once) is not None


def test_query(spark):
    schema = "record_id long, title string, abstract string, full_text string"
    bad = "cafÃ© survey"
    rows = [(1, bad, None, SOUND[0] + " " + bad), (2, SOUND[0], "", None), (1, bad, None, "x"), (3, None, "plain. " * 50_000 + bad, None)]
    df = spark.createDataFrame(rows, schema).withColumn("field", F.lit("clash"))
    assert sorted(map(tuple, find_garbled(df).collect())) == [(1, "full_text"), (1, "title"), (3, "abstract")]
    fixed = repair(df)
    assert fixed.columns == df.columns and fixed.where("record_id = 2").first()["title"] == SOUND[0]
    assert fixed.where("title = 'café survey'").count() == 2
    assert find_garbled(df.limit(0)).count() == 0
