import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.llm.canonical import CanonicalIndex, edits, map_rows, map_values

NAMES = [(1, "Halden Annals of Sensory Genomics"), (2, "bioRxiv"), (3, "Sensory Genetics Letters"), (4, "Sensory Genomics Letters"), (5, "International Archives of Neural Circuit Medicine"), (6, "The Korrimel Review of Bioethics and Patent Law"), (7, "Advances in Taste and Nutrition and Practice"), (8, "Neural Circuit Methods: Methods and Protocols"), (9, "International Archives of Tumour Evolution")]
INDEX = CanonicalIndex(NAMES)


@pytest.mark.parametrize(
    "value, want",
    [
        ("HALDEN ANNALS OF SENSORY GENOMICS", 1), ("HASG", 1), ("H.A.S.G.", 1), ("Halden Ann. Sens. Genom.", 1), ("Halden_Annals_of_Sensory_Genomics", 1), ("HaldenAnnalsofSensoryGenomics", 1),
        ("Halden Annals of Sensory Genomics (Online)", 1), ("Halden Annals of Sensory Genomics; 36 (11)", 1), ("In: Halden Annals of Sensory Genomics. 2014", 1), ("Sensory Genomics, Halden Annals of", 1),
        ("Ｓｅｎｓｏｒｙ Ｇｅｎｏｍｉｃｓ Ｌｅｔｔｅｒｓ", 4), ("Sesnory Geetics Letters", 3), ("Sens. Genet. Lett.", 3), ("Sens Genom Lett", 4), ("Int Arch Neural Circ Med", 5), ("International Archives of Neural Circui…", 5),
        ("The Korrimel Review of Bioethics & Patent Law", 6), ("korrimel rev bioeth pat law", 6), ("Advances in Taste &amp; Nutrition &amp; Practice", 7), ("BIORXIV", 2),
        ("Marine Acoustics Letters", 0), ("Halden Annals of Marine Acoustics", 0), ("in press", 0), ("-", 0), ("Halden Annals of Sensory Genetics", 0), ("International Archives of", 0),
    ],
)
def test_names(value, want):
    assert INDEX.match(value)[0] == want


def _plain(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9), st.integers(0, 4))
def test_edits_against_the_full_table(a, b, most):
    assert edits(a, b, most) == min(_plain(a, b), most + 1)


def test_every_entry_with_a_cosine_is_a_candidate():
    score = INDEX.cosines("haldenannalsofsensorygenomics")
    assert score.argmax() == 0 and abs(score[0] - 1) < 1e-9


def test_list_beyond_its_bound_is_refused():
    with pytest.raises(ValueError):
        CanonicalIndex(NAMES, max_entries=3)


def test_ties_mean_none():
    assert CanonicalIndex([(1, "Alpha Beta Gamma"), (2, "Alpha Beta Gamma")]).match("alpha beta gamma")[0] == 0
    assert CanonicalIndex([]).match("alpha")[0] == 0


def test_query(spark):
    ref = spark.createDataFrame(NAMES, "journal_id int, journal string")
    rows = [(1, "HASG"), (2, "Halden Annals of Sensory Genomics"), (3, None), (4, "  "), (5, "Marine Acoustics"), (6, "HASG"), (6, "HASG")]
    df = spark.createDataFrame(rows, "entry_id long, journal string").withColumn("value", F.lit("clash")).withColumn("canonical_id", F.lit(9))
    assert sorted(map(tuple, map_rows(df, "entry_id", "journal", ref, "journal_id", "journal").collect())) == [(1, 1), (5, 0), (6, 1), (6, 1)]
    counts = {r["value"]: (r["canonical_id"], r["n_rows"]) for r in map_values(df, "journal", ref, "journal_id", "journal").collect()}
    assert counts["HASG"] == (1, 3) and counts["Marine Acoustics"] == (0, 1)
    assert map_rows(df.limit(0), "entry_id", "journal", ref, "journal_id", "journal").count() == 0
