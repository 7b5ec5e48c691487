import random

import pytest
from pyspark.sql import functions as F

from scholion.llm.leaks import ItemIndex, find_leaks, words

A = "The careful warden photographs read depth before noon until every hasty courier weighs forty jars beside the kiln. Some bilingual nurse mails clonal expansion without gloves. Which quantity changes first?"
B = "One lecturer from Kelmere relabels this crate of river catchments by mistake once no baker hides her thermostat of farm ponds."
FIELD = "Loss of gene doubled mitotic index in sixty of many tumour organoids. Sampling of ancient samples ended early. "


@pytest.fixture
def index():
    return ItemIndex([(1, A), (2, B)])


@pytest.mark.parametrize(
    "text, want",
    [
        (FIELD + A + FIELD, [0]),
        (FIELD + A.upper().replace(".", " ;") + FIELD, [0]),
        (FIELD + "\n".join(A.split()) + FIELD, [0]),
        (FIELD + A.replace("warden", "guard").replace("hasty", "slow").replace("jars", "pots") + FIELD, [0]),
        (" ".join(A.split()[:7]) + " " + FIELD + " ".join(A.split()[14:22]), [0]),
        (" ".join(A.split()[14:24]) + " " + FIELD + " ".join(A.split()[:8]), [0]),  # reordered
        (FIELD + " ".join(A.split()[:6]) + " " + FIELD, []),  # less than a third
        (FIELD * 3, []),
        (A + B, [0, 1]),
        ("", []),
    ],
)
def test_leaks(index, text, want):
    assert sorted(index.leaks(text)) == want


def test_tiles_do_not_overlap_and_agree(index):
    rng = random.Random(1)
    vocabulary = "a b c d".split()
    for _ in range(60):
        item, doc = (" ".join(rng.choices(vocabulary, k=n)) for n in (12, 30))
        ix = ItemIndex([(1, item)])
        ids, own = ix.ids(doc), ix.items[0][1]
        seeds = [(k, j) for k, s in ix.found_seeds(ids) for _, j in ix.seeds[s]]
        tiles = ix.tiles(ids, own, seeds)
        used = [x for k, _, n in tiles for x in range(k, k + n)]
        used_item = [x for _, j, n in tiles for x in range(j, j + n)]
        assert len(used) == len(set(used)) and len(used_item) == len(set(used_item))
        assert all(ids[k : k + n] == own[j : j + n] and n >= 3 for k, j, n in tiles)
        # The first tile is as long as the longest common run that brute force finds.
        longest = max((n for k in range(len(ids)) for j in range(len(own)) for n in range(1, 13) if k + n <= len(ids) and j + n <= len(own) and ids[k : k + n] == own[j : j + n]), default=0)
        assert max((n for *_, n in tiles), default=0) == (longest if longest >= 3 else 0)


def test_field_wording_is_no_leak(spark):
    phrase = "time to second line therapy in patients with sarcoma"
    docs = [(i, FIELD + phrase) for i in range(40)] + [(100, FIELD + A), (100, FIELD + A), (101, None), (102, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, A), (2, phrase + " stains the clerk"), (3, None), (4, "two words")], "item_id long, text string")
    assert sorted(map(tuple, find_leaks(d, items).collect())) == [(100, 1)]
    assert find_leaks(d.limit(0), items).count() == 0
    assert find_leaks(d, items.limit(0)).count() == 0


def test_a_leak_in_many_documents_is_no_field_wording(spark):
    """Verbatim copies, copies with changed words and one half, all beyond the share that makes seeds common; a phrase that
    other items' copies hold stays wording of the field."""
    changed = A.replace("warden", "guard").replace("hasty", "slow").replace("jars", "pots")
    half = " ".join(A.split()[:15])
    docs = [(i, FIELD + A) for i in range(30)] + [(i, FIELD + changed) for i in range(30, 45)] + [(i, half + " " + FIELD) for i in range(45, 55)]
    docs += [(i, FIELD + B + " in the end") for i in range(55, 95)] + [(i, FIELD) for i in range(95, 120)]
    short = "Depth before noon until every nurse mails thirty ledgers"  # shares eight words with A in two phrases
    items = spark.createDataFrame([(1, A), (2, B), (3, short)], "item_id long, text string")
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect())) == [(i, 1) for i in range(55)] + [(i, 2) for i in range(55, 95)]


def test_very_long_text_is_read_whole(index):
    assert index.leaks(FIELD * 8000 + A) == [0]


def test_bound():
    with pytest.raises(ValueError):
        ItemIndex([(1, A), (2, B)], max_items=1)
    assert words("Ａ left-handed–clerk’s 3 trays 我们") == ["a", "left", "handed", "clerk", "s", "3", "trays", "我", "们"]
