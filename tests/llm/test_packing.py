import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.llm.packing import TOKENIZERS, configurations, container_use, pack, pack_documents

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no public vocabulary here")


def loads(lengths, place):
    room = {}
    for n, c in zip(lengths, place):
        room[c] = room.get(c, 0) + n
    return room


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_every_item_is_placed_and_nothing_overflows(lengths):
    place = pack(lengths, 100)
    assert len(place) == len(lengths) and all(c >= 0 for c in place)
    room = loads(lengths, place)
    assert all(v <= 100 for v in room.values())
    assert set(room) == set(range(len(room)))
    # Never worse than first-fit's bound.
    assert len(room) <= 2 * -(-sum(lengths) // 100) + 1


def test_close_to_the_least_possible():
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in np.clip(rng.lognormal(5, 0.9, 6000), 5, 2048)]
    room = loads(lengths, pack(lengths, 2048))
    assert sum(lengths) / (len(room) * 2048) > 0.985


def test_perfect_pairs_are_found():
    lengths = [60, 40] * 200
    assert len(loads(lengths, pack(lengths, 100))) == 200


def test_configurations_meet_the_fractional_optimum():
    # Three sizes whose optimum is known: 50 x 51, 50 x 27, 100 x 24 in bins of 102 (51+51, 27+27+24+24, 24*4).
    total = sum(x for x, _ in configurations(np.array([51, 27, 24]), np.array([50.0, 50.0, 100.0]), 102))
    assert total == pytest.approx(25 + 25 + 12.5, abs=0.51)
    assert configurations(np.array([]), np.array([]), 10) == []


def test_ties_repeat():
    assert pack([5, 5, 5, 5], 10) == pack([5, 5, 5, 5], 10)


@needs_vocabulary
def test_documents(spark):
    text = "Sampling of mice ended early because optical mapping failed on many occasions. "
    rows = [(i, text * (1 + i % 7)) for i in range(120)] + [(500, text * 400), (501, None), (502, ""), (3, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("capacity", F.lit("clash")).withColumn("bucket", F.lit(1))
    kinds = spark.createDataFrame([("short", 128), ("long", 1024)], "container_kind string, capacity_tokens int")
    packed = pack_documents(docs, kinds, bucket_docs=50)
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).join(kinds, "container_kind")
    assert per.where("n > capacity_tokens").count() == 0
    got = {(r["container_kind"], r["doc_id"]): (r["n"], r["k"]) for r in packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()}
    assert not {d for _, d in got} & {501, 502}
    assert got["short", 500][1] > 1 and got["long", 5][1] == 1 and got["short", 3][1] == 2
    assert all(got["short", d][0] == got["long", d][0] for k, d in got if k == "short")
    # Buckets of fifty documents leave a part-filled container each; one bucket leaves one.
    used = {r["container_kind"]: r for r in container_use(pack_documents(docs, kinds), kinds).collect()}
    assert used["long"]["used"] > 0.9 and used["short"]["fullest"] <= 128
    assert pack_documents(docs.limit(0), kinds).count() == 0
