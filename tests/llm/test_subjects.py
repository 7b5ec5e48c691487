import pickle
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.llm.subjects import Features, Model, Sentences, assign, find_subjects

WORDS = {1: "genome splice allele haplotype", 2: "cortex neuron synapse axon", 3: "meadow pollinator kelp beetle"}
COMMON = ["differences persisted after", "was linked to", "failed near the station during", "explained the spread among"]


def sentence(rng, s):
    w = WORDS[s].split()
    return f"{rng.choice(w)} {rng.choice(COMMON)} {rng.choice(w)} {rng.choice(w)}."


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        subjects = rng.sample([1, 2, 3], rng.choice([1, 1, 2]))
        docs.append((i, " ".join(sentence(rng, s) for s in subjects for _ in range(6)) + " Missing values were carried as missing."))
        truth[i] = set(subjects)
    return docs, truth


@pytest.fixture(scope="module")
def result(spark):
    docs, truth = corpus()
    labels = [(i, s) for i in range(0, 400, 4) for s in truth[i]] + [(0, next(iter(truth[0]))), (9999, 1), (4, 77)]
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (1002, "Zzz qqq.")], "doc_id long, text string").withColumn("share", F.lit("clash")).withColumn("subject_id", F.lit(5))
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "subject_id int, subject string")
    rows = find_subjects(d, spark.createDataFrame(labels, "doc_id long, subject_id int"), s).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["subject_id"])
    return got, truth


def test_held_out_accuracy(result):
    got, truth = result
    held = [i for i in truth if i % 4]
    right = sum(set(got[i]) == truth[i] for i in held)
    assert right >= 0.95 * len(held)


def test_every_document_has_one_to_three(result):
    got, _ = result
    assert all(1 <= len(v) <= 3 and len(set(v)) == len(v) for v in got.values())
    assert {1000, 1001, 1002} <= set(got)


def test_tables_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "A text about something.")], "doc_id long, text string")
    s = spark.createDataFrame([(1, "a")], "subject_id int, subject string")
    none = spark.createDataFrame([], "doc_id long, subject_id int")
    assert find_subjects(d, none, s).count() == 0
    assert find_subjects(d.limit(0), none, s).count() == 0


def test_one_sentence_in_passing_is_not_enough():
    curves = np.tile([40.0, -40.0 * 0.21], (3, 1))
    assert assign(np.array([0.92, 0.08, 0.0]), curves)[0] == [0]
    assert assign(np.array([0.5, 0.25, 0.25]), curves)[0] == [0, 1, 2]
    assert assign(np.zeros(3), curves)[0] == [0]


def test_features_of_all_scripts():
    ids, starts = Features().sentences("Genome splice allele one. 本研究考察了基因组变异与转座子的关系。No.")
    assert len(starts) == 2 and len(ids) > 10


def test_a_word_of_all_subjects_weighs_nothing():
    counts = np.zeros((4, 2))
    counts[0] = [50, 50]
    counts[1] = [40, 0]
    counts[2] = [0, 40]
    m = Model(counts, [1, 2])
    assert abs(m.weights[0]).max() < 0.1 and m.weights[1, 0] > 1 > -1 > m.weights[1, 1] and not m.weights[3].any()


def test_a_batch_gives_what_its_documents_give_alone():
    rng = random.Random(4)
    features = Features(512)
    got = [features.sentences(t) for t in ("", sentence(rng, 1), " ".join(sentence(rng, 2) for _ in range(5)), "Zz.", sentence(rng, 3) + " " + sentence(rng, 1))]
    words, starts = ([np.asarray(g[i], dtype=np.int32).tobytes() for g in got] for i in (0, 1))
    counts = np.random.default_rng(1).random((512, 3)) * 5
    m = Model(counts, [1, 2, 3])
    whole = Sentences([*words, None], [*starts, None])
    assert whole.rows.tolist() == [1, 2, 4]
    shares = m.by_document(*m.posteriors(whole.ids, whole.starts), whole.docs)
    for row, share in zip(whole.rows, shares):
        one = Sentences([words[row]], [starts[row]])
        assert np.allclose(m.by_document(*m.posteriors(one.ids, one.starts), one.docs)[0], share, atol=1e-5)
        assert abs(share.sum() - 1) < 1e-5


def test_models_of_past_rounds_leave_the_disk(spark):
    def held():
        return sum(p.stat().st_size for p in Path(spark.sparkContext._temp_dir).rglob("*") if p.is_file())

    docs, truth = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 60, 2) for s in truth[i]], "doc_id long, subject_id int")
    before = held()
    found = find_subjects(d, labels, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "subject_id int, subject string"))
    # Only the model that the result is still to be read with stays.
    assert held() - before < 1.5 * len(pickle.dumps(Model(np.zeros((1 << 17, 3)), [1, 2, 3])))
    assert {r["doc_id"] for r in found.collect()} == set(range(60))


def test_subjects_beyond_the_bound_are_refused(spark):
    d = spark.createDataFrame([(1, "A text about something.")], "doc_id long, text string")
    s = spark.createDataFrame([(i, "a") for i in range(5)], "subject_id int, subject string")
    with pytest.raises(ValueError):
        find_subjects(d, spark.createDataFrame([(1, 1)], "doc_id long, subject_id int"), s, most_subjects=4)
