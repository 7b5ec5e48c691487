"""Subject areas of documents: complement naive Bayes, expectation-maximization, calibrated posteriors (problem 9).

Texts are read once: sentences become hashed words (pairs of characters for Han), kept in the shared folder, and all
later passes are arithmetic over these numbers, a batch of documents at a time. A complement naive Bayes model is
trained from the labelled documents and refined by expectation-maximization: every sentence of every document gets
posteriors under the model (a labelled document's sentences only among its labels), the expected counts of all
documents make the next model, until the masses of the subjects settle. Features are hashed to a fixed number of
buckets, so the model and the counts that reach the driver are bounded whatever the corpus. For a document the
subjects' shares among its sentences that have a subject are turned into independent posteriors, one logistic curve
for each subject, fitted on a fifth of the labelled documents that the model was not trained on; subjects with a
posterior of at least a half are assigned, at least one and at most three.

Defined results: null and empty texts, and texts without a known word, get the most frequent subject, so that every
document has one; repeated label pairs count once; labels of unknown documents and unknown subjects are ignored;
without labels, or for an empty table, the result is empty; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.session import cut

BUCKETS = 1 << 17
#: At most so many labelled documents fit the first model and the curves.
MOST_LABELLED = 200_000

_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+(?=\s|\Z|[一-鿿])|[.!?](?=\S)[^.!?。！？\n]*)*[.!?。！？]*")
_FEATURE = re.compile(r"[一-鿿]+|[^\W\d_]{3,}")


class Features:
    """Hashed features of sentences."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        got = self.known.get(w)
        if got is None:
            if w[0] >= "一":
                got = [crc32(w[i : i + 2].encode()) % self.buckets for i in range(max(1, len(w) - 1))]
            else:
                got = [crc32(w.encode()) % self.buckets]
            if len(self.known) < 300_000:
                self.known[w] = got
        return got

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature buckets of all sentences in a row, and where each sentence starts."""
        ids: list[int] = []
        starts: list[int] = []
        word = self.word
        find = _FEATURE.findall
        for m in _SENTENCE.finditer(text.lower()):
            before = len(ids)
            for w in find(m.group()):
                ids += word(w)
            if len(ids) - before >= 3:
                starts.append(before)
            else:
                del ids[before:]
        return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)


class Model:
    """Complement naive Bayes weights, centred over the subjects so that a word of no subject weighs nought."""

    def __init__(self, counts: np.ndarray, subjects: list[int], smooth: float = 0.3):
        self.subjects = subjects
        total = counts.sum(axis=1, keepdims=True)
        rest = total - counts + smooth
        theta = rest / rest.sum(axis=0, keepdims=True)
        weights = -np.log(theta)
        # Subjects differ in how often they are written about; a word's weight is what sets a subject apart.
        prior = -np.log((rest.sum(axis=1, keepdims=True)) / rest.sum())
        weights = weights - prior
        weights -= weights.mean(axis=1, keepdims=True)
        weights[total[:, 0] < 0.5] = 0.0
        self.weights = weights.astype(np.float32)

    def posteriors(self, ids: np.ndarray, starts: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of each sentence (``among`` its allowed subjects), and whether it has a subject at all."""
        score = np.add.reduceat(self.weights[ids], starts, axis=0)
        ranked = np.partition(score, -2, axis=1) if score.shape[1] > 1 else np.hstack([score * 0, score])
        clear = (ranked[:, -1] - ranked[:, -2]) >= 1.2
        if among is not None:
            score = np.where(among, score, -1e9)
        score = score - score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True), clear

    @staticmethod
    def by_document(p: np.ndarray, clear: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Mean posteriors of each document's clear sentences, or of all where none is clear; ``docs`` is where each document's sentences start."""
        n = np.add.reduceat(clear.astype(float), docs)
        size = np.diff(np.append(docs, len(p)))
        some = np.add.reduceat(p * clear[:, None], docs, axis=0) / np.maximum(n, 1)[:, None]
        return np.where((n > 0)[:, None], some, np.add.reduceat(p, docs, axis=0) / size[:, None])

    def in_document(self, p: np.ndarray, clear: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Sentence posteriors weighed with the subjects of their document, so that wording of no subject is spread over all of them."""
        mix = np.repeat(self.by_document(p, clear, docs) + 0.01, np.diff(np.append(docs, len(p))), axis=0)
        p = p * mix
        return p / p.sum(axis=1, keepdims=True)


_FEATURES = "doc_id long, words binary, starts binary"


def read_features(documents: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """doc_id with the hashed words of its sentences and the places where the sentences start, as packed numbers of four bytes."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for b in batches:
            got = [features.sentences(t) if t else ((), ()) for t in b.column(1).to_pylist()]
            packed = [pa.array([np.asarray(g[i], dtype=np.int32).tobytes() for g in got], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *packed], names=["doc_id", "words", "starts"])

    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(scan, _FEATURES)


class Sentences:
    """The sentences of a batch of documents in one array each; documents without sentences are left out."""

    def __init__(self, words: list[bytes | None], starts: list[bytes | None]):
        sizes = np.array([len(s or b"") // 4 for s in starts], dtype=np.int64)
        #: Rows of the batch that have sentences.
        self.rows = np.flatnonzero(sizes)
        self.ids = np.frombuffer(b"".join(words[i] for i in self.rows), dtype=np.int32)
        lengths = np.array([len(words[i]) // 4 for i in self.rows], dtype=np.int64)
        sizes = sizes[self.rows]
        offset = np.repeat(np.cumsum(lengths) - lengths, sizes)
        self.starts = np.frombuffer(b"".join(starts[i] for i in self.rows), dtype=np.int32) + offset
        self.docs = np.cumsum(sizes) - sizes
        self.sizes = sizes


#: Documents of one step of arithmetic: bounds the memory of a step whatever the batch.
_STEP = 1000


def _steps(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Sentences]]:
    for at in range(0, b.num_rows, _STEP):
        part = b.slice(at, _STEP)
        yield part, Sentences(part.column(0).to_pylist(), part.column(1).to_pylist())


@contextmanager
def _lent(spark: SparkSession, value: Model | None) -> Iterator[Broadcast]:
    """``value`` broadcast for the jobs of the block: the driver and every executor keep a copy on disk until it is destroyed."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def _counts(rows: DataFrame, subjects: list[int], model: Model | None, buckets: int) -> np.ndarray:
    """Expected counts of features by subject over all rows (words, starts, s); at most ``buckets`` rows reach the driver."""
    k = len(subjects)
    at = {s: i for i, s in enumerate(subjects)}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((k, buckets))
        for b in batches:
            for part, x in _steps(b):
                if not len(x.rows):
                    continue
                sets = part.column(2).to_pylist()
                allowed = np.ones((len(x.rows), k), dtype=bool)
                for i, row in enumerate(x.rows):
                    if sets[row]:
                        allowed[i] = False
                        allowed[i, [at[s] for s in sets[row]]] = True
                among = np.repeat(allowed, x.sizes, axis=0)
                if own is None:
                    p = among / among.sum(axis=1, keepdims=True)
                else:
                    p = own.in_document(*own.posteriors(x.ids, x.starts, among), x.docs)
                lengths = np.diff(np.append(x.starts, len(x.ids)))
                for i in range(k):
                    total[i] += np.bincount(x.ids, np.repeat(p[:, i], lengths), buckets)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[i, used]) for i in range(k)]], names=["bucket", *[f"c{i}" for i in range(k)]])

    schema = "bucket int, " + ", ".join(f"c{i} double" for i in range(k))
    with _lent(rows.sparkSession, model) as shared:
        summed = rows.select("words", "starts", "s").mapInArrow(scan, schema).groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).toPandas()
    out = np.zeros((buckets, k))
    if len(summed):
        out[summed["bucket"].to_numpy()] = summed[[f"c{i}" for i in range(k)]].to_numpy()
    return out


def _labelled(features: DataFrame, labels: DataFrame, subjects: list[int], most: int) -> DataFrame:
    """Features with their sets of labels and whether they are kept for the curves, at most ``most`` documents by order of a hash of their ids."""
    sets = labels.where(F.col("subject_id").isin(subjects)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_set(F.col("subject_id").cast("int"))).alias("s"))
    n = sets.count()
    if n > most:
        sets = sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return features.join(sets, "doc_id").withColumn("kept", F.pmod(F.xxhash64(F.lit("kept"), "doc_id"), F.lit(5)) == 0)


def train(features: DataFrame, known: DataFrame, subjects: list[int], rounds: int = 10, settled: float = 0.005, buckets: int = BUCKETS, trust: float = 2.0) -> Model | None:
    """The model refined until the subjects' shares of all words move by less than ``settled`` in sum, or ``rounds`` are over; None without usable labels.

    The labelled documents weigh ``trust`` times as much as all the corpus, so that wording of a language or a kind of
    document that few labels cover does not pull a subject away.
    """
    counts = _counts(known.where(F.size("s") == 1), subjects, None, buckets)
    if not counts.any():
        return None
    # The labelled documents with several subjects first, then all documents.
    model = Model(counts + _counts(known.where(F.size("s") > 1), subjects, Model(counts, subjects), buckets), subjects)
    every = features.withColumn("s", F.lit(None).cast("array<int>"))
    before = None
    for _ in range(rounds):
        soft, hard = _counts(every, subjects, model, buckets), _counts(known, subjects, model, buckets)
        counts = soft + trust * soft.sum() / max(hard.sum(), 1.0) * hard
        model = Model(counts, subjects)
        mass = counts.sum(axis=0) / counts.sum()
        if before is not None and np.abs(mass - before).sum() < settled:
            break
        before = mass
    return model


def _shares(own: Model, part: pa.RecordBatch, x: Sentences) -> np.ndarray:
    """Share of each subject among the sentences that have one, for each row; noughts for rows without sentences."""
    out = np.zeros((part.num_rows, len(own.subjects)))
    if len(x.rows):
        out[x.rows] = own.by_document(*own.posteriors(x.ids, x.starts), x.docs)
    return out


def calibrate(labelled: DataFrame, model: Model, start: tuple[float, float] = (40.0, 0.21), strength: float = 8.0) -> np.ndarray:
    """Slope and offset of each subject's logistic curve, drawn towards a common start where labels are few."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _steps(b):
                yield pa.RecordBatch.from_arrays([pa.array(_shares(shared.value, part, x).tolist(), pa.list_(pa.float64())), part.column(2)], names=["share", "s"])

    with _lent(labelled.sparkSession, model) as shared:
        got = labelled.where("kept").select("words", "starts", "s").mapInArrow(scan, "share array<double>, s array<int>").toPandas()  # bounded by most_labelled
    k = len(model.subjects)
    share = np.array(got["share"].tolist()).reshape(-1, k)
    truth = np.array([[s in set(x) for s in model.subjects] for x in got["s"]], dtype=float).reshape(-1, k)
    curves = np.zeros((k, 2))
    for i in range(k):
        near = share[:, i] > 0.02
        x, y = share[near, i] - start[1], truth[near, i]
        a, b = start[0], 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p)
            grad = np.array([((y - p) * x).sum() - strength * 0.002 * (a - start[0]), (y - p).sum() - strength * b])
            hess = np.array([[(w * x * x).sum() + strength * 0.002, (w * x).sum()], [(w * x).sum(), w.sum() + strength]])
            step = np.linalg.solve(hess, grad)
            a, b = a + float(np.clip(step[0], -10, 10)), b + float(np.clip(step[1], -1, 1))
        curves[i] = max(a, 10.0), b - max(a, 10.0) * start[1]
    return curves


def assign(share: np.ndarray, curves: np.ndarray, least: float = 0.5, most: int = 3) -> tuple[list[int], np.ndarray]:
    """Numbers of the assigned subjects and all posteriors."""
    p = 1 / (1 + np.exp(-np.clip(curves[:, 0] * share + curves[:, 1], -30, 30)))
    order = np.lexsort((np.arange(len(p)), -share))[:most]
    return [int(i) for i in order if p[i] >= least] or [int(order[0])], p


def find_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 10, buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED, most_subjects: int = 1000, posteriors: bool = False) -> DataFrame:
    """Rows ``doc_id, subject_id``; with ``posteriors`` also ``posterior`` and ``share``."""
    spark = documents.sparkSession
    schema = "doc_id long, subject_id int" + (", posterior double, share double" if posteriors else "")
    ids = sorted(r[0] for r in subjects.select(F.col("subject_id").cast("int")).where("subject_id is not null").distinct().limit(most_subjects + 1).collect())
    if len(ids) > most_subjects:
        raise ValueError(f"more than {most_subjects} subjects; a model holds a column for each")
    empty = spark.createDataFrame([], schema)
    if not ids:
        return empty
    features = cut(read_features(documents, doc_id, text, buckets), "features")
    labelled = cut(_labelled(features, labels, ids, most_labelled), "labelled")
    # The curves are those of a model that has not seen the rows they are fitted on; the documents get one that has seen all.
    fitted = train(features, labelled.where("not kept"), ids, rounds, buckets=buckets)
    model = train(features, labelled, ids, rounds, buckets=buckets)
    if model is None:
        return empty
    shared = spark.sparkContext.broadcast((model, calibrate(labelled, fitted or model)))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, curves = shared.value
        for b in batches:
            for part, x in _steps(b):
                cols: list[list] = [[], [], [], []]
                for i, share in zip(part.column(2).to_pylist(), _shares(own, part, x)):
                    chosen, p = assign(share, curves)
                    for c in chosen:
                        for col, v in zip(cols, (i, own.subjects[c], float(p[c]), float(share[c]))):
                            col.append(v)
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())]
                names = ["doc_id", "subject_id"]
                if posteriors:
                    arrays += [pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())]
                    names += ["posterior", "share"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return features.select("words", "starts", "doc_id").mapInArrow(scan, schema).dropDuplicates(["doc_id", "subject_id"])
