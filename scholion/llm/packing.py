"""Documents packed into containers of fixed capacity, by linear grouping (problem 7).

Lengths are counted in tokens of a public tokenizer whose file is a parameter. Documents are spread evenly over
buckets of bounded size, so no task ever holds more than ``bucket_docs`` lengths however large the table is; each
bucket is packed on its own and wastes at most a container or two. Within a bucket large lengths are sorted into
groups of equal cardinality and rounded up to the largest of their group; for these few sizes the best mix of
configurations is found by column generation (a simplex over configurations, priced by a knapsack over the
capacity); the actual documents, no longer than their group's size, take the places; what is left over and the
small documents go where they fit best. A document longer than the capacity is cut into full containers and a rest,
and only such a document.

Defined results: null and empty texts have no tokens and are not packed; ties are broken by length and id, so a run
repeats; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, unless the caller names another place.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(path: str):
    """A tokenizer from a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every document; texts are tokenized whole."""
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        for b in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32())], names=["doc_id", "n_tokens"])

    picked = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return picked.mapInArrow(scan, "doc_id long, n_tokens int")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 400) -> list[tuple[float, np.ndarray]]:
    """A basis of the fractional optimum: (how often, items of each size) for few sizes."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    most = int(capacity // sizes.min())
    for _ in range(most_steps):
        try:
            price = np.linalg.solve(basis.T, np.ones(m))
        except np.linalg.LinAlgError:
            break
        column, value = _knapsack(sizes, np.maximum(price, 0), capacity, most)
        if value <= 1 + 1e-7:
            break
        x = np.linalg.solve(basis, demand)
        d = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.linalg.solve(basis, demand)
    return [(float(x[i]), basis[:, i].astype(int)) for i in range(m)]


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, float]:
    """The configuration of the largest price, by layers of one item more each."""
    best = np.zeros(capacity + 1)
    layers = [best]
    choices = []
    for _ in range(most):
        new, choice = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if price[i] <= 0:
                continue
            got = layers[-1][: capacity + 1 - s] + price[i]
            part = new[s:]
            better = got > part + 1e-12
            part[better] = got[better]
            choice[s:][better] = i
        if (choice == -1).all():
            break
        layers.append(new)
        choices.append(choice)
        best = new
    column = np.zeros(len(sizes), dtype=int)
    room, layer = capacity, len(choices)
    value = float(best[capacity])
    while layer > 0:
        i = choices[layer - 1][room]
        layer -= 1
        if i >= 0:
            column[i] += 1
            room -= int(sizes[i])
    return column, value


def pack(lengths: list[int], capacity: int, groups: int = 48, small: float = 1 / 4) -> list[int]:
    """The container, from 0, of each length (all between 1 and ``capacity``)."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    large = [i for i in order if lengths[i] > capacity * small]
    place = [-1] * len(lengths)
    room: list[int] = []
    if large:
        k = min(groups, len(large))
        bounds = [round(len(large) * g / k) for g in range(k + 1)]
        sizes: list[int] = []
        counts: list[int] = []
        for first, last in zip(bounds, bounds[1:]):
            size = lengths[large[first]]
            if sizes and sizes[-1] == size:
                counts[-1] += last - first
            else:
                sizes.append(size)
                counts.append(last - first)
        waiting = sorted((lengths[i], -i) for i in large)
        for often, column in sorted(configurations(np.array(sizes), np.array(counts, dtype=float), capacity), key=lambda c: -c[0]):
            slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            for _ in range(int(often + 1e-6)):
                # The longest waiting document that a place takes; the last place takes what the actual lengths leave.
                left, got = capacity, []
                for n, g in enumerate(slots, 1):
                    at = bisect_left(waiting, (min(left, left if n == len(slots) else sizes[g]) + 1, -len(lengths)))
                    if not at:
                        break
                    length, i = waiting.pop(at - 1)
                    got.append(-i)
                    left -= length
                if not got:
                    break
                for i in got:
                    place[i] = len(room)
                room.append(left)
    # What still waits and the small lengths, longest first, where they leave the least room.
    return _best_fit(lengths, capacity, order, place, room)


def _best_fit(lengths: list[int], capacity: int, order: list[int], place: list[int], room: list[int]) -> list[int]:
    free = sorted((r, c) for c, r in enumerate(room) if r)
    for i in order:
        if place[i] >= 0:
            continue
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            r, c = free.pop(at)
        else:
            r, c = capacity, len(room)
            room.append(capacity)
        place[i] = c
        r -= lengths[i]
        room[c] = r
        if r:
            insort(free, (r, c))
    return place


def pack_documents(documents: DataFrame, containers: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, bucket_docs: int = 20_000, groups: int = 48, most_kinds: int = 1000) -> DataFrame:
    """Rows ``container_kind, container_id, doc_id, part_no, n_tokens``: what each container of each kind holds."""
    from scholion.session import cut

    schema = "container_kind string, container_id string, doc_id long, part_no int, n_tokens int"
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").distinct().limit(most_kinds + 1).collect()
    if len(kinds) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of containers")
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    counted = cut(token_counts(documents, doc_id, text, vocabulary).where("n_tokens > 0"), "tokens")
    buckets = max(1, -(-counted.count() // bucket_docs))
    # Parts: full ones of a document beyond the capacity need no packing; its rest and all others do.
    each = F.array(*[F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(k["capacity"]).alias("capacity")) for k in kinds])
    sized = counted.select("*", F.explode(each).alias("__kind")).select("doc_id", "n_tokens", "__kind.*")
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    parts = sized.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    whole = (
        parts.where("full > 0")
        .select("container_kind", "doc_id", "capacity", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("part_no"))
        .select("container_kind", F.concat(F.lit("f"), "doc_id", F.lit("."), "part_no").alias("container_id"), "doc_id", "part_no", F.col("capacity").alias("n_tokens"))
    )
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    items = parts.where("rest > 0").select("container_kind", "capacity", bucket.alias("bucket"), "doc_id", (F.col("full") + 1).alias("part_no"), F.col("rest").alias("n_tokens"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no", "n_tokens"], kind="stable")
        at = pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]), groups)
        pdf["container_id"] = [f"{b}.{c}" for b, c in zip(pdf["bucket"], at)]
        return pdf[["container_kind", "container_id", "doc_id", "part_no", "n_tokens"]]

    packed = items.groupBy("container_kind", "bucket").applyInPandas(fill, schema)
    return packed.unionByName(whole)


def container_use(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """For each kind: containers, tokens and the share of the space that is used."""
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    kinds = containers.select("container_kind", "capacity_tokens")
    return (
        per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"))
        .join(F.broadcast(kinds), "container_kind")
        .select("container_kind", "n_containers", "n_tokens", "fullest", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used"))
    )
