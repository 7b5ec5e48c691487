"""Held-out test items that leaked into documents, by greedy string tiling (problem 8).

The items are few and fixed, so their seeds (runs of three words) form a broadcast index; documents are scanned
once to count in how many of them each seed of an item occurs elsewhere than in a long passage of that item, and
once to be compared. Seeds that many documents hold so are wording of the field for that item and start no match,
unless they stand in a long passage of it: the copies of a leaked item, however many, do not make it wording of the
field. For a document that shares seeds with an item the longest matches are
marked first, one after the other, without overlap (Karp-Rabin: the hashes of a document's windows of three words are looked
up among those of the items, and equal windows extended word by word); tiles on nearly one diagonal with a changed word between them are one passage. A
document gives an item away if one or two passages span at least a third of the item's words, in whichever order
they stand.

Defined results: null and empty texts hold nothing; an item shorter than a seed is never found; repeated documents
under one id are reported once; equal items are all reported; empty tables give an empty result; other columns are
ignored. Texts are compared whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[一-鿿]|[^\W_]+")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    return _WORD.findall(text.lower())


class ItemIndex:
    """The seeds of the test items with their places; ``common`` holds the (item, seed) that start no match outside passages of ``long`` words."""

    def __init__(self, items: list[tuple[int, str]], share: float = 1 / 3, passage: int = 4, gap: int = 2, long: int = 12, max_items: int = 100_000):
        if len(items) > max_items:
            raise ValueError(f"{len(items)} test items; at most {max_items} are indexed in memory")
        self.share, self.passage, self.gap, self.long = share, passage, gap, long
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            n = len(self.items)
            self.items.append((item_id, ids))
            for j in range(len(ids) - SEED + 1):
                self.seeds[tuple(ids[j : j + SEED])].append((n, j))
        self.seeds = dict(self.seeds)
        self.numbers = {(n, s): i for i, (n, s) in enumerate(dict.fromkeys((n, s) for s, at in self.seeds.items() for n, _ in at))}
        self.common: set[tuple[int, tuple[int, int, int]]] = set()
        self.windows = np.unique(self.rolling(np.array(list(self.seeds), dtype=np.int64).reshape(-1, SEED))) if self.seeds else np.zeros(0, dtype=np.uint64)

    @staticmethod
    def rolling(windows: np.ndarray) -> np.ndarray:
        """The Karp-Rabin hash of each window of words, modulo 2 to the 64."""
        h = np.zeros(len(windows), dtype=np.uint64)
        for i in range(SEED):
            h = h * _BASE + windows[:, i].astype(np.uint64)
        return h

    def ids(self, text: str) -> list[int]:
        get = self.vocabulary.get
        return [get(w, -1) for w in words(text)]

    def found_seeds(self, ids: list[int]) -> list[tuple[int, tuple[int, int, int]]]:
        """Places of the document's windows that are seeds: those of an equal hash are compared word by word."""
        if len(ids) < SEED or not len(self.windows):
            return []
        every = np.array(ids, dtype=np.int64)
        known = every >= 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return []
        h = self.rolling(every[at[:, None] + np.arange(SEED)])
        spot = np.searchsorted(self.windows, h)
        hit = at[self.windows[np.minimum(spot, len(self.windows) - 1)] == h]
        got = [(k, tuple(ids[k : k + SEED])) for k in hit.tolist()]
        return [(k, t) for k, t in got if t in self.seeds]

    def leaks(self, text: str) -> list[int]:
        """Numbers of the items that a text gives away."""
        ids = self.ids(text)
        found = self.found_seeds(ids)
        if not found:
            return []
        return [n for n, places in self.places(found).items() if self._given_away(ids, n, places)]

    def places(self, found: list[tuple[int, tuple[int, int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """(place in the document, place in the item) of the seeds, for each item."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in found:
            for n, j in self.seeds[t]:
                places[n].append((k, j))
        return places

    def long_places(self, ids: list[int], n: int, seeds: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """The seeds in passages that span at least ``long`` words, longer than wording of the field."""
        own = self.items[n][1]
        if len(seeds) * SEED + (len(seeds) - 1) * self.gap < self.long:
            return set()
        whole = [p for p in self.passages(self.tiles(ids, own, seeds)) if self.span(p) >= self.long]
        return {(k + x, j + x) for p in whole for k, j, length in p for x in range(length - SEED + 1)}

    def field_seeds(self, ids: list[int]) -> set[int]:
        """Numbers of the (item, seed) that stand in a text outside the long passages of the item."""
        out = set()
        for n, places in self.places(self.found_seeds(ids)).items():
            inside = {k for k, _ in self.long_places(ids, n, places)}
            out.update(self.numbers[n, tuple(ids[k : k + SEED])] for k, _ in places if k not in inside)
        return out

    def _given_away(self, ids: list[int], n: int, seeds: list[tuple[int, int]]) -> bool:
        own = self.items[n][1]
        need = -(-len(own) * self.share // 1)
        if len(seeds) + SEED - 1 < min(need, self.passage) - self.gap * 2:
            return False
        dull = {(k, j) for k, j in seeds if (n, tuple(own[j : j + SEED])) in self.common}
        if dull:
            dull -= self.long_places(ids, n, seeds)
            if len(dull) == len(seeds):
                return False
        tiles = self.tiles(ids, own, seeds, dull)
        spans = sorted((s for s in map(self.span, self.passages(tiles)) if s >= self.passage), reverse=True)
        return bool(spans) and sum(spans[:2]) >= need

    def tiles(self, ids: list[int], own: list[int], seeds: list[tuple[int, int]], dull: Collection[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
        """(place in the document, place in the item, length) of the tiles, longest first, without overlap; ``dull`` seeds start none."""
        starts = set(seeds)
        matches = []
        for k, j in seeds:
            if (k - 1, j - 1) in starts:
                continue
            length = SEED
            while (k + length - SEED + 1, j + length - SEED + 1) in starts:
                length += 1
            if any((k + x, j + x) not in dull for x in range(length - SEED + 1)):
                matches.append((length, k, j))
        out, used_doc, used_item = [], set(), set()
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        while matches:
            length, k, j = matches.pop(0)
            run = 0
            pieces = []
            for x in range(length + 1):
                free = x < length and k + x not in used_doc and j + x not in used_item
                if free:
                    run += 1
                elif run:
                    pieces.append((run, k + x - run, j + x - run))
                    run = 0
            if len(pieces) == 1 and pieces[0][0] == length:
                out.append((k, j, length))
                used_doc.update(range(k, k + length))
                used_item.update(range(j, j + length))
            else:
                # Partly covered by a longer tile: what is left of it waits its turn.
                left = [p for p in pieces if p[0] >= SEED]
                if left:
                    matches.extend(left)
                    matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        return out

    def passages(self, tiles: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The tiles of each passage: tiles in a row with at most ``gap`` changed words between."""
        out: list[list[tuple[int, int, int]]] = []
        last_k = last_j = None
        for k, j, length in sorted(tiles):
            if last_k is not None and 0 <= k - last_k <= self.gap and 0 <= j - last_j <= self.gap:
                out[-1].append((k, j, length))
            else:
                out.append([(k, j, length)])
            last_k, last_j = k + length, j + length
        return out

    @staticmethod
    def span(passage: list[tuple[int, int, int]]) -> int:
        """Words of the item that a passage spans. A changed word at either end hides up to two more words that agree; they are not counted."""
        return passage[-1][1] + passage[-1][2] - passage[0][1]


def load_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", max_items: int = 100_000, **options) -> ItemIndex:
    got = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null").limit(max_items + 1).collect()
    return ItemIndex(sorted((r["i"], r["t"]) for r in got), max_items=max_items, **options)


def mark_common(documents: DataFrame, index: ItemIndex, text: str = "text", share: float = 0.002, least: int = 5) -> ItemIndex:
    """Counts over all documents in how many each seed stands outside long passages of its item; those beyond ``share`` of them (and ``least``) are common."""
    shared = documents.sparkSession.sparkContext.broadcast(index)  # bounded by max_items

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts[-1] += 1
                if t:
                    counts.update(own.field_seeds(own.ids(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["seed", "n"])

    rows = documents.select(F.col(f"`{text}`").alias("t")).mapInArrow(scan, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    n = {r["seed"]: r["n"] for r in rows}
    most = max(least, share * n.pop(-1, 0))
    index.common = {s for s, i in index.numbers.items() if n.get(i, 0) > most}
    return index


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows ``doc_id, item_id`` of the documents that give items away."""
    index = mark_common(documents, load_items(benchmark, **options), text)
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            docs, items = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    for n in own.leaks(t):
                        docs.append(i)
                        items.append(own.items[n][0])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    picked = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return picked.mapInArrow(scan, "doc_id long, item_id long").distinct()
