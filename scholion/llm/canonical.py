"""Free-entered values mapped to a canonical list (problem 2).

Values are deduplicated and normalised; an inverted index from character trigrams to the entries of the list gives
candidates with their weighted cosine (trigrams weighted by inverse document frequency over the list); the best
candidate is accepted above a threshold and with a margin over the next. An exact check follows: the words of the
value and of the entry must agree but for spelling, abbreviation, additions and shortening, so that a name with
another word in it is no match. The list is a fixed reference of bounded size (``max_entries``); values may be any
number, they are matched once each and joined back.

Defined results: a null or blank value is missing and gives no row; a value equal to an entry letter for letter
needs no mapping and gives no row in ``map_values``' found form; a value that means no entry gets id 0; ties
between two entries give 0; an empty table gives an empty result; an empty list gives 0 for every value.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP = frozenset({"the", "of", "and", "in", "for", "on", "a", "an", "to"})
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LEAD = re.compile(r"^\s*(?:in|journal|journal title|source|published in|publ\. in)\s*:\s*", re.I)
_TAIL = re.compile(
    r"\s*(?:\s(?:the )?preprint(?: server)?(?: for .*)?|\s=\s.*|\s:\s+(?:official|an? |the official|organ|journal of record).*|[;,]\s*(?:vol(?:ume)?\.?\s*)?\d.*|,\s*(?:vol|no|pp|iss)\b.*|\.\s*\d{4}\.?|\s\d+(?:\s*\(\d+\))?\s*,\s*\d.*|\s\d{1,4}(?:\s*\(\d+\))?|[(\[][^()\[\]]*[)\]])\s*\.?\s*$",
    re.I,
)


def fold(text: str) -> str:
    """Compatibility forms, accents and case folded; ampersands spelt out; joining signs made spaces."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", html.unescape(text)))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[&+]", " and ", text)).strip()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def squeeze(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


def forms(value: str) -> list[str]:
    """The value, then the value without what may be added to a name, and turned round at a comma."""
    text = re.sub(r"^[\"'“”„«»‘’\s*†]+|[\"'“”«»‘’\s*†]+$", "", _LEAD.sub("", fold(value)))
    out = [text]
    for _ in range(4):
        cut = _TAIL.sub("", out[-1]).strip(" ;:,=")
        if not cut or cut == out[-1]:
            break
        out.append(cut)
    for t in list(out):
        head, comma, tail = t.rstrip(" .").partition(", ")
        if comma and tail:
            out.append(f"{tail} {head}")
    return list(dict.fromkeys(t for t in out if squeeze(t)))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most`` + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    if sum((Counter(a) - Counter(b)).values()) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        lo, hi = max(1, i - most), min(len(b), i + most)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = before[j - 1] + (x != y)
            if before[j] < d:
                d = before[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and two[j - 2] < d:
                d = two[j - 2] + 1
            row[j] = d
        if min(row[lo : hi + 1], default=far) > most:
            return most + 1
    return min(row[-1], far)


class CanonicalIndex:
    """The character n-gram index over the list, with the exact check."""

    def __init__(self, entries: list[tuple[int, str]], threshold: float = 0.3, margin: float = 0.02, n: int = 3, max_entries: int = 200_000):
        if len(entries) > max_entries:
            raise ValueError(f"the list has {len(entries)} entries; at most {max_entries} are indexed in memory")
        self.threshold, self.margin, self.n = threshold, margin, n
        self.ids = [i for i, _ in entries]
        self.full = [fold(t) for _, t in entries]
        self.raw = {t for _, t in entries}
        self.tokens = [words(t) for t in self.full]
        self.content = [[w for w in t if w not in STOP] for t in self.tokens]
        self.vocabulary = {w for c in self.content for w in c if len(w) >= 4}
        self.word_sets = [set(t) for t in self.tokens]
        self.tight = [squeeze(t) for t in self.full]
        self.bare = ["".join(c) for c in self.content]
        self.initials = ["".join(w[0] for w in c) for c in self.content]
        self.same: dict[str, list[int]] = defaultdict(list)
        for k, t in enumerate(self.tight):
            self.same[t].append(k)
        # Each entry is indexed under its full name and under its initials.
        rows = [(k, g) for k, t in enumerate(self.tight) for g in (self.grams(t), self.grams(self.initials[k]))]
        df = Counter(x for _, g in rows for x in g)
        self.idf = {x: math.log(1 + len(rows) / c) for x, c in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.owner = np.array([k for k, _ in rows], dtype=np.int64)
        for r, (_, g) in enumerate(rows):
            norm = math.sqrt(sum((c * self.idf[x]) ** 2 for x, c in g.items())) or 1.0
            for x, c in g.items():
                self.postings[x].append((r, c * self.idf[x] / norm))
        self.arrays = {x: (np.array([r for r, _ in p], dtype=np.int64), np.array([w for _, w in p])) for x, p in self.postings.items()}
        del self.postings
        self.rows = len(rows)

    def grams(self, tight: str) -> Counter:
        text = f"^{tight}$"
        return Counter(text[i : i + self.n] for i in range(max(1, len(text) - self.n + 1)))

    def cosines(self, tight: str) -> np.ndarray:
        """The weighted cosine of a value with every entry that shares a gram (all others nought)."""
        grams = self.grams(tight)
        top = math.log(1 + max(self.rows, 1))
        norm = math.sqrt(sum((c * self.idf.get(x, top)) ** 2 for x, c in grams.items())) or 1.0
        score = np.zeros(self.rows)
        for x, c in grams.items():
            if x in self.arrays:
                r, w = self.arrays[x]
                score[r] += w * (c * self.idf[x] / norm)
        best = np.zeros(len(self.ids))
        np.maximum.at(best, self.owner, score)
        return best

    def agreement(self, form: str, k: int, cosine: float = 1.0) -> float:
        """How a form of a value agrees with an entry: 4 the same letters, 3 initials or abbreviation, 2.2 shortening, 1..2 misspelling, 0 none."""
        tight = squeeze(form)
        if tight in (self.tight[k], self.bare[k]) or tight.removeprefix("the") == self.tight[k].removeprefix("the"):
            return 4.0
        if "".join(w for w in words(form) if w not in STOP) == self.bare[k]:
            return 4.0
        own = words(form)
        if len(self.initials[k]) >= 3 and tight == self.initials[k]:
            return 3.0
        cut = bool(re.search(r"(?:…|\.\.\.)\W*$", form))
        content = [w for w in own if w not in STOP]
        if len(content) >= 2 and self._abbreviates(content, self.content[k], cut):
            return 3.0
        entry = self.tight[k].removeprefix("the")
        value = tight.removeprefix("the")
        if len(value) >= 0.5 * len(entry) and entry.startswith(value):
            return 2.2
        most = 1 if len(entry) < 8 else 2 if len(entry) < 16 else 4
        # A word of the list in the place of another makes another name, however few letters differ.
        if any(w in self.vocabulary and w not in self.word_sets[k] for w in content):
            return 0.0
        # A name within so few edits keeps a good part of its grams.
        d = edits(value, entry, most) if cosine >= 0.25 else most + 1
        if d <= most:
            return 2.0 - d / 10
        if cut and cosine >= 0.25 and len(value) >= 0.5 * len(entry):
            d = edits(value, entry[: len(value)], 2)
            if d <= 2:
                return 1.5 - d / 10
        return 0.0

    @staticmethod
    def _abbreviates(value: list[str], entry: list[str], cut: bool) -> bool:
        if len(value) != len(entry):
            return False
        for v, e in zip(value, entry):
            if not e.startswith(v) and edits(v, e, 1) > (1 if len(e) > 4 else 0):
                return False
        return True

    def match(self, value: str) -> tuple[int, float]:
        """The id meant and its cosine; id 0 if no entry is meant."""
        found: dict[int, tuple[float, float]] = {}
        for form in forms(value):
            tight = squeeze(form)
            score = self.cosines(tight)
            same = self.same.get(tight)
            # All entries in reach of the best are checked; where one has the same letters, only those that have them too.
            reach = same if same else np.flatnonzero(score >= max(self.threshold * 0.5, 0.4 * score.max(initial=0.0)))
            for k in reach:
                agree = self.agreement(form, int(k), float(score[k]))
                if agree:
                    old = found.get(int(k), (0.0, 0.0))
                    found[int(k)] = max(old, (agree, float(score[k])))
            if found and max(found.values())[0] >= 3:
                break
        if not found:
            return 0, 0.0
        ranked = sorted(((a, s, k) for k, (a, s) in found.items()), reverse=True)
        if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < 0.05 and (ranked[0][0] == 2.2 or ranked[0][1] - ranked[1][1] < self.margin):
            # As near to one entry as to another; a shortening that two entries share means neither.
            return 0, ranked[0][1]
        a, s, k = ranked[0]
        return (self.ids[k], s) if s >= self.threshold or a >= 3 else (0, s)


def load_entries(reference: DataFrame, id_col: str, name_col: str, max_entries: int = 200_000) -> list[tuple[int, str]]:
    """The canonical list; refused beyond ``max_entries``, so nothing unbounded reaches the driver."""
    got = reference.select(F.col(id_col).cast("int").alias("i"), F.col(name_col).alias("n")).where("n is not null").limit(max_entries + 1).collect()
    return sorted((r["i"], r["n"]) for r in got)


def map_values(values: DataFrame, value_col: str, reference: DataFrame, id_col: str, name_col: str, **options) -> DataFrame:
    """Distinct values with ``canonical_id``, ``cosine`` and ``n_rows``; id 0 marks the values to report as unmatched.

    The values are counted with a map-side partial aggregate first, so a value that fills a third of the rows
    reaches the shuffle once a task.
    """
    index = CanonicalIndex(load_entries(reference, id_col, name_col), **options)
    shared = values.sparkSession.sparkContext.broadcast(index)  # bounded by max_entries

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            got = [own.match(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), b.column(1), pa.array([i for i, _ in got], pa.int32()), pa.array([round(s, 6) for _, s in got], pa.float64())],
                names=["value", "n_rows", "canonical_id", "cosine"],
            )

    v = F.col(f"`{value_col}`")
    counted = values.where(v.isNotNull() & (F.trim(v) != "")).groupBy(v.alias("value")).agg(F.count("*").alias("n_rows"))
    # Few bytes but much work a value: a fixed number of partitions keeps the values from being merged into one task.
    spread = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    return counted.repartition(spread).mapInArrow(scan, "value string, n_rows long, canonical_id int, cosine double")


def map_rows(rows: DataFrame, row_id: str, value_col: str, reference: DataFrame, id_col: str, name_col: str, **options) -> DataFrame:
    """Every row whose value is neither missing nor an entry letter for letter, with the id meant or 0."""
    exact = reference.select(F.col(name_col).alias("__name")).where("__name is not null").distinct()
    v = F.col(f"`{value_col}`")
    asked = rows.select(F.col(f"`{row_id}`").alias("__row"), v.alias("__value")).where(v.isNotNull() & (F.trim(v) != ""))
    asked = asked.join(F.broadcast(exact), F.col("__value") == F.col("__name"), "left_anti")  # bounded by max_entries, checked in load_entries
    mapped = map_values(asked, "__value", reference, id_col, name_col, **options).select("value", "canonical_id")
    return asked.join(mapped, F.col("__value") == F.col("value")).select(F.col("__row").alias(row_id), F.col("canonical_id").alias(id_col))
