"""Each new batch against all that was accepted before: a prefix-tree hash forest (problem 4).

The head of a title becomes a set of shingles, and these, joined with the parts of the record that have to agree, a
signature; several permutations of it are kept as runs sorted by key in the shared folder, one level of the tree for
each minhash of a key. A batch finds its candidates by range search: all keys with a prefix of its own lie beside
it. Prefixes are widened (shortened) until the share of damaged copies of the batch's titles that lie beside their
originals reaches the target. Shingles are taken from the head alone, as a cut-off title still has it; a tree joins
them with the start or the end of the surname and with the genes that end in the head, so that a wrong letter in the
surname or before a gene spoils half of the trees at most. Candidates are verified on the whole titles, surnames,
kinds, genes and numbers; identifiers are matched exactly; the runs of batches are merged by ``compact``. Sameness
carries over, so entries end in connected components, found with joins on keys; no group is collected anywhere.

Defined results: null, blank and unusable identifiers count as missing; entries without an identifier and without
a title or surname match nothing; of equal entry ids in one table all rows take part, an entry is no duplicate of
itself; an empty history or batch is allowed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import cut, scratch_path

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_TAGS = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}(?:\s[^<>]*)?/?>")
_END_MARKS = frozenset("])*†‡. \t\n\xa0")
_AFFIX = re.compile(r"\s*(?:\[(?:article|preprint|internet|abstract|review|letter|research article)\]|\((?:preprint|article|abstract|version \d+|v\d+)\)|[*†‡.\s])+$", re.I)
#: Words that make a work another one than its original.
_KIND = re.compile(r"^\W*(corrections?(?: to)?|corrigend(?:um|a)(?: to)?|errat(?:um|a)(?: to)?|retract(?:ion|ed)(?: of)?(?: article)?|reply(?: to)?|response(?: to)?|authors?['’]? (?:reply|response)|comments?(?: on| to)?|commentary(?: on)?|re|addend(?:um|a)(?: to)?|expression of concern|letter to the editor|withdrawn)\s*[:—–.,-]?\s", re.I)
_GENE = re.compile(r"\b[a-z]{2,6}\d{1,4}(?=\b|dependent\b)")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\d+(?![A-Za-z0-9])")
_ELLIPSIS = re.compile(r"\s*(?:…|\.\.\.)[\W]*$")
_ROMAN = re.compile(r"\b(?:part|study|report|paper|volume|chapter|phase|series)\s+([ivx]{1,5}|[a-d])\b", re.I)


def fold(text: str) -> str:
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub("", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    return "".join([c for c in text if not unicodedata.combining(c)]).lower().translate(_LETTERS)


_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def surname(authors: str | None) -> str:
    """The first author's family name, whatever the order of its parts."""
    first = re.split(r"[,;]|\bet al\b|\band\b|&", authors or "", maxsplit=1)[0]
    parts = [p for p in re.split(r"[\s.]+", fold(first)) if p]
    full = [p for p in parts if len(p) > 1]
    if not full:
        return ""
    # Initials after the name ("Korham J", "Korham JA") or before it ("J. Korham"), or a full given name first.
    name = full[0] if len(parts) > 1 and (len(parts[-1]) == 1 or re.search(r"\s[A-Z]{1,3}\.?\s*$", first)) else full[-1]
    return re.sub(r"[\W\d_]", "", name)


def title_parts(title: str | None) -> tuple[str, str, bool]:
    """Letters and figures of a title; what must be equal (kind, genes, numbers); whether it was cut off."""
    if not title or not title.strip():
        return "", "", False
    text = fold(title).strip()
    text = re.sub(r"^[\W_]+", "", text)
    cut_off = False
    # Only the end is looked at, again and again, as marks may follow one another.
    while text:
        before = text
        if "…" in text[-8:] or "..." in text[-8:]:
            m = _ELLIPSIS.search(text, len(text) - 8)
            if m:
                cut_off, text = True, text[: m.start()]
        if text[-1:] in _END_MARKS:
            m = _AFFIX.search(text, max(0, len(text) - 40))
            if m:
                text = text[: m.start()]
        if text[-1:] in "]”\"'»" or text[-1:] == ")" and text.count("(") < text.count(")"):
            text = text[:-1]
        if text == before:
            break
    kind = _KIND.match(text + " ")
    if kind:
        text = text[kind.end() :]
    text = re.sub(r"\s*&\s*", " and ", text)
    genes = sorted(set(_GENE.findall(text)))
    numbers = sorted(_NUMBER.findall(text)) + sorted(m.group(1) for m in _ROMAN.finditer(text))
    guard = (re.sub(r"\W.*", "", kind.group(1).lower())[:6] if kind else "") + "|" + ",".join(genes)
    letters = re.sub(r"[\W_]+", "", text)
    return letters, guard + "|" + ("" if cut_off else ",".join(numbers)), cut_off


TREES, LEVELS, BITS = 8, 3, 20
#: Letters at the start of a title that the signatures are made of: a cut-off title still has them.
HEAD = 24
#: Share of damaged copies of the batch's own titles that the prefixes have to find, and how many are tried.
RECALL, TRIED = 0.99, 2000
#: Prefixes of at most so many classes of a batch, and so many candidate pairs, are broadcast to filter older runs in their scan (some 30 MB); of more, the runs are joined by shuffle.
MOST_BROADCAST = 50_000


def _constants(label: bytes, n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(label + b"%d" % i, digest_size=8).digest(), "big") | 1 for i in range(n)], dtype=np.uint64)


_A, _B, _P = _constants(b"a", TREES * LEVELS), _constants(b"b", TREES * LEVELS), _constants(b"p", 4)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P[3]
    return h ^ (h >> np.uint64(33))


def _salts(name: str, guard: str, letters: str) -> list[int]:
    """What a tree's shingles are joined with: the kind, a part of the surname, the genes that end in the head.

    Trees differ in the part of the surname (its start or its end) and in how far the head reaches for genes, so a
    letter wrong in the surname, or letters lost before a gene, leave half of the trees as they are.
    """
    kind, genes = guard.split("|")[:2]
    ends = [(g, letters.find(g) + len(g)) for g in genes.split(",") if g and g in letters]
    seen = [",".join(g for g, end in ends if end <= reach) for reach in (HEAD, HEAD - 6)]
    return [zlib.crc32(f"{part}|{kind}|{s}".encode()) for s in seen for part in (name[:3] + "<", name[-3:] + ">")]


def signatures(rows: list[tuple[str, str, str]], chunk: int = 4000) -> np.ndarray:
    """The tree keys of (surname, guard, letters): for each tree one number of LEVELS minhashes of BITS bits, the tree before them.

    The shingles are runs of three letters of the head, each joined with the salt of the tree.
    """
    out = np.zeros((len(rows), TREES), dtype=np.int64)
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        raws = [letters[:HEAD].encode().ljust(3, b" ") for _, _, letters in part]
        salts = np.array([_salts(*r) for r in part], dtype=np.uint64)
        raw = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(r) for r in raws])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = raw[:-2] * _P[0] + raw[1:-1] * _P[1] + raw[2:] * _P[2]
        # Shingles that run from one title into the next are left out.
        inside = np.ones(len(raw), dtype=bool)
        inside[starts + sizes - 1] = inside[starts + sizes - 2] = False
        h, n = h[inside[:-2]], sizes - 2
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        for t in range(TREES):
            own = _mixed(h ^ (np.repeat(salts[:, t % 4], n) * _P[1]))
            key = np.full(len(part), t, dtype=np.uint64)
            for i in range(t * LEVELS, (t + 1) * LEVELS):
                least = np.minimum.reduceat(own * _A[i] + _B[i], first)
                key = (key << np.uint64(BITS)) | (_mixed(least) >> np.uint64(64 - BITS))
            out[at : at + chunk, t] = key.astype(np.int64)
    return out


def allowed_edits(letters: int) -> int:
    """Edits by which titles may differ, the shorter of which has so many letters."""
    return min(10, max(2, int(letters * 0.06)))


def damaged(rng: random.Random, name: str, guard: str, letters: str) -> tuple[str, str, str]:
    """A copy as free typing makes it: a few letters wrong outside the genes, the end cut off, a letter of the surname wrong."""
    genes = [g for g in guard.split("|")[1].split(",") if g]
    safe = [i for i in range(len(letters)) if not any(letters.find(g) <= i < letters.find(g) + len(g) for g in genes)]
    marks = list(letters)
    for i in rng.sample(safe, min(len(safe), rng.randint(1, allowed_edits(len(letters))))):
        marks[i] = rng.choice(["", marks[i] * 2, rng.choice("abcdefghij")])
    text = "".join(marks)
    if rng.random() < 0.4 and len(text) > HEAD:
        text = text[: rng.randint(HEAD, len(text))]
        genes = [g for g in genes if g in text]
    elif len(name) > 4 and rng.random() < 0.2:
        i = rng.randrange(len(name))
        name = name[:i] + rng.choice("abcdefghij") + name[i + 1 :]
    return name, guard.split("|")[0] + "|" + ",".join(genes) + "|", text


def needed_level(rows: list[tuple[str, str, str]], recall: float = RECALL) -> tuple[int, float]:
    """The longest prefix under which at least ``recall`` of damaged copies of the titles lie beside their originals, and the share it finds.

    Prefixes are widened (shortened) level by level until that holds; the widest is one level.
    """
    if not rows:
        return LEVELS, 1.0
    rng = random.Random(29)
    a, b = signatures(rows), signatures([damaged(rng, *r) for r in rows])
    for level in range(LEVELS, 0, -1):
        shift = BITS * (LEVELS - level)
        share = float(((a >> shift) == (b >> shift)).any(axis=1).mean())
        if share >= recall or level == 1:
            return level, share
    raise AssertionError


def _identifiers(df: DataFrame, id_col: str = "id") -> DataFrame:
    invisible = "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF\\u00A0\\s]"
    tidy = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), invisible, ""))
    pmid = F.regexp_extract(tidy("pmid"), r"^(?:pmid)?[:=#]?0*(\d{4,10})(?:\.0*)?\.?$", 1)
    own_id = tidy(id_col)
    from_id = F.regexp_extract(own_id, r"^(?:pmid)?:?0*(\d{4,10})(?:\.0*)?$", 1)
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%2f", "/"), "%28", "("), "%29", ")")
    tail = r"[.,;\]\"'>]+$"
    doi = F.regexp_replace(F.regexp_extract(plain(tidy("doi")), r"(10\.\d{4,9}/[^\s]+)", 1), tail, "")
    id_doi = F.regexp_replace(F.regexp_extract(plain(own_id), r"(10\.\d{4,9}/[^\s]+)", 1), tail, "")
    # A server's own identifier ends in a version; a DOI field that repeats it with the version is cut alike.
    server = F.regexp_replace(id_doi, r"v\d{1,2}$", "")
    versioned = own_id.rlike(r"^[a-z]+:10\.") & id_doi.rlike(r"v\d{1,2}$")
    from_server = F.when(versioned, server).otherwise(id_doi)
    doi = F.when((doi != "") & versioned & doi.startswith(server) & F.regexp_replace(doi, r"v\d{1,2}$", "").eqNullSafe(server), server).otherwise(doi)
    return df.select(
        "entry_id",
        F.when(pmid != "", pmid).when(from_id != "", from_id).alias("pmid"),
        F.when(doi != "", doi).when(from_server != "", from_server).alias("doi"),
        "title",
        "authors",
    )



def prepare(entries: DataFrame) -> DataFrame:
    """entry_id, normal pmid and doi, surname, guard, letters of the title and whether it was cut off."""
    base = _identifiers(entries)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, authors = b.column(3).to_pylist(), b.column(4).to_pylist()
            parts = [title_parts(t) for t in titles]
            names = [surname(a) for a in authors]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([p[0] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.bool_())],
                names=["entry_id", "pmid", "doi", "surname", "guard", "letters", "cut_off"],
            )

    return base.mapInArrow(scan, "entry_id long, pmid string, doi string, surname string, guard string, letters string, cut_off boolean")


#: Which identifiers a row has: 1 none, 2 a PMID, 4 a DOI, 8 both. Rows can be the same by title if one has none, or one has a PMID only and the other a DOI only.
_HAS = "CASE WHEN pmid IS NULL AND doi IS NULL THEN 1 WHEN doi IS NULL THEN 2 WHEN pmid IS NULL THEN 4 ELSE 8 END"
_TEXT = ("surname", "guard", "letters", "cut_off", "has")
_CLASS = "class_id long, surname string, guard string, letters string, cut_off boolean, has int, n long"
_TREE = "key long, class_id long, mark long"


def _titled(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("surname") != "") & (F.length("letters") >= 8)).withColumn("has", F.expr(_HAS))


def classes(entries: DataFrame) -> DataFrame:
    """The distinct titles with their smallest entry and number of rows.

    Rows that agree in all that is compared by title are one class: a work repeated in a third of all rows is
    aggregated on the map side and takes one place in each tree.
    """
    return _titled(entries).groupBy(*_TEXT).agg(F.min("entry_id").alias("class_id"), F.count("*").alias("n")).select("class_id", *_TEXT, "n")


def tree_rows(of: DataFrame) -> DataFrame:
    """(key, class_id, mark) of each class in each tree; the mark holds what the search tests before the titles are fetched."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, guards, letters = (b.column(i).to_pylist() for i in (1, 2, 3))
            keys = signatures(list(zip(names, guards, letters)))
            whole = np.array([zlib.crc32(g.encode()) for g in guards], dtype=np.int64)
            kind = np.array([zlib.crc32(g.split("|")[0].encode()) & 0xFFFF for g in guards], dtype=np.int64)
            cut_off = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = (whole << 24) | (kind << 8) | (cut_off << 4) | b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), pa.array(np.tile(ids, TREES)), pa.array(np.tile(marks, TREES))], names=["key", "class_id", "mark"])

    return of.mapInArrow(scan, _TREE)


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether marks allow the classes to be one work."""
    cut_off = ((a | b) >> 4) & 1
    same = np.where(cut_off == 1, ((a ^ b) >> 8) & 0xFFFF == 0, (a ^ b) >> 24 == 0)
    x, y = a & 15, b & 15
    return same & ((x == 1) | (y == 1) | ((x | y) == 6))


def range_search(old: DataFrame | None, new: DataFrame, level: int) -> DataFrame:
    """(a, b): classes under one prefix of ``level`` hashes in some tree, at least one of them new, whose marks agree.

    The permutations lie sorted by key; all keys with the prefix of a key are one range beside it. A range never
    spans partitions, as these are cut at prefixes; within one it is walked along, however many batches it fills.
    """
    shift = BITS * (LEVELS - level)
    every = new.withColumn("own", F.lit(True))
    if old is not None:
        every = every.unionByName(old.withColumn("own", F.lit(False)))
    ordered = every.repartitionByRange(F.shiftright("key", shift)).sortWithinPartitions("key")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            got = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            prefix = got[0] >> shift
            last = int(np.searchsorted(prefix, prefix[-1])) if len(prefix) else 0
            rest = [x[last:] for x in got]
            yield from pairs(prefix[:last], *[x[:last] for x in got[1:]])
        if rest is not None:
            yield from pairs(rest[0] >> shift, *rest[1:])

    def pairs(prefix: np.ndarray, ids: np.ndarray, marks: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, step = np.arange(len(prefix)), 0
        while len(at):
            step += 1
            at = at[at + step < len(prefix)]
            at = at[prefix[at] == prefix[at + step]]
            hit = at[(own[at] | own[at + step]) & (ids[at] != ids[at + step]) & _compatible(marks[at], marks[at + step])]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[hit], ids[hit + step])), pa.array(np.maximum(ids[hit], ids[hit + step]))], names=["a", "b"])

    return ordered.mapInArrow(scan, "a long, b long").distinct()


def _genes(p: str) -> F.Column:
    return F.filter(F.split(F.split(p + "guard", r"\|")[1], ","), lambda g: g != "")


def _same_genes() -> F.Column:
    """A gene of one title may miss in the other only where the cut-off title a ends before the gene or within it."""
    n, mine, other = F.length("a_letters"), _genes("a_"), _genes("b_")
    clipped = F.filter(mine, lambda g: F.col("a_letters").endswith(g) & F.exists(other, lambda h: h.startswith(g)))
    known = F.forall(mine, lambda g: F.array_contains(other, g) | F.array_contains(clipped, g))
    beyond = lambda h: F.position(h, "b_letters") + F.length(h) - 1 > n
    return known & F.forall(other, lambda h: F.array_contains(mine, h) | F.exists(clipped, lambda g: h.startswith(g)) | beyond(h))


def same_work() -> F.Column:
    """Whether columns a_* and b_* are one work by title: for a cut-off title, a is the shorter of the cut-off ones."""
    la, lb = F.length("a_letters"), F.length("b_letters")
    allowed = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.least(la, lb) * 0.06))).cast("int")
    wrong = F.levenshtein("a_surname", "b_surname", 1)
    names = (F.col("a_surname") == F.col("b_surname")) | ((F.least(F.length("a_surname"), F.length("b_surname")) >= 5) & (wrong >= 0))
    near = F.levenshtein("a_letters", "b_letters", 12)
    whole = ~F.col("a_cut_off") & ~F.col("b_cut_off") & (F.col("a_guard") == F.col("b_guard")) & (near >= 0) & (near <= allowed)
    n = F.least(la, lb)
    start = F.levenshtein(F.substring(F.col("a_letters"), F.lit(1), n), F.substring(F.col("b_letters"), F.lit(1), n), 8)
    kind = F.substring_index("a_guard", "|", 1) == F.substring_index("b_guard", "|", 1)
    # A cut-off title has to be the shorter one, or both are cut.
    shorter = F.col("a_cut_off") & ((la <= lb) | F.col("b_cut_off") | (la - lb <= 3)) & (n >= 16)
    return names & (whole | (shorter & kind & _same_genes() & (start >= 0) & (start <= allowed)))


def verified(candidates: DataFrame, of: DataFrame, few: bool = False) -> DataFrame:
    """The candidate pairs whose whole titles agree; ``few`` candidates are broadcast to pick their classes in the scan."""
    touched = candidates.select(F.col("a").alias("class_id")).unionByName(candidates.select(F.col("b").alias("class_id"))).distinct()
    own = of.join(F.broadcast(touched) if few else touched, "class_id", "left_semi")
    named = lambda p: own.select(*[F.col(c).alias(f"{p}_{c}") for c in ("class_id", "surname", "guard", "letters", "cut_off")])
    # Either of two cut-off titles, or the only one, takes the part of the shorter.
    both = candidates.select(F.col("a").alias("a_class_id"), F.col("b").alias("b_class_id")).join(named("a"), "a_class_id").join(named("b"), "b_class_id")
    turned = both.select(*[F.col(("b" if c[0] == "a" else "a") + c[1:]).alias(c) for c in both.columns])
    return both.unionByName(turned).where(same_work()).select(F.least("a_class_id", "b_class_id").alias("a"), F.greatest("a_class_id", "b_class_id").alias("b")).distinct()


def member_links(entries: DataFrame, of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second) of the verified pairs, and of the other rows of their classes, each with one entry it is the same as.

    Rows of one class are one work where they have no identifier, or where another class is the same as all of them.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    anchors = both.groupBy(F.col("a").alias("class_id")).agg(F.min("b").alias("near"))
    several = of.where("n > 1").join(anchors, "class_id", "left").withColumn("anchor", F.when(F.col("has") == 1, F.col("class_id")).otherwise(F.col("near"))).where("anchor is not null")
    text = [F.xxhash64(*_TEXT).alias("h1"), F.xxhash64(F.lit(7), *_TEXT).alias("h2")]
    rows = _titled(entries).select("entry_id", *text).join(several.select("anchor", *text), ["h1", "h2"]).where("entry_id <> anchor")
    return pairs.select(F.col("a").alias("first"), F.col("b").alias("second")).unionByName(rows.select(F.least("entry_id", "anchor").alias("first"), F.greatest("entry_id", "anchor").alias("second")))


def _keys(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", F.explode(F.array(F.concat(F.lit("p"), "pmid"), F.concat(F.lit("d"), "doi"))).alias("key")).where("key is not null")


def identifier_links(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(first, second): each entry with the smallest entry of the same PMID or DOI. Hot identifiers are aggregated before they are joined."""
    keys = _keys(new)
    smallest = keys
    if old is not None:
        smallest = keys.unionByName(_keys(old))
    least = smallest.groupBy("key").agg(F.min("entry_id").alias("first"), F.max("entry_id").alias("__last")).where("first <> __last").drop("__last")
    return keys.join(least, "key").where("entry_id <> first").select("first", F.col("entry_id").alias("second"))


def components(links: DataFrame) -> DataFrame:
    """(entry_id, first_id) for each linked entry: the smallest entry of its component, by large and small stars.

    Every round hangs the larger neighbours of an entry under its smallest one; rounds go on until all hang under
    one first. Lineage is cut by writing each round to the shared folder.
    """
    edges = cut(links.where("first <> second").distinct(), "edges")
    while True:
        # Large star: link every neighbour of a node that is larger than it to the node's smallest neighbour.
        both = edges.select(F.col("first").alias("u"), F.col("second").alias("v")).unionByName(edges.select(F.col("second").alias("u"), F.col("first").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("first"), F.col("v").alias("second")).where("first <> second").distinct()
        # Small star: link the smaller neighbours of a node, and the node, to the smallest of them.
        low = large.groupBy("second").agg(F.min("first").alias("m"))
        small = large.join(low, "second")
        new = small.select(F.col("m").alias("first"), "second").unionByName(small.select(F.col("m").alias("first"), F.col("first").alias("second"))).where("first <> second").distinct()
        edges = cut(new, "edges")
        # At the end every node hangs directly under one first, and no first hangs under another.
        parents = edges.groupBy("second").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        chained = edges.select(F.col("second").alias("k")).join(edges.select(F.col("first").alias("k")), "k", "left_semi").select(F.lit(1).alias("x"))
        if parents.unionByName(chained).isEmpty():
            return edges.select(F.col("second").alias("entry_id"), F.col("first").alias("first_id"))


NAMES = ("entry_id", "id", "pmid", "doi", "title", "authors")


class HistoryIndex:
    """All that was accepted, kept as runs under a shared folder, so that a batch is compared without preparing or linking the history again.

    A run holds the batch's prepared entries, its classes, its permutations as files sorted by key, and the stars found
    (an entry and the first of its work). A batch reads of the older runs the narrow keys only: identifiers by equality,
    permutations by the ranges that the batch's prefixes open, and titles of the candidates found there. Entries of
    the batch link to the firsts of older works, so older links are looked up, not joined again. ``compact`` merges
    the runs into one.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        entries = self._read("entries")
        last = entries.agg(F.max("run").alias("m")).first()["m"] if entries is not None else None
        self.runs = 0 if last is None else int(last) + 1
        #: The level and measured recall of the last search.
        self.level, self.recall = LEVELS, 1.0

    def _read(self, kind: str, before: int | None = None) -> DataFrame | None:
        try:
            got = self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return None
        return (got if before is None else got.where(F.col("run") < before)) if "run" in got.columns else None

    def _write(self, df: DataFrame, kind: str, run: int) -> DataFrame:
        path = f"{self.path}/{kind}/run={run}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _add(self, batch: DataFrame) -> tuple[int, DataFrame, DataFrame, DataFrame]:
        run, self.runs = self.runs, self.runs + 1
        entries = self._write(prepare(batch.select(*NAMES)), "entries", run)
        of = self._write(classes(entries), "classes", run)
        forest = self._write(tree_rows(of).sortWithinPartitions("key"), "forest", run)
        return run, entries, of, forest

    def seed(self, history: DataFrame) -> None:
        """Adds works that are known to be different: they are not compared with each other."""
        self._add(history)

    def accept(self, batch: DataFrame) -> DataFrame:
        """Adds a batch; (first_id, dup_id) of its entries whose work was there before or earlier in the batch."""
        run, entries, of, forest = self._add(batch)
        size = of.count()
        tried = of.orderBy(F.xxhash64("class_id"), "class_id").limit(TRIED).select("surname", "guard", "letters").collect()
        self.level, self.recall = needed_level([tuple(r) for r in tried])
        old = self._read("forest", run) if run else None
        if old is not None:
            old = old.drop("run")
            if size <= MOST_BROADCAST:
                prefix = lambda df: F.shiftright(df["key"], BITS * (LEVELS - self.level))
                open_ranges = forest.select(prefix(forest).alias("__p")).distinct()
                old = old.join(F.broadcast(open_ranges), prefix(old) == open_ranges["__p"], "left_semi")
        candidates = cut(range_search(old, forest, self.level), "candidates")
        every = self._read("classes").drop("run") if run else of
        pairs = cut(verified(candidates, every, candidates.count() <= MOST_BROADCAST), "pairs")
        before = self._read("entries", run) if run else None
        links = identifier_links(entries, before).unionByName(member_links(entries, of, pairs))
        found = components(self._rooted(links, run))
        self._write(found, "stars", run)
        return found.join(entries.select("entry_id").distinct(), "entry_id", "left_semi").select("first_id", F.col("entry_id").alias("dup_id"))

    def _rooted(self, links: DataFrame, run: int) -> DataFrame:
        """The links with entries of older runs replaced by the firsts of their works."""
        for n in range(run):
            try:
                stars = self.spark.read.schema("entry_id long, first_id long").parquet(f"{self.path}/stars/run={n}")
            except AnalysisException:  # a run that was seeded has no stars
                continue
            for c in ("first", "second"):
                named = stars.select(F.col("entry_id").alias(c), F.col("first_id").alias("__root"))
                links = links.join(named, c, "left").select(F.coalesce("__root", c).alias(c), "second" if c == "first" else "first").select("first", "second")
        return links.select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second"))

    def compact(self, path: str) -> HistoryIndex:
        """The same history as one run under another folder; its sorted permutations are merged."""
        self._read("entries").drop("run").write.parquet(f"{path}/entries/run=0")
        self._read("classes").drop("run").write.parquet(f"{path}/classes/run=0")
        self._read("forest").drop("run").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/forest/run=0")
        stars = self._read("stars")
        if stars is not None:
            merged = components(stars.select(F.col("first_id").alias("first"), F.col("entry_id").alias("second")))
            merged.write.parquet(f"{path}/stars/run=0")
        return HistoryIndex(self.spark, path)


def known_works(history: DataFrame, batches: DataFrame) -> DataFrame:
    """(first_id, dup_id) for each entry of ``batches`` whose work occurred before, in history or in earlier batches.

    The history seeds an index of its own; the batches given are compared with it, and with one another, as one.
    """
    index = HistoryIndex(batches.sparkSession, scratch_path(batches.sparkSession, "history"))
    index.seed(history)
    return index.accept(batches)
