"""Deeply nested records into flat tables that keep parent-child links (problem 6).

Records are stream-parsed into path-value-ordinal triples: for every element its path, its text, and the ordinals
of the repeated ancestors it lies under. Paths are grouped by their nearest repeated ancestor, and each group is
pivoted into one table with a row for each occurrence of that ancestor. A record never spans tasks, so parsing and
pivoting need no shuffle. Arrays of structs take the same triples from their columns and stay in the JVM.

Defined results: a null, empty or malformed record gives no rows (``errors`` lists the malformed ones); missing
optional elements give nulls, empty ones empty strings; repeated deliveries count each; text of an element is all
text inside it, inline markup removed; an empty table gives empty tables; columns of the input other than the id
and the payload are not read, so clashing names cannot matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """One output table: the path of its repeated ancestor and the leaves (relative path to column name).

    ``within`` names the group that the ancestor is nested in; ``pos`` is then the place of that outer ancestor and
    ``sub_pos`` the own place among its kind, else ``sub_pos`` is 0. A leaf "." is the ancestor's own text and
    "@name" an attribute.
    """

    name: str
    path: str
    leaves: tuple[tuple[str, str], ...] = ()
    within: str | None = None


#: The repeated groups of an article record.
ARTICLE = (
    Group("author", "PubmedArticle/MedlineCitation/Article/AuthorList/Author", (("LastName", "last_name"), ("ForeName", "fore_name"), ("Initials", "initials"), ("CollectiveName", "collective_name"), ("@ValidYN", "valid"))),
    Group("affiliation", "PubmedArticle/MedlineCitation/Article/AuthorList/Author/AffiliationInfo", (("Affiliation", "affiliation"),), "author"),
    Group("identifier", "PubmedArticle/MedlineCitation/Article/AuthorList/Author/Identifier", ((".", "identifier"), ("@Source", "source")), "author"),
    Group("abstract", "PubmedArticle/MedlineCitation/Article/Abstract/AbstractText", ((".", "text"), ("@Label", "label"), ("@NlmCategory", "category"))),
)


@dataclass
class _Open:
    group: Group
    pos: int
    sub_pos: int
    depth: int
    counts: dict = field(default_factory=dict)


class TripleParser:
    """Parses one record after another; ``triples`` yields (group, pos, sub_pos, leaf, value) in document order.

    The leaf of a group's own occurrence is "" with value None, so an occurrence without leaves is kept.
    """

    def __init__(self, groups: tuple[Group, ...]):
        self.by_path = {g.path: g for g in groups}
        self.leaf_names = {g.name: {x for x, _ in g.leaves} for g in groups}
        self.attributes = {g.name: [x[1:] for x, _ in g.leaves if x.startswith("@")] for g in groups}

    def triples(self, payload: str) -> list[tuple[str, int, int, str, str | None]]:
        out: list[tuple[str, int, int, str, str | None]] = []
        path: list[str] = []
        open_groups: list[_Open] = []
        counts: dict[str, int] = defaultdict(int)
        # Leaves being read: depth, group, relative path, text so far.
        texts: list[tuple[int, _Open, str, list[str]]] = []
        by_path, leaf_names, attributes = self.by_path, self.leaf_names, self.attributes

        def start(tag: str, attrs: dict) -> None:
            path.append(tag)
            depth = len(path)
            group = by_path.get("/".join(path))
            if group is not None:
                if group.within:
                    outer = next((o for o in reversed(open_groups) if o.group.name == group.within), None)
                    if outer is None:
                        return
                    n = outer.counts[group.name] = outer.counts.get(group.name, 0) + 1
                    opened = _Open(group, outer.pos, n, depth)
                else:
                    counts[group.name] += 1
                    opened = _Open(group, counts[group.name], 0, depth)
                open_groups.append(opened)
                out.append((group.name, opened.pos, opened.sub_pos, "", None))
                for a in attributes[group.name]:
                    if a in attrs:
                        out.append((group.name, opened.pos, opened.sub_pos, "@" + a, attrs[a]))
                if "." in leaf_names[group.name]:
                    texts.append((depth, opened, ".", []))
            elif open_groups:
                own = open_groups[-1]
                relative = "/".join(path[own.depth :])
                if relative in leaf_names[own.group.name]:
                    texts.append((depth, own, relative, []))

        def end(tag: str) -> None:
            depth = len(path)
            while texts and texts[-1][0] == depth:
                _, own, relative, parts = texts.pop()
                value = "".join(parts)
                out.append((own.group.name, own.pos, own.sub_pos, relative, value))
                if texts:
                    texts[-1][3].append(value)
            while open_groups and open_groups[-1].depth == depth:
                open_groups.pop()
            path.pop()

        def text(data: str) -> None:
            if texts:
                texts[-1][3].append(data)

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        parser.Parse(payload, True)
        return out


def pivot(triples: list[tuple[str, int, int, str, str | None]]) -> dict[str, dict[tuple[int, int], dict[str, str]]]:
    """Group name to (pos, sub_pos) to leaf values: one row for each occurrence of the group's ancestor.

    A leaf that occurs again under one ancestor is kept under its name with ``#2``, ``#3`` and so on.
    """
    tables: dict[str, dict[tuple[int, int], dict[str, str]]] = defaultdict(dict)
    for name, pos, sub_pos, leaf, value in triples:
        row = tables[name].setdefault((pos, sub_pos), {})
        if leaf:
            own, n = leaf, 1
            while own in row:
                n += 1
                own = f"{leaf}#{n}"
            row[own] = value
    return tables


def repeated_paths(records: DataFrame, id_col: str, payload_col: str, most_paths: int = 10_000) -> list[str]:
    """The paths that occur more than once under one parent in any record: the repeated ancestors by which leaves are grouped.

    Counted in one pass over all records; a distinct path a task reaches the driver, and more than ``most_paths`` of
    them (a schema is small) is an error.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for payload in b.column(1).to_pylist():
                if payload and payload.strip():
                    counts: list[dict[str, int]] = [{}]
                    path: list[str] = []

                    def start(tag: str, attrs: dict, counts: list = counts, path: list = path) -> None:
                        path.append(tag)
                        counts[-1][tag] = counts[-1].get(tag, 0) + 1
                        if counts[-1][tag] > 1:
                            found.add("/".join(path))
                        counts.append({})

                    def end(tag: str, counts: list = counts, path: list = path) -> None:
                        path.pop()
                        counts.pop()

                    parser = expat.ParserCreate()
                    parser.StartElementHandler, parser.EndElementHandler = start, end
                    try:
                        parser.Parse(payload.strip(), True)
                    except expat.ExpatError:
                        continue
        yield _batch([sorted(found)], [pa.string()], ["path"])

    got = [r[0] for r in _picked(records, id_col, payload_col).mapInArrow(scan, "path string").distinct().limit(most_paths + 1).collect()]
    if len(got) > most_paths:
        raise ValueError(f"more than {most_paths} repeated paths")
    return sorted(got)


def derived_groups(records: DataFrame, id_col: str, payload_col: str) -> tuple[Group, ...]:
    """A group for each repeated path of the records, named by its last element (by its path where two share it), nested in the nearest group above it."""
    paths = repeated_paths(records, id_col, payload_col)
    last = [p.rsplit("/", 1)[-1] for p in paths]
    names = {p: n if last.count(n) == 1 else p for p, n in zip(paths, last)}
    out = []
    for p in paths:
        above = [q for q in paths if p.startswith(q + "/")]
        out.append(Group(names[p], p, ((".", "text"),), names[max(above, key=len)] if above else None))
    return tuple(out)


def xml_triples(records: DataFrame, id_col: str, payload_col: str, groups: tuple[Group, ...] = ARTICLE) -> DataFrame:
    """The long form: parent_id, child, pos, sub_pos, path, value."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = TripleParser(groups)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in _safe(parser, payload):
                    for c, v in zip(cols, (i, *t)):
                        c.append(v)
            yield _batch(cols, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()], ["parent_id", "child", "pos", "sub_pos", "path", "value"])

    return _picked(records, id_col, payload_col).mapInArrow(scan, "parent_id long, child string, pos int, sub_pos int, path string, value string")


def xml_children(records: DataFrame, id_col: str, payload_col: str, groups: tuple[Group, ...] = ARTICLE) -> DataFrame:
    """One row for each occurrence of any group: child, parent_id, pos, sub_pos, and its leaves as a map ``leaves``."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = TripleParser(groups)
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, rows in pivot(_safe(parser, payload)).items():
                    for (pos, sub_pos), leaves in rows.items():
                        for c, v in zip(cols, (name, i, pos, sub_pos, list(leaves.items()))):
                            c.append(v)
            yield _batch(cols, [pa.string(), pa.int64(), pa.int32(), pa.int32(), kind], ["child", "parent_id", "pos", "sub_pos", "leaves"])

    return _picked(records, id_col, payload_col).mapInArrow(scan, "child string, parent_id long, pos int, sub_pos int, leaves map<string,string>")


def xml_tables(records: DataFrame, id_col: str, payload_col: str, groups: tuple[Group, ...] = ARTICLE) -> dict[str, DataFrame]:
    """A flat table for each group, its leaves as columns."""
    rows = xml_children(records, id_col, payload_col, groups)
    return {
        g.name: rows.where(F.col("child") == g.name).select("parent_id", "pos", "sub_pos", *[F.element_at("leaves", leaf).alias(column) for leaf, column in g.leaves])
        for g in groups
    }


def errors(records: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Ids of records that are not well-formed, with the parser's message."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], []]
            for i, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if payload and payload.strip():
                    try:
                        expat.ParserCreate().Parse(payload.strip(), True)
                    except expat.ExpatError as e:
                        cols[0].append(i)
                        cols[1].append(str(e))
            yield _batch(cols, [pa.int64(), pa.string()], ["parent_id", "error"])

    return _picked(records, id_col, payload_col).mapInArrow(scan, "parent_id long, error string")


def array_children(records: DataFrame, id_col: str, array_col: str, child: str) -> DataFrame:
    """One row for each element of an array of structs, its fields as columns; null and empty arrays give none."""
    fields = records.schema[array_col].dataType.elementType.fieldNames()
    out = records.select(F.col(f"`{id_col}`").cast("long").alias("parent_id"), F.posexplode(F.col(f"`{array_col}`")).alias("__pos", "__item"))
    return out.select(F.lit(child).alias("child"), "parent_id", (F.col("__pos") + 1).alias("pos"), F.lit(0).alias("sub_pos"), *[F.col("__item").getField(n).alias(f"item_{n}") for n in fields])


def _safe(parser: TripleParser, payload: str | None) -> list:
    if not payload or not payload.strip():
        return []
    try:
        return parser.triples(payload.strip())
    except expat.ExpatError:
        return []


def _picked(records: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    return records.select(F.col(f"`{id_col}`").cast("long").alias("parent_id"), F.col(f"`{payload_col}`").alias("payload"))


def _batch(cols: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
