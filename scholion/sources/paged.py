"""Sources that come in pages: a Python data source with one partition a page, and parsers of what the pages hold.

A page source reads any client with ``total(query)`` and ``page(query, start, size)``; without a network the client
reads saved pages from a folder. Pages are fetched in the tasks, so a lost executor's pages are fetched again.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retried(call: Callable[[], object], tries: int = 3, wait: float = 0.0, stop: tuple[type[BaseException], ...] = (FileNotFoundError,)) -> object:
    """The result of ``call``; repeated with growing waits, at once given up on errors in ``stop``."""
    for k in range(tries):
        try:
            return call()
        except stop:
            raise
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError("unreachable")


def fetched(call: Callable[[], object], tries: int = 3, wait: float = 0.0) -> tuple[object, str]:
    """What ``call`` gives and how it went: ok, missing, json (not readable as such), timeout or error; failures give None and are never raised."""
    try:
        return retried(call, tries, wait, (FileNotFoundError, json.JSONDecodeError)), "ok"
    except FileNotFoundError:
        return None, "missing"
    except json.JSONDecodeError:
        return None, "json"
    except TimeoutError:
        return None, "timeout"
    except Exception:
        return None, "error"


def budget(a_day: int, days: int, cap: int) -> int:
    """Rows a source may give: so many a day, at most the cap if there is one."""
    most = max(0, a_day) * max(1, days)
    return min(most, cap) if cap > 0 else most


def fetch_batches(ids: DataFrame, fetch: Callable[[list[str]], list[tuple[str, str]]], size: int = 100, id_col: str = "id") -> DataFrame:
    """``id, item, kind``: records fetched in batches of ``size`` ids inside the tasks.

    A batch that fails is split in two, again and again, so that one bad record costs no other; an id that fails alone
    has a null item and its kind of error, one that the source does not know is ``missing``. Null ids are left out.
    """

    def load(batch: list[str]) -> list[tuple[str, str | None, str]]:
        got, kind = fetched(lambda: dict(fetch(batch)), tries=1)
        if kind == "ok":
            return [(i, got.get(i), "ok" if i in got else "missing") for i in batch]
        if len(batch) == 1:
            return [(batch[0], None, kind)]
        half = len(batch) // 2
        return load(batch[:half]) + load(batch[half:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_pylist()
            for at in range(0, len(every), size):
                rows = load(every[at : at + size])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["id", "item", "kind"])

    return ids.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct().mapInArrow(scan, "id string, item string, kind string")


def read_windows(spark: SparkSession, windows: list, fetch: Callable[[str, str], list[tuple[str, str]]]) -> DataFrame:
    """``id, item, start, kind``: windows of days fetched one to a task; one that fails is fetched day by day, and days that fail leave a row with their kind of error. Of equal ids the first day's counts."""
    from scholion.operators.dates import Window

    parts = [(str(w.start), str(w.end)) for w in windows]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for start, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got, kind = fetched(lambda: fetch(start, end), tries=1)  # noqa: B023
                if kind == "ok":
                    out += [(i, item, start, "ok") for i, item in got]
                    continue
                day = date.fromisoformat(start)
                while day <= date.fromisoformat(end):
                    got, kind = fetched(lambda: fetch(str(day), str(day)), tries=2)  # noqa: B023
                    out += [(i, item, str(day), "ok") for i, item in got] if kind == "ok" else [(None, None, str(day), kind)]
                    day += timedelta(days=1)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["id", "item", "start", "kind"])

    assert all(isinstance(w, Window) for w in windows)
    t = spark.createDataFrame(parts or [("", "")], "start string, end string").where("start <> ''").repartition(max(1, len(parts)))
    rows = t.mapInArrow(scan, "id string, item string, start string, kind string")
    # Of equal ids one row stays; failures have no id and all stay.
    return rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct("item", "start", "kind"), F.struct("start", "item")).alias("r")).select("id", "r.*").unionByName(rows.where("id is null"))


class FolderClient:
    """Pages saved as ``<start>.json``, each an object with ``total`` and ``items``."""

    def __init__(self, folder: str):
        self.folder = folder

    def _read(self, start: int) -> dict:
        with open(os.path.join(self.folder, f"{start}.json"), encoding="utf-8") as f:
            return json.load(f)

    def total(self) -> int:
        return int(self._read(0).get("total", 0))

    def page(self, start: int) -> list[dict]:
        return self._read(start).get("items", [])


class _Page(InputPartition):
    def __init__(self, start: int, take: int):
        self.start, self.take = start, take


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size = int(options.get("pageSize", 100))
        self.most = int(options.get("limit", 9_999))

    def partitions(self) -> list[_Page]:
        total = min(int(retried(FolderClient(self.folder).total)), self.most)
        return [_Page(s, min(self.size, total - s)) for s in range(0, total, self.size)]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        if partition is None:  # no page at all
            return
        items = retried(lambda: FolderClient(self.folder).page(partition.start))
        for i, item in enumerate(items[: partition.take]):
            yield (partition.start + i, json.dumps(item, ensure_ascii=False))


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("pageSize", 100).option("limit", n).load(folder)``: position and item as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "position long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, folder: str, page_size: int = 100, limit: int = 9_999) -> DataFrame:
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").option("pageSize", page_size).option("limit", limit).load(folder)


PREPRINT = "title string, doi string, server string, version string, date string, category string, authors string, abstract string"


def preprint_rows(pages: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """Preprint items as papers: id ``server:doi`` with version, rows without title or DOI dropped, of equal ids the first."""
    from scholion.functions.text import display_text, split_authors

    t = pages.select("position", F.from_json("item", PREPRINT).alias("p")).select("position", "p.*")
    t = t.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("doi", F.lit(""))) != ""))
    if categories:
        t = t.where(F.lower(F.trim("category")).isin(*[c.lower() for c in categories]))
    server = F.lower(F.coalesce("server", F.lit("biorxiv")))
    rows = t.select(
        "position",
        F.concat(server, F.lit(":"), F.trim("doi"), F.lit("v"), F.coalesce("version", F.lit("1"))).alias("id"),
        F.trim("doi").alias("doi"), display_text("title").alias("title"), display_text("abstract").alias("abstract"),
        F.array_join(split_authors("authors"), ", ").alias("authors"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("category", F.lit("")).alias("category"), server.alias("source"),
    )
    return rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), "position").alias("r")).select("r.*")


def inverted_abstract(x) -> F.Column:
    """An abstract from its inverted index (JSON: word to positions): words in the order of their positions."""
    entries = F.map_entries(F.from_json(x, "map<string,array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "), F.lit(""))


def query_terms(keywords: list[str], field: str = "Title/Abstract") -> list[str]:
    """Keywords as search terms: phrases quoted, each with its field; quotes inside are dropped."""
    out = []
    for k in keywords:
        k = " ".join(k.replace('"', " ").split())
        if k:
            out.append(f'"{k}"[{field}]' if " " in k or "-" in k else f"{k}[{field}]")
    return list(dict.fromkeys(out))


def query_chunks(terms: list[str], most: int = 1400) -> list[str]:
    """OR-queries of at most ``most`` characters, filled in order; a longer term stands alone."""
    out: list[str] = []
    for t in terms:
        joined = f"{out[-1]} OR {t}" if out else t
        if out and len(joined) <= most:
            out[-1] = joined
        else:
            out.append(t)
    return out
