"""Records in the formats of their sources: article XML of the open archive, feeds, metadata JSON, image and PDF bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.records import image_kind, is_pdf, png_size
from scholion.functions.text import _c, squash, text

#: Elements of an archive article whose paragraphs are not its running text.
NOT_BODY = ("fig", "table-wrap", "ref-list", "ack")
#: Least bytes and pixels of an acceptable figure; least bytes of a PDF.
LEAST_IMAGE, LEAST_PIXELS, LEAST_PDF = 5_000, 700, 5_000
_NO_XML = "<none/>"


def _xml(x: Column | str) -> Column:
    t = F.trim(text(x))
    return F.when(t == "", F.lit(_NO_XML)).otherwise(F.regexp_replace(t, r"^<\?xml[^>]*\?>\s*", ""))


def _strings(x: Column | str, path: str) -> Column:
    return F.filter(F.transform(F.xpath(_xml(x), F.lit(path)), squash), lambda s: s != "")


def jats_title(x: Column | str) -> Column:
    return squash(F.xpath_string(_xml(x), F.lit("/article/front/article-meta/title-group/article-title")))


def jats_abstract(x: Column | str) -> Column:
    return F.array_join(_strings(x, "/article/front/article-meta/abstract//text()"), " ")


def jats_body(x: Column | str) -> Column:
    """Headings and paragraphs of the body in order, a line each; figures, tables, references and thanks are left out."""
    outside = " and ".join(f"not(ancestor::{n})" for n in NOT_BODY)
    return F.array_join(_strings(x, f"/article/body//*[(self::p or self::title) and {outside}]/text()"), "\n")


def jats_captions(x: Column | str) -> Column:
    return _strings(x, "/article/body//fig/caption//text()")


def feed_entry(x: Column | str) -> Column:
    """id, title, summary, published day and authors of an entry of a feed."""
    one = lambda name: squash(F.xpath_string(_xml(x), F.lit(f"/entry/{name}")))
    return F.struct(
        F.regexp_extract(one("id"), r"(\d{4}\.\d{4,5})", 1).alias("id"), one("title").alias("title"), one("summary").alias("summary"),
        F.substring(one("published"), 1, 10).alias("day"), _strings(x, "/entry/author/name/text()").alias("authors"),
    )


def metadata_day(x: Column | str) -> Column:
    """The first of a work's four date fields that is there, as year, month and day joined; empty where none is."""
    kind = ", ".join(f"`{n}` struct<`date-parts`: array<array<int>>>" for n in ("published-print", "published-online", "published", "issued"))
    got = F.from_json(text(x), f"message struct<{kind}>")["message"]
    parts = [F.get(got[n]["date-parts"], F.lit(0)) for n in ("published-print", "published-online", "published", "issued")]
    first = F.coalesce(*[F.when(F.size(F.filter(p, lambda v: v.isNotNull())) > 0, p) for p in parts])
    return F.coalesce(F.array_join(F.transform(first, lambda v: F.lpad(v.cast("string"), F.greatest(F.lit(2), F.length(v.cast("string"))), F.lit("0"))), "-"), F.lit(""))


def embedded_object(x: Column | str) -> Column:
    """The JSON object in a text, from its first brace to its last, as a variant; null where there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text(x), r"(?s)(\{.*\})", 1), F.lit("")))


def chosen_version(versions: Column, wanted: Column) -> Column:
    """The version asked for of an array of structs with a field ``version``, else the last."""
    hit = F.filter(versions, lambda v: v["version"] == wanted)
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(versions, F.lit(-1)))


def is_figure(data: Column | str, content_type: Column | str) -> Column:
    """A raster image of more than 5,000 bytes that says it is one and, where its header tells its size, has a side of 700 pixels."""
    kind = image_kind(data)
    width, height = png_size(data)
    small = F.greatest(width, height) < LEAST_PIXELS
    return F.coalesce(F.lower(text(content_type)).startswith("image/") & (F.octet_length(_c(data)) > LEAST_IMAGE) & (kind != "") & ~F.coalesce(small & (width > 0) & (height > 0), F.lit(False)), F.lit(False))


def is_usable_pdf(data: Column | str) -> Column:
    """A PDF by its first bytes and size that is no page of a challenge."""
    head = F.lower(F.decode(F.substring(_c(data), 1, 2000), "ISO-8859-1"))
    wall = head.contains("just a moment") | head.contains("<html")
    return F.coalesce(is_pdf(data) & (F.octet_length(_c(data)) >= LEAST_PDF) & ~wall, F.lit(False))


def front_value(x: Column | str) -> Column:
    """The items of a front-matter value: a list in brackets parted at commas outside quotes, else the one value; comments and quotes are taken off."""
    t = F.trim(F.regexp_replace(F.trim(text(x)), r"""^((?:[^"'#]|"[^"]*"|'[^']*'|(?<!\s)#)*?)(?:\s#.*|$)""", "$1"))
    inner = F.regexp_extract(t, r"(?s)^\[(.*)\]$", 1)
    items = F.regexp_extract_all(inner, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)"""), F.lit(1))
    bare = lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2")
    return F.filter(F.transform(F.when(t.rlike(r"^\[.*\]$"), items).otherwise(F.array(t)), bare), lambda v: v != "")
