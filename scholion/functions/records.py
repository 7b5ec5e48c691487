"""Identifiers, addresses, files and figure items of records, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import _c, contains_any, let, squash, text

#: Registrants whose articles come from one publisher's interface.
API_PREFIXES = ("10.1016/", "10.1006/", "10.1053/", "10.1054/", "10.1067/", "10.1078/", "10.1383/")
#: Words of images that are no figures.
NO_FIGURE_WORDS = ("logo", "spinner", "icon", "avatar", "advert")


def starts_any(x: Column | str, prefixes: Sequence[str]) -> Column:
    low = F.lower(F.trim(text(x)))
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def doi_from_address(x: Column | str) -> Column:
    """The DOI that a value is, or that an address holds behind doi.org/ or /doi/; else empty."""
    v = F.trim(text(x))
    resolver = F.regexp_extract(v, r"^https?://(?:dx\.)?doi\.org/(.+?)/*$", 1)
    path = F.rtrim(F.regexp_extract(v, r"(?i)/doi/(?:abs/|full/|pdf/)?(10\.\d{4,9}/[^\s?#\"'\]]+)", 1), F.lit("/.,;)"))
    return F.when(resolver != "", resolver).when(v.rlike(r"^10\.\d{4,9}/\S+"), v).otherwise(path)


#: Hosts whose addresses are read as pages even where they hold a DOI.
PAGE_HOSTS = ("oup.com", "pnas.org", "sciencedirect.com", "nature.com", "wiley.com", "springer.com")


def source_kind(x: Column | str) -> Column:
    """How a reference is read: as an article of the index or the open archive, a PDF, a DOI, a file, or a page."""
    v = F.trim(text(x))
    low = F.lower(v)
    address = low.rlike("^https?://")
    return (
        F.when(address & v.contains("pubmed.ncbi.nlm.nih.gov"), "pubmed_url")
        .when(address & v.contains("pmc.ncbi.nlm.nih.gov"), "pmc_url")
        .when(address & low.endswith(".pdf"), "pdf_url")
        .when(address & contains_any(low, PAGE_HOSTS), "web_url")
        .when(doi_from_address(v) != "", "doi")
        .when(~address & low.rlike(r"[^/]\.pdf$"), "local_pdf")
        .otherwise("web_url")
    )


def page_url(doi: str = "doi", source: str = "source", pmc: str = "pmc_id", ident: str = "id") -> Column:
    """Where the page of a paper is: none for the API's publishers, the preprint server, the open archive, the index."""
    server = F.regexp_extract(F.trim(text(doi)), r"10\.1101/(\S+)", 1)
    preprint = F.lower(text(source)).rlike("biorxiv|medrxiv|preprint") & (server != "")
    number = F.regexp_replace(F.trim(text(pmc)), "(?i)^PMC", "")
    digits = F.trim(text(ident))
    return (
        F.when(starts_any(doi, API_PREFIXES), F.lit(""))
        .when(preprint, F.concat(F.lit("https://www.biorxiv.org/content/10.1101/"), server))
        .when(number != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), number, F.lit("/")))
        .when(digits.rlike("^[0-9]+$"), F.concat(F.lit("https://europepmc.org/article/MED/"), digits))
        .otherwise(F.lit(""))
    )


#: Points of a figure item and the pattern that earns them, in its addresses (a), its words (w) or both;
#: of the first group the first that holds counts, of the rest all.
FIRST_FIGURE = (
    (220, "a", r"(^|[-_/])(fig(ure)?[-_]?0?1|f0?1|gr1)(\.|[-_/]|$)"),
    (180, "a", r"[a-z0-9]+f0?1\.(jpe?g|png|webp|gif)"),
    (120, "w", r"^\s*(fig(ure)?\.?\s*1\b|1[.)])"),
    (35, "w", r"\bfig(ure)?\.?\s*1\b"),
)
FIGURE_POINTS = (
    (-120, "a", r"(^|[-_/])(fig(ure)?[-_]?[2-9]|f[2-9]|gr[2-9])(\.|[-_/]|$)|[a-z0-9]+f[2-9]\.(jpe?g|png|webp|gif)"),
    (-90, "b", r"graphical abstract|ga1\.|[-_/]fa\.|unfig"),
    (100, "a", r"/view-large/figure/"),
    (-200, "b", "|".join(NO_FIGURE_WORDS)),
)
#: Kinds of sources that are figures of the page, and their points.
FIGURE_SOURCES, SOURCE_POINTS = ("figure", "dom_figure", "dom_view_large"), 20


def figure_points(item: Column) -> Column:
    """How likely a figure item is the first figure of its article: the sum over the table of rules."""
    joined = lambda *names: F.lower(F.concat_ws(" ", *[F.coalesce(item[n], F.lit("")) for n in names]))

    def total(s: Column) -> Column:
        first = F.coalesce(*[F.when(s[part].rlike(pattern), points) for points, part, pattern in FIRST_FIGURE], F.lit(0))
        others = [F.when(s[part].rlike(pattern), points).otherwise(0) for points, part, pattern in FIGURE_POINTS]
        return sum(others, first)

    found = let(F.struct(joined("src", "href").alias("a"), joined("caption", "alt").alias("w"), joined("src", "href", "caption", "alt").alias("b")), total)
    return found + F.when(item["source"].isin(*FIGURE_SOURCES), SOURCE_POINTS).otherwise(0)


def takeaways(items: Column, most: int = 3) -> Column:
    """The first distinct captions (or alternative texts) of figure items."""
    said = F.transform(F.coalesce(items, F.lit(None)), lambda i: squash(F.coalesce(F.when(F.coalesce(i["caption"], F.lit("")) != "", i["caption"]), i["alt"], F.lit(""))))
    return F.coalesce(F.slice(F.array_distinct(F.filter(said, lambda s: s != "")), 1, most), F.array().cast("array<string>"))


def image_kind(data: Column | str) -> Column:
    """The type of an image by its first bytes; empty where it is none."""
    head = F.hex(F.substring(_c(data), 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383961") | head.startswith("474946383761"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .otherwise("")
    )


def png_size(data: Column | str) -> tuple[Column, Column]:
    """Width and height of a PNG; null for other bytes."""
    number = lambda at: F.when(image_kind(data) == "png", F.conv(F.hex(F.substring(_c(data), at, 4)), 16, 10).cast("int"))
    return number(17), number(21)


def is_pdf(data: Column | str) -> Column:
    return F.coalesce(F.hex(F.substring(_c(data), 1, 5)) == "255044462D", F.lit(False))


def byte_text(size: Column | str) -> Column:
    """Bytes in the largest unit of which there is at least one."""
    n = _c(size).cast("double")
    out = F.concat(F.format_string("%.2f", F.bround(n / 1024.0**4, 2)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", F.bround(n / 1024.0**power, 2)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(_c(size).cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def scalar_kind(x: Column | str) -> Column:
    """What a front-matter value is: empty, text, bool, int or float."""
    v = F.trim(text(x))
    return (
        F.when(v == "", "empty")
        .when(v.rlike("""^(".*"|'.*')$"""), "text")
        .when(F.lower(v).isin("true", "false"), "bool")
        .when(v.rlike(r"^-?\d+$"), "int")
        .when(v.rlike(r"^-?\d+\.\d+$"), "float")
        .otherwise("text")
    )


def same_doi(candidate: Column | str, target: Column | str, registrant: str = "10.1093/") -> Column:
    """Equal DOIs; for one registrant a numeric article number behind the target's is let pass."""
    a, b = (F.lower(F.trim(text(x))) for x in (candidate, target))
    tail = F.regexp_replace(F.substring(a, F.length(b) + 1, F.lit(2**20)), "^/", "")
    return (a != "") & (b != "") & ((a == b) | (b.startswith(registrant) & a.startswith(F.concat(b, F.lit("/"))) & tail.rlike(r"^\d+$")))
