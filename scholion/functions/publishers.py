"""Addresses of publishers: sites, slugs, PDF and image variants, preprints. All expressions, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.records import doi_from_address
from scholion.functions.text import let, squash, text

#: The site of each registrant.
SLUGS = {
    "10.1126": "science_org", "10.1038": "nature_com", "10.1002": "wiley_com", "10.1093": "oup_com", "10.1016": "sciencedirect_com", "10.1371": "plos_org", "10.1073": "pnas_org",
    "10.7554": "elifesciences_org", "10.1101": "biorxiv_org", "10.3389": "frontiersin_org", "10.1136": "bmj_com", "10.1056": "nejm_org", "10.1007": "springer_com", "10.1017": "cambridge_org",
    "10.1098": "royalsociety_org", "10.1534": "genetics_org", "10.7717": "peerj_com", "10.3354": "int_res_com", "10.1111": "wiley_com", "10.1242": "biologists_com", "10.1083": "rupress_org",
    "10.1084": "rupress_org", "10.1085": "rupress_org",
}
#: Registrants of preprints.
PREPRINTS = ("10.1101/", "10.64898/")
#: Sites by registrant or by a part of an address, the first that holds.
SITES = (
    ("oup", ("10.1093/",), ("oup.com",)),
    ("elsevier", ("10.1016/",), ("sciencedirect.com", "elsevier")),
    ("nature", ("10.1038/",), ("nature.com",)),
    ("pnas", ("10.1073/",), ("pnas.org",)),
    ("springer", ("10.1186/",), ("springer.com",)),
    ("wiley", (), ("wiley.com",)),
    ("pmc", (), ("pmc.ncbi.nlm.nih.gov",)),
)


def _any(x: Column, test, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(x, v)
    return out


def doi_anywhere(x: Column | str) -> Column:
    """The first DOI in an address or text, up to a query, quotation mark or bracket."""
    return F.rtrim(F.regexp_extract(text(x), r"(?i)(10\.\d{4,9}/[^\s?#\"'<>]+)", 1), F.lit(".,;)"))


def netloc(x: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(x), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def slug(x: Column | str) -> Column:
    """A stable name of an address's site; of a resolver's address that of the registrant."""
    site = F.ltrim(netloc(x), F.lit("w."))
    prefix = F.regexp_extract(text(x), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#.]*(?:\.[^/?#.]*)?)", 1)
    table = F.create_map(*[F.lit(v) for pair in SLUGS.items() for v in pair])
    own = F.substring(F.regexp_replace(F.substring_index(site, ":", 1), "[^a-z0-9]", "_"), 1, 40)
    return F.when(site.contains("doi.org"), F.coalesce(table[prefix], F.lit("doi_org"))).when(own == "", "generic").otherwise(own)


def site(doi: Column | str, address: Column | str) -> Column:
    """The publisher of a record by its DOI or its address; empty where it is unknown."""
    d = doi_from_address(squash(doi))
    hay = F.lower(F.concat_ws(" ", d, squash(address)))
    out = F.lit("")
    for name, prefixes, parts in reversed(SITES):
        out = F.when(_any(d, lambda c, v: c.startswith(v), prefixes) | _any(hay, lambda c, v: c.contains(v), parts), name).otherwise(out)
    return out


def direct_pdf(x: Column | str) -> Column:
    """The address of the PDF itself where a publisher's rule gives it; else empty."""
    d, low = doi_anywhere(x), F.lower(text(x))
    quoted = F.replace(F.url_encode(d), F.lit("%2F"), F.lit("/"))
    wiley = low.contains("onlinelibrary.wiley.com") & (d.startswith("10.1111/") | d.startswith("10.1002/"))
    return (
        F.when(wiley, F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdfdirect/"), quoted, F.lit("?download=true")))
        .when(d.startswith("10.1186/"), F.concat(F.lit("https://link.springer.com/content/pdf/"), quoted, F.lit("_reference.pdf")))
        .when(d.startswith("10.1007/"), F.concat(F.lit("https://link.springer.com/content/pdf/"), quoted, F.lit(".pdf")))
        .otherwise("")
    )


def pdf_variants(x: Column | str) -> Column:
    """The forms under which a PDF may be had, the likeliest first, each once; HTML wrappers are left out."""
    url = squash(x)
    to = lambda a, b: F.replace(url, F.lit(a), F.lit(b))
    load = lambda c: F.concat(c, F.when(url.contains("?"), "&download=true").otherwise("?download=true"))
    epdf, direct, pdf = "/doi/epdf/", "/doi/pdfdirect/", "/doi/pdf/"
    forms = (
        F.when(url.contains(epdf), F.array(load(to(epdf, direct)), to(epdf, pdf), url, to(epdf, direct)))
        .when(url.contains(direct), F.array(F.when(url.contains("download=true"), url).otherwise(load(url)), url, to(direct, pdf)))
        .when(url.contains(pdf), F.array(load(to(pdf, direct)), url, to(pdf, epdf)))
        .otherwise(F.array(url))
    )
    rank = lambda u: F.when(u.rlike(r'(?i)\.full\.pdf("|$)'), 0).when(u.contains(direct), 1).when(u.contains(pdf), 2).when(u.rlike(r'(?i)\.pdf("|$)'), 3).when(u.contains(epdf), 4).otherwise(5)
    kept = F.filter(F.array_distinct(forms), lambda u: (u != "") & ~F.lower(u).contains(".pdf+html"))
    ranked = F.array_sort(F.transform(kept, lambda u, i: F.struct(rank(u).alias("r"), i.alias("i"), u.alias("u"))))
    return F.transform(ranked, lambda s: s["u"])


def image_variants(x: Column | str) -> Column:
    """Larger forms of a figure's address before the address itself, each once."""
    src = F.trim(text(x))
    host, bare = netloc(src), F.regexp_extract(src, r"^([^?#]*)", 1)
    stem = F.regexp_extract(bare, r"(?i)^(.+-fig-\d{4})-[a-z]\.(?:jpe?g|png|gif|webp)$", 1)
    large = F.when(host.contains("onlinelibrary.wiley.com") & F.lower(bare).contains("/cms/asset/") & (stem != ""), F.array(*[F.concat(stem, F.lit(e)) for e in (".jpg", ".png", ".gif", ".webp")]))
    full = F.regexp_replace(bare, r"(?i)/m_([^/]+\.(?:jpe?g|png|webp|gif))$", "/$1")
    signed = F.when(host.contains("silverchair-cdn.com") & (full != bare), F.array(F.concat(full, F.substring(src, F.length(bare) + 1, F.lit(2**20)))))
    none = F.array().cast("array<string>")
    return F.when(src == "", none).otherwise(F.array_distinct(F.concat(F.coalesce(large, none), F.coalesce(signed, none), F.array(src))))


def preprint_doi(x: Column | str) -> Column:
    """The DOI of a preprint without its version, from a DOI or the address of its page."""
    own = doi_from_address(squash(x))
    page = F.btrim(F.regexp_extract(squash(x), r"(?i)/content/(10\.\d{4,}/[^/\"#]+)", 1), F.lit("/"))
    return F.regexp_replace(F.when(_any(own, lambda c, v: c.startswith(v), PREPRINTS), own).otherwise(page), r"(?i)v\d+$", "")


def preprint_revision(x: Column | str) -> Column:
    """The version (v and its number) of a preprint's address or DOI; else empty."""
    page = F.regexp_extract(squash(x), r"(?i)/content/10\.1101/[^/\"#]+?(v\d+)(?:[/\"#]|$)", 1)
    return F.when(page != "", page).otherwise(F.regexp_extract(doi_from_address(squash(x)), r"(?i)(v\d+)$", 1))


def is_preprint(doi: Column | str, address: Column | str) -> Column:
    d = doi_from_address(squash(doi))
    hay = F.lower(F.concat_ws(" ", d, squash(address)))
    return d.startswith("10.1101/") | hay.contains("biorxiv.org") | hay.contains("medrxiv.org")


def preprint_server(x: Column | str) -> Column:
    return F.when(F.lower(squash(x)).contains("medrxiv.org"), "medrxiv").otherwise("biorxiv")


def publisher_key(pmc: Column | str, doi: Column | str, address: Column | str) -> Column:
    """What papers are grouped by for fetching: the open archive, else the registrant, else the host."""
    d = F.trim(text(doi))
    host = let(F.trim(text(address)), lambda a: F.regexp_extract(a, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.when(text(pmc) != "", "pmc.ncbi.nlm.nih.gov").when(d != "", F.element_at(F.split(d, "/"), 1)).when(host != "", host).otherwise("unknown")
