"""Text expressions: every function takes and returns columns and stays in the JVM.

Null input counts as empty text unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that end in "ies" in the singular too.
IES_SINGULAR = ("species", "series", "rabies", "scabies", "facies")
#: Endings after which "es" is a plural.
SIBILANTS = ("s", "x", "z", "ch", "sh")
#: Endings in s that are no plural.
NOT_PLURAL = ("ss", "us", "is")
#: Month names of bibliographic dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_INVISIBLE = r"[​-‍⁠﻿�]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def _ends(x: Column, endings: Sequence[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | x.endswith(e)
    return out


def squash(x: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"(?U)\s+", " "))


def strip_chars(x: Column, chars: str) -> Column:
    """``chars`` off both ends."""
    return F.btrim(x, F.lit(chars))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_S_BEFORE = "[a-hj-rtv-z0-9]"  # a last letter that makes neither ss nor us nor is


def token_text(x: Column | str) -> Column:
    """The tokens of a text with a space around each, so that a phrase is found by ``contains``.

    Tokens are runs of ASCII letters and digits, in lower case and without plural endings: ies becomes y, es goes
    after a sibilant, s goes unless ss, us or is; tokens of up to three letters stay. All in generated code.
    """
    t = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(text(x), "[^A-Za-z0-9]+", " "))), F.lit(" "))
    t = F.regexp_replace(t, f"(?<= )(?!(?:{'|'.join(IES_SINGULAR)}) )([a-z0-9]{{2,}})ies(?= )", "$1y")
    # What lost its es is marked, so that its own s is not taken for an ending.
    t = F.regexp_replace(t, f"(?<= )(?=[a-z0-9]{{3,}}es )([a-z0-9]*(?:{'|'.join(SIBILANTS)}))es(?= )", "$1_")
    t = F.regexp_replace(t, f"(?<= )([a-z0-9]{{2,}}{_S_BEFORE})s(?= )", "$1")
    return F.translate(t, "_", "")


def norm_tokens(x: Column | str) -> Column:
    """The tokens of ``token_text`` as an array."""
    return F.filter(F.split(token_text(x), " "), lambda t: t != "")


def padded(tokens: Column) -> Column:
    """Tokens as one text with a space around each."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def joined(first: Column, *rest: Column) -> Column:
    """Token texts one after the other."""
    return F.concat(first, *[F.substring(r, F.lit(2), F.length(r)) for r in rest])


def norm_tokens_py(value: str | None) -> list[str]:
    """The tokens of a configured phrase, on the driver, by the rules of ``norm_tokens``."""
    import re

    out = []
    for t in re.split(r"[^A-Za-z0-9]+", value or ""):
        t = t.lower()
        if not t:
            continue
        if len(t) > 3:
            if t.endswith("ies") and len(t) >= 5 and t not in IES_SINGULAR:
                t = t[:-3] + "y"
            elif t.endswith("es") and len(t) >= 5 and t[:-2].endswith(SIBILANTS):
                t = t[:-2]
            elif t.endswith("s") and not t.endswith(NOT_PLURAL):
                t = t[:-1]
        out.append(t)
    return out


def unique_ci(items: Column) -> Column:
    """Squashed items without blanks, each once however its case, in order, in the spelling of its first place."""
    return F.aggregate(
        F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), squash), lambda s: s != ""),
        F.array().cast("array<string>"),
        lambda got, s: F.when(F.exists(got, lambda g: F.lower(g) == F.lower(s)), got).otherwise(F.concat(got, F.array(s))),
    )


def unique_cs(items: Column) -> Column:
    """As ``unique_ci``, but case counts."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), squash), lambda s: s != ""))


def drop_contained(phrases: Column) -> Column:
    """Phrases whose tokens do not run inside a longer kept phrase, each once, in order."""

    def reduce(keyed: Column) -> Column:
        return F.transform(F.filter(keyed, lambda a: ~F.exists(keyed, lambda b: (F.length(b["k"]) > F.length(a["k"])) & (b["n"] > a["n"]) & b["k"].contains(a["k"]))), lambda a: a["p"])

    keyed = F.transform(unique_ci(phrases), lambda p: let(token_text(p), lambda k: F.struct(p.alias("p"), k.alias("k"), (F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit("")))).alias("n"))))
    return let(F.filter(keyed, lambda a: F.trim(a["k"]) != ""), reduce)


def split_override(x: Column | str) -> Column:
    """Keywords as typed: parted at commas, semicolons and line ends if there are any, else at white space."""
    t = F.trim(text(x))
    parts = F.when(t.rlike("[,，;；\n]"), F.split(t, "[,，;；\n]+")).otherwise(F.split(t, r"\s+"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def clean_title(x: Column | str) -> Column:
    return strip_chars(F.regexp_replace(squash(x), _INVISIBLE, ""), " .;:,")


def display_text(x: Column | str) -> Column:
    """Squashed text without invisible characters and loose punctuation at its ends."""
    return strip_chars(squash(F.regexp_replace(squash(x), r"[\u0000-\u0008\u000B\u000C\u000E-\u001F​-‍⁠﻿�]", "")), " .;:,")


def safe_filename(x: Column | str, most: int = 110) -> Column:
    name = strip_chars(F.substring(squash(F.regexp_replace(text(x), r"[\\/:*?\"<>|]", " ")), 1, most), " .")
    return F.when(name == "", F.lit("untitled")).otherwise(name)


def bibliographic_date(year: Column, month: Column, day: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-D``: month names to two figures, the day as given."""
    y, m, d = (F.trim(text(c)) for c in (year, month, day))
    names = F.create_map(*[F.lit(v) for i, name in enumerate(MONTHS, 1) for v in (name, f"{i:02d}")])
    m = F.when(m == "", F.lit(None)).otherwise(F.coalesce(names[F.lower(m)], F.when(F.length(m) < 2, F.lpad(m, 2, "0")).otherwise(m)))
    return F.when(y == "", F.lit("")).otherwise(F.concat_ws("-", y, m, F.when(d != "", d)))


def journal_aliases(x: Column | str) -> Column:
    """The name, the name before " : " or "=", and the name before ";", each once."""
    raw = display_text(x)
    primary = F.trim(F.element_at(F.split(raw, r"\s+:\s+|\s*=\s*", 2), 1))
    before = F.trim(F.element_at(F.split(raw, ";", 2), 1))
    return F.array_distinct(F.filter(F.array(raw, primary, before), lambda a: a != ""))


def journal_key(x: Column | str) -> Column:
    """Upper case, no parentheses, AND for the ampersand, spaces for all other signs."""
    t = F.regexp_replace(F.upper(F.trim(text(x))), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "&", "AND"), "[^A-Z0-9]+", " "))


def split_authors(x: Column | str) -> Column:
    """A list at semicolons, else at " and ", else one name."""
    t = squash(x)
    parts = F.when(t.contains(";"), F.split(t, ";")).when(t.contains(" and "), F.split(t, " and ")).otherwise(F.array(t))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def author_candidates(items: Column) -> Column:
    """Items that can be names: a letter, at most 80 characters, no address, link or register number."""
    return F.filter(unique_ci(items), lambda s: ~F.lower(s).rlike(r"@|orcid|https?:|www\.") & (F.length(s) <= 80) & s.rlike(r"\p{L}"))


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(squash(x), r"(?<=[.!?。！？])\s+"), lambda s: s != "")


def first_sentence(x: Column | str) -> Column:
    return F.coalesce(F.try_element_at(sentences(x), F.lit(1)), F.lit(""))


def excerpt(x: Column | str, n: int = 2, most: int = 420) -> Column:
    parts = F.split(squash(x), r"(?<=[.!?])\s+")
    return F.trim(F.substring(F.trim(F.array_join(F.slice(parts, 1, n), " ")), 1, most))


def bullets(items: Column, most: int | None = None, fallback: str = "") -> Column:
    kept = F.filter(F.transform(items, squash), lambda s: s != "")
    kept = F.slice(kept, 1, most) if most else kept
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(F.lit(fallback))


def question(x: Column | str) -> Column:
    """One sentence that ends in a question mark; empty text stays empty."""
    t = F.regexp_replace(squash(x), r"[.。!！?？\s]+$", "")
    return F.when(t == "", F.lit("")).otherwise(F.concat(t, F.lit("?")))


def count_cjk(x: Column | str) -> Column:
    return F.length(F.regexp_replace(text(x), r"[^一-鿿]", ""))


def count_latin_words(x: Column | str) -> Column:
    return F.regexp_count(text(x), F.lit("[A-Za-z]{3,}"))


def cjk_share(x: Column | str) -> Column:
    n = F.length(F.regexp_replace(text(x), r"(?U)\s", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(count_cjk(x) / n)


def find_doi(x: Column | str) -> Column:
    """The first DOI in a text or address, without punctuation behind it."""
    return F.rtrim(F.regexp_extract(text(x), r"(?i)\b(10\.\d{4,9}/[^\s\"'<>]+)", 1), F.lit(".,;)]}"))


def doi_in_text(x: Column | str) -> Column:
    """The first DOI in running text: letters, figures and the marks of DOIs alone."""
    return F.rtrim(F.regexp_extract(text(x), r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), F.lit(").,;]"))


def preprint_version(x: Column | str) -> Column:
    return F.regexp_extract(text(x), r"(?i)10\.\d{4,9}/\S+?v(\d+)\b", 1)


def strip_tags(x: Column | str) -> Column:
    """Tags replaced by nothing, the common character references resolved."""
    t = F.regexp_replace(text(x), "<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def repair_breaks(x: Column | str) -> Column:
    """Ligatures spelt out, words joined that a line end had parted, white space squashed."""
    t = F.translate(text(x), "­", "")
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    return squash(F.regexp_replace(t, r"([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def words3(x: Column | str) -> Column:
    """Words of at least three letters or hyphens, lower case."""
    return F.transform(F.regexp_extract_all(text(x), F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0)), lambda w: F.lower(w))


def profile_stem(token: Column) -> Column:
    """A word without ing, ers, er, ed, es or s where at least four letters remain."""
    out = token
    for ending in reversed(("ing", "ers", "er", "ed", "es", "s")):
        keep = F.length(token) - len(ending)
        out = F.when(token.endswith(ending) & (keep >= 4), F.substring(token, F.lit(1), keep)).otherwise(out)
    return out


def ngrams(tokens: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of the given sizes, as texts."""

    def of(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.array_distinct(F.concat(*[of(t, n) for n in sizes])))


def host(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text(x), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def contains_any(x: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | x.contains(m)
    return out


def count_markers(x: Column, markers: Sequence[str]) -> Column:
    """How many of the markers occur."""
    out = F.lit(0)
    for m in markers:
        out = out + x.contains(m).cast("int")
    return out
