"""How much of an article a text holds: section marks, access walls, full-text evidence, quality numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import contains_any, squash, text

#: Words that head the sections of an article.
SECTIONS = ("abstract", "introduction", "background", "materials and methods", "methods", "results", "discussion", "conclusion", "references", "supplementary")
#: Words of pages that hold an article back.
BLOCKED = ("just a moment", "请稍候", "checking your browser", "enable javascript and cookies", "attention required", "cloudflare")
#: Words of consent pages, and of articles.
COOKIE = ("your privacy, your choice", "accept all cookies", "manage cookies", "privacy policy", "cookie policy")
ARTICLE = ("abstract", "introduction", "results", "discussion", "references")
#: Labels of full texts.
FULL_TEXT = ("全文", "正文", "pdf", "xml", "full text", "full-text", "fulltext", "可提取文本")
#: Words of research articles.
RESEARCH = ("sample", "sequencing", "analysis", "genome", "species", "experiment", "review", "evolution")
#: Titles that are none.
NO_TITLE = ("redirecting", "untitled", "please wait", "请稍候…", "请稍候")


def section_hits(x: Column | str) -> Column:
    """How many of the ten section words stand free and are not followed by a colon."""
    low = F.lower(text(x))
    out = F.lit(0)
    for s in SECTIONS:
        out = out + low.rlike(rf"(?<![a-z]){s}(?![a-z]|:)").cast("int")
    return out


def blocked(title: Column | str, body: Column | str) -> Column:
    return contains_any(F.lower(squash(F.concat_ws(" ", text(title), F.substring(text(body), 1, 4000)))), BLOCKED)


def cookie_wall(title: Column | str, body: Column | str) -> Column:
    hay = F.lower(squash(F.concat_ws(" ", text(title), F.substring(text(body), 1, 6000))))
    return contains_any(hay, COOKIE) & ~contains_any(hay, ARTICLE)


def full_article(title: Column | str, body: Column | str) -> Column:
    """Two section words, or one in a long text, or a very long text of research."""
    clean = squash(body)
    low_title = F.lower(squash(title))
    hits = section_hits(body)
    long_enough = (hits >= 2) | ((hits >= 1) & (F.length(clean) >= 4500)) | ((F.length(clean) >= 6000) & contains_any(F.lower(clean), RESEARCH))
    return (text(body) != "") & ~blocked(title, body) & ~cookie_wall(title, body) & (low_title != "") & ~low_title.isin(*NO_TITLE) & long_enough


#: Statuses of a record whose full text was fetched.
FETCHED = ("elsevier_api", "pdf", "fulltext")


def labelled_full_text(mode: Column | str, status: Column | str | None = None, file: Column | str | None = None) -> Column:
    """Whether a record is said to have its full text: by a file, by its status, or by the words of its mode."""
    out = contains_any(F.lower(squash(mode)), FULL_TEXT)
    if status is not None:
        out = out | F.lower(squash(status)).isin(*FETCHED)
    return out if file is None else out | (squash(file) != "")


def has_full_text(title: Column | str, body: Column | str, mode: Column | str, status: Column | str | None = None, file: Column | str | None = None) -> Column:
    return (labelled_full_text(mode, status, file) & (text(body) != "")) | full_article(title, body)


def text_quality(x: Column | str) -> Column:
    """Length and 4000 for each section word; -1 for empty texts and walls."""
    clean = squash(x)
    bad = (clean == "") | cookie_wall(F.lit(""), clean) | blocked(F.lit(""), clean)
    return F.when(bad, F.lit(-1)).otherwise(F.length(clean) + 4000 * section_hits(clean))


def snapshot_quality(title: Column | str, body: Column | str, figures: Column, headings: Column) -> Column:
    size = lambda c, most: F.least(F.size(F.coalesce(c, F.array())), F.lit(most))
    bonus = F.when(squash(title) != "", 2000).otherwise(0) + F.when(full_article(title, body), 100_000).otherwise(0)
    return F.length(squash(body)) + 5000 * size(figures, 4) + 500 * size(headings, 10) + bonus
