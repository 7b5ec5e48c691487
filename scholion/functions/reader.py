"""Texts of a reader's records and notes: titles, sentences, sections, tables of metadata. All expressions, in the JVM.

Null input counts as empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import let, sentences, squash, strip_chars, text, unique_cs

#: Titles that stand for none.
NO_TITLES = ("", "[no-title]", "no-title", "untitled", "untitled-paper", "redirecting", "please wait", "loading...")
#: Headings that are no sentences.
HEADINGS = ("abstract", "introduction", "background", "methods", "materials and methods", "results", "discussion", "conclusion", "highlights", "graphical abstract", "references")
#: Characters that Chinese text shows after a wrong decoding.
MARKERS = ("鍩", "鐨", "鏂", "绗", "鍙", "锛", "銆", "鈥", "鏈", "缁", "鎬")
#: Names of internal fields that a note must not show as lines.
DUMP_FIELDS = (
    "summary_mode", "source", "title", "authors", "journal", "doi", "image_url", "web_url", "doi_url", "pubmed_url", "pdf_path", "downloaded_pdf", "local_pdf", "figure_paths",
    "figure_items", "acquisition_path", "abstract_available", "full_text_excerpt_available", "figure_count", "evidence_note", "source url", "pdf downloaded", "figure paths extracted",
    "figure items extracted", "evidence level", "full text/body", "full text available", "images", "has abstract", "has full text excerpt", "has figures", "access issue",
)
#: What takes the place of internal terms, in this order.
TERMS = (
    (r"(?i)\bsummary_mode\b", "证据层级"), (r"(?i)\bfull_text_excerpt\b", "正文摘录"), (r"(?i)\bfigure_items\b", "图注材料"), (r"(?i)\bfigure_paths\b", "图像文件"),
    (r"(?i)\bmaterials\.json\b", "当前材料"), (r"(?i)\bweb_url\b", "网页落地页"), (r"(?i)\bpdf_path\b", "本地 PDF"), (r"(?i)\bdownloaded_pdf\b", "已下载 PDF"), (r"(?i)\bJSON\b", "材料"),
)
#: Words that begin the frame of a page behind an article.
SHELL = (
    "Additional links", "About Wiley Online Library", "Wiley Home Page", "Log in to Wiley Online Library", "Create a new account", "Forgot your password", "Request Username",
    "Export citation", "Download Citation", "Article Metrics", "Scite metrics", "Share QR Code", "Generating QR code", "Close Figure Viewer", "Privacy Policy", "Terms of Use", "Manage Cookies",
)


def record_title(x: Column | str) -> Column:
    """The squashed title, empty where it only stands for one."""
    t = squash(x)
    return F.when(F.lower(t).isin(*NO_TITLES), "").otherwise(t)


def chunks(x: Column | str, most: int = 6) -> Column:
    """The first sentences."""
    return F.slice(sentences(x), 1, most)


def article_sentences(x: Column | str, most: int = 5) -> Column:
    """Sentences without headings and short lines in capitals, looked for among twice as many."""
    heading = lambda s: (F.length(s) < 18) & F.lower(s).isin(*HEADINGS) | s.rlike(r"^[A-Z0-9 \-,:;()]+$") & (F.length(s) <= 40)
    return F.slice(F.filter(chunks(x, 2 * most), lambda s: ~heading(s)), 1, most)


def asked(x: Column | str, default: str = "What core question does this study ask?") -> Column:
    """The text as a question; a general one for empty text."""
    t = squash(x)
    return F.when(t == "", F.lit(default)).otherwise(F.concat(F.regexp_replace(t, "[.?!]+$", ""), F.lit("?")))


def tidy_lines(x: Column | str) -> Column:
    """The lines of a text, blanks and tabs squashed, empty ones left out."""
    lines = F.split(F.regexp_replace(text(x), "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), r"(?U)^\s+|\s+$", "")), lambda s: s != ""), "\n")


def listed(items: Column) -> Column:
    """Items as lines with a dash, those with one left alone."""
    lines = F.filter(F.transform(items, tidy_lines), lambda s: s != "")
    return F.array_join(F.transform(lines, lambda s: F.when(s.startswith("-"), s).otherwise(F.concat(F.lit("- "), s))), "\n")


def note_name(x: Column | str, most: int = 110) -> Column:
    """A file name for a note: question marks stay."""
    name = strip_chars(F.substring(squash(F.regexp_replace(text(x), r'[\\/:*"<>|]', " ")), 1, most), " .")
    return F.when(name == "", "untitled").otherwise(name)


def title_prefix(x: Column | str, most: int = 60) -> Column:
    """The start of a title as the report's table writes it."""
    t = strip_chars(F.regexp_replace(F.regexp_replace(text(x), r"[�​-‍⁠]+", ""), r"(?U)\s+", " "), " .;:,")
    return F.trim(F.substring(squash(F.regexp_replace(t, r'[:*?"<>|]', " ")), 1, most))


def wrongly_decoded(x: Column | str) -> Column:
    """Four marks of wrong decoding, or a lost character among Han."""
    t = text(x)
    marks = sum((F.regexp_count(t, F.lit(m)) for m in MARKERS[1:]), F.regexp_count(t, F.lit(MARKERS[0])))
    han = F.length(F.regexp_replace(t, "[^一-鿿]", ""))
    return (marks >= 4) | (t.contains("锟") | t.contains("�")) & (han > 8)


def concept_lines(x: Column | str) -> Column:
    """Wiki links, each on a line of its own."""
    t = text(x)
    apart = F.trim(F.regexp_replace(F.regexp_replace(t, r"\]\]\s*-\s*\[\[", "]]\n- [["), r"\]\]\s+\[\[", "]]\n- [["))
    return F.when(t.contains("[["), F.when(apart.startswith("[["), F.concat(F.lit("- "), apart)).otherwise(apart)).otherwise(t)


def section_line(x: Column | str) -> tuple[Column, Column]:
    """Label and text of a line of a section; the label is empty where there is none."""
    t = F.regexp_replace(squash(x), r"^\s*(?:[-•]\s+|\d+[.)]\s+|\*(?!\*)\s+)", "")
    pattern = r"(?i)^(finding|basis|path|caption|takeaway|figure)\s*[:：]\s*(.+)$"
    label = F.lower(F.regexp_extract(t, pattern, 1))
    return label, F.when(label != "", squash(F.regexp_extract(t, pattern, 2))).otherwise(t)


def is_dump(x: Column | str) -> Column:
    return F.lower(squash(x)).rlike("^(?:" + "|".join(DUMP_FIELDS) + r")\s*[:：]")


def section_lines(lines: Column) -> Column:
    """Lines without internal fields, each once."""
    return unique_cs(F.filter(lines, lambda s: ~is_dump(s)))


def plain_terms(x: Column | str) -> Column:
    """Internal terms in the words of a note."""
    t = F.replace(squash(x), F.lit("`"), F.lit(""))
    for pattern, words in TERMS:
        t = F.regexp_replace(t, pattern, words)
    return squash(t)


def metadata_table(rows: Sequence[tuple[str, Column]]) -> Column:
    """A Markdown table of the keys that have a value."""
    cell = lambda c: F.trim(F.replace(tidy_lines(c), F.lit("\n"), F.lit("<br>")))
    line = lambda k, c: let(cell(c), lambda v: F.when(~v.isin("", "-", "无", "N/A"), F.concat(F.lit(f"| {k} | "), v, F.lit(" |"))))
    return F.concat_ws("\n", F.lit("| Key | Value |"), F.lit("| --- | --- |"), *[line(k, c) for k, c in rows])


def sources_list(items: Sequence[tuple[str, Column]]) -> Column:
    lines = F.concat_ws("\n", *[F.when(squash(c) != "", F.concat(F.lit(f"- {k}: "), squash(c))) for k, c in items])
    return F.when(lines == "", "-").otherwise(lines)


def without_shell(x: Column | str, after: int = 3000) -> Column:
    """The text before the first word of a page's frame that stands beyond ``after`` characters (words before that mean nothing)."""
    t = text(x)
    # Only the first place of a word counts, as in a search from the start.
    at = [let(F.locate(w, t), lambda n: F.when(n - 1 > after, n - 1)) for w in SHELL]
    body = F.substring(t, F.lit(1), F.coalesce(F.least(*at), F.length(t)))
    body = F.regexp_replace(body, r"(?i)(?:Search for more papers by this author\s+){2,}", "Search for more papers by this author ")
    return squash(body)


def without_markup(x: Column | str) -> Column:
    """Markdown without images, comments and blocks of code."""
    t = text(x)
    for pattern in (r"!\[[^\]]*\]\([^\)]+\)", r"(?i)<img\b[^>]*>", r"(?s)<!--.*?-->", r"(?s)```.*?```"):
        t = F.regexp_replace(t, pattern, " ")
    return squash(t)


def keyword_forms(x: Column | str) -> Column:
    """A keyword with its other number: an s off the last word, or one added."""
    t = squash(x)
    last = F.substring_index(t, " ", -1)
    low = F.lower(last)
    odd = low.endswith("ss") | low.endswith("us") | low.endswith("is")
    off = (F.length(last) >= 4) & low.endswith("s") & ~odd
    other = F.when(off, F.substring(t, F.lit(1), F.length(t) - 1)).when((F.length(last) >= 3) & ~odd, F.concat(t, F.lit("s")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(t, other), lambda v: v.isNotNull()))


def affiliation(x: Column | str) -> Column:
    """An affiliation without footnote marks, braces, loose punctuation and a trailing "intern"."""
    t = F.regexp_replace(F.trim(text(x)), r"^[\d,†‡∗*§¶∥ ]+[)\].]?\s*", "")
    t = F.translate(F.regexp_replace(t, r"\s*[\d,†‡∗*§¶]+$", ""), "{}", "")
    return F.regexp_replace(F.btrim(squash(t), F.lit(".,;:- ")), r"(?i)\s+intern$", "")


def numbered_parts(x: Column | str) -> Column:
    """A line of numbered affiliations in its parts: parted before numbers behind commas, else before numbers behind blanks."""
    t = text(x)
    commas = F.split(t, r",\s*(?=\d+\s+[A-Z])", -1)
    return F.when(F.size(commas) > 1, commas).otherwise(F.split(t, r"\s+(?=\d+\s+[A-Z])", -1))
