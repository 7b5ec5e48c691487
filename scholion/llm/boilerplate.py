"""Main text of pages mixed with page furniture, by composite text density (problem 3).

The fields hold pages already flattened to lines, so the document tree is rebuilt from them: the field is the
body, its headings open sections, lines hang under their section, and the parts of a line that a page renders as
links or controls (menu entries between separators, Markdown links, sentences that are controls or notices of the
site, entries that lead elsewhere) are its link nodes. A line with link nodes is an element of its own, one without
is a text node of its section. Every node has characters C, tags T, link characters LC and link tags LT; its
composite text density is

    C/T * log_{ln(C*LC/(C-LC+1) + LC_b*C/C_b + e)} (C*T / (LC*LT))

with the body's values marked b, and nought where all is link. Densities of the children are summed; the container
(the body or a section) with the largest sum is the main one, and the threshold is the least density along the path
from the body over that container to its thinnest text node. Elements below the threshold belong to the page; text
nodes belong to the paper. A heading carries no link and stays with the section that it opens.

Defined results: null and empty fields give no lines; lines are counted from 1 and split at line feeds alone;
blank lines are never reported; a record that occurs twice under one id is reported once; an empty table gives an
empty result; other columns are ignored; lines are judged alike whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.residue import ResidueIndex, build_index

#: One-word and short labels of menus and controls, as pages show them between separators.
MENU_WORDS = frozenset(
    "about|accessibility|account|advertise|advertisement|advertising|alerts|all issues|archive|archives|article|articles|authors|blog|books|browse|careers|cart|cite|collections|"
    "conferences|contact|contact us|cookies|current issue|donate|download|editors|editorial board|epub|export|faq|favourites|feed|feedback|figures & data|figures|for authors|for librarians|for reviewers|full text|help|"
    "home|imprint|info & metrics|issues|jobs|journals|language|librarians|link|login|log in|logout|mail|menu|metrics|my account|news|newsletter|online first|open access|pdf|permissions|podcasts|press|print|privacy|"
    "read this|references|register|registration|reprints|reviewers|rss|save|search|settings|share|sign in|sign up|site map|sitemap|societies|start|subjects|submit|subscribe|supplement|supporters|"
    "terms|terms of use|topics|tools|track citation|volumes|xml|"
    "startseite|zeitschriften|themen|über uns|impressum|datenschutz|agb|anmelden|warenkorb|suche|anzeige|drucken|merken|teilen|kontakt|hilfe|"
    "inicio|revistas|temas|contacto|buscar|iniciar sesión|aviso legal|"
    "首页|期刊|作者中心|关于我们|登录|注册|分享到|收藏|打印|帮助|联系我们|隐私政策|使用条款|投稿|搜索|菜单".split("|")
)

#: Whole lines that are controls, labels or notices of the site; figures stand for any number.
CONTROLS = re.compile(
    "|".join(
        [
            r"menu|advertisement|anzeige|广告|related (?:articles|content)|recommended for you|people also (?:looked at|read|viewed)|most (?:read|cited|viewed)(?: this (?:month|week|year))?|you (?:may|might) also like",
            r"meistgelesen(?: im monat)?|ähnliche (?:beiträge|artikel)|本月热门|相关文章|推荐阅读|跳到主要内容|接受全部\s*拒绝|下载 ?pdf.*",
            r"skip to (?:main )?content|zum inhalt springen|(?:back )?to top ?↑?|back to top.*|nach oben.*|返回顶部",
            r"subscribe ?/ ?renew|submit your manuscript|report a problem with this page|for (?:librarians|authors|reviewers|editors)|only necessary cookies",
            r"(?:accept|reject) all\b.*|alle akzeptieren\b.*|manage (?:preferences|cookies)|cookie (?:settings|preferences|policy)|nur notwendige.*",
            r"your privacy choices.*|.{2,60} values your privacy|privacy policy ·.*",
            r"share:.*|jump to:.*|language:.*|you are here:.*|tags?:.*|fig(?:ure)?\. viewer:.*|article metrics:.*|newsletter: .*",
            r"powered by \S.{0,40}|site version [\d.]+|version [\d.]+|page generated .*|last updated \d+; .*|server node .*",
            r"issn [\dx–-]+.*|e-?issn.*|download pdf.*|download citation.*|export citation.*|view (?:all )?\d* ?figures?|open in (?:a )?(?:new tab|viewer)\b.*|open in viewer.*",
            r"your download will start.*|scan to open on your phone|rate this article.*|log in via .{2,40}|sign in\b.{0,60}|log in\b.{0,60}|register\b.{0,40}",
            r"cited by \d*.*views.*|\d[\d,.]* (?:people|readers) (?:have )?read this.*|\d+ (?:views|downloads|shares|comments)\b.*",
            r"received mail \d+ times.*|join the list.*|previous article.*|next article.*|current issue.*|search this (?:journal|site).*|search in .{3,90}|suche in .{3,90}|搜索.{0,60}",
            r"follow .{2,60} on (?:social networks|.{2,20})|part of the .{2,60} group|hosted by .{2,60}(?: since \d+)?|sponsored: .*|save \d+ ?% on .*|member of the .{2,60} (?:publishers['’]?s? circle|association|group)",
            r"no part of this site may be copied.*|©.*|\(c\) ?\d{4}.*|copyright ©.*|copyright notice.*|版权所有.*|all rights reserved.*|alle rechte vorbehalten.*",
            r".{2,60} is registered in .{2,40} under no\. ?[\d-]+\.?|.{2,60}, .{2,40} \d+, tel\. .*|tel\.? ?[\d –-]+",
            r"get e-?mail alerts for .*|.{3,110} invites reviewers.*|call for papers.*|apply by \d.*|subscribe to .{2,100}|sign up for .*",
            r"artikel teilen\b.*|anmelden\b.*|startseite\b.*\|.*|impressum\b.*·.*|登录\s+注册.*|首页 ?\|.*|分享到.*|隐私政策\s.*",
            r"by browsing on you agree\b.*|by (?:using|continuing to use) (?:this|our) (?:web)?site\b.*|we use cookies\b.*|this (?:web)?site uses? cookies\b.*|wir verwenden cookies\b.*|本网站使用 ?cookie.*|utilizamos cookies\b.*",
            r"(?:this (?:web)?site|our (?:web)?(?:pages|sites?)|we|third parties chosen by us|the .{2,50} platform|.{2,50} and (?:its|our) partners|diese (?:web)?seite)\s+(?:may )?(?:use|set|place|store|collect|share|process)s?\b.{0,60}\b(?:cookies|text files|tracking tags|usage data|your device|personal data|identifiers)\b.*",
            r"read our (?:cookie statement|privacy policy)\b.*|more on this in our policy.*|adjust(?: your settings| choices)?\.?|change your settings.*|allow all.*",
            r"this (?:web)?site uses? (?:small files|cookies)\b.*|consent saved\b.*|page id \S+ generated\b.*|(?:home|start|startseite|首页|当前位置)\s*[:：›>].*|also in issue\b.*",
            r"were you looking for [“\"].*|popular in .{3,110}:.*|by the same (?:group|authors?):.*|(?:also|more) (?:in|from|by) (?:this|the) (?:issue|journal|authors?|group)\b.*|up next:.*|read next:.*|next in .{3,110}:.*|cited in:.*|trending:.*|from the archive:.*|see also:.*|editors?['’] (?:pick|choice)s?\b.*|recommended:.*|similar:.*|related:.*",
        ]
    ),
    re.IGNORECASE,
)
_HEADING = re.compile(
    r"(?:\d+(?:\.\d+)*\.? +|[IVX]+\. +)?(?:abstract|summary|introduction|background|aims?|objectives?|main|materials? and methods?|methods?(?: and materials?)?|methodology|sampling|study area|study design|participants|data|analysis|statistical analysis|"
    r"results?(?: and discussion)?|findings|discussion|conclusions?|outlook|limitations|acknowledge?ments?|references|bibliography|funding|author contributions?|data availability|supplementary (?:material|information)|appendix(?: \w)?|keywords|ethics|"
    r"einleitung|methoden|ergebnisse|diskussion|schluss|literatur|引言|方法|结果|讨论|结论|参考文献|致谢)\s*:?",
    re.IGNORECASE,
)
_BULLET = re.compile(r"^\s*(?:[*•·–>»▸-]\s+)+")
_MARKDOWN = re.compile(r"\[[^\]\n]+\]\([^)\s]*\)")
_SEPARATOR = re.compile(r"\s*[|•·›»/>\t]\s*|\s{2,}|\s+-\s+")
_POINTER = re.compile(r".{15,}(?:\(\d{4}\)|\b(?:19|20)\d{2})\s*\Z")
_FRAGMENT = re.compile(r"[{(\d].*\b[a-z]{2,} [a-z]{2,}\b")
_CJK = re.compile(r"[\u4e00-\u9fff\uff00-\uffef\u3000-\u303f\w\s#(),:>|-]+")
_TERMINAL = re.compile(r"[.!?。！？…”\"’)\]:;]\s*\Z")


_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+")
#: Words one of which every control or notice of more than one sentence holds.
_NOTICE = ("cookie", "brows", "privacy", "policy", "settings", "consent", " site", "rights", "copied", "sign ", "subscri", "alerts", "download", "view ", "share", "register", "adjust", "reject", "accept", "隐私")
#: Longest part of a menu.
_PART = 34


def link_share(line: str, headings: frozenset[str] = frozenset()) -> tuple[int, int, int, int]:
    """Characters, tags, link characters and link tags of a line."""
    text = line.strip()
    chars = len(text)
    if not chars:
        return 0, 1, 0, 0
    bullet = _BULLET.match(line)
    core = (line[bullet.end() :] if bullet else text).strip()
    if not core or core in headings or _HEADING.fullmatch(core):
        return chars, 1, 0, 0
    if CONTROLS.fullmatch(core):
        return chars, 2, chars, 1
    links = _MARKDOWN.findall(core)
    if links:
        inside = sum(map(len, links))
        rest = len(re.sub(r"\W", "", _MARKDOWN.sub("", core)))
        return chars, 1 + len(links), chars if rest < 4 else inside, len(links)
    closed = bool(_TERMINAL.search(core))
    parts = [p for p in _SEPARATOR.split(core) if p] if core[-1] not in ".。" else []
    if len(parts) > 1 and max(map(len, parts)) <= _PART:
        return chars, 1 + len(parts), chars, len(parts)
    if core.lower().rstrip(":.… ").strip() in MENU_WORDS:
        return chars, 2, chars, 1
    if (core[-1] == ")" or core[-1].isdigit()) and _POINTER.fullmatch(core):
        return chars, 2, chars, 1
    low = core.lower()
    notice = any(w in low for w in _NOTICE)
    if closed and not notice:
        return chars, 1, 0, 0
    sentences = _SENTENCES.split(core)
    links = [x for x in sentences if CONTROLS.fullmatch(x)] if notice and len(sentences) > 1 else []
    last = sentences[-1]
    if not closed and last not in links and (len(sentences) == 1 or len(last) <= _PART) and (_CJK.fullmatch(last) if 3 * sum(c > "\x7f" for c in last) >= len(last) else not _FRAGMENT.match(last)):
        # No closed sentence: an entry that leads elsewhere, or a label behind a text.
        links.append(last)
    if links:
        return chars, 1 + len(links), chars if len(links) == len(sentences) else sum(map(len, links)), len(links)
    return chars, 1, 0, 0


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """The composite text density of a node."""
    if not chars:
        return 0.0
    if link_chars >= chars:
        return 0.0
    lc, lt = max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars * link_chars / (chars - link_chars + 1) + body_link_chars * chars / max(body_chars, 1) + math.e)
    return chars / tags * math.log(chars * tags / (lc * lt) + 1) / math.log(max(base, 1.0001) + 1)


def page_lines(text: str | None, headings: frozenset[str] = frozenset(), known: dict | None = None) -> list[int]:
    """Numbers, from 1, of the lines that belong to the page and not to the main text."""
    if not text:
        return []
    lines = text.split("\n")
    #: Sections with their lines: number and counts.
    sections: list[list[tuple[int, tuple[int, int, int, int]]]] = [[]]
    for n, line in enumerate(lines, 1):
        if not line or line.isspace():
            continue
        got = known.get(line) if known is not None else None
        if got is None:
            got = link_share(line, headings)
            if known is not None and len(known) < 50_000 and not headings:
                known[line] = got
        if sections[-1] and _HEADING.fullmatch(line.strip()):
            sections.append([])
        sections[-1].append((n, got))
    if not sections[-1]:
        return []
    counts = [tuple(map(sum, zip(*(got for _, got in s)))) for s in sections]
    body = tuple(map(sum, zip(*counts)))
    of = lambda got: density(*got, body[0], body[2])
    dense = [[(n, got, of(got)) for n, got in s] for s in sections]
    # The container with the largest sum of its children's densities, and the path to it from the body.
    sums = [sum(d for *_, d in s) for s in dense]
    of_sections = list(map(of, counts))
    best = max(range(len(sums)), key=sums.__getitem__)
    path = [of(body)]
    inside = dense
    if sums[best] > sum(of_sections):
        path.append(of_sections[best])
        inside = [dense[best]]
    texts = [d for s in inside for _, got, d in s if not got[3]] or [d for s in dense for _, got, d in s if not got[3]]
    threshold = min([d for d in path if d > 0.0] + texts, default=0.0)
    return [n for s in dense for n, got, d in s if got[3] and (d < threshold or d == 0.0)]


def find_page_lines(records: DataFrame, id_col: str = "record_id", fields: Sequence[str] = ("full_text", "abstract"), residue: ResidueIndex | None = None, skip_residue: bool = True) -> DataFrame:
    """Rows ``record_id, field, line_no`` of the lines that belong to the page; records with residue are left out."""
    index = (residue or build_index(records)) if skip_residue else None
    shared = records.sparkSession.sparkContext.broadcast(index)
    names = list(fields)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict = {}
        for b in batches:
            ids, title, full, mode = (b.column(i).to_pylist() for i in range(4))
            bad = [own is not None and own.record(x, y, z) for x, y, z in zip(title, full, mode)]
            r_id, r_field, r_line = [], [], []
            for k, name in enumerate(names):
                for i, text, skip in zip(ids, b.column(4 + k).to_pylist(), bad):
                    if skip or not text:
                        continue
                    for n in page_lines(text, known=known):
                        r_id.append(i)
                        r_field.append(name)
                        r_line.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(r_id, pa.int64()), pa.array(r_field, pa.string()), pa.array(r_line, pa.int32())], names=["record_id", "field", "line_no"])

    picked = records.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), "title", "full_text", "summary_mode", *[F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(names)])
    return picked.mapInArrow(scan, "record_id long, field string, line_no int")


def main_text(records: DataFrame, field: str = "full_text", to: str = "main_text") -> DataFrame:
    """The records with the main body of ``field`` in a new column ``to``; null stays null."""

    @F.pandas_udf("string")
    def keep(texts):
        def one(t):
            if t is None:
                return None
            drop = set(page_lines(t))
            return "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in drop)

        return texts.map(one)

    return records.withColumn(to, keep(F.col(f"`{field}`")))
