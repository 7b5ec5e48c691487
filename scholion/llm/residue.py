"""Template residue, filler, error pages and access notices in record fields (problem 1).

Labelled exemplars of residue are cut into tokens and kept in an inverted index. Token weights are inverse
document frequencies counted over the whole table. Text is read in passages (pieces between sentence marks);
the index proposes exemplars for a passage, a window of the exemplar's length slides over it, and a record is
excluded when the window contains enough of the exemplar's weight and the exemplars found cover enough of the
passage's weight. Unfilled slots of any template syntax become one token before that; a slot is an exemplar of
its own and covers a window of length one.

Defined results: null and empty fields hold no residue; a record is reported once however many passages match;
repeated record ids are judged row by row and reported once; an empty table gives an empty result; columns other
than the named ones are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled exemplars. "field" ones must be a whole line; the rest must cover most of a passage.
EXEMPLARS: tuple[tuple[str, str], ...] = (
    ("filler", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"),
    ("filler", "lorem ipsum dolor"),
    ("filler", "ipsum dolor amet vel nulla facilisis vestibulum porta sem quis arcu"),
    ("filler", "duis aute irure in reprehenderit in voluptate velit esse cillum"),
    ("filler", "ut enim ad minim veniam quis nostrud exercitation ullamco laboris"),
    ("filler", "excepteur sint occaecat cupidatat non proident sunt in culpa"),
    ("filler", "the quick brown fox jumps over the lazy dog"),
    ("filler", "sample text sample text"),
    ("filler", "blah blah blah"),
    ("filler", "more words go here until the real paragraph arrives"),
    ("filler", "asdf asdf qwer qwer test test"),
    ("filler", "占位文字占位文字"),
    ("filler", "此处填写研究结论"),
    ("filler", "此处填写"),
    ("filler", "请在此处输入"),
    ("template", "text goes here"),
    ("template", "title goes here"),
    ("template", "summary mode goes here"),
    ("template", "your text here"),
    ("template", "insert results here"),
    ("template", "insert text here"),
    ("template", "click here to enter text"),
    ("template", "this paragraph will be supplied by the authors"),
    ("template", "article title placeholder"),
    ("template", "this is a placeholder"),
    ("template", "placeholder text"),
    ("template", "untitled document"),
    ("template", "text folgt in kürze"),
    ("template", "content to be added"),
    ("template", "write the discussion once data are in"),
    ("error", "object object"),
    ("error", "could not load mode timeout after s"),
    ("error", "timeout after s"),
    ("error", "the page you asked for is not here"),
    ("error", "the page you requested could not be found"),
    ("error", "the page you are looking for does not exist"),
    ("error", "this page does not exist"),
    ("error", "page not found"),
    ("error", "error not found"),
    ("error", "forbidden you do not have permission"),
    ("error", "you don t have permission to access article on this server"),
    ("error", "you do not have permission to view this page"),
    ("error", "access denied"),
    ("error", "bad gateway"),
    ("error", "gateway timeout"),
    ("error", "upstream timed out"),
    ("error", "service unavailable"),
    ("error", "http service unavailable"),
    ("error", "internal server error"),
    ("error", "the server encountered an internal error"),
    ("error", "something went wrong while loading this content"),
    ("error", "something went wrong"),
    ("error", "an unexpected error occurred"),
    ("error", "traceback most recent call last"),
    ("error", "warning mysql connect too many connections in srv www view php on line"),
    ("error", "error code nosuchkey code key fulltext html key error"),
    ("error", "status error article not available data null"),
    ("error", "doi not found"),
    ("error", "the identifier is unknown to this resolver"),
    ("error", "this page could not be loaded"),
    ("error", "the article could not be loaded"),
    ("error", "failed to load content"),
    ("error", "the full text is not available right now"),
    ("error", "this content is currently unavailable"),
    ("error", "the file you wanted has been withdrawn from this address"),
    ("error", "the link you followed is broken"),
    ("error", "the article server did not answer"),
    ("error", "the server did not respond"),
    ("error", "the connection has timed out"),
    ("error", "we are down for scheduled maintenance"),
    ("error", "this site is under maintenance"),
    ("error", "the library will be back at"),
    ("error", "loading article"),
    ("error", "页面不存在"),
    ("error", "系统错误请稍后再试"),
    ("error", "无法加载此页面"),
    ("error", "seite nicht gefunden"),
    ("error", "página no encontrada"),
    ("notice", "please enable javascript to view this article"),
    ("notice", "please enable javascript"),
    ("notice", "javascript is disabled in your browser"),
    ("notice", "javascript is required to view this page"),
    ("notice", "this site requires javascript"),
    ("notice", "you need to enable scripts to run this app"),
    ("notice", "you need to enable javascript to run this app"),
    ("notice", "your browser does not run scripts"),
    ("notice", "this viewer needs scripting to draw the article"),
    ("notice", "dieser inhalt benötigt javascript"),
    ("notice", "bitte aktivieren sie es in ihrem browser"),
    ("notice", "bitte aktivieren sie javascript"),
    ("notice", "esta página requiere javascript para mostrarse"),
    ("notice", "habilite javascript en su navegador"),
    ("notice", "veuillez activer javascript"),
    ("notice", "请启用 javascript 后刷新页面以查看全文"),
    ("notice", "访问过于频繁请在 分钟后重试"),
    ("notice", "请完成验证后继续访问"),
    ("notice", "请登录后查看全文"),
    ("notice", "checking that you are not a robot"),
    ("notice", "checking your browser before accessing"),
    ("notice", "are you a robot"),
    ("notice", "verify that you are human"),
    ("notice", "we could not confirm that you are human"),
    ("notice", "complete the captcha to continue"),
    ("notice", "automated traffic was noticed from your address"),
    ("notice", "unusual traffic from your network"),
    ("notice", "one more step complete the security check to open"),
    ("notice", "complete the security check"),
    ("notice", "too many requests"),
    ("notice", "your network has been paused for minutes"),
    ("notice", "your session has expired"),
    ("notice", "your access token is no longer valid"),
    ("notice", "your library has no licence for this content"),
    ("notice", "your institution does not have access to this content"),
    ("notice", "sign in again to read on"),
    ("notice", "sign in to continue"),
    ("notice", "please sign in to view the full text"),
    ("notice", "log in to continue reading"),
    ("notice", "please log in to view this content"),
    ("notice", "cookies must be enabled to view this page"),
    ("field", "undefined"),
    ("field", "null"),
    ("field", "nan"),
    ("field", "loading"),
    ("field", "loading article"),
    ("field", "please wait"),
    ("field", "one moment please"),
    ("field", "bitte warten"),
    ("field", "just a moment"),
    ("field", "redirecting"),
    ("field", "untitled"),
    ("field", "no title"),
    ("field", "error"),
    ("field", "not found"),
    ("field", "forbidden"),
    ("field", "keyerror mode"),
    ("field", "keyerror body"),
    ("field", "待补充"),
    ("field", "placeholder"),
)

_NAME = r"[A-Za-z][\w.\- ]{0,40}?"
_HTML = (
    "a abbr article b big blockquote body br caption center cite code col dd del div dl dt em figure font footer h1 h2 h3 h4 h5 h6 "
    "head header hr html i img inf ins it kbd li link main math meta mi mn mo mrow msub msup nav ol p pre q s samp sc section small span strike "
    "strong style sub sup svg table tbody td th thead title tr tt u ul underline var italic bold sec xref"
)
_HTML_ALT = "|".join(_HTML.split())
_SLOT_WORDS = (
    "authors?|author name|titles?|species|organisms?|topics?|doi|pmid|date|year|institutions?|outcomes?|names?|genes?|values?|city|country|location|"
    "methods?|results?|section|journal|affiliation|abstract|keywords?|drug|dose|treatment|group|sample|unit|number|variable|condition|disease|model|dataset|text"
)
#: Unfilled slots: paired delimiters around a name, and bare marks that stand for something to be filled in.
SLOT = re.compile(
    "|".join(
        [
            rf"\{{\{{\s*{_NAME}\s*\}}\}}",
            rf"[$#]\{{\s*{_NAME}\s*\}}",
            rf"\{{%\s*{_NAME}\s*%\}}",
            rf"<%=?\s*{_NAME}\s*%>",
            rf"<<\s*{_NAME}\s*>>",
            rf"\[\[\s*{_NAME}\s*\]\]",
            rf"@@\s*{_NAME}\s*@@",
            rf"~~\s*{_NAME}\s*~~",
            r"##[A-Za-z][\w.\-]*##",
            r"(?<![`\w\\}])\{\d{1,2}\}(?!`)",
            r"(?<!\w)__[A-Za-z][A-Za-z0-9.\-]*(?:_[A-Za-z0-9.\-]+)*__(?!\w)",
            r"(?<![\w%])%{1,2}[A-Za-z][\w.\-]*%{1,2}(?!\w)",
            r"%\([a-z_]+\)[sd]",
            rf"(?<![`\w\\}}]){{[A-Za-z][\w.\-]{{0,40}}}}(?!`)",
            rf"<(?!/?(?:(?i:{_HTML_ALT}))\b)[A-Za-z][\w.\-]{{1,40}}>",
            rf"&lt;(?!/?(?:(?i:{_HTML_ALT}))\b)[A-Za-z][\w.\-]{{1,40}}&gt;",
            rf"\[(?:(?i:{_SLOT_WORDS})|[A-Za-z]+(?:[_.][A-Za-z0-9]+)+|(?i:first-author|last-author|no-title)|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*)\](?!\()",
            r"\[(?i:insert|enter|add|your|click here|to be|please|fill|platzhalter|placeholder)\b[^\]\n]{0,60}\](?!\()",
            r"(?<![\w?])\?{3,}(?![\w?])",
            r"(?<!\w)_{4,}(?!\w)",
            r"\bX{3,}\b",
            r"\bXX ?%",
            r"\bxx\.x",
            r"\bn ?= ?N{1,3}\b",
            r"\b(?:TKTK|TBD|TBA|TODO|FIXME)\b",
        ]
    )
)
_SLOT_HINT = re.compile(r"\{[%\s\w{]|\[[A-Za-z\[]|<[<%A-Za-z]|@@|~~|##|%[%A-Za-z(]|&lt;|__|\?{3}|X[X]|xx\.x|= ?N|T(?:KTK|B[DA]\b|ODO)|FIXME")
_BARE_FIELD = re.compile(r"\s*(?:%[sd]|_{3,}|\?{2,}|<MODE>|\{\}|\[\])\s*\Z")

TOKEN = re.compile(r"[一-鿿]|[^\W\d_]+")
#: Ends of a clause and of a sentence; a passage is one or the other.
_BREAKS = (re.compile(r"[.!?。！？；，,:：…\n|]|\s[–—-]\s|\s→"), re.compile(r"[.!?。！？\n](?=\s|\Z|(?<=\n))|[。！？]"))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class ResidueIndex:
    """The inverted index over exemplars, with weights from the table's document frequencies."""

    def __init__(self, frequencies: dict[str, int], rows: int, containment: float = 0.8, coverage: float = 0.62, exemplars: Sequence[tuple[str, str]] = EXEMPLARS):
        self.containment, self.coverage = containment, coverage
        self.rows = max(rows, 1)
        self.frequencies = frequencies
        self.items: list[tuple[str, list[str], float]] = []
        self.index: dict[str, list[int]] = defaultdict(list)
        anchors: set[str] = set()
        for label, text in exemplars:
            words = tokens(text)
            total = sum(map(self.weight, set(words)))
            n = len(self.items)
            self.items.append((label, words, total))
            # Its rarest tokens, until a text without any of them has too little of the exemplar's weight left.
            spare = (1 - (1.0 if label == "field" else containment)) * total
            for w in sorted(set(words), key=lambda w: (-self.weight(w), -len(w), w)):
                self.index[w].append(n)
                if label != "field":
                    anchors.add(w)
                spare -= self.weight(w)
                if spare < 0:
                    break
        self.anchors = anchors
        #: Tokens of the exemplars that count only as a whole field.
        self.alone = {w for label, own, _ in self.items if label == "field" for w in own}
        self._find = None

    def weight(self, token: str) -> float:
        """Inverse document frequency; tokens outside the exemplars weigh as a middling token of the table."""
        df = self.frequencies.get(token)
        return math.log(1 + self.rows / (1 + df)) if df is not None else math.log(1 + self.rows / (1 + self.rows / 8))

    def _automaton(self):
        if self._find is None:
            import ahocorasick

            self._find = ahocorasick.Automaton()
            for a in self.anchors:
                self._find.add_word(a, a)
            self._find.make_automaton()
        return self._find

    def __getstate__(self):
        return {**self.__dict__, "_find": None}

    def passage(self, text: str, field: bool = False) -> bool:
        """Whether exemplars fill a passage; with ``field`` the passage is a whole field, all of which has to be covered by one that counts only alone."""
        words = tokens(text)
        covered = [False] * len(words)
        hit = False
        for n in {n for w in set(words) for n in self.index.get(w, ())}:
            label, own, total = self.items[n]
            if (label == "field") != field:
                continue
            wanted = set(own)
            width = len(words) if field else min(len(words), len(own) + 2)
            for at in range(len(words) - width + 1):
                if sum(map(self.weight, wanted.intersection(words[at : at + width]))) >= (0.999 if field else self.containment) * total:
                    hit = True
                    for i in range(at, at + width):
                        covered[i] = covered[i] or words[i] in wanted
        if not hit:
            return False
        every = [self.weight(w) for w in words]
        return sum(x for x, c in zip(every, covered) if c) >= (0.999 if field else self.coverage) * sum(every)

    def matches(self, text: str | None, short: bool = False) -> bool:
        """Whether a field holds residue. ``short``: titles and modes, where a bare mark is the whole field."""
        if not text or not text.strip():
            return False
        # A slot is an exemplar of one token, contained whole wherever it stands.
        if _SLOT_HINT.search(text) and SLOT.search(text):
            return True
        if short and _BARE_FIELD.match(text):
            return True
        low = text.lower()
        first = TOKEN.search(low)
        if first and first.group() in self.alone and self.passage(low, True):
            return True
        seen = [end for end, _ in self._automaton().iter(low)]
        for stop in _BREAKS if seen else ():
            done = -1
            marks = [m.span() for m in stop.finditer(low)]
            starts, ends = [s for s, _ in marks], [e for _, e in marks]
            for end in seen:
                if end < done:
                    continue
                before, after = bisect_right(ends, end), bisect_left(starts, end)
                done = starts[after] if after < len(starts) else len(low)
                if self.passage(low[ends[before - 1] if before else 0 : done]):
                    return True
        return False

    def record(self, title: str | None, full_text: str | None, mode: str | None) -> bool:
        return self.matches(title, True) or self.matches(mode, True) or self.matches(full_text)


def exemplar_vocabulary(exemplars: Sequence[tuple[str, str]] = EXEMPLARS) -> list[str]:
    return sorted({w for _, text in exemplars for w in tokens(text)})


def build_index(records: DataFrame, fields: Sequence[str] = ("title", "full_text", "summary_mode"), **options) -> ResidueIndex:
    """Counts the exemplar tokens' document frequencies over every row; at most one row a token comes to the driver."""
    vocabulary = exemplar_vocabulary()
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`") for c in fields]))
    words = F.split(text, r"[^\p{L}]+|(?<=\p{IsHan})")
    known = F.array(*[F.lit(w) for w in vocabulary])
    counted = records.select(F.explode(F.concat(F.array_intersect(words, known), F.array(F.lit("")))).alias("token")).groupBy("token").count()
    found = {r["token"]: r["count"] for r in counted.collect()}
    rows = found.pop("", 0)
    return ResidueIndex({w: found.get(w, 0) for w in vocabulary}, rows, **options)


def find_residue(records: DataFrame, id_col: str = "record_id", index: ResidueIndex | None = None) -> DataFrame:
    """One row ``record_id`` for each record whose title, full_text or summary_mode holds residue. No shuffle but for repeated ids."""
    shared = records.sparkSession.sparkContext.broadcast(index or build_index(records))  # bounded by the exemplar list

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            ids, a, f, m = (b.column(i).to_pylist() for i in range(4))
            out = [i for i, x, y, z in zip(ids, a, f, m) if own.record(x, y, z)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["record_id"])

    picked = records.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), "title", "full_text", "summary_mode")
    return picked.mapInArrow(scan, "record_id long").distinct()


def without_residue(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The records that hold no residue, all columns kept."""
    hit = find_residue(records, id_col).withColumnRenamed("record_id", "__residue_id")
    return records.join(hit, records[id_col].cast("long") == hit["__residue_id"], "left_anti")
