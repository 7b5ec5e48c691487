"""Phrase matching, scoring and vetoes of papers against configured keywords.

Keywords are a short configured list; phrases are compared on normalised tokens, as one padded text per field, so a
match is a substring test inside whole-stage code: no join, no UDF, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import joined, let, norm_tokens, norm_tokens_py, text, token_text

REJECTED = -999


@dataclass(frozen=True)
class Rules:
    """What to look for. ``variants`` gives other surface forms of a keyword; without an entry a keyword stands for itself."""

    keywords: tuple[str, ...] = ()
    boosts: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    rejected_journals: tuple[str, ...] = ()
    variants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    boost_admits: bool = False
    min_score: int = 2

    def phrases(self, keyword: str) -> list[str]:
        got = (" ".join(norm_tokens_py(v)) for v in self.variants.get(keyword, (keyword,)))
        return sorted({p for p in got if p})


def has(tokens: Column, rules: Rules, keyword: str) -> Column:
    """Whether any surface form of a keyword runs in the padded tokens."""
    out = F.lit(False)
    for p in rules.phrases(keyword):
        out = out | tokens.contains(f" {p} ")
    return out


def covering(keywords: Sequence[str]) -> dict[str, list[str]]:
    """For each keyword those whose tokens are more and contain its own, in a run."""
    runs = {k: norm_tokens_py(k) for k in dict.fromkeys(keywords)}
    pad = {k: f" {' '.join(t)} " for k, t in runs.items()}
    return {k: [o for o in runs if len(runs[o]) > len(t) and pad[k] in pad[o]] for k, t in runs.items() if t}


def _reduced(hits: dict[str, Column], covers: dict[str, list[str]]) -> dict[str, Column]:
    """Hits that no hit of a covering keyword takes the place of."""
    out = {}
    for k, hit in hits.items():
        for o in covers.get(k, ()):
            if o in hits:
                hit = hit & ~hits[o]
        out[k] = hit
    return out


def _names(hits: dict[str, Column]) -> Column:
    if not hits:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(h, F.lit(k)) for k, h in hits.items()]), lambda k: k.isNotNull())


def _count(hits: dict[str, Column]) -> Column:
    out = F.lit(0)
    for h in hits.values():
        out = out + h.cast("int")
    return out


def _any(hits) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def matches(tokens: Column, rules: Rules, keywords: Sequence[str]) -> Column:
    """The keywords that match and are not covered by a longer match, in their configured order."""
    covers = covering(keywords)
    return _names(_reduced({k: has(tokens, rules, k) for k in covers}, covers))


def score(papers: DataFrame, rules: Rules) -> DataFrame:
    """The papers with ``matched``, ``boosted``, ``veto`` and ``points``.

    Three points a keyword in the title, one a keyword elsewhere, and for boost terms two (or one, if there is one)
    and one more if one is in the title; boosts count only beside a keyword unless ``boost_admits``. A rejected
    journal or a negative keyword gives -999. Token texts are computed once a row, whatever
    is filtered or derived later.
    """
    words, boosts = covering(rules.keywords), covering(rules.boosts)

    def judge(t: Column) -> Column:
        every = joined(t["title"], t["body"])
        full = joined(t["title"], t["body"], t["journal"])

        def inner(s: Column) -> Column:
            hit = lambda x, names: {k: has(x, rules, k) for k in names}
            matched = _reduced(hit(s["every"], words), words)
            boosted = _reduced(hit(s["full"], boosts), boosts)
            in_title = _reduced(hit(t["title"], words), words)
            elsewhere = _reduced({k: h & ~in_title[k] for k, h in hit(t["body"], words).items()}, words)
            base = 3 * _count(in_title) + _count(elsewhere)
            boost = F.least(_count(boosted), F.lit(2)) + _any(hit(t["title"], boosts).values()).cast("int")
            veto = F.when(_any(hit(t["journal"], rules.rejected_journals).values()), F.lit("rejected_journal")).when(_any(hit(s["full"], rules.negatives).values()), F.lit("rejected_negative_keyword"))
            total = let(base, lambda b: b + F.when(F.lit(rules.boost_admits) | (b > 0), boost).otherwise(0))
            return F.struct(_names(matched).alias("matched"), _names(boosted).alias("boosted"), veto.alias("veto"), F.when(veto.isNotNull(), F.lit(REJECTED)).otherwise(total).cast("int").alias("points"))

        return let(F.struct(every.alias("every"), full.alias("full")), inner)

    keyword_text = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")
    body = joined(token_text("abstract"), token_text(keyword_text))
    fields = F.struct(token_text("title").alias("title"), body.alias("body"), token_text("journal").alias("journal"))
    # Generated, not projected: a filter on the result is not pushed below it, so the judgement is made once a row.
    kept = [c for c in papers.columns if c not in ("matched", "boosted", "veto", "points")]
    return papers.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(let(fields, judge))))


def semi(papers: DataFrame, rules: Rules, index_source: str = "pubmed") -> DataFrame:
    """The papers of the index with a keyword or boost term in title or abstract; papers of other sources pass, and all do without terms."""
    terms = tuple(dict.fromkeys((*rules.keywords, *rules.boosts)))
    if not terms:
        return papers
    hit = let(joined(token_text("title"), token_text("abstract")), lambda t: _any([has(t, rules, k) for k in terms]))
    return papers.where((F.lower(text("source")) != index_source) | hit)


#: Phrases of at most so many bytes in memory are broadcast to the scan of the texts; of more, texts and phrases are joined by shuffle.
MOST_BROADCAST = 16 << 20
#: Bits of the table that filters n-grams before a shuffle, at most (8 MB).
MOST_BITS = 1 << 26


def _possible(grams: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """The n-grams whose hash one of the ``n`` phrases has, by a broadcast table of bits: all that match, and few others."""
    bits = min(MOST_BITS, 1 << max(10, (32 * n).bit_length()))
    place = F.pmod(F.xxhash64("__gram"), F.lit(bits)).cast("int")
    words = keyed.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, p & 63))").alias("b")).collect()  # at most MOST_BITS / 64
    table = [0] * (bits // 64)
    for w, b in words:
        table[w] = b
    marks = F.broadcast(grams.sparkSession.createDataFrame([(table,)], "__bits array<long>"))
    hit = F.expr("getbit(get(__bits, shiftright(__place, 6)), __place & 63) = 1")
    return grams.withColumn("__place", place).join(marks, hit).drop("__place", "__bits")


def pairs(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str, sizes: Sequence[int] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, phrase) for every phrase of a table that a text contains, once for each row of ``texts``, whatever the number of phrases.

    N-grams of the texts are joined with the phrases by equality, so the cost grows with the texts and not with
    texts times phrases. Without ``sizes`` the runs are those that the phrases have. The n-grams are many times the
    texts, which the planner does not know: they are never broadcast, and only shuffled where the phrases, whose bytes
    are counted first, are too many to be broadcast; then those go first that have the hash of no phrase.
    """
    from scholion.functions.text import ngrams

    keyed = phrases.select(F.col(phrase_col), F.trim(token_text(phrase_col)).alias("__gram")).where("__gram <> ''").distinct()
    held = F.octet_length(text(phrase_col)) + F.octet_length("__gram") + 100  # a row's own bytes in the hash table
    by_size = keyed.groupBy(F.size(F.split("__gram", " ")).alias("n")).agg(F.sum(held).alias("bytes"), F.count("*").alias("phrases")).collect()
    if sizes is None:
        sizes = sorted(r["n"] for r in by_size)
    if not sizes:
        return texts.select(F.col(id_col), F.lit(None).cast("string").alias(phrase_col)).where("false")
    grams = texts.select(F.col(id_col), F.explode(ngrams(norm_tokens(text_col), sizes)).alias("__gram"))
    if sum(r["bytes"] for r in by_size) <= most_broadcast:
        found = grams.join(F.broadcast(keyed), "__gram")
    else:
        found = _possible(grams, keyed, sum(r["phrases"] for r in by_size)).join(keyed.hint("merge"), "__gram")
    return found.select(id_col, phrase_col)
