"""An interest profile from a library: n-gram document frequencies, scores, a diverse choice of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import ngrams, profile_stem, squash, words3


def document_terms(docs: DataFrame, key: str, title: str = "title", abstract: str = "abstract", keywords: str = "keywords") -> DataFrame:
    """``key, term, in_title, in_abstract, in_keywords``, each term once a document.

    Titles give runs of one to three words, abstracts of two and three; keywords are taken whole.
    """
    kw = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.lower(squash(k))), lambda k: k != ""))
    sets = docs.select(key, ngrams(words3(title), (1, 2, 3)).alias("__t"), ngrams(words3(abstract), (2, 3)).alias("__a"), kw.alias("__k"))
    every = sets.select("*", F.explode(F.array_distinct(F.concat("__t", "__a", "__k"))).alias("term"))
    return every.select(key, "term", F.array_contains("__t", F.col("term")).alias("in_title"), F.array_contains("__a", F.col("term")).alias("in_abstract"), F.array_contains("__k", F.col("term")).alias("in_keywords"))


def term_statistics(terms: DataFrame) -> DataFrame:
    """Documents of each term, in all and by part; terms are distinct in a document, so a count is enough."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return terms.groupBy("term").agg(F.count("*").alias("docs"), n("in_title").alias("title_docs"), n("in_abstract").alias("abstract_docs"), n("in_keywords").alias("keyword_docs"))


def score_terms(stats: DataFrame, least_docs: int = 2, penalties: Sequence[str] = (), blacklist: Sequence[str] = ()) -> DataFrame:
    """(2 docs + 3 title + abstract - penalty) and half as much again for terms of several words.

    A term needs ``least_docs`` documents, or one title or abstract; a single word has to stand in a title or among
    keywords, and not in the blacklist.
    """
    words = F.split("term", " ")
    penalty = F.arrays_overlap(words, F.array(*[F.lit(p) for p in penalties])).cast("int") if penalties else F.lit(0)
    base = 2 * F.col("docs") + 3 * F.col("title_docs") + F.col("abstract_docs") - penalty
    n = F.size(words3("term"))
    scored = stats.withColumns({"n_words": n, "score": F.bround(base * F.when(n >= 2, 1.5).otherwise(1.0), 2)})
    admitted = (F.col("docs") >= least_docs) | (F.col("title_docs") >= 1) | (F.col("abstract_docs") >= 1)
    alone = (F.col("title_docs") > 0) | (F.col("keyword_docs") > 0)
    if blacklist:
        alone = alone & ~F.col("term").isin(*blacklist)
    return scored.where(admitted & ((F.col("n_words") != 1) | alone))


def rank_terms(scored: DataFrame) -> list:
    return [F.col("score").desc(), F.col("docs").desc(), F.col("title_docs").desc(), F.col("abstract_docs").desc(), F.col("term").asc()]


def diverse_terms(scored: DataFrame, limit: int = 30, pool: int = 400) -> DataFrame:
    """The best terms, none a part or near copy of another: greedy in their order, as one fold over an array.

    A term is left out if its stems are those of a term before it, or contain or are contained in them. The fold runs
    over the ``pool`` best; if these give fewer than ``limit``, over four times as many, until all have been seen, so
    that the choice is that over all terms.
    """
    while True:
        got = _diverse(scored, limit, pool)
        found = got.agg(F.max("rank").alias("n"), F.max("seen").alias("seen")).first()
        if (found["n"] or 0) >= limit or (found["seen"] or 0) < pool:
            return got.drop("seen")
        pool *= 4


def _diverse(scored: DataFrame, limit: int, pool: int) -> DataFrame:
    best = scored.orderBy(*rank_terms(scored)).limit(pool)
    order = best.select(F.struct((-F.col("score")).alias("a"), (-F.col("docs")).alias("b"), (-F.col("title_docs")).alias("c"), (-F.col("abstract_docs")).alias("d"), "term", "score", "docs").alias("__s"))
    stems = lambda t: F.array_distinct(F.transform(F.split(t, " "), profile_stem))
    row = order.agg(F.array_sort(F.collect_list("__s")).alias("__all"))  # at most ``pool`` terms
    keyed = row.select(F.transform("__all", lambda s: F.struct(s["term"].alias("term"), s["score"].alias("score"), s["docs"].alias("docs"), stems(s["term"]).alias("stems"))).alias("__all"))
    kept = F.aggregate(
        "__all",
        F.filter("__all", lambda _: F.lit(False)),
        lambda got, t: F.when(
            (F.size(got) >= limit) | F.exists(got, lambda g: (F.size(F.array_except(g["stems"], t["stems"])) == 0) | (F.size(F.array_except(t["stems"], g["stems"])) == 0)), got
        ).otherwise(F.concat(got, F.array(t))),
    )
    t = keyed.select(F.size("__all").alias("seen"), F.posexplode(kept).alias("__p", "t"))
    return t.select((F.col("__p") + 1).alias("rank"), F.col("t.term").alias("term"), F.col("t.score").alias("score"), F.col("t.docs").alias("docs"), "seen")


def frequent_names(rows: DataFrame, key: str, text: str, title: str, stop: Sequence[str] = (), most: int = 15, first: int = 40) -> DataFrame:
    """Names of methods in a text: written at least twice, in mixed or upper case; the ``first`` most frequent are looked at.

    Four families of patterns count one after the other, so a name of two families counts twice; words of the title
    and of ``stop`` are none.
    """
    #: The four families of names.
    families = (r"(?U)\b([A-Z][a-z]+(?:[A-Z][a-z]*)+(?:V?\d+)?)\b", r"(?U)\b([A-Z]{2,}(?:[-_]\d+)?)\b", r"(?U)\b([A-Z][a-z]+[A-Z][a-z]*\d+[a-z]?)\b", r"(?U)\b([A-Z][a-z]+-[A-Z][a-z]+(?:-[A-Z][a-z]+)?)\b")
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in families])
    title_words = F.filter(F.regexp_extract_all(F.coalesce(F.col(title), F.lit("")), F.lit(r"(?U)\b[A-Za-z]+\b"), F.lit(0)), lambda w: F.length(w) >= 3)
    found = rows.select(key, title_words.alias("__tw"), F.posexplode(names).alias("__p", "name"))
    counted = found.groupBy(key, "name").agg(F.count("*").alias("n"), F.min("__p").alias("__p"), F.first("__tw").alias("__tw"))
    # Names of one text: an array small against the text, sorted in place instead of by a window over the table.
    per = counted.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("__p").alias("p"), F.col("name"), F.col("n"), F.array_contains("__tw", F.col("name")).alias("t")))), 1, first).alias("__all"))
    ok = F.filter("__all", lambda s: (s["n"] >= 2) & ~s["t"] & (F.length(s["name"]) >= 2) & (~s["name"].isin(*stop) if stop else F.lit(True)))
    once = F.aggregate(ok, F.slice(ok, 1, 0), lambda got, s: F.when(F.exists(got, lambda g: F.lower(g["name"]) == F.lower(s["name"])), got).otherwise(F.concat(got, F.array(s))))
    return per.select(key, F.posexplode(F.slice(once, 1, most)).alias("__p", "s")).select(key, (F.col("__p") + 1).alias("rank"), F.col("s.name").alias("name"), F.col("s.n").alias("n"))
