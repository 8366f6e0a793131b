"""Lines repeated across one site's documents.

Documents with the same text at one source are collapsed to a cluster first; only clusters are exploded to lines.
A line then counts the distinct articles, clusters and publication dates behind it. Which of these counts decide is
said by the limits: lines repeated over articles (``min_articles``) include those of an article that its site published
several times; boilerplate is what several clusters on several dates print (``min_clusters``, ``min_dates``), so
the body of a republished article is not taken for it.

Lines are equal after lower-casing, with digit runs as one digit and white space trimmed and collapsed. The key is
128 bits of hash, so lines never travel. Defined results: null, empty and blank texts have no lines but count as
articles of their source; a null source is a source of its own; an article repeated in several rows counts once;
very long texts are only split inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ARTICLES, MIN_SHARE = 4, 0.02
#: Clusters of equal texts and dates of publication that boilerplate has at least; an unknown date is one more date.
MIN_CLUSTERS, MIN_DATES = 4, 2
_SPACE = r"[\s\u0085\p{Z}]+"


def line_form(line: Column) -> Column:
    """The compared form of a line; empty for a blank one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), _SPACE, " "))


def _key(form: Column) -> Column:
    return F.when(form != "", F.struct(F.xxhash64(form).alias("a"), F.xxhash64(form, F.lit(1)).alias("b")))


def line_keys(text: Column) -> Column:
    """One hash pair per line of the text, null for blank lines."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: _key(line_form(x)))


def line_statistics(articles: DataFrame, key: str = "article_id", source: str = "source_domain", text: str = "text",
                    published: str = "date_publish") -> DataFrame:
    """(source, line, n_articles, n_clusters, n_dates, source_articles) of every line of every source."""
    docs = articles.select(
        F.col(source).alias("source"), F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7)).alias("doc"),
        F.coalesce(F.substring(F.trim(published), 1, 10), F.lit("")).alias("day"), F.array_distinct(F.array_compact(line_keys(F.col(text)))).alias("lines"))
    articles_of = docs.groupBy("source", "id").agg(F.lit(1).alias("x")).groupBy("source").agg(F.count("*").alias("source_articles"))
    # distinct articles first, then clusters: neither a hot source nor a hot copy is gathered in one place
    one = docs.groupBy("source", "doc", "day", "id", "lines").agg(F.lit(1).alias("x"))
    clusters = one.groupBy("source", "doc", "day", "lines").agg(F.count("*").alias("n"))
    lines = clusters.select("source", "doc", "day", "n", F.explode("lines").alias("line"))
    stats = lines.groupBy("source", "line").agg(
        F.sum("n").alias("n_articles"), F.count_distinct("doc").alias("n_clusters"), F.count_distinct("day").alias("n_dates"))
    return stats.join(articles_of, stats["source"].eqNullSafe(articles_of["source"])).drop(articles_of["source"])


def repeated_lines(articles: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE, min_clusters: int = 1,
                   min_dates: int = 1, **columns: str) -> DataFrame:
    """The lines that occur in at least ``min_articles`` articles and ``min_share`` of all articles of their source, in
    at least ``min_clusters`` clusters and on ``min_dates`` dates."""
    s = line_statistics(articles, **columns)
    s = s.where((F.col("n_articles") >= min_articles) & (F.col("n_articles") >= F.col("source_articles") * min_share))
    if min_clusters > 1:
        s = s.where(F.col("n_clusters") >= min_clusters)
    return s.where(F.col("n_dates") >= min_dates) if min_dates > 1 else s


def occurrences(articles: DataFrame, key: str = "article_id", source: str = "source_domain", text: str = "text", **limits: float) -> DataFrame:
    """(key, line_no, n_articles, n_clusters, n_dates): every occurrence of a repeated line; a repeated row repeats its."""
    found = repeated_lines(articles, key=key, source=source, text=text, **limits).withColumnsRenamed({"source": "s", "line": "form"})
    at = articles.select(F.col(key), F.col(source).alias("source"), F.posexplode(line_keys(F.col(text))).alias("line_no", "line")).where("line IS NOT NULL")
    hit = at.join(found, (F.col("line") == F.col("form")) & F.col("source").eqNullSafe(F.col("s")))
    return hit.select(key, "line_no", "n_articles", "n_clusters", "n_dates")


def without_repeated_lines(articles: DataFrame, key: str = "article_id", source: str = "source_domain", text: str = "text", **limits: float) -> DataFrame:
    """(key, text, removed): each article once, its text without the repeated lines."""
    gone = occurrences(articles, key, source, text, **limits).groupBy(F.col(key).alias("k")).agg(F.collect_set("line_no").alias("nos"))
    one = articles.groupBy(key).agg(F.max(text).alias("text"))
    j = one.join(gone, one[key] == gone["k"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("nos", i), F.lit(False)))
    return j.select(key, F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("nos"), F.lit(0)).alias("removed"))
