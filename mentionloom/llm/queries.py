"""Registered queries of the text operators and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm import canonical, near_duplicates, packing, reading_level, residue, sentences, site_lines, stories, tokens, truncation
from mentionloom.session import cut
from mentionloom.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P1_LINES = r"""
WITH a AS (SELECT DISTINCT article_id, source_domain, text FROM articles),
 n AS (SELECT source_domain, count(DISTINCT article_id) AS total FROM a GROUP BY 1),
 l AS (SELECT article_id, source_domain, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM a WHERE text IS NOT NULL),
 f AS (SELECT article_id, source_domain, line_no, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS form FROM l),
 k AS (SELECT source_domain, form, count(DISTINCT article_id) AS n_articles FROM f WHERE form <> '' GROUP BY 1, 2),
 r AS (SELECT k.*, total FROM k JOIN n USING (source_domain) WHERE n_articles >= 4 AND n_articles >= total * 0.02)
"""


@query("p1_found", _P1_LINES + "SELECT DISTINCT article_id, CAST(line_no AS INT) AS line_no FROM f JOIN r USING (source_domain, form)")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.occurrences(read(spark, sf, "articles")).select("article_id", "line_no").distinct()


_BOILERPLATE = {"min_clusters": site_lines.MIN_CLUSTERS, "min_dates": site_lines.MIN_DATES}


@query("p1_clean")
def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without boilerplate; the body of an article that its site published several times stays."""
    return site_lines.without_repeated_lines(read(spark, sf, "articles"), **_BOILERPLATE)


_P1_BOILERPLATE = r"""
WITH a AS (SELECT DISTINCT article_id, source_domain, coalesce(text, '') AS text, coalesce(substr(trim(date_publish, ' '), 1, 10), '') AS day FROM articles),
 n AS (SELECT source_domain, count(DISTINCT article_id) AS total FROM a GROUP BY 1),
 l AS (SELECT article_id, source_domain, text, day, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM a),
 f AS (SELECT article_id, source_domain, text, day, line_no, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS form FROM l),
 k AS (SELECT source_domain, form, count(DISTINCT article_id) AS n_articles, count(DISTINCT text) AS n_clusters, count(DISTINCT day) AS n_dates FROM f WHERE form <> '' GROUP BY 1, 2),
 r AS (SELECT k.*, total FROM k JOIN n USING (source_domain) WHERE n_articles >= 4 AND n_articles >= total * 0.02 AND n_clusters >= 4 AND n_dates >= 2)
SELECT DISTINCT article_id, CAST(line_no AS INT) AS line_no, n_articles, n_clusters, n_dates FROM f JOIN r USING (source_domain, form)"""


@query("p1_boilerplate", _P1_BOILERPLATE)
def p1_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """The occurrences of lines that several clusters of equal texts print on several dates, with these counts."""
    return site_lines.occurrences(read(spark, sf, "articles"), **_BOILERPLATE).distinct()


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.disguised_fields(read(spark, sf, "articles"))


@query("p5_canonical")
def p5_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_fields(read(spark, sf, "articles"))


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, sf, "documents"))


@query("p9_containers")
def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), read(spark, sf, "pack_specs"))


@query("p9_report")
def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """How far the containers of every spec are from the least number."""
    specs = read(spark, sf, "pack_specs")
    return packing.report(cut(packing.pack_documents(read(spark, sf, "documents"), specs)), specs)


@query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(read(spark, sf, "articles"))


def _stories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and classes of the articles that are no residue and not of a site in Chinese."""
    articles = read(spark, sf, "articles")
    chinese = read(spark, sf, "sources").where("main_language = 'zh'").select(F.col("source_domain").alias("source"))
    scanned = cut(stories.scan(articles, width=3), forget=True)
    rows = scanned.where("kind = 'sign'").join(chinese, "source", "left_anti").select("id", "d1", "d2", "n", "shingles")
    return near_duplicates.near_duplicates(articles, least=0.5, width=3, exclude=residue.decide(scanned, "article_id"), rows=rows)


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.all_pairs(*_stories(spark, sf)).select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b")).distinct()


@query("p4_groups")
def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(*_stories(spark, sf))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(read(spark, sf, "documents"))


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(read(spark, sf, "articles")).where("cut").select("article_id", "field")


@query("p2_by_source")
def p2_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(read(spark, sf, "articles"))


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(read(spark, sf, "documents"), read(spark, sf, "level_ratings")).select("doc_id", "level").distinct()
