"""Annotations of the mentions' words: part of speech, named-entity class and dependency.

A parser's tables have these columns; the tables at hand hold only text, so they are bound by rules of form, once here,
in Spark and in SQL. Operators and queries read the columns and do not know where they come from. Word vectors are
bound likewise: a word has the vector that a hash of it points to, out of all vectors of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.plans.registry import M, mentions
from mentionloom.sources.tables import read

#: Closed classes of words.
DETERMINERS = ("the", "a", "an", "la", "el", "los", "las", "le", "les", "der", "die", "das")
PRONOUNS = ("i", "he", "she", "it", "we", "you", "they", "er", "sie", "il", "elle", "ils", "ella")
TITLES = ("mr", "mrs", "ms", "dr", "prof")
GENERAL_NOUNS = ("something", "anything", "nothing", "everything", "someone", "anyone", "everyone")
STOPS = (*DETERMINERS, "of", "in", "on", "at", "to", "for", "by", "with", "from", "as", "is", "de", "des", "du", "und", "et", "y", "and", "s")


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: (condition on word, raw, kind, i, n; value): the first that holds decides. The same text in Spark and in SQL.
_POS = [(f"word IN {_in(DETERMINERS)}", "'DT'"), (f"word IN {_in(PRONOUNS)}", "'PRP'"), ("{digits}", "'CD'"), ("{upper} AND word LIKE '%s'", "'NNPS'"), ("{upper}", "'NNP'"), ("word LIKE '%ly'", "'RB'"),
        ("word LIKE '%ed'", "'VBD'"), ("word LIKE '%al' OR word LIKE '%ous' OR word LIKE '%ive' OR word LIKE '%ic'", "'JJ'"), ("word LIKE '%s'", "'NNS'")]
_NER = [("kind = 'TIM'", "'DATE'"), (f"word IN {_in(TITLES)}", "'TITLE'"), ("NOT {upper}", "'O'"), ("kind = 'HUM'", "'PERSON'"), ("kind = 'GRP' AND (word LIKE '%ist' OR word LIKE '%ists')", "'IDEOLOGY'"), ("kind = 'GRP'", "'ORGANIZATION'"),
        ("kind = 'LOC' AND (word LIKE '%land' OR word LIKE '%ia')", "'COUNTRY'"), ("kind = 'LOC' AND (word LIKE '%by' OR word LIKE '%ford')", "'CITY'"), ("kind = 'LOC'", "'LOCATION'"), ("kind = 'NON'", "'MISC'")]
_DEP = [("i = n - 1", "'root'"), ("pos = 'DT'", "'det'"), ("pos = 'CD'", "'nummod'"), ("pos IN ('JJ', 'VBD')", "'amod'"), ("i < n - 2 AND pos IN ('NNP', 'NNPS')", "'nmod:poss'")]


def _case(rules: list[tuple[str, str]], other: str, upper: str, digits: str) -> str:
    return "CASE " + " ".join(f"WHEN {c.format(upper=upper, digits=digits)} THEN {v}" for c, v in rules) + f" ELSE {other} END"


_DUCK = {"upper": r"regexp_matches(raw, '^\p{Lu}')", "digits": r"regexp_matches(word, '^[0-9]+$')"}
_SPARK = {"upper": r"(raw RLIKE '^\\p{Lu}')", "digits": "(word RLIKE '^[0-9]+$')"}

#: The annotated words of the mentions in SQL, view ``t`` beside ``m``: one row per word, i of n, of a mention.
A = (
    M
    + r""", rw AS (SELECT *, list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS raws FROM m),
 t0 AS (SELECT mention_id, topic_id, doc_id, sent_id, chain, kind, score, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS word, unnest(raws) AS raw FROM rw WHERE len(words) = len(raws)),
 t1 AS (SELECT *, """
    + _case(_POS, "'NN'", **_DUCK)
    + " AS pos, "
    + _case(_NER, "'O'", **_DUCK)
    + " AS ner FROM t0),\n t AS (SELECT *, "
    + _case(_DEP, "'compound'", **_DUCK)
    + " AS dep FROM t1)\n"
)


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """The same frame in Spark."""
    m = mentions(spark, sf)
    raws = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pairs: Column = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("words") - 1), F.col("words"), F.col("raws")))
    m = m.withColumn("raws", raws).where((F.size("words") > 0) & (F.size("words") == F.size("raws")))
    t = m.select("mention_id", "topic_id", "doc_id", "sent_id", "chain", "kind", "score", F.size("words").alias("n"), pairs.alias("x"))
    t = t.select("mention_id", "topic_id", "doc_id", "sent_id", "chain", "kind", "score", "n", F.col("x.0").alias("i"), F.col("x.words").alias("word"), F.col("x.raws").alias("raw"))
    t = t.withColumns({"pos": F.expr(_case(_POS, "'NN'", **_SPARK)), "ner": F.expr(_case(_NER, "'O'", **_SPARK))})
    return t.withColumn("dep", F.expr(_case(_DEP, "'compound'", **_SPARK)))


#: Word vectors in SQL, view ``wv`` after ``t``.
WV = ", wv AS (SELECT word, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM t) JOIN embeddings USING (vec_id))\n"


def word_vectors(spark: SparkSession, sf: str, words: DataFrame) -> DataFrame:
    """(word, v) of the distinct words."""
    e = read(spark, sf, "embeddings")
    n = e.agg(F.count("*").alias("n_vectors"))  # one row
    w = words.select("word").distinct().crossJoin(n)
    w = w.withColumn("vec_id", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % F.col("n_vectors"))
    return w.join(e, "vec_id").select("word", F.col("embedding").cast("array<double>").alias("v"))
