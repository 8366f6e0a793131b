"""The registry of queries and their oracles, and the frames and SQL that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators.mention_ops import mention_base
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


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct mentions with chain, class, head and span."""
    return mention_base(read(spark, sf, "mentions"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two labelings of the mentions: gold chains, and groups of equal head words within a topic."""
    m = mentions(spark, sf)
    return m.select("mention_id", "topic_id", "kind", "doc_id", F.col("chain").alias("key"), F.concat_ws("/", "topic_id", "head").alias("response"))


#: The same frames in SQL.
M = r"""
WITH d AS (SELECT DISTINCT * FROM mentions),
 w AS (SELECT *, list_filter(string_split(regexp_replace(lower(tokens_str), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM d),
 m AS (SELECT mention_id, doc_id, sent_id, tokens_number AS tok_ids, tokens_str AS text, split_part(coref_chain, '+', 1) AS chain, coref_chain AS labels,
   replace(coalesce(mention_type, 'UNK'), '+', '') AS kind, topic_id, score, is_continuous, is_singleton, words, words[-1] AS head,
   list_min(tokens_number) AS first_tok, list_max(tokens_number) AS last_tok FROM w)
"""
KR = M + ", kr AS (SELECT mention_id, topic_id, kind, doc_id, chain AS key, concat_ws('/', topic_id, head) AS response FROM m)\n"


def f1(r: str = "r", p: str = "p") -> str:
    return f"round(CASE WHEN {r} + {p} > 0 THEN 2 * {r} * {p} / ({r} + {p}) ELSE 0 END, 6) AS f1"
