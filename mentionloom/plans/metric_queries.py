"""Evaluation queries: coreference measures of two labelings of the mentions, per topic unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import metrics
from mentionloom.operators.mention_ops import wordset
from mentionloom.plans.registry import KR, M, f1, labels, mentions, query

BY = ["topic_id"]
_C = KR + ", c AS (SELECT topic_id, key, response, count(*) AS n FROM kr GROUP BY ALL)"
_S = _C + """,
 k AS (SELECT topic_id, key, sum(n) AS nk FROM c WHERE key IS NOT NULL GROUP BY ALL), r AS (SELECT topic_id, response, sum(n) AS nr FROM c WHERE response IS NOT NULL GROUP BY ALL),
 s AS (SELECT c.topic_id, c.key, c.response, n, nk, nr FROM c JOIN k USING (topic_id, key) JOIN r USING (topic_id, response)),
 t AS (SELECT topic_id, sum(CASE WHEN key IS NOT NULL THEN n ELSE 0 END) AS mk, sum(CASE WHEN response IS NOT NULL THEN n ELSE 0 END) AS mr FROM c GROUP BY 1)"""
_OUT = "SELECT topic_id, round(r, 6) AS recall, round(p, 6) AS precision, " + f1() + " FROM x"


@query("met1_muc", _C + """,
 k AS (SELECT topic_id, key, sum(n) AS size, count(DISTINCT response) + sum(CASE WHEN response IS NULL THEN n ELSE 0 END) AS parts FROM c WHERE key IS NOT NULL GROUP BY ALL),
 r AS (SELECT topic_id, response, sum(n) AS size, count(DISTINCT key) + sum(CASE WHEN key IS NULL THEN n ELSE 0 END) AS parts FROM c WHERE response IS NOT NULL GROUP BY ALL),
 a AS (SELECT topic_id, sum(size - parts) AS ra, sum(size - 1) AS rb FROM k GROUP BY 1), b AS (SELECT topic_id, sum(size - parts) AS pa, sum(size - 1) AS pb FROM r GROUP BY 1),
 x AS (SELECT topic_id, CASE WHEN rb > 0 THEN ra / rb::DOUBLE ELSE 0 END AS r, CASE WHEN pb > 0 THEN pa / pb::DOUBLE ELSE 0 END AS p FROM a JOIN b USING (topic_id))
""" + _OUT)  # fmt: skip
def met1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.muc(labels(spark, sf), BY)


@query("met2_b_cubed", _S + """, x AS (SELECT topic_id, sum(n * n / nk::DOUBLE) / any_value(mk) AS r, sum(n * n / nr::DOUBLE) / any_value(mr) AS p FROM s JOIN t USING (topic_id) GROUP BY 1)
""" + _OUT)  # fmt: skip
def met2(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.b_cubed(labels(spark, sf), BY)


@query("met3_extended_b_cubed")
def met3(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).where("head IS NOT NULL")
    return metrics.extended_b_cubed(m.select("topic_id", F.col("mention_id").alias("item"), F.split("labels", r"\+").alias("key"), F.array("head").alias("response")), BY)


@query("met4_met5_ceaf")
def met45(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ceaf(labels(spark, sf), BY)


@query("met6_blanc", _S + """,
 kc AS (SELECT topic_id, sum(nk * (nk - 1) / 2) AS kc, sum(nk) AS km FROM k GROUP BY 1), rc AS (SELECT topic_id, sum(nr * (nr - 1) / 2) AS rc, sum(nr) AS rm FROM r GROUP BY 1),
 mk2 AS (SELECT topic_id, sum(q * (q - 1) / 2) AS mkc FROM (SELECT topic_id, key, sum(n) AS q FROM s GROUP BY ALL) GROUP BY 1),
 mr2 AS (SELECT topic_id, sum(q * (q - 1) / 2) AS mrc FROM (SELECT topic_id, response, sum(n) AS q FROM s GROUP BY ALL) GROUP BY 1),
 cm AS (SELECT topic_id, sum(n * (n - 1) / 2) AS cc, sum(n) AS mm FROM s GROUP BY 1),
 j AS (SELECT topic_id, kc, km * (km - 1) / 2 - kc AS kn, rc, rm * (rm - 1) / 2 - rc AS rn, cc, mm * (mm - 1) / 2 - mkc - mrc + cc AS cn
   FROM kc JOIN rc USING (topic_id) JOIN mk2 USING (topic_id) JOIN mr2 USING (topic_id) JOIN cm USING (topic_id)),
 q AS (SELECT topic_id, kc, kn, CASE WHEN kc > 0 THEN cc / kc ELSE 0 END AS r1, CASE WHEN rc > 0 THEN cc / rc ELSE 0 END AS p1, CASE WHEN kn > 0 THEN cn / kn ELSE 0 END AS r2, CASE WHEN rn > 0 THEN cn / rn ELSE 0 END AS p2 FROM j),
 f AS (SELECT *, CASE WHEN r1 + p1 > 0 THEN 2 * r1 * p1 / (r1 + p1) ELSE 0 END AS f1c, CASE WHEN r2 + p2 > 0 THEN 2 * r2 * p2 / (r2 + p2) ELSE 0 END AS f1n FROM q)
SELECT topic_id, round(CASE WHEN kc = 0 THEN r2 WHEN kn = 0 THEN r1 ELSE (r1 + r2) / 2 END, 6) AS recall, round(CASE WHEN kc = 0 THEN p2 WHEN kn = 0 THEN p1 ELSE (p1 + p2) / 2 END, 6) AS precision,
 round(CASE WHEN kc = 0 THEN f1n WHEN kn = 0 THEN f1c ELSE (f1c + f1n) / 2 END, 6) AS f1 FROM f
""")  # fmt: skip
def met6(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.blanc(labels(spark, sf), BY)


@query("met7_lea", _S + """,
 a AS (SELECT topic_id, sum(nk * x) AS a FROM (SELECT topic_id, key, any_value(nk) AS nk, sum(CASE WHEN nk = 1 THEN CASE WHEN nr = 1 THEN 1.0 ELSE 0 END ELSE (n * (n - 1) / 2) / (nk * (nk - 1) / 2) END) AS x FROM s GROUP BY ALL) GROUP BY 1),
 b AS (SELECT topic_id, sum(nr * x) AS b FROM (SELECT topic_id, response, any_value(nr) AS nr, sum(CASE WHEN nr = 1 THEN CASE WHEN nk = 1 THEN 1.0 ELSE 0 END ELSE (n * (n - 1) / 2) / (nr * (nr - 1) / 2) END) AS x FROM s GROUP BY ALL) GROUP BY 1),
 x AS (SELECT topic_id, a / mk AS r, b / mr AS p FROM t JOIN a USING (topic_id) JOIN b USING (topic_id))
""" + _OUT)  # fmt: skip
def met7(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lea(labels(spark, sf), BY)


_BEST = _S + """,
 b0 AS (SELECT *, row_number() OVER (PARTITION BY topic_id, key ORDER BY n DESC, nr, response) AS i FROM s),
 b AS (SELECT topic_id, key, k.nk, coalesce(n, 0) AS n, coalesce(nr, 0) AS nr, CASE WHEN n > 0 THEN n / k.nk::DOUBLE ELSE 0 END AS r1, CASE WHEN n > 0 THEN n / nr::DOUBLE ELSE 0 END AS p1
   FROM k LEFT JOIN (SELECT topic_id, key, n, nr FROM b0 WHERE i = 1) USING (topic_id, key)),
 v AS (SELECT *, CASE WHEN r1 + p1 > 0 THEN 2 * r1 * p1 / (r1 + p1) ELSE 0 END AS f FROM b)
"""  # fmt: skip


@query("met8_weighted_f1", _BEST + "SELECT topic_id, round(sum(r1 * nk) / sum(nk), 6) AS recall, round(sum(p1 * nk) / sum(nk), 6) AS precision, round(sum(f * nk) / sum(nk), 6) AS f1 FROM v GROUP BY 1")
def met8(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_f1(labels(spark, sf), BY)


_STOP = "['" + "','".join("a an and the of in on at to for by with from as is la el los las le les des du de der die das ein eine und et y".split()) + "']"
_WCL = f""", ws AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(words, lambda x: NOT list_contains({_STOP}, x)))), ' ') AS wordset FROM m),
 h AS (SELECT chain, head, count(DISTINCT wordset) AS u, count(*) AS n FROM ws GROUP BY ALL),
 e AS (SELECT chain, CASE WHEN sum(n) > 1 THEN sum(u / n::DOUBLE) * sum(u) / sum(n) ELSE 1.0 END AS wcl, sum(n) AS mentions FROM h GROUP BY 1)
"""


def _wcl(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).withColumn("wordset", wordset(F.col("words")))
    return metrics.phrasing_complexity(m, "chain", "head", "wordset")


@query("met9_wcl_weighted_f1", _BEST + _WCL + "SELECT topic_id, round(sum(r1 * wcl) / sum(wcl), 6) AS recall, round(sum(p1 * wcl) / sum(wcl), 6) AS precision, round(sum(f * wcl) / sum(wcl), 6) AS f1 FROM v JOIN e ON v.key = e.chain GROUP BY 1")
def met9(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_f1(labels(spark, sf), BY, _wcl(spark, sf).select(F.col("chain").alias("key"), F.col("wcl").alias("w")))


@query("met10_conll_f1")
def met10(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.conll(labels(spark, sf), BY)


@query("met11_by_type", _S.replace("topic_id, key, response, count(*) AS n FROM kr", "kind AS topic_id, key, response, count(*) AS n FROM kr") + """,
 rr AS (SELECT response, count(*) AS nr FROM kr WHERE response IS NOT NULL GROUP BY 1),
 z AS (SELECT c.topic_id, c.n, k.nk, rr.nr FROM c JOIN k USING (topic_id, key) JOIN rr USING (response)),
 x AS (SELECT topic_id, sum(n * n / nk::DOUBLE) / any_value(mk) AS r, sum(n * n / nr::DOUBLE) / any_value(mk) AS p, any_value(mk)::BIGINT AS support FROM z JOIN t USING (topic_id) GROUP BY 1)
SELECT topic_id AS kind, round(r, 6) AS recall, round(p, 6) AS precision, """ + f1() + ", support FROM x")  # fmt: skip
def met11(spark: SparkSession, sf: str) -> DataFrame:
    """Truth restricted to a type; response chains keep their mentions of other types."""
    kr = labels(spark, sf)
    c = metrics.contingency(kr, ["kind"])
    k = c.where("key IS NOT NULL").groupBy("kind", "key").agg(F.sum("n").alias("nk"))
    r = kr.where("response IS NOT NULL").groupBy("response").agg(F.count("*").alias("nr"))
    s = c.join(k, ["kind", "key"]).join(r, "response").groupBy("kind").agg(
        F.sum(F.col("n") * F.col("n") / F.col("nk")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("nr")).alias("b"))
    t = c.where("key IS NOT NULL").groupBy("kind").agg(F.sum("n").alias("support"))
    j = s.join(t, "kind").select("kind", (F.col("a") / F.col("support")).alias("r"), (F.col("b") / F.col("support")).alias("p"), "support")
    return j.select("kind", F.round("r", 6).alias("recall"), F.round("p", 6).alias("precision"), F.round(metrics.f_beta(F.col("r"), F.col("p")), 6).alias("f1"), "support")


_STEPS = KR + """, st AS (SELECT mention_id, topic_id, key, step, CASE step WHEN 0 THEN mention_id WHEN 1 THEN concat_ws('/', topic_id, doc_id, split_part(response, '/', 2)) ELSE response END AS response FROM kr, (SELECT unnest([0, 1, 2]) AS step)),
 c AS (SELECT step, key, response, count(*) AS n FROM st GROUP BY ALL), k AS (SELECT step, key, sum(n) AS nk FROM c GROUP BY ALL), r AS (SELECT step, response, sum(n) AS nr FROM c GROUP BY ALL),
 x AS (SELECT step, sum(n * n / nk::DOUBLE) / sum(n) AS r, sum(n * n / nr::DOUBLE) / sum(n) AS p FROM c JOIN k USING (step, key) JOIN r USING (step, response) GROUP BY 1)
SELECT step, round(r, 6) AS recall, round(p, 6) AS precision, """ + f1() + " FROM x"  # fmt: skip


@query("met12_by_step", _STEPS)
def met12(spark: SparkSession, sf: str) -> DataFrame:
    """The measure after each merge step: singletons, equal heads in a document, equal heads in a topic."""
    kr = labels(spark, sf)
    steps = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step")
    s = kr.select("*", steps).withColumn("response", F.when(F.col("step") == 0, F.col("mention_id")).when(
        F.col("step") == 1, F.concat_ws("/", "topic_id", "doc_id", F.split_part("response", F.lit("/"), F.lit(2)))).otherwise(F.col("response")))
    return metrics.b_cubed(s, ["step"])


@query("met14_mention_identification", KR + """, q AS (SELECT topic_id, CASE WHEN kind = 'UNK' THEN NULL ELSE key END AS key, CASE WHEN kind = 'TIM' THEN NULL ELSE response END AS response FROM kr),
 x AS (SELECT topic_id, sum((key IS NOT NULL AND response IS NOT NULL)::INT) / count(key)::DOUBLE AS r, sum((key IS NOT NULL AND response IS NOT NULL)::INT) / count(response)::DOUBLE AS p FROM q GROUP BY 1)
""" + _OUT)  # fmt: skip
def met14(spark: SparkSession, sf: str) -> DataFrame:
    kr = labels(spark, sf).select("topic_id", F.when(F.col("kind") != "UNK", F.col("key")).alias("key"), F.when(F.col("kind") != "TIM", F.col("response")).alias("response"))
    return metrics.mention_identification(kr, BY)


@query("met15_truncated_percent", _S + """, x AS (SELECT topic_id, sum(n * n / nk::DOUBLE) / any_value(mk) AS r FROM s JOIN t USING (topic_id) GROUP BY 1)
SELECT topic_id, floor(round(r, 6) * 10000) / 100 AS recall_percent FROM x""")  # fmt: skip
def met15(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.b_cubed(labels(spark, sf), BY).select("topic_id", (F.floor(F.col("recall") * 10000) / 100).alias("recall_percent"))


@query("met16_micro", _S.replace("topic_id, key, response, count(*)", "doc_id AS topic_id, key, response, count(*)") + """,
 x AS (SELECT sum(n * n / nk::DOUBLE) / (SELECT sum(mk) FROM t) AS r, sum(n * n / nr::DOUBLE) / (SELECT sum(mr) FROM t) AS p FROM s)
SELECT round(r, 6) AS recall, round(p, 6) AS precision, """ + f1() + " FROM x")  # fmt: skip
def met16(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluation_counts(labels(spark, sf), ["doc_id"])


@query("agg5_phrasing_complexity", M + _WCL + "SELECT chain, round(wcl, 3) AS wcl, mentions::BIGINT AS mentions FROM e")
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    return _wcl(spark, sf).select("chain", F.round("wcl", 3).alias("wcl"), "mentions")


@query("agg6_wcl_by_type", M + _WCL + """, ct AS (SELECT chain, min(kind) AS concept_type FROM m GROUP BY 1)
SELECT concept_type, round(sum(wcl * mentions) / sum(mentions), 6) AS wcl, count(*) AS entities, sum(mentions)::BIGINT AS mentions FROM e JOIN ct USING (chain) GROUP BY 1""")  # fmt: skip
def agg6(spark: SparkSession, sf: str) -> DataFrame:
    kind = mentions(spark, sf).groupBy("chain").agg(F.min("kind").alias("concept_type"))
    w = _wcl(spark, sf).join(kind, "chain")
    return w.groupBy("concept_type").agg(
        F.round(F.sum(F.col("wcl") * F.col("mentions")) / F.sum("mentions"), 6).alias("wcl"), F.count("*").alias("entities"), F.sum("mentions").alias("mentions"))


@query("embedding_label_metrics", """
WITH c AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[3] > 0 THEN 4 ELSE 0 END AS response FROM embeddings),
 n AS (SELECT label, response, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT label, sum(n) AS nk FROM n GROUP BY 1), r AS (SELECT response, sum(n) AS nr FROM n GROUP BY 1),
 x AS (SELECT sum(n * n / nk::DOUBLE) / sum(n) AS r, sum(n * n / nr::DOUBLE) / sum(n) AS p FROM n JOIN k USING (label) JOIN r USING (response))
SELECT round(r, 6) AS recall, round(p, 6) AS precision, """ + f1() + " FROM x")  # fmt: skip
def embedding_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Gold labels of vectors against the octant of their first three dimensions."""
    from mentionloom.sources.tables import read

    bit = lambda i, w: F.when(F.col("embedding")[i] > 0, w).otherwise(0)
    e = read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("key"), (bit(0, 1) + bit(1, 2) + bit(2, 4)).alias("response"))
    return metrics.b_cubed(e)
