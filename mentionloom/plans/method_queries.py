"""Queries of entity identification: methods, merge steps, clustering, significance and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import metrics, sieves, significance
from mentionloom.plans.registry import M, labels, mentions, query
from mentionloom.sources.tables import read
from mentionloom.streaming import ingest

# -- methods -------------------------------------------------------------------------------------------------------------


@query("mtd1_lemma_baseline", M + ", f AS (SELECT topic_id, chain, arg_min(head, mention_id) AS h FROM m WHERE head IS NOT NULL GROUP BY ALL) SELECT topic_id, h AS lemma, count(*) AS entities FROM f GROUP BY ALL")
def mtd1(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).where("head IS NOT NULL")
    return m.groupBy("topic_id", "chain").agg(F.min_by("head", "mention_id").alias("lemma")).groupBy("topic_id", "lemma").agg(F.count("*").alias("entities"))


@query("mtd2_head_lemma_clusters", M + "SELECT topic_id, head, count(*) AS mentions, count(DISTINCT chain) AS chains FROM m GROUP BY ALL")
def mtd2(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("topic_id", "head").agg(F.count("*").alias("mentions"), F.count_distinct("chain").alias("chains"))


@query("mtd3_chains_as_entities", M + "SELECT topic_id, chain, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL HAVING count(DISTINCT doc_id) > 1")
def mtd3(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("topic_id", "chain").agg(F.count_distinct("doc_id").alias("documents")).where("documents > 1")


@query("mtd4_as_annotated", M + ", l AS (SELECT mention_id, unnest(string_split(labels, '+')) AS label FROM m) SELECT label, count(*) AS mentions FROM l GROUP BY 1")
def mtd4(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select(F.explode(F.split("labels", r"\+")).alias("label")).groupBy("label").agg(F.count("*").alias("mentions"))


@query("clu5_seeds", M + "SELECT doc_id, chain, min(mention_id) AS seed, count(*) AS size FROM m GROUP BY ALL")
def clu5(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("doc_id", "chain").agg(F.min("mention_id").alias("seed"), F.count("*").alias("size"))


_CP = M + ", c AS (SELECT DISTINCT doc_id, chain FROM m)"


@query("clu6_cluster_pairs", _CP + " SELECT x.doc_id, x.chain AS a, y.chain AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.chain < y.chain")
def clu6(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a document's clusters: groups bounded by a document."""
    c = mentions(spark, sf).select("doc_id", "chain").distinct()
    return c.withColumnRenamed("chain", "a").join(c.withColumnRenamed("chain", "b"), "doc_id").where("a < b")


_MP = M + ", p AS (SELECT x.doc_id, x.chain AS a, y.chain AS b, x.mention_id AS i, y.mention_id AS j, CASE WHEN x.head = y.head THEN 1.0 ELSE 0.0 END + CASE WHEN x.kind = y.kind THEN 0.5 ELSE 0.0 END AS s FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.chain < y.chain)"


def _mention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    x = m.select("doc_id", F.col("chain").alias("a"), F.col("mention_id").alias("i"), F.col("head").alias("hi"), F.col("kind").alias("ki"))
    y = m.select("doc_id", F.col("chain").alias("b"), F.col("mention_id").alias("j"), F.col("head").alias("hj"), F.col("kind").alias("kj"))
    s = F.when(F.col("hi") == F.col("hj"), 1.0).otherwise(0.0) + F.when(F.col("ki") == F.col("kj"), 0.5).otherwise(0.0)
    return x.join(y, "doc_id").where("a < b").select("doc_id", "a", "b", "i", "j", s.alias("s"))


@query("clu7_mention_pairs", _MP + " SELECT doc_id, i, j FROM p")
def clu7(spark: SparkSession, sf: str) -> DataFrame:
    return _mention_pairs(spark, sf).select("doc_id", "i", "j")


@query("clu8_cluster_scores", _MP + " SELECT doc_id, a, b, round(avg(s), 6)::DOUBLE AS score FROM p GROUP BY ALL")
def clu8(spark: SparkSession, sf: str) -> DataFrame:
    return _mention_pairs(spark, sf).groupBy("doc_id", "a", "b").agg(F.round(F.avg("s"), 6).alias("score"))




@query("clu13_clusters_by_subtopic", M + "SELECT chain || '/' || split_part(doc_id, '_', 1) AS cluster, count(*) AS size FROM m GROUP BY 1")
def clu13(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy(F.concat_ws("/", "chain", F.split_part("doc_id", F.lit("_"), F.lit(1))).alias("cluster")).agg(F.count("*").alias("size"))


@query("clu14_global_chain_ids", M + ", c AS (SELECT DISTINCT topic_id, chain FROM m) SELECT topic_id, chain, dense_rank() OVER (PARTITION BY topic_id ORDER BY chain) AS chain_no FROM c")
def clu14(spark: SparkSession, sf: str) -> DataFrame:
    from mentionloom.sources.writers import chain_numbers

    c = mentions(spark, sf).select("topic_id", "chain").distinct()
    return chain_numbers(c, ["topic_id"], "chain").select("topic_id", "chain", F.col("chain_no").cast("long").alias("chain_no"))


@query("clu15_topic_agreement", M + """, c AS (SELECT DISTINCT doc_id, topic_id AS gold, split_part(doc_id, '_', 1) AS predicted FROM m), n AS (SELECT gold, predicted, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n),
 g AS (SELECT gold, sum(n) AS ng FROM n GROUP BY 1), p AS (SELECT predicted, sum(n) AS np FROM n GROUP BY 1),
 h AS (SELECT -(SELECT sum(ng / t * ln(ng / t)) FROM g, t) AS hg, -(SELECT sum(np / t * ln(np / t)) FROM p, t) AS hp, -(SELECT sum(n / t * ln(n / np)) FROM n JOIN p USING (predicted), t) AS hgp, -(SELECT sum(n / t * ln(n / ng)) FROM n JOIN g USING (gold), t) AS hpg),
 v AS (SELECT CASE WHEN hg > 0 THEN 1 - hgp / hg ELSE 1 END AS hom, CASE WHEN hp > 0 THEN 1 - hpg / hp ELSE 1 END AS com FROM h)
SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, (SELECT round((i - e) / (m - e), 6) FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(ng * (ng - 1) / 2) FROM g) * (SELECT sum(np * (np - 1) / 2) FROM p) / (SELECT t * (t - 1) / 2 FROM t) AS e, ((SELECT sum(ng * (ng - 1) / 2) FROM g) + (SELECT sum(np * (np - 1) / 2) FROM p)) / 2 AS m)) AS ari FROM v""")  # fmt: skip
def clu15(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of a document's topic with the topic that its name begins with."""
    c = mentions(spark, sf).select("doc_id", F.col("topic_id").alias("gold"), F.split_part("doc_id", F.lit("_"), F.lit(1)).alias("predicted")).distinct()
    return metrics.partition_agreement(c)


@query("clu15_predicted_topics")
def clu15_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Topics predicted from the texts: TF-IDF of one to three words (in at least three and at most half of the documents),
    k-means of 20 clusters with a fixed seed, and how they agree with the given topics."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer

    docs = read(spark, sf, "articles").where("text IS NOT NULL").groupBy("article_id").agg(F.max("topic_id").alias("gold"), F.max("text").alias("text"))
    docs = RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"[^\p{L}\p{N}]+").transform(docs)
    for n in (2, 3):
        docs = NGram(n=n, inputCol="w1", outputCol=f"w{n}").transform(docs)
    docs = docs.select("article_id", "gold", F.concat("w1", "w2", "w3").alias("terms"))
    model = Pipeline(stages=[CountVectorizer(inputCol="terms", outputCol="tf", minDF=3.0, maxDF=0.5), IDF(inputCol="tf", outputCol="x"), KMeans(featuresCol="x", predictionCol="cluster", k=20, seed=1, maxIter=20)]).fit(docs)
    return metrics.partition_agreement(model.transform(docs).select(F.col("article_id").alias("doc_id"), "gold", F.col("cluster").cast("string").alias("predicted")))


# -- merge steps -----------------------------------------------------------------------------------------------------

_E = M + """, hh AS (SELECT topic_id, chain, head, row_number() OVER (PARTITION BY topic_id, chain ORDER BY count(*) DESC, head) AS i FROM m GROUP BY 1, 2, 3),
 e0 AS (SELECT topic_id, chain AS entity, count(*) AS size, min(kind) AS kind FROM m GROUP BY ALL),
 ent AS (SELECT e0.*, head, CASE WHEN kind = 'HUM' AND size > 1 THEN CASE WHEN coalesce(head, '') LIKE '%s' THEN 'person-nes' ELSE 'person-ne' END WHEN kind = 'HUM' THEN CASE WHEN coalesce(head, '') LIKE '%s' THEN 'person-nns' ELSE 'person-nn' END
   WHEN kind = 'GRP' AND size > 1 THEN 'group-ne' WHEN kind = 'GRP' THEN 'group' WHEN kind = 'LOC' AND size > 1 THEN 'country-ne' WHEN kind = 'LOC' THEN 'country' ELSE 'misc' END AS etype
   FROM e0 JOIN (SELECT topic_id, chain AS entity, head FROM hh WHERE i = 1) USING (topic_id, entity))
"""  # fmt: skip


def _gated(edges: str, step: str, allowed: str, method: str = "newer") -> str:
    return _E + f""", ed AS ({edges}), o AS (SELECT ed.topic_id, CASE WHEN y.size > x.size OR (y.size = x.size AND y.entity < x.entity) THEN y.entity ELSE x.entity END AS a,
   CASE WHEN y.size > x.size OR (y.size = x.size AND y.entity < x.entity) THEN x.entity ELSE y.entity END AS b, ed.sim FROM ed JOIN ent x ON x.topic_id = ed.topic_id AND x.entity = ed.a JOIN ent y ON y.topic_id = ed.topic_id AND y.entity = ed.b)
SELECT o.topic_id, o.a, o.b, round(o.sim, 6)::DOUBLE AS sim FROM o JOIN ent x ON x.topic_id = o.topic_id AND x.entity = o.a JOIN ent y ON y.topic_id = o.topic_id AND y.entity = o.b
 JOIN rules r ON r.method = '{method}' AND r.step = '{step}' AND r.type_a = x.etype AND r.type_b = y.etype WHERE {allowed}"""  # fmt: skip


def _gate(spark: SparkSession, sf: str, edges: DataFrame, step: str, allowed: str, method: str = "newer") -> DataFrame:
    ents = sieves.entities(mentions(spark, sf))
    g = sieves.gate(edges, ents, read(spark, sf, "rules"), method, step, F.expr(allowed))
    return g.select("topic_id", "a", "b", F.round("sim", 6).alias("sim"))


_SHARE = "SELECT x.topic_id, x.entity AS a, y.entity AS b, {sim} AS sim FROM ({items}) x JOIN ({items}) y ON x.topic_id = y.topic_id AND x.item = y.item AND x.entity < y.entity GROUP BY 1, 2, 3"
_TITLES = "SELECT DISTINCT topic_id, entity, head AS item FROM ent WHERE head IS NOT NULL AND kind IN ('HUM', 'GRP', 'LOC')"


def _shared(items: str, sim: str = "1.0") -> str:
    return _SHARE.replace("{items}", items).replace("{sim}", sim)


@query("x0_title_match", _gated(_shared(_TITLES), "step0", "r.value > 0"))
def x0(spark: SparkSession, sf: str) -> DataFrame:
    ents = sieves.entities(mentions(spark, sf))
    titles = ents.select("topic_id", "entity", F.when(F.col("kind").isin("HUM", "GRP", "LOC"), F.col("head")).alias("title"))
    return _gate(spark, sf, sieves.title_edges(ents, titles), "step0", "rule > 0")


@query("t0_head_equality", _gated(_shared("SELECT topic_id, entity, head AS item FROM ent WHERE head IS NOT NULL"), "step0", "r.value > 0", "older"))
def t0(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf, sieves.head_edges(sieves.entities(mentions(spark, sf))), "step0", "rule > 0", "older")


# -- significance and events ---------------------------------------------------------------------------------------------

_TWO = "WITH p AS (SELECT event_id AS k, value AS a, value * (0.9 + (event_id % 7) / 30.0)::DOUBLE AS b FROM events)"


def _two(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("value").alias("a"), (F.col("value") * (0.9 + F.col("event_id") % 7 / 30.0)).alias("b"))


_KS = _TWO + """, v AS (SELECT a - b AS d FROM p), g AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM v), c AS (SELECT d, count(*) AS c, sum(count(*)) OVER (ORDER BY d) AS upto FROM v GROUP BY d),
 z AS (SELECT c, upto, n, (d - mean) / sd AS z, 1 / (1 + 0.3275911 * abs((d - mean) / sd) / sqrt(2.0)) AS t FROM c, g),
 f AS (SELECT c, upto, n, CASE WHEN z >= 0 THEN 1 - e / 2 ELSE e / 2 END AS phi FROM (SELECT *, ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2) AS e FROM z))
SELECT round(max(greatest(abs(upto / n - phi), abs((upto - c) / n - phi))), 5) AS distance FROM f"""  # fmt: skip


@query("sta1_distribution_distance", _KS)
def sta1(spark: SparkSession, sf: str) -> DataFrame:
    return significance.kolmogorov_smirnov(_two(spark, sf).select((F.col("a") - F.col("b")).alias("d")), "d")


@query("sta2_paired_t", _TWO + " SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t FROM p")
def sta2(spark: SparkSession, sf: str) -> DataFrame:
    return significance.paired_t(_two(spark, sf), "a", "b")


@query("sta2_wilcoxon", _TWO + ", v AS (SELECT a - b AS d FROM p WHERE a <> b), r AS (SELECT d, avg(rn) OVER (PARTITION BY abs(d)) AS r FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rn FROM v)), w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r) SELECT n, round(w, 1) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 5) AS z FROM w")
def sta2_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return significance.wilcoxon(_two(spark, sf), "a", "b")


@query("sta2_mcnemar", "WITH p AS (SELECT value > 10 AS a, event_id % 3 > 0 AS b FROM events), c AS (SELECT sum((a AND b)::INT) AS rr, sum((a AND NOT b)::INT) AS rw, sum((NOT a AND b)::INT) AS wr, sum((NOT a AND NOT b)::INT) AS ww FROM p) SELECT rr::BIGINT AS rr, rw::BIGINT AS rw, wr::BIGINT AS wr, ww::BIGINT AS ww, round((abs(rw - wr) - 1)::DOUBLE ** 2 / (rw + wr), 6) AS chi2 FROM c")
def sta2_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select((F.col("value") > 10).alias("a"), (F.col("event_id") % 3 > 0).alias("b"))
    return significance.mcnemar(e, "a", "b")


def _topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    kr = labels(spark, sf)
    return metrics.b_cubed(kr, ["topic_id"]).select("topic_id", F.col("f1").alias("a")).join(metrics.muc(kr, ["topic_id"]).select("topic_id", F.col("f1").alias("b")), "topic_id")


@query("sta3_permutation")
def sta3(spark: SparkSession, sf: str) -> DataFrame:
    return significance.permutation(_topic_scores(spark, sf), "topic_id", "a", "b")


@query("sta4_bootstrap")
def sta4(spark: SparkSession, sf: str) -> DataFrame:
    return significance.bootstrap(_topic_scores(spark, sf), "topic_id", "a", "b")


@query("sta6_largest_chains", M + "SELECT chain, count(*) AS size FROM m GROUP BY 1 ORDER BY size DESC, chain LIMIT 20")
def sta6(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("chain").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "chain").limit(20)


@query("events_by_hour", "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.event_windows(read(spark, sf, "events"))


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, no""")  # fmt: skip
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sessions(read(spark, sf, "events"))
