"""Queries of phrase operators, further joins and the remaining merge steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.operators import metrics, phrases, sieves, vectors
from mentionloom.plans.method_queries import _E
from mentionloom.plans.registry import KR, M, labels, mentions, query
from mentionloom.plans.text_queries import _TOK, tokens
from mentionloom.session import cut
from mentionloom.sources.tables import read

# -- dependencies of mentions: every word hangs on the last one; the one before it is a compound, others are modifiers --

_DEP = M + """, t AS (SELECT mention_id, doc_id, sent_id, unnest(tok_ids) AS tok, last_tok FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY tok DESC) AS back FROM t),
 dp AS (SELECT DISTINCT doc_id, sent_id, last_tok AS governor, tok AS dependent, CASE WHEN back = 2 THEN 'compound' ELSE 'amod' END AS dep FROM o WHERE tok < last_tok)
"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", "doc_id", "sent_id", F.explode("tok_ids").alias("tok"), "last_tok")


def _deps(spark: SparkSession, sf: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("tok")))
    d = _spans(spark, sf).withColumn("back", back).where("tok < last_tok")
    return d.select("doc_id", "sent_id", F.col("last_tok").alias("governor"), F.col("tok").alias("dependent"), F.when(F.col("back") == 2, "compound").otherwise("amod").alias("dep")).distinct()


@query("ext5_dependency_subset", _DEP + "SELECT mention_id, governor, dependent, dep FROM dp JOIN (SELECT DISTINCT mention_id, doc_id, sent_id, tok FROM t) a ON a.doc_id = dp.doc_id AND a.sent_id = dp.sent_id AND a.tok = governor JOIN (SELECT DISTINCT mention_id, doc_id, sent_id, tok FROM t) b USING (mention_id) WHERE b.doc_id = dp.doc_id AND b.sent_id = dp.sent_id AND b.tok = dependent")
def ext5(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.dependency_subset(_deps(spark, sf), _spans(spark, sf).drop("last_tok").distinct(), "mention_id").select("mention_id", "governor", "dependent", "dep")


@query("ext6_span_heads", _DEP + ", ins AS (SELECT a.mention_id, governor, dependent FROM dp JOIN t a ON a.doc_id = dp.doc_id AND a.sent_id = dp.sent_id AND a.tok = governor JOIN t b ON b.mention_id = a.mention_id AND b.tok = dependent), h AS (SELECT mention_id, min(governor) AS h FROM ins i WHERE NOT EXISTS (SELECT 1 FROM ins j WHERE j.mention_id = i.mention_id AND j.dependent = i.governor) GROUP BY 1) SELECT m.mention_id, coalesce(h, last_tok) AS head FROM m LEFT JOIN h USING (mention_id) WHERE len(tok_ids) > 0")
def ext6_heads(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.span_heads(_deps(spark, sf), _spans(spark, sf).drop("last_tok").distinct(), "mention_id")


@query("ext12_modifier_expansion", _DEP + "SELECT mention_id, dep AS relation, dependent AS tok FROM m JOIN dp ON dp.doc_id = m.doc_id AND dp.sent_id = m.sent_id AND governor = last_tok".replace("SELECT mention_id", "SELECT DISTINCT mention_id"))
def ext12(spark: SparkSession, sf: str) -> DataFrame:
    h = mentions(spark, sf).select("mention_id", "doc_id", "sent_id", F.col("last_tok").alias("head"))
    return phrases.modifier_expansion(_deps(spark, sf), h, "mention_id")


# -- a chain of words: each word depends on the next one of its sentence; words in -ed count as verbs ---------------------


@query("ext4_verb_phrases", _TOK + "SELECT doc_id, sent_id, tok AS head, greatest(tok - 2, 0) AS first_tok, tok AS last_tok, least(tok, 2) + 1::BIGINT AS size FROM tk WHERE word LIKE '%ed'")
def ext4(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf).select("doc_id", "sent_id", F.col("tok").alias("tok_id"), "word", F.when(F.col("word").endswith("ed"), "VBD").otherwise("NN").alias("pos"))
    d = t.where("tok_id > 0").select("doc_id", "sent_id", F.col("tok_id").alias("governor"), (F.col("tok_id") - 1).alias("dependent"), F.lit("dep").alias("dep"))
    return phrases.verb_phrases(t, d)


@query("ext8_quantity_heads", _TOK + ", nx AS (SELECT *, lower(lead(word, 1) OVER w) AS n1, lead(tok, 2) OVER w AS n2 FROM tk WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok)) SELECT doc_id, sent_id, tok AS tok_id, n2 AS head FROM nx WHERE lower(word) IN ('number','group','lot','majority','dozens','hundreds','thousands','couple','half','part','percent') AND n1 = 'of' AND n2 IS NOT NULL")
def ext8(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.quantity_heads(tokens(spark, sf).withColumnRenamed("tok", "tok_id")).where("head <> tok_id")


@query("ext15_entities_of_clusters", M + "SELECT topic_id, chain, kind, count(*) AS members FROM m GROUP BY ALL")
def ext15(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("topic_id", "chain", "kind").agg(F.count("*").alias("members"))


@query("jn15_match_to_gold")
def jn15(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return phrases.match_to_gold(m.where("kind <> 'UNK'").withColumn("last_tok", F.col("first_tok")), m)


# -- joins and aggregates -----------------------------------------------------------------------------------------------


@query("jn5_step_table", KR + ", s AS (SELECT response, min(mention_id) AS first_id, count(*) AS n FROM kr GROUP BY 1 HAVING count(*) > 1) SELECT mention_id, coalesce(first_id, mention_id) AS step_entity FROM kr LEFT JOIN s USING (response)")
def jn5(spark: SparkSession, sf: str) -> DataFrame:
    kr = labels(spark, sf)
    s = kr.groupBy("response").agg(F.min("mention_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return kr.join(s, "response", "left").select("mention_id", F.coalesce("first_id", "mention_id").alias("step_entity"))


@query("jn6_metric_frame", M + ", a AS (SELECT topic_id, count(*) AS mentions FROM m GROUP BY 1), b AS (SELECT topic_id, count(*) AS events FROM m WHERE kind = 'ACT' GROUP BY 1) SELECT a.topic_id, mentions, coalesce(events, 0) AS events FROM a LEFT JOIN b ON a.topic_id = b.topic_id")
def jn6(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    a, b = m.groupBy("topic_id").agg(F.count("*").alias("mentions")), m.where("kind = 'ACT'").groupBy("topic_id").agg(F.count("*").alias("events"))
    return a.join(b, "topic_id", "left").select("topic_id", "mentions", F.coalesce("events", F.lit(0)).alias("events"))


@query("jn7_code_types", M + ", c AS (SELECT Code, count(*) AS n FROM codings GROUP BY 1), k AS (SELECT replace(regexp_replace(chain, '_[0-9]+$', ''), '_', ' ') AS code, min(kind) AS kind FROM m GROUP BY 1) SELECT c.Code, n, coalesce(kind, '') AS kind FROM c LEFT JOIN k ON k.code = c.Code")
def jn7(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "codings").groupBy("Code").agg(F.count("*").alias("n"))
    k = mentions(spark, sf).groupBy(F.translate(F.regexp_replace("chain", "_[0-9]+$", ""), "_", " ").alias("name")).agg(F.min("kind").alias("kind"))
    return c.join(k, F.col("Code") == F.col("name"), "left").select("Code", "n", "kind").fillna("", ["kind"])


@query("jn8_gated_pairs", _E + "SELECT x.topic_id, x.entity AS a, y.entity AS b, r.value AS rule FROM ent x JOIN ent y ON x.topic_id = y.topic_id AND (x.size > y.size OR (x.size = y.size AND x.entity < y.entity)) JOIN rules r ON r.method = 'newer' AND r.step = 'step1' AND r.type_a = x.etype AND r.type_b = y.etype WHERE r.value > 0")
def jn8(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a topic's entities, the larger first, that the type table lets be compared: the gate is joined before the
    partners are, so types that never meet form no pairs."""
    e = sieves.entities(mentions(spark, sf)).select("topic_id", "entity", "size", "etype")
    r = read(spark, sf, "rules").where("method = 'newer' AND step = 'step1' AND value > 0").select(F.col("type_a").alias("etype"), F.col("type_b").alias("tb"), F.col("value").alias("rule"))
    x = e.join(F.broadcast(r), "etype").select("topic_id", F.col("entity").alias("a"), F.col("size").alias("sa"), F.col("tb").alias("etype"), "rule")
    j = x.join(e, ["topic_id", "etype"]).where("sa > size OR (sa = size AND a < entity)")
    return j.select("topic_id", "a", F.col("entity").alias("b"), "rule")


@query("jn9_equal_titles", _E + "SELECT x.topic_id, x.entity AS a, y.entity AS b FROM ent x JOIN ent y ON x.topic_id = y.topic_id AND x.head = y.head AND x.entity < y.entity")
def jn9(spark: SparkSession, sf: str) -> DataFrame:
    e = sieves.entities(mentions(spark, sf))
    return sieves.title_edges(e, e.select("topic_id", "entity", F.col("head").alias("title"))).select("topic_id", "a", "b")


@query("flt7_type_gate", _E + "SELECT r.step, count(*) AS pairs FROM ent x JOIN ent y ON x.topic_id = y.topic_id AND x.head = y.head AND x.entity < y.entity JOIN rules r ON r.method = 'older' AND r.type_a = x.etype AND r.type_b = y.etype AND r.value > 0 GROUP BY 1")
def flt7(spark: SparkSession, sf: str) -> DataFrame:
    e = sieves.entities(mentions(spark, sf))
    p = sieves.head_edges(e).select("topic_id", "a", "b")
    t = e.select("topic_id", "entity", "etype")
    j = p.join(t.select("topic_id", F.col("entity").alias("a"), F.col("etype").alias("type_a")), ["topic_id", "a"]).join(t.select("topic_id", F.col("entity").alias("b"), F.col("etype").alias("type_b")), ["topic_id", "b"])
    r = read(spark, sf, "rules").where("method = 'older' AND value > 0").select("step", "type_a", "type_b")
    return j.join(F.broadcast(r), ["type_a", "type_b"]).groupBy("step").agg(F.count("*").alias("pairs"))


@query("agg8_sense_weights", M + ", n0 AS (SELECT head AS word, kind AS lexname, count(*) AS c FROM m WHERE head IS NOT NULL GROUP BY ALL), s AS (SELECT word, lexname, row_number() OVER (PARTITION BY word ORDER BY c DESC, lexname) - 1 AS rank FROM n0), n AS (SELECT word, count(*) AS n FROM s GROUP BY 1), w2 AS (SELECT word, lexname, sum(2 * (n - rank) / n::DOUBLE) * count(*) / any_value(n) AS w FROM s JOIN n USING (word) GROUP BY ALL) SELECT word, lexname, round(w, 6) AS weight FROM w2 WHERE w >= 0.25")
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    c = mentions(spark, sf).where("head IS NOT NULL").groupBy(F.col("head").alias("word"), F.col("kind").alias("lexname")).agg(F.count("*").alias("c"))
    s = c.select("word", "lexname", (F.row_number().over(Window.partitionBy("word").orderBy(F.desc("c"), "lexname")) - 1).alias("rank"))
    return phrases.sense_weights(s)


@query("met13_filled_labels", KR + ", t AS (SELECT response, arg_min(key, (-n, key)) AS best FROM (SELECT response, key, count(*) AS n FROM kr WHERE kind <> 'UNK' GROUP BY ALL) GROUP BY 1) SELECT mention_id, CASE WHEN kind <> 'UNK' THEN key ELSE coalesce(best, 'UNK') END AS truth FROM kr LEFT JOIN t USING (response)")
def met13(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of unlabelled mentions filled from the most frequent label of equal heads."""
    kr = labels(spark, sf)
    n = kr.where("kind <> 'UNK'").groupBy("response", "key").agg(F.count("*").alias("n"))
    best = n.groupBy("response").agg(F.min_by("key", F.struct((-F.col("n")).alias("o"), "key")).alias("best"))
    return kr.join(best, "response", "left").select("mention_id", F.when(F.col("kind") != "UNK", F.col("key")).otherwise(F.coalesce("best", F.lit("UNK"))).alias("truth"))


@query("sta5_topic_samples")
def sta5(spark: SparkSession, sf: str) -> DataFrame:
    """1000 samples of 20 topics: mean scores of two systems (head words, and head words within documents) on the same
    topics. A hash of sample and topic orders the topics, the first 20 are taken."""
    kr = labels(spark, sf)
    one = metrics.b_cubed(kr, ["topic_id"]).select("topic_id", F.col("f1").alias("a"))
    two = metrics.b_cubed(kr.withColumn("response", F.concat_ws("/", "doc_id", "response")), ["topic_id"]).select("topic_id", F.col("f1").alias("b"))
    r = cut(one.join(two, "topic_id")).select("topic_id", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("replicate"))
    order = Window.partitionBy("replicate").orderBy(F.md5(F.concat_ws("|", F.col("replicate").cast("string"), "topic_id")))
    picked = r.withColumn("i", F.row_number().over(order)).where("i <= 20")
    return picked.groupBy("replicate").agg(F.round(F.avg("a"), 6).alias("f1_a"), F.round(F.avg("b"), 6).alias("f1_b"))


# -- further merge steps ---------------------------------------------------------------------------------------------------


_TFIDF = M + """, v AS (SELECT topic_id, chain, unnest(words) AS word FROM m), tf AS (SELECT topic_id, chain, word, count(*) AS tf FROM v GROUP BY ALL), n AS (SELECT topic_id, count(DISTINCT chain) AS n FROM tf GROUP BY 1), df AS (SELECT topic_id, word, count(*) AS df FROM tf GROUP BY ALL),
 x AS (SELECT topic_id, chain, word, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN df USING (topic_id, word) JOIN n USING (topic_id)), l AS (SELECT topic_id, chain, sqrt(sum(x * x)) AS l FROM x GROUP BY ALL),
 p AS (SELECT a.topic_id, a.chain AS a, b.chain AS b, sum(a.x * b.x) AS d FROM x a JOIN x b ON a.topic_id = b.topic_id AND a.word = b.word AND a.chain < b.chain GROUP BY ALL)
SELECT p.topic_id, p.a, p.b, round(d / (la.l * lb.l), 5) AS sim FROM p JOIN l la ON la.topic_id = p.topic_id AND la.chain = p.a JOIN l lb ON lb.topic_id = p.topic_id AND lb.chain = p.b WHERE d / (la.l * lb.l) >= 0.59"""  # fmt: skip


@query("x3k_tf_idf_edges", _TFIDF)
def x3k(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of TF-IDF vectors of a topic's entities, by an inverted index of words."""
    tf = mentions(spark, sf).select("topic_id", "chain", F.explode("words").alias("word")).groupBy("topic_id", "chain", "word").agg(F.count("*").alias("tf"))
    n = tf.groupBy("topic_id").agg(F.count_distinct("chain").alias("n"))
    df = tf.groupBy("topic_id", "word").agg(F.count("*").alias("df"))
    x = tf.join(df, ["topic_id", "word"]).join(n, "topic_id").select("topic_id", "chain", "word", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    le = x.groupBy("topic_id", "chain").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    a, b = x.select("topic_id", "word", F.col("chain").alias("a"), F.col("x").alias("xa")), x.select("topic_id", "word", F.col("chain").alias("b"), F.col("x").alias("xb"))
    p = a.join(b, ["topic_id", "word"]).where("a < b").groupBy("topic_id", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))
    j = p.join(le.select("topic_id", F.col("chain").alias("a"), F.col("l").alias("la")), ["topic_id", "a"]).join(le.select("topic_id", F.col("chain").alias("b"), F.col("l").alias("lb")), ["topic_id", "b"])
    sim = F.col("d") / (F.col("la") * F.col("lb"))
    return j.where(sim >= 0.6 - 0.01).select("topic_id", "a", "b", F.round(sim, 5).alias("sim"))


@query("clu12_span_vectors", "SELECT vec_id, 192 AS dims, round(embedding[64]::DOUBLE + embedding[1]::DOUBLE, 6) AS edge FROM embeddings")
def clu12(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    span = F.concat("embedding", F.reverse("embedding"), "embedding")
    return e.select("vec_id", F.size(span).alias("dims"), F.round(F.element_at(span, 64).cast("double") + F.element_at(span, 129).cast("double"), 6).alias("edge"))


@query("mtd10_pair_agglomeration")
def mtd10(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of a document merged by best mean pair score: equal heads, shared words and classes score a pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mention_id").reset_index(drop=True)
        sets = [set(w) for w in pdf["words"]]
        n = len(pdf)
        s = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                both = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
                s[i, j] = s[j, i] = 0.6 * both + 0.3 * (pdf["head"][i] == pdf["head"][j]) + 0.1 * (pdf["kind"][i] == pdf["kind"][j])
        label = vectors.best_pair_agglomeration(s, 0.5)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "mention_id": pdf["mention_id"], "cluster": pdf["mention_id"].to_numpy()[label]})

    return mentions(spark, sf).select("doc_id", "mention_id", "words", "head", "kind").groupBy("doc_id").applyInPandas(run, "doc_id string, mention_id string, cluster string")
