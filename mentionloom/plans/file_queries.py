"""Round trips through files - whole tables written to the shared folder and read by the readers -, and operators over spans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import phrases
from mentionloom.plans.annotations import A, annotated
from mentionloom.plans.registry import M, mentions, query
from mentionloom.session import ensure_checkpoint_dir
from mentionloom.sources import readers
from mentionloom.sources.tables import read


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("src8_selected_sentences", M + "SELECT topic_id AS topic, doc_id AS file, array_to_string(list_sort(list_distinct(list(sent_id))), ',') AS sentences FROM m GROUP BY ALL")
def src8(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    mentions(spark, sf).select(F.col("topic_id").alias("topic"), F.col("doc_id").alias("file"), F.col("sent_id").alias("sentence")).write.option("header", True).csv(path)
    back = readers.selected_sentences(spark, path)
    return back.select("topic", "file", F.array_join(F.transform("sentences", lambda x: x.cast("string")), ",").alias("sentences"))


@query("src9_tagged_tokens", A + "SELECT doc_id, sent_id, i::INT AS tok_id, word, CASE WHEN kind <> 'UNK' THEN chain END AS chain, count(*) AS n FROM t GROUP BY ALL")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    t = annotated(spark, sf).select("doc_id", "sent_id", F.col("i").alias("tok_id"), "word", F.when(F.col("kind") == "UNK", "-").otherwise(F.col("chain")).alias("chain"))
    t.write.option("sep", "\t").option("quote", "\0").csv(path)
    return readers.tagged_tokens(spark, path).groupBy("doc_id", "sent_id", "tok_id", "word", "chain").agg(F.count("*").alias("n"))


@query("src11_role_frames", M + "SELECT e.doc_id, e.sent_id, e.head AS verb, a.kind AS role, a.text AS text, len(a.tok_ids)::INT AS size, count(*) AS n FROM m e JOIN m a ON a.doc_id = e.doc_id AND a.sent_id = e.sent_id AND a.mention_id <> e.mention_id WHERE e.kind = 'ACT' AND e.head IS NOT NULL GROUP BY ALL")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the event mentions, the other mentions of their sentence being their arguments."""
    m = mentions(spark, sf)
    a = m.select("doc_id", "sent_id", F.col("mention_id").alias("a_id"), F.struct(F.col("kind").alias("role"), "text", "tok_ids").alias("arg"))
    e = m.where("kind = 'ACT' AND head IS NOT NULL").select("doc_id", "sent_id", "mention_id", "head").join(a, ["doc_id", "sent_id"]).where("a_id <> mention_id")
    v = e.groupBy("doc_id", "sent_id", "mention_id", "head").agg(F.collect_list("arg").alias("args"))
    path = _folder(spark)
    v.groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct(F.col("head").alias("verb"), "args")).alias("verbs")).write.json(path)
    verbs = spark.read.schema("doc_id string, sent_id int, verbs array<struct<verb:string>>").json(path).select("doc_id", "sent_id", F.posexplode("verbs").alias("frame", "v"))
    f = readers.srl_frames(spark, path).join(verbs.select("doc_id", "sent_id", "frame", "v.verb"), ["doc_id", "sent_id", "frame"])
    return f.groupBy("doc_id", "sent_id", "verb", "role", "text", F.size("tok_ids").alias("size")).agg(F.count("*").alias("n"))


@query("src14_text_vectors", "SELECT 'v' || vec_id AS word, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last, len(embedding)::INT AS dims FROM embeddings")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    e = read(spark, sf, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("v"), "vec_id"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    return readers.word_vectors(spark, path, 64).select("word", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("vec", F.lit(63)).cast("double"), 6).alias("last"), F.size("vec").alias("dims"))


@query("src16_listing")
def src16(spark: SparkSession, sf: str) -> DataFrame:
    """The files of the tables' folder."""
    return readers.listing(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")


_NODES = M + ", nd AS (SELECT DISTINCT doc_id, sent_id, first_tok, last_tok FROM m WHERE first_tok IS NOT NULL)"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of a mention as a noun phrase of its sentence."""
    n = mentions(spark, sf).where("first_tok IS NOT NULL").select("doc_id", "sent_id", "first_tok", "last_tok").distinct()
    return n.withColumn("node_id", F.format_string("%s-%d-%d-%d", "doc_id", "sent_id", "first_tok", "last_tok")).withColumn("label", F.lit("NP"))


@query("ext7_extended_phrases", _NODES + ", b AS (SELECT mention_id, max(nd.first_tok) AS nf FROM m JOIN nd ON nd.doc_id = m.doc_id AND nd.sent_id = m.sent_id AND nd.last_tok = m.last_tok AND nd.first_tok < m.first_tok AND nd.last_tok - nd.first_tok + 1 < 20 GROUP BY 1) SELECT mention_id, coalesce(nf, first_tok) AS first_tok, last_tok FROM m LEFT JOIN b USING (mention_id)")
def ext7(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).select("mention_id", "doc_id", "sent_id", "first_tok", "last_tok")
    return phrases.extended_phrases(m, _nodes(spark, sf), "mention_id")


@query("ext3_noun_phrases", _NODES + ", k AS (SELECT DISTINCT doc_id, sent_id, last_tok FROM m WHERE kind = 'ACT'), w2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, last_tok ORDER BY first_tok) AS r FROM nd WHERE last_tok - first_tok + 1 < 20) SELECT doc_id, sent_id, first_tok, last_tok FROM w2 WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = w2.doc_id AND k.sent_id = w2.sent_id AND k.last_tok = w2.last_tok)")
def ext3(spark: SparkSession, sf: str) -> DataFrame:
    """The widest noun phrase of each head that no event mention has; every word counts as one with content."""
    n = _nodes(spark, sf)
    tokens = n.select("doc_id", "sent_id", F.explode(F.sequence("first_tok", "last_tok")).alias("tok_id")).distinct().withColumn("pos", F.lit("NN"))
    known = mentions(spark, sf).where("kind = 'ACT'").select("doc_id", "sent_id", F.col("last_tok").alias("head"))
    return phrases.noun_phrases(n, tokens, 20, known).select("doc_id", "sent_id", "first_tok", "last_tok")


@query("ext17_role_spans", A + "SELECT mention_id, dep AS kind, min(i)::INT AS first_tok, max(i)::INT AS last_tok FROM (SELECT *, i - row_number() OVER (PARTITION BY mention_id, dep ORDER BY i) AS g FROM t) GROUP BY mention_id, dep, g")
def ext17(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of words of one role within a mention, written as B- and I- tags and read as spans."""
    from pyspark.sql import Window

    before = F.lag("dep").over(Window.partitionBy("mention_id").orderBy("i"))
    t = annotated(spark, sf).select("mention_id", "i", "dep", before.alias("before"))
    tags = t.withColumn("tag", F.concat(F.when(F.col("before").eqNullSafe(F.col("dep")), "I-").otherwise("B-"), "dep"))
    return readers.bio_spans(tags, ["mention_id"], "i", "tag").select("mention_id", "kind", "first_tok", "last_tok")
