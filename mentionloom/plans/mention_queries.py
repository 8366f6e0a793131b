"""Queries over mentions: projections, filters, joins, dictionaries, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.operators import mention_ops as ops
from mentionloom.plans.registry import M, mentions, query
from mentionloom.sources.tables import read

# -- projections and filters --------------------------------------------------------------------------------------

_FULL = r"""
WITH a AS (SELECT DISTINCT article_id, title, description, text FROM articles),
 p AS (SELECT article_id, unnest([{'i': 0, 'v': trim(title)}, {'i': 1, 'v': trim(description)}, {'i': 2, 'v': trim(text)}]) AS x FROM a),
 f AS (SELECT article_id, x.i AS i, CASE WHEN regexp_matches(x.v, '[.!?。！？]$') THEN x.v ELSE x.v || '.' END AS v FROM p WHERE length(x.v) > 0)
SELECT article_id, md5(string_agg(v, chr(10) ORDER BY i)) AS fulltext_md5, sum(length(v))::BIGINT + count(*) - 1 AS chars,
 max(CASE WHEN i = 0 THEN length(v) + 1 ELSE 0 END)::BIGINT + max(CASE WHEN i = 1 THEN length(v) + 1 ELSE 0 END)::BIGINT AS text_offset FROM f GROUP BY 1"""


@query("prj1_fulltext", _FULL)
def prj1(spark: SparkSession, sf: str) -> DataFrame:
    """Title, description and text, each ended by a stop, one under the other; offsets of the text."""
    a = read(spark, sf, "articles").select("article_id", "title", "description", "text").distinct()
    ended = lambda c: F.when(F.length(F.trim(c)) > 0, F.when(F.trim(c).rlike("[.!?。！？]$"), F.trim(c)).otherwise(F.concat(F.trim(c), F.lit("."))))
    t, d, x = ended(F.col("title")), ended(F.col("description")), ended(F.col("text"))
    full = F.concat_ws("\n", t, d, x)
    size = lambda c: F.coalesce(F.length(c) + 1, F.lit(0))
    return a.where(t.isNotNull() | d.isNotNull() | x.isNotNull()).select(
        "article_id", F.md5(full).alias("fulltext_md5"), F.length(full).cast("long").alias("chars"), (size(t) + size(d)).cast("long").alias("text_offset"))


@query("prj2_sentence_offsets", M + "SELECT mention_id, first_tok - min(first_tok) OVER (PARTITION BY doc_id, sent_id) AS offset_in_sentence FROM m")
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "sent_id")
    return mentions(spark, sf).select("mention_id", (F.col("first_tok") - F.min("first_tok").over(w)).alias("offset_in_sentence"))


@query("prj3_stable_mention_id", M + "SELECT mention_id, md5(concat_ws('|', doc_id, sent_id, text, first_tok)) AS stable_id FROM m")
def prj3(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", ops.stable_id(*map(F.col, ("doc_id", "sent_id", "text", "first_tok"))).alias("stable_id"))


@query("prj4_entity_name", M + """, r AS (SELECT chain, text, count(*) AS n, row_number() OVER (PARTITION BY chain ORDER BY count(*) DESC, text) AS i FROM m GROUP BY 1, 2),
 e AS (SELECT chain, md5(string_agg(mention_id, ',' ORDER BY mention_id)) AS entity_id, count(*) AS size FROM m GROUP BY 1)
SELECT chain, entity_id, concat_ws('_', text, size, substr(entity_id, 1, 7)) AS name FROM e JOIN (SELECT chain, text FROM r WHERE i = 1) USING (chain)""")  # fmt: skip
def prj4(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    best = ops.first_of(m.groupBy("chain", "text").agg(F.count("*").alias("n")), ["chain"], [F.desc("n"), F.asc("text")])
    e = m.groupBy("chain").agg(F.md5(F.array_join(F.array_sort(F.collect_list("mention_id")), ",")).alias("entity_id"), F.count("*").alias("size"))
    return e.join(best.select("chain", "text"), "chain").select("chain", "entity_id", F.concat_ws("_", "text", F.col("size").cast("string"), F.substring("entity_id", 1, 7)).alias("name"))


@query("prj5_entity_or_event", M + "SELECT mention_id, CASE WHEN kind = 'ACT' THEN 'event' WHEN kind IN ('HUM', 'LOC', 'GRP', 'NON') THEN 'entity' WHEN length(words[1]) > 0 AND list_contains(['the', 'la', 'le', 'der', 'die', 'das', 'el'], words[1]) THEN 'entity' WHEN len(words) = 1 THEN 'event' ELSE 'entity' END AS side FROM m")
def prj5(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get("words", F.lit(0))
    return mentions(spark, sf).select("mention_id", F.when(F.col("kind") == "ACT", "event").when(F.col("kind").isin("HUM", "LOC", "GRP", "NON"), "entity").when(
        first.isin("the", "la", "le", "der", "die", "das", "el"), "entity").when(F.size("words") == 1, "event").otherwise("entity").alias("side"))


@query("prj6_document_id", "SELECT DISTINCT article_id, regexp_replace(source_domain, '\\W', '', 'g') || '_' || article_id AS document FROM articles")
def prj6(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "articles").select("article_id", "source_domain").distinct()
    return a.select("article_id", F.concat_ws("_", F.regexp_replace("source_domain", r"\W", ""), F.col("article_id").cast("string")).alias("document"))


@query("prj7_mention_class", M + "SELECT mention_id, CASE WHEN contains(upper(kind), 'ACT') THEN 'ACTION' WHEN contains(upper(kind), 'LOC') THEN 'LOCATION' WHEN contains(upper(kind), 'NON') THEN 'NON_HUMAN' WHEN contains(upper(kind), 'HUM') THEN 'HUMAN' WHEN contains(upper(kind), 'GRP') THEN 'HUMAN' WHEN contains(upper(kind), 'TIM') THEN 'TIME' ELSE 'UNKNOWN' END AS class FROM m")
def prj7(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", ops.mention_class(F.col("kind")).alias("class"))


@query("prj8_continuity", M + "SELECT mention_id, list_max(tok_ids) - list_min(tok_ids) + 1 = len(list_distinct(tok_ids)) AS contiguous, is_continuous FROM m")
def prj8(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", ops.is_contiguous(F.col("tok_ids")).alias("contiguous"), "is_continuous")


@query("prj9_topic_of_document", M + "SELECT DISTINCT doc_id, split_part(doc_id, '_', 1) AS topic, CASE WHEN contains(topic_id, 'plus') THEN 'plus' ELSE 'base' END AS category FROM m")
def prj9(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("doc_id", F.split_part("doc_id", F.lit("_"), F.lit(1)).alias("topic"), F.when(F.col("topic_id").contains("plus"), "plus").otherwise("base").alias("category")).distinct()


@query("flt4_relevant_entities", M + ", s AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, sent_id FROM m)) SELECT chain, count(*) AS members FROM m GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT n FROM s) AND min(kind) = 'HUM'")
def flt4(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    total = m.select("doc_id", "sent_id").distinct().agg(F.count("*").alias("sentences"))
    g = m.groupBy("chain").agg(F.count("*").alias("members"), F.min("kind").alias("kind")).crossJoin(total)  # one row
    return g.where((F.col("members") >= 0.02 * F.col("sentences")) & (F.col("kind") == "HUM")).select("chain", "members")


@query("flt6_excluded_type", M + "SELECT kind, count(*) AS n FROM m WHERE kind <> 'GRP' GROUP BY 1")
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).where("kind <> 'GRP'").groupBy("kind").agg(F.count("*").alias("n"))


@query("flt9_stop_words", M + ", s AS (SELECT unnest(words) AS word FROM m) SELECT word, count(*) AS n FROM s WHERE word IN ('the', 'a', 'of', 'la', 'el', 'de', 'le', 'die', 'der', 'das') GROUP BY 1")
def flt9(spark: SparkSession, sf: str) -> DataFrame:
    w = mentions(spark, sf).select(F.explode("words").alias("word"))
    return w.where(F.col("word").isin("the", "a", "of", "la", "el", "de", "le", "die", "der", "das")).groupBy("word").agg(F.count("*").alias("n"))


# -- joins -----------------------------------------------------------------------------------------------------------

_AB = M + ", a AS (SELECT * FROM m WHERE kind = 'HUM'), b AS (SELECT * FROM m WHERE kind <> 'HUM')"


@query("jn1_extracted_and_annotated", M + """, x AS (SELECT DISTINCT doc_id, sent_id, head FROM m WHERE is_continuous), y AS (SELECT DISTINCT doc_id, sent_id, head, chain FROM m WHERE score = -1)
SELECT doc_id, sent_id, head, chain, x.head IS NOT NULL AND chain IS NOT NULL AS matched FROM x FULL JOIN y USING (doc_id, sent_id, head)""".replace("x.head IS NOT NULL AND chain IS NOT NULL", "(x.head IS NOT NULL AND y.chain IS NOT NULL)"))  # fmt: skip
def jn1(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted left-joined to annotated spans, unmatched annotated ones added again: a full outer join."""
    m = mentions(spark, sf)
    x = m.where("is_continuous").select("doc_id", "sent_id", "head").distinct().withColumn("l", F.lit(True))
    y = m.where("score = -1").select("doc_id", "sent_id", "head", "chain").distinct()
    j = x.join(y, ["doc_id", "sent_id", "head"], "full")
    return j.select("doc_id", "sent_id", "head", "chain", (F.col("l").isNotNull() & F.col("chain").isNotNull()).alias("matched"))


@query("jn3_unknown_heads", _AB + "SELECT DISTINCT doc_id, sent_id, head FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.head = b.head)")
def jn3(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return m.where("kind <> 'HUM'").join(m.where("kind = 'HUM'"), ["doc_id", "sent_id", "head"], "left_anti").select("doc_id", "sent_id", "head").distinct()


_PH = M + ", p AS (SELECT DISTINCT topic_id, chain, array_to_string(list_sort(list_distinct(words)), ' ') AS phrase FROM m WHERE len(words) > 0), w2 AS (SELECT *, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS n FROM p)"


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = mentions(spark, sf).where(F.size("words") > 0).select("topic_id", "chain", F.array_sort(F.array_distinct("words")).alias("w")).distinct()
    return p.select("topic_id", "chain", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"), F.explode("w").alias("word"))


@query("jn13_span_match", _AB + """SELECT DISTINCT a.mention_id AS a_id, b.mention_id AS b_id, CASE WHEN a.text = b.text AND a.first_tok = b.first_tok THEN 'strict' WHEN a.text = b.text THEN 'text' ELSE 'inside' END AS how
FROM a JOIN b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND (a.text = b.text OR contains(a.text, b.text) OR contains(b.text, a.text))""")  # fmt: skip
def jn13(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    a = m.where("kind = 'HUM'").select("doc_id", "sent_id", F.col("mention_id").alias("a_id"), F.col("text").alias("ta"), F.col("first_tok").alias("fa"))
    b = m.where("kind <> 'HUM'").select("doc_id", "sent_id", F.col("mention_id").alias("b_id"), F.col("text").alias("tb"), F.col("first_tok").alias("fb"))
    j = a.join(b, ["doc_id", "sent_id"]).where((F.col("ta") == F.col("tb")) | F.col("ta").contains(F.col("tb")) | F.col("tb").contains(F.col("ta")))
    how = F.when((F.col("ta") == F.col("tb")) & (F.col("fa") == F.col("fb")), "strict").when(F.col("ta") == F.col("tb"), "text").otherwise("inside")
    return j.select("a_id", "b_id", how.alias("how")).distinct()


@query("jn14_shared_tokens", M + ", t AS (SELECT doc_id, sent_id, mention_id, unnest(tok_ids) AS tok FROM m) SELECT x.doc_id, x.sent_id, x.mention_id AS a_id, y.mention_id AS b_id, count(*) AS shared FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND x.tok = y.tok AND x.mention_id < y.mention_id GROUP BY ALL")
def jn14(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return ops.span_overlap(m, m, ["doc_id", "sent_id"])


@query("jn16_argument_match", M + """, e AS (SELECT * FROM m WHERE kind = 'ACT'), n AS (SELECT * FROM m WHERE kind IN ('LOC', 'HUM')),
 c AS (SELECT e.mention_id AS event_id, n.mention_id AS entity_id, n.kind AS role, row_number() OVER (PARTITION BY e.mention_id, n.kind ORDER BY abs(n.first_tok - e.first_tok), n.mention_id) AS i FROM e JOIN n ON e.doc_id = n.doc_id AND e.sent_id = n.sent_id)
SELECT event_id, entity_id, role FROM c WHERE i = 1""")  # fmt: skip
def jn16(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    e = m.where("kind = 'ACT'").select("doc_id", "sent_id", F.col("mention_id").alias("event_id"), F.col("first_tok").alias("fe"))
    n = m.where("kind IN ('LOC', 'HUM')").select("doc_id", "sent_id", F.col("mention_id").alias("entity_id"), F.col("kind").alias("role"), F.col("first_tok").alias("fn"))
    j = e.join(n, ["doc_id", "sent_id"]).withColumn("gap", F.abs(F.col("fn") - F.col("fe")))
    return ops.first_of(j, ["event_id", "role"], [F.asc("gap"), F.asc("entity_id")]).select("event_id", "entity_id", "role")


_NEAR = _AB + """, c AS (SELECT a.doc_id, a.sent_id, a.mention_id AS left_id, b.mention_id AS right_id, {gap} AS gap FROM a JOIN b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND {cond})
SELECT doc_id, sent_id, left_id, right_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, right_id DESC) AS i FROM c) WHERE i = 1"""  # fmt: skip


@query("jn17_nearest_left", _NEAR.replace("{gap}", "a.first_tok - b.last_tok").replace("{cond}", "b.last_tok < a.first_tok - 1"))
def jn17_left(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return ops.nearest(m.where("kind = 'HUM'"), m.where("kind <> 'HUM'"), ["doc_id", "sent_id"], "left")


@query("jn17_nearest_right", _NEAR.replace("{gap}", "b.first_tok - a.last_tok").replace("{cond}", "b.first_tok > a.last_tok + 1").replace("right_id DESC", "right_id"))
def jn17_right(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return ops.nearest(m.where("kind = 'HUM'"), m.where("kind <> 'HUM'"), ["doc_id", "sent_id"], "right")


@query("jn17_nearest_event", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT * FROM events WHERE event_type = 'click'),
 j AS (SELECT e.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS click_id FROM e JOIN c ON e.user_id = c.user_id AND c.ts <= e.ts GROUP BY 1)
SELECT event_id, click_id FROM j""")  # fmt: skip
def jn17_events(spark: SparkSession, sf: str) -> DataFrame:
    """As-of: the last click of a user before each error, by one window over the merged timeline."""
    ev = read(spark, sf, "events").where("event_type IN ('error', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = ev.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return t.where("event_type = 'error' AND click_id IS NOT NULL").select("event_id", "click_id")


@query("jn19_paragraphs_of_codings", r"""WITH c AS (SELECT DISTINCT Document_name, Code, Segment, Beginning FROM codings), a AS (SELECT DISTINCT doc_key, text FROM articles WHERE text IS NOT NULL),
 l AS (SELECT doc_key, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM a)
SELECT Document_name, Code, Segment, Beginning, min(line_no)::INT AS line_no FROM c JOIN l ON Document_name = doc_key AND contains(line, Segment) GROUP BY ALL""")  # fmt: skip
def jn19(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "codings").select("Document_name", "Code", "Segment", "Beginning").distinct()
    a = read(spark, sf, "articles").where("text IS NOT NULL").select(F.col("doc_key").alias("Document_name"), "text").distinct()
    coded = a.join(c.select("Document_name").distinct(), "Document_name", "left_semi")
    line = coded.select("Document_name", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return c.join(line, "Document_name").where(F.col("line").contains(F.col("Segment"))).groupBy("Document_name", "Code", "Segment", "Beginning").agg(F.min("line_no").cast("int").alias("line_no"))


_CFG = ["candidates_origin_type", "candidates_coref_extraction_strategy", "candidates_change_head", "candidates_phrase_extension", "dataset", "candidates_annot_index", "entities_method", "entities_param_source", "entities_custom_file_id", "entities_word_vectors"]


@query("jn21_configs_to_run", "WITH f AS (SELECT * FROM experiments WHERE experiment_num % 2 = 0) SELECT experiment_num FROM experiments e WHERE NOT EXISTS (SELECT 1 FROM f WHERE " + " AND ".join(f"f.{c} IS NOT DISTINCT FROM e.{c}" for c in _CFG) + ")")
def jn21(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations without a finished equal one: a null-safe anti join."""
    e = read(spark, sf, "experiments")
    done = e.where("experiment_num % 2 = 0").select(*[F.col(c).alias(f"d_{c}") for c in _CFG])
    cond = None
    for c in _CFG:
        cond = F.col(c).eqNullSafe(F.col(f"d_{c}")) if cond is None else cond & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    return e.join(done, cond, "left_anti").select("experiment_num")


@query("jn22_running_sentence_index", M + ", s AS (SELECT topic_id, doc_id, max(sent_id) + 1 AS n FROM m GROUP BY ALL), o AS (SELECT topic_id, doc_id, sum(n) OVER (PARTITION BY topic_id ORDER BY doc_id) - n AS start FROM s) SELECT mention_id, (start + sent_id)::BIGINT AS global_sentence FROM m JOIN o USING (topic_id, doc_id)")
def jn22(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    s = m.groupBy("topic_id", "doc_id").agg((F.max("sent_id") + 1).alias("n"))
    o = s.withColumn("start", F.sum("n").over(Window.partitionBy("topic_id").orderBy("doc_id")) - F.col("n"))
    return m.join(o, ["topic_id", "doc_id"]).select("mention_id", (F.col("start") + F.col("sent_id")).cast("long").alias("global_sentence"))


# -- dictionaries and aggregates -------------------------------------------------------------------------------------


@query("agg1_word_types", M + ", v AS (SELECT unnest(words) AS word, kind FROM m), n AS (SELECT word, kind, count(*) AS n FROM v GROUP BY ALL) SELECT word, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, kind) AS i FROM n) WHERE i = 1")
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    return ops.word_type_votes(mentions(spark, sf)).select("word", "kind", "n")


@query("agg7_entity_type_vote", M + ", v AS (SELECT chain, kind, sum(CASE WHEN is_continuous THEN 1.0 ELSE 0.5 END) AS w FROM m GROUP BY ALL) SELECT chain, kind, w FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY w DESC, kind) AS i FROM v) WHERE i = 1".replace("sum(CASE", "CAST(sum(CASE").replace("END) AS w", "END) AS DOUBLE) AS w"))
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    v = mentions(spark, sf).groupBy("chain", "kind").agg(F.sum(F.when(F.col("is_continuous"), 1.0).otherwise(0.5)).alias("w"))
    return ops.first_of(v, ["chain"], [F.desc("w"), F.asc("kind")]).select("chain", "kind", "w")


@query("agg9_plural_majority", M + "SELECT chain, CASE WHEN sum((head LIKE '%s')::INT) > 0 AND sum((head LIKE '%s')::INT) >= sum((head NOT LIKE '%s')::INT) THEN 'plural' ELSE 'singular' END AS number FROM m GROUP BY 1")
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    g = mentions(spark, sf).groupBy("chain").agg(F.count_if(F.col("head").endswith("s")).alias("p"), F.count_if(~F.col("head").endswith("s")).alias("s"))
    return g.select("chain", F.when((F.col("p") > 0) & (F.col("p") >= F.col("s")), "plural").otherwise("singular").alias("number"))


@query("agg11_word_counts", M + ", v AS (SELECT chain, unnest(words) AS word FROM m) SELECT chain, word, count(*) AS n FROM v GROUP BY ALL")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("chain", F.explode("words").alias("word")).groupBy("chain", "word").agg(F.count("*").alias("n"))


@query("agg12_representative_phrases", M + """, p AS (SELECT chain, text, count(*) AS n, any_value(len(words)) AS len FROM m WHERE len(words) > 0 GROUP BY ALL), s AS (SELECT *, round(ln(1 + len) * ln(1 + n), 6) AS relevance FROM p)
SELECT chain, text, relevance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY relevance DESC, text) AS rank FROM s) WHERE rank <= 5""")  # fmt: skip
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    p = mentions(spark, sf).where(F.size("words") > 0).groupBy("chain", "text").agg(F.count("*").alias("n"), F.first(F.size("words")).alias("len"))
    s = p.withColumn("relevance", F.round(F.log1p("len") * F.log1p("n"), 6))
    return ops.top_of(s, ["chain"], [F.desc("relevance"), F.asc("text")], 5).select("chain", "text", "relevance", "rank")


@query("agg13_share_above_threshold", "SELECT user_id, round(sum((event_type = 'click' AND value > 10)::INT) / greatest(sum((value > 10)::INT), 1)::DOUBLE, 6) AS share FROM events GROUP BY 1")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "click") & (F.col("value") > 10)).alias("a"), F.count_if(F.col("value") > 10).alias("b"))
    return g.select("user_id", F.round(F.col("a") / F.greatest("b", F.lit(1)), 6).alias("share"))


@query("agg14_split_statistics", M + "SELECT coalesce(topic_id, 'Total') AS split, count(*) AS mentions, count(DISTINCT chain) AS chains, sum((kind = 'ACT')::INT)::BIGINT AS events FROM m GROUP BY ROLLUP (topic_id)")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    r = mentions(spark, sf).rollup("topic_id").agg(F.count("*").alias("mentions"), F.count_distinct("chain").alias("chains"), F.count_if(F.col("kind") == "ACT").alias("events"))
    return r.select(F.coalesce("topic_id", F.lit("Total")).alias("split"), "mentions", "chains", "events")


@query("agg15_chain_counts", M + "SELECT coalesce(kind, 'Total') AS kind, count(DISTINCT chain) AS chains, count(DISTINCT CASE WHEN is_singleton THEN chain END) AS singletons FROM m GROUP BY ROLLUP (kind)")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    r = mentions(spark, sf).rollup("kind").agg(F.count_distinct("chain").alias("chains"), F.count_distinct(F.when(F.col("is_singleton"), F.col("chain"))).alias("singletons"))
    return r.select(F.coalesce("kind", F.lit("Total")).alias("kind"), "chains", "singletons")


@query("agg17_mean_by_setup", "SELECT dataset, entities_method, round(avg(candidates_annot_index), 6) AS mean_index, count(*) AS runs FROM experiments GROUP BY ALL")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "experiments").groupBy("dataset", "entities_method").agg(F.round(F.avg("candidates_annot_index"), 6).alias("mean_index"), F.count("*").alias("runs"))


@query("agg18_time_per_mention", M + ", t AS (SELECT topic_id, count(*) AS n, max(last_tok) AS s FROM m GROUP BY 1) SELECT topic_id, round(s / n::DOUBLE, 6) AS per_mention FROM t")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("topic_id").agg(F.round(F.max("last_tok") / F.count("*"), 6).alias("per_mention"))


@query("agg19_merge_purity", M + """, n AS (SELECT head, chain, count(*) AS n FROM m WHERE head IS NOT NULL GROUP BY ALL), t AS (SELECT head, sum(n) AS t FROM n GROUP BY 1)
SELECT head, round(sum(n * n) / (any_value(t) * any_value(t))::DOUBLE, 6) AS purity FROM n JOIN t USING (head) GROUP BY 1""")  # fmt: skip
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).where("head IS NOT NULL").groupBy("head", "chain").agg(F.count("*").alias("n"))
    return n.groupBy("head").agg(F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("purity"))


@query("agg20_cluster_errors", M + """, c AS (SELECT mention_id, head, chain, count(*) OVER (PARTITION BY head) AS n, count(*) OVER (PARTITION BY head, chain) AS same FROM m WHERE head IS NOT NULL)
SELECT mention_id FROM c WHERE n > 1 AND 1 - (same - 1) / (n - 1)::DOUBLE > 0.7""")  # fmt: skip
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that disagree with more than 70 % of their cluster: counts by (head, chain) joined back, no window over a
    hot head."""
    m = mentions(spark, sf).where("head IS NOT NULL").select("mention_id", "head", "chain")
    s = m.groupBy("head", "chain").agg(F.count("*").alias("same"))
    n = s.groupBy("head").agg(F.sum("same").alias("n"))
    wrong = s.join(n, "head").where((F.col("n") > 1) & (1 - (F.col("same") - 1) / (F.col("n") - 1) > 0.7)).select("head", "chain")
    return m.join(wrong, ["head", "chain"]).select("mention_id")


@query("agg21_segments_found", """WITH c AS (SELECT DISTINCT Document_name, Segment FROM codings), a AS (SELECT DISTINCT doc_key, text FROM articles WHERE text IS NOT NULL),
 x AS (SELECT Document_name, count(*) AS expected, sum(contains(text, Segment)::INT) AS found FROM c JOIN a ON Document_name = doc_key GROUP BY 1)
SELECT Document_name, expected, found::BIGINT AS found FROM x WHERE found >= 0.5 * expected""")  # fmt: skip
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "codings").select("Document_name", "Segment").distinct()
    a = read(spark, sf, "articles").where("text IS NOT NULL").select(F.col("doc_key").alias("Document_name"), "text").distinct()
    g = c.join(a, "Document_name").groupBy("Document_name").agg(F.count("*").alias("expected"), F.count_if(F.col("text").contains(F.col("Segment"))).alias("found"))
    return g.where("found >= 0.5 * expected")


@query("agg22_page_of_core", M + ", n AS (SELECT topic_id, head, chain, count(*) AS n FROM m WHERE head IS NOT NULL GROUP BY ALL) SELECT topic_id, head, chain AS page, n FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, head ORDER BY n DESC, chain) AS i FROM n) WHERE i = 1")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).where("head IS NOT NULL").groupBy("topic_id", "head", "chain").agg(F.count("*").alias("n"))
    return ops.first_of(n, ["topic_id", "head"], [F.desc("n"), F.asc("chain")]).select("topic_id", "head", F.col("chain").alias("page"), "n")


@query("agg24_tf_idf", M + """, v AS (SELECT chain, unnest(words) AS word FROM m), tf AS (SELECT chain, word, count(*) AS tf FROM v GROUP BY ALL), n AS (SELECT count(DISTINCT chain) AS n FROM tf), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
 w3 AS (SELECT chain, word, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN df USING (word), n) SELECT chain, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY chain)), 5) AS weight FROM w3""")  # fmt: skip
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    tf = mentions(spark, sf).select("chain", F.explode("words").alias("word")).groupBy("chain", "word").agg(F.count("*").alias("tf"))
    n = tf.agg(F.count_distinct("chain").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    x = tf.join(df, "word").crossJoin(n).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    length = x.groupBy("chain").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return x.join(length, "chain").select("chain", "word", F.round(F.col("x") / F.col("l"), 5).alias("weight"))


# -- windows, sorts, limits, set operations --------------------------------------------------------------------------


@query("win1_latest_per_config", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def win1(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each configuration; max_by combines before the shuffle where a window would not."""
    e = read(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win3_suffix_heads", M + ", n AS (SELECT head, count(*) AS n FROM m WHERE head IS NOT NULL GROUP BY 1) SELECT head, n FROM (SELECT *, row_number() OVER (PARTITION BY substr(head, 2) ORDER BY n DESC, head) AS i FROM n) WHERE i = 1")
def win3(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).where("head IS NOT NULL").groupBy("head").agg(F.count("*").alias("n")).withColumn("suffix", F.expr("substring(head, 2)"))
    return ops.first_of(n, ["suffix"], [F.desc("n"), F.asc("head")]).select("head", "n")


_PAIRS = M + ", e AS (SELECT DISTINCT topic_id, chain, head FROM m), p AS (SELECT x.topic_id, x.chain AS a, y.chain AS b, count(*) AS shared FROM e x JOIN e y ON x.topic_id = y.topic_id AND x.head = y.head AND x.chain < y.chain GROUP BY ALL)"


@query("win4_best_partner", _PAIRS + " SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS i FROM p) WHERE i = 1")
def win4(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_of(ops.head_overlap(mentions(spark, sf), ["topic_id"], "chain", "head"), ["a"], [F.desc("shared"), F.asc("b")]).select("a", "b", "shared")


@query("win5_top_neighbours", _PAIRS + """, o AS (SELECT a, b, shared::DOUBLE AS s FROM (SELECT a, b, shared FROM p UNION ALL SELECT b, a, shared FROM p) UNION ALL SELECT chain, chain, 0.95 * count(*) FROM e GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM o QUALIFY r <= 4), w5 AS (SELECT *, max(CASE WHEN a = b THEN r END) OVER (PARTITION BY a) AS own FROM k)
SELECT a, CASE WHEN own IS NULL AND r = 4 THEN a ELSE b END AS b, r::INT AS rank FROM w5 WHERE r <= coalesce(own, 4)""")  # fmt: skip
def win5(spark: SparkSession, sf: str) -> DataFrame:
    """The four most similar of each entity, itself damped by 0.95 among them, up to and with itself."""
    m = mentions(spark, sf)
    p = ops.head_overlap(m, ["topic_id"], "chain", "head")
    own = m.select("topic_id", "chain", "head").distinct().groupBy("chain").agg((0.95 * F.count("*")).alias("s"))
    o = p.select("a", "b", F.col("shared").cast("double").alias("s")).union(p.select("b", "a", F.col("shared").cast("double"))).union(own.select("chain", "chain", "s"))
    k = ops.top_of(o, ["a"], [F.desc("s"), F.asc("b")], 4)
    place = k.where("a = b").select("a", F.col("rank").alias("own"))
    j = k.join(place, "a", "left").where(F.col("rank") <= F.coalesce("own", F.lit(4)))
    return j.select("a", F.when(F.col("own").isNull() & (F.col("rank") == 4), F.col("a")).otherwise(F.col("b")).alias("b"), "rank")


@query("win6_global_best_pair", _PAIRS + " SELECT a, b, shared FROM p ORDER BY shared DESC, a, b LIMIT 1")
def win6(spark: SparkSession, sf: str) -> DataFrame:
    return ops.head_overlap(mentions(spark, sf), ["topic_id"], "chain", "head").orderBy(F.desc("shared"), "a", "b").limit(1).select("a", "b", "shared")


@query("win9_primary_entity", M + ", z AS (SELECT chain, count(*) AS size FROM m GROUP BY 1), c AS (SELECT DISTINCT doc_id, sent_id, chain, size FROM m JOIN z USING (chain)) SELECT doc_id, sent_id, chain FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY size DESC, chain) AS i FROM c) WHERE i = 1")
def win9(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    c = m.join(m.groupBy("chain").agg(F.count("*").alias("size")), "chain")
    return c.groupBy("doc_id", "sent_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "chain")).alias("b")).select("doc_id", "sent_id", F.col("b.chain").alias("chain"))


@query("win10_chain_numbers", M + ", c AS (SELECT DISTINCT doc_id, chain FROM m) SELECT doc_id, chain, (dense_rank() OVER (PARTITION BY split_part(doc_id, '_', 1) ORDER BY doc_id) * 10000 + dense_rank() OVER (PARTITION BY doc_id ORDER BY chain))::BIGINT AS chain_no FROM c")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of chains within documents, offset by document: documents are numbered within their topic."""
    c = mentions(spark, sf).select("doc_id", "chain").distinct().withColumn("t", F.split_part("doc_id", F.lit("_"), F.lit(1)))
    no = F.dense_rank().over(Window.partitionBy("t").orderBy("doc_id")) * 10000 + F.dense_rank().over(Window.partitionBy("doc_id").orderBy("chain"))
    return c.select("doc_id", "chain", no.cast("long").alias("chain_no"))


@query("srt1_entities_by_size", M + "SELECT chain, count(*) AS size FROM m GROUP BY 1 ORDER BY size DESC, chain")
def srt1(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("chain").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "chain")


@query("srt2_evaluation_order", M + "SELECT topic_id, chain, mention_id FROM m ORDER BY topic_id, chain, mention_id")
def srt2(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("topic_id", "chain", "mention_id").orderBy("topic_id", "chain", "mention_id")


@query("lim1_top_wordsets", M + ", p AS (SELECT chain, array_to_string(list_sort(list_distinct(words)), ' ') AS wordset, count(*) AS n FROM m GROUP BY ALL) SELECT chain, wordset, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY n DESC, wordset) AS rank FROM p) WHERE rank <= 6")
def lim1(spark: SparkSession, sf: str) -> DataFrame:
    p = mentions(spark, sf).groupBy("chain", F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("wordset")).agg(F.count("*").alias("n"))
    return ops.top_of(p, ["chain"], [F.desc("n"), F.asc("wordset")], 6).select("chain", "wordset", "n", "rank")


@query("lim2_batches", M + "SELECT mention_id, ((row_number() OVER (PARTITION BY topic_id ORDER BY mention_id) - 1) // 256)::BIGINT AS batch FROM m")
def lim2(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("topic_id").orderBy("mention_id"))
    return mentions(spark, sf).select("mention_id", F.floor((rn - 1) / 256).alias("batch"))


@query("set1_union_of_candidates", M + "SELECT mention_id, 'human' AS origin FROM m WHERE kind = 'HUM' UNION ALL SELECT mention_id, 'multiword' AS origin FROM m WHERE len(tok_ids) > 1")
def set1(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return m.where("kind = 'HUM'").select("mention_id", F.lit("human").alias("origin")).unionByName(m.where(F.size("tok_ids") > 1).select("mention_id", F.lit("multiword").alias("origin")))


@query("set2_unmatched", M + "SELECT chain FROM m WHERE kind = 'HUM' EXCEPT SELECT chain FROM m WHERE is_singleton")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    return m.where("kind = 'HUM'").select("chain").subtract(m.where("is_singleton").select("chain"))


@query("set3_maximal_sets", _PH + ", ph AS (SELECT DISTINCT topic_id, phrase FROM p), v2 AS (SELECT DISTINCT topic_id, phrase, word, n FROM w2), sub AS (SELECT x.topic_id, x.phrase FROM v2 x JOIN v2 y ON x.topic_id = y.topic_id AND x.word = y.word AND x.n < y.n GROUP BY x.topic_id, x.phrase, y.phrase HAVING count(*) = min(x.n)) SELECT topic_id, phrase FROM ph EXCEPT SELECT topic_id, phrase FROM sub")
def set3(spark: SparkSession, sf: str) -> DataFrame:
    """Word sets contained in no larger one."""
    p = _phrases(spark, sf).drop("chain").distinct()
    x = p.select("topic_id", "word", "phrase", F.col("n").alias("na"))
    y = p.select("topic_id", "word", F.col("phrase").alias("outer"), F.col("n").alias("nb"))
    sub = x.join(y, ["topic_id", "word"]).where("na < nb").groupBy("topic_id", "phrase", "outer").agg(F.count("*").alias("c"), F.min("na").alias("na")).where("c = na")
    return p.select("topic_id", "phrase").distinct().join(sub, ["topic_id", "phrase"], "left_anti")


@query("set4_shared_heads", M + ", h AS (SELECT topic_id, list_sort(list_distinct(list(head) FILTER (kind = 'HUM'))) AS x, list_sort(list_distinct(list(head) FILTER (kind <> 'HUM'))) AS y FROM m GROUP BY 1) SELECT topic_id, len(list_intersect(x, y))::BIGINT AS shared FROM h".replace("len(list_intersect(x, y))", "coalesce(len(list_intersect(x, y)), 0)"))
def set4(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).where("head IS NOT NULL").select("topic_id", "head", (F.col("kind") == "HUM").alias("h")).distinct()
    g = m.groupBy("topic_id", "head").agg(F.count("*").alias("sides")).groupBy("topic_id").agg(F.count_if(F.col("sides") == 2).alias("shared"))
    return g


@query("set5_one_parent", M + "SELECT mention_id, count(DISTINCT chain) AS parents FROM m GROUP BY 1 HAVING count(DISTINCT chain) > 1")
def set5(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that would break the rule of one parent each."""
    return mentions(spark, sf).groupBy("mention_id").agg(F.count_distinct("chain").alias("parents")).where("parents > 1")
