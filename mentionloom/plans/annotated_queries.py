"""Queries of preprocessing rules over annotated words: filters, joins, dictionaries and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import mention_ops as ops
from mentionloom.plans.annotations import GENERAL_NOUNS, STOPS, TITLES, A, _in, annotated
from mentionloom.plans.registry import M, mentions, query
from mentionloom.sources.tables import read

_STOPS = _in(STOPS)

# -- filters ---------------------------------------------------------------------------------------------------------------

_KEEP = f"""h AS (SELECT mention_id, max(score) AS score, max(n) AS n, max(CASE WHEN i = n - 1 THEN pos END) AS pos, max(CASE WHEN i = n - 1 THEN ner END) AS ner, max(CASE WHEN i = n - 1 THEN word END) AS word, sum((word NOT IN {_STOPS})::INT) AS content FROM t GROUP BY 1),
 kept AS (SELECT mention_id FROM h WHERE coalesce(score, 0) = -1 OR NOT ((n = 1 AND pos = 'DT') OR (pos LIKE 'JJ%' AND ner = 'O' AND content = 1) OR word IN {_in(GENERAL_NOUNS)} OR word IN {_in(TITLES)} OR ner IN ('TIME', 'DATE', 'DURATION')))"""


def kept_mentions(words: DataFrame) -> DataFrame:
    """(mention_id) of the mentions that stay: all annotated ones; of the others none that is a lone determiner or adjective,
    or whose head is a general noun, a title, or a time."""
    head = lambda c: F.max(F.when(F.col("i") == F.col("n") - 1, F.col(c)))
    h = words.groupBy("mention_id").agg(F.max("score").alias("score"), F.max("n").alias("n"), head("pos").alias("pos"), head("ner").alias("ner"), head("word").alias("word"), F.count_if(~F.col("word").isin(*STOPS)).alias("content"))
    lone = ((F.col("n") == 1) & (F.col("pos") == "DT")) | (F.col("pos").startswith("JJ") & (F.col("ner") == "O") & (F.col("content") == 1))
    out = lone | F.col("word").isin(*GENERAL_NOUNS) | F.col("word").isin(*TITLES) | F.col("ner").isin("TIME", "DATE", "DURATION")
    return h.where((F.coalesce("score", F.lit(0.0)) == -1) | ~out).select("mention_id")


@query("flt1_keep_filter", A + f", {_KEEP} SELECT mention_id FROM kept")
def flt1(spark: SparkSession, sf: str) -> DataFrame:
    return kept_mentions(annotated(spark, sf))


@query("flt2_chain_filters", A + ", g AS (SELECT chain, mention_id, max(n) AS n, max(CASE WHEN i = n - 1 THEN pos END) AS pos, max(CASE WHEN i = n - 1 THEN ner END) AS ner, bool_or(word IN ('and', 'und', 'et', 'y')) AS list FROM t GROUP BY ALL) SELECT chain FROM g GROUP BY 1 HAVING NOT bool_and(n = 1 AND pos = 'PRP') AND NOT bool_or(list) AND NOT bool_and(ner = 'TITLE')")
def flt2(spark: SparkSession, sf: str) -> DataFrame:
    """Chains that are not all pronouns, have no list among them and are not all titles."""
    head = lambda c: F.max(F.when(F.col("i") == F.col("n") - 1, F.col(c)))
    g = annotated(spark, sf).groupBy("chain", "mention_id").agg(F.max("n").alias("n"), head("pos").alias("pos"), head("ner").alias("ner"), F.bool_or(F.col("word").isin("and", "und", "et", "y")).alias("list"))
    c = g.groupBy("chain").agg(F.bool_and((F.col("n") == 1) & (F.col("pos") == "PRP")).alias("p"), F.bool_or("list").alias("l"), F.bool_and(F.col("ner") == "TITLE").alias("t"))
    return c.where("NOT p AND NOT l AND NOT t").select("chain")


@query("flt3_phrase_length", A + "SELECT mention_id FROM t GROUP BY 1 HAVING max(n) < 25 AND NOT bool_and(pos IN ('DT', 'EX', 'CD', 'PRP', 'PRP$', 'RB'))")
def flt3(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of fewer than 25 words that are not made of determiners, numbers, pronouns and adverbs alone."""
    g = annotated(spark, sf).groupBy("mention_id").agg(F.max("n").alias("n"), F.bool_and(F.col("pos").isin("DT", "EX", "CD", "PRP", "PRP$", "RB")).alias("all"))
    return g.where("n < 25 AND NOT all").select("mention_id")


@query("flt8_entity_tokens", A + ", d AS (SELECT doc_id, sum((ner <> 'O')::INT) AS names FROM t GROUP BY 1) SELECT doc_id, word, count(*) AS n FROM t JOIN d USING (doc_id) WHERE ner <> 'O' OR names < 3 GROUP BY ALL".replace(", d AS (SELECT doc_id, sum", ", dn AS (SELECT doc_id, sum").replace("JOIN d USING", "JOIN dn USING"))
def flt8(spark: SparkSession, sf: str) -> DataFrame:
    """A document's words inside names, all its words where these are fewer than three."""
    t = annotated(spark, sf)
    d = t.groupBy("doc_id").agg(F.count_if(F.col("ner") != "O").alias("names"))
    return t.join(d, "doc_id").where("ner <> 'O' OR names < 3").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# -- joins -----------------------------------------------------------------------------------------------------------------


@query("jn10_head_overlap", A + ", e AS (SELECT DISTINCT topic_id, chain, word FROM t WHERE ner NOT IN ('O', 'DATE', 'TITLE') AND dep IN ('root', 'compound')) SELECT x.topic_id, x.chain AS a, y.chain AS b, count(*) AS shared FROM e x JOIN e y ON x.topic_id = y.topic_id AND x.word = y.word AND x.chain < y.chain GROUP BY ALL")
def jn10(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that share names among their heads and compounds."""
    t = annotated(spark, sf).where("ner NOT IN ('O', 'DATE', 'TITLE') AND dep IN ('root', 'compound')")
    return ops.head_overlap(t, ["topic_id"], "chain", "word")


_PHR = f""", pm AS (SELECT topic_id, chain, mention_id, array_to_string(list_sort(list_distinct(list(word))), ' ') AS phrase, max(CASE WHEN i = n - 1 THEN word END) AS head FROM t GROUP BY ALL),
 pd AS (SELECT DISTINCT topic_id, chain, phrase, head FROM pm), pw AS (SELECT topic_id, chain, phrase, head, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS size FROM pd)"""


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    t = annotated(spark, sf)
    p = t.groupBy("topic_id", "chain", "mention_id").agg(F.array_sort(F.collect_set("word")).alias("w"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("word"))).alias("head"))
    p = p.select("topic_id", "chain", F.array_join("w", " ").alias("phrase"), "head").distinct()
    return p.withColumn("word", F.explode(F.split("phrase", " "))).withColumn("size", F.size(F.split("phrase", " ")))


@query("jn11_phrase_subsets", A + _PHR + f""", ct AS (SELECT topic_id, chain, phrase, head, sum((word NOT IN {_STOPS})::INT) AS content FROM pw GROUP BY ALL),
 j AS (SELECT x.topic_id, x.chain AS a, y.chain AS b, x.phrase AS outer_phrase, y.phrase AS inner_phrase, count(*) AS shared, sum((x.word NOT IN {_STOPS})::INT) AS inter, any_value(y.size) AS size, bool_or(x.word = x.head AND x.word NOT IN {_STOPS}) AS ha, bool_or(x.word = y.head AND x.word NOT IN {_STOPS}) AS hb, bool_or(x.word <> x.head) AS comp, any_value(c.content) AS content
  FROM pw x JOIN pw y ON x.topic_id = y.topic_id AND x.word = y.word AND x.chain <> y.chain JOIN ct c ON c.topic_id = y.topic_id AND c.chain = y.chain AND c.phrase = y.phrase AND c.head = y.head GROUP BY x.topic_id, x.chain, y.chain, x.phrase, y.phrase, x.head, y.head)
SELECT DISTINCT topic_id, inner_phrase, outer_phrase FROM j WHERE (shared = size AND comp) OR (((inter >= 1 AND content = 1) OR inter >= 2) AND ha AND hb)""")  # fmt: skip
def jn11(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of one entity beside phrases of another: a part of it that holds a modifier of it, or enough content words in
    common (two, or the only one) with the heads of both among them. Words are joined and shared words counted."""
    p = _phrases(spark, sf)
    stop = F.col("word").isin(*STOPS)
    content = p.groupBy("topic_id", "chain", "phrase", "head").agg(F.count_if(~stop).alias("content"))
    y = p.join(content, ["topic_id", "chain", "phrase", "head"]).select("topic_id", "word", F.col("chain").alias("b"), F.col("phrase").alias("inner_phrase"), F.col("head").alias("hy"), "size", "content")
    x = p.select("topic_id", "word", F.col("chain").alias("a"), F.col("phrase").alias("outer_phrase"), F.col("head").alias("hx"))
    g = x.join(y, ["topic_id", "word"]).where("a <> b").groupBy("topic_id", "a", "b", "outer_phrase", "inner_phrase", "hx", "hy").agg(
        F.count("*").alias("shared"), F.count_if(~stop).alias("inter"), F.first("size").alias("size"), F.first("content").alias("content"), F.bool_or((F.col("word") == F.col("hx")) & ~stop).alias("ha"), F.bool_or((F.col("word") == F.col("hy")) & ~stop).alias("hb"), F.bool_or(F.col("word") != F.col("hx")).alias("comp"))
    return g.where("(shared = size AND comp) OR (((inter >= 1 AND content = 1) OR inter >= 2) AND ha AND hb)").select("topic_id", "inner_phrase", "outer_phrase").distinct()


@query("jn12_first_long_phrase", A + _PHR + ", u2 AS (SELECT DISTINCT topic_id, phrase, head, word, size FROM pw), c AS (SELECT x.topic_id, x.phrase AS short, y.phrase AS long, any_value(y.size) AS n FROM u2 x JOIN u2 y ON x.topic_id = y.topic_id AND x.word = y.word AND x.size < y.size AND x.head = y.head GROUP BY x.topic_id, x.phrase, x.head, y.phrase, x.size HAVING count(*) = x.size) SELECT topic_id, short, long FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, short ORDER BY n DESC, long) AS i FROM c) WHERE i = 1")
def jn12(spark: SparkSession, sf: str) -> DataFrame:
    """For each short phrase the first longer one of the same head that contains it: the longest, then the first by name."""
    p = _phrases(spark, sf).drop("chain").distinct()
    x = p.select("topic_id", "word", "head", F.col("phrase").alias("short"), F.col("size").alias("na"))
    y = p.select("topic_id", "word", "head", F.col("phrase").alias("long"), F.col("size").alias("nb"))
    g = x.join(y, ["topic_id", "word", "head"]).where("na < nb").groupBy("topic_id", "head", "short", "long").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return ops.first_of(g.where("c = na"), ["topic_id", "short"], [F.desc("nb"), F.asc("long")]).select("topic_id", "short", "long")


# -- dictionaries ------------------------------------------------------------------------------------------------------------

_COUNTS = ", wl AS (SELECT word, ner, count(*) AS n FROM t WHERE ner <> 'O' GROUP BY ALL), pv AS (SELECT word, coalesce(max(CASE WHEN ner = 'PERSON' THEN n END), 0) AS p, coalesce(max(CASE WHEN ner = 'ORGANIZATION' THEN n END), 0) AS o, coalesce(max(CASE WHEN ner = 'LOCATION' THEN n END), 0) AS l FROM wl GROUP BY 1)"
_CLEAN = _COUNTS + ", dr AS (SELECT word, 'PERSON' AS ner FROM pv WHERE p > 0 AND o > 0 AND o >= p UNION SELECT word, 'ORGANIZATION' FROM pv WHERE p > 0 AND o > 0 AND o < p UNION SELECT word, 'LOCATION' FROM pv WHERE p > 0 AND l > 0 AND NOT (o > 0 AND o >= p) AND p >= l UNION SELECT word, 'PERSON' FROM pv WHERE p > 0 AND l > 0 AND NOT (o > 0 AND o >= p) AND p < l), cl AS (SELECT word, ner FROM wl EXCEPT SELECT word, ner FROM dr)"


def name_labels(words: DataFrame) -> DataFrame:
    """(word, ner): the labels of each word after conflicts: of person and organization the more frequent one stays (an
    organization where equal), then of person and location (a person where equal)."""
    n = words.where("ner <> 'O'").groupBy("word", "ner").agg(F.count("*").alias("n"))
    count = lambda label: F.coalesce(F.max(F.when(F.col("ner") == label, F.col("n"))), F.lit(0))
    v = n.groupBy("word").agg(count("PERSON").alias("p"), count("ORGANIZATION").alias("o"), count("LOCATION").alias("l"))
    j = n.join(v, "word")
    no_person = (F.col("p") > 0) & (F.col("o") > 0) & (F.col("o") >= F.col("p"))
    beaten = (F.col("p") > 0) & (F.col("l") > 0) & ~no_person & (F.col("p") < F.col("l"))
    drop = F.when(F.col("ner") == "PERSON", no_person | beaten).when(F.col("ner") == "ORGANIZATION", (F.col("p") > 0) & (F.col("o") < F.col("p"))).when(F.col("ner") == "LOCATION", (F.col("p") > 0) & ~no_person & (F.col("p") >= F.col("l"))).otherwise(F.lit(False))
    return j.where(~drop).select("word", "ner")


@query("agg2_type_conflicts", A + _CLEAN + " SELECT word, ner FROM cl")
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    return name_labels(annotated(spark, sf))


@query("agg3_type_set_algebra", A + _CLEAN + """, mv AS (SELECT p.word FROM cl p JOIN cl o ON p.ner = 'PERSON' AND o.ner = 'ORGANIZATION' AND o.word = left(p.word, length(p.word) - 1)),
 s1 AS (SELECT word, ner FROM cl WHERE NOT (ner = 'PERSON' AND word IN (SELECT word FROM mv)) UNION SELECT word, 'ORGANIZATION' FROM mv), s2 AS (SELECT DISTINCT word, CASE WHEN ner IN ('STATE', 'LOCATION', 'CITY') THEN 'COUNTRY' ELSE ner END AS ner FROM s1),
 ms AS (SELECT m.word, CASE WHEN EXISTS (SELECT 1 FROM s2 i WHERE i.ner = 'IDEOLOGY' AND (i.word = left(m.word, length(m.word) - 1) OR i.word = m.word || 's')) THEN 'IDEOLOGY' WHEN EXISTS (SELECT 1 FROM s2 i WHERE i.ner = 'NATIONALITY' AND i.word = left(m.word, length(m.word) - 1)) OR m.word LIKE '%ns' THEN 'NATIONALITY' ELSE 'MISC' END AS ner FROM s2 m WHERE m.ner = 'MISC'),
 s3 AS (SELECT word, ner FROM s2 WHERE ner <> 'MISC' UNION SELECT word, ner FROM ms), og AS (SELECT word FROM s3 WHERE ner IN ('ORGANIZATION', 'IDEOLOGY') EXCEPT SELECT word FROM s3 WHERE ner = 'TITLE')
SELECT word, 'ORGANIZATION' AS ner FROM og UNION SELECT word, 'COUNTRY' FROM (SELECT word FROM s3 WHERE ner = 'COUNTRY' EXCEPT SELECT word FROM og) UNION SELECT word, ner FROM s3 WHERE ner NOT IN ('ORGANIZATION', 'IDEOLOGY', 'COUNTRY', 'MISC', 'TITLE')""")  # fmt: skip
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    """The name dictionary by set algebra, in order: plurals of organizations move there from persons; states, locations and
    cities join countries; miscellaneous words move to ideologies and nationalities they are forms of; organizations take
    ideologies in and lose titles; countries lose organizations."""
    s = name_labels(annotated(spark, sf))
    of = lambda df, *labels: df.where(F.col("ner").isin(*labels)).select("word")
    chopped = F.expr("left(word, length(word) - 1)")
    moved = of(s, "PERSON").withColumn("base", chopped).join(of(s, "ORGANIZATION").withColumnRenamed("word", "base"), "base", "left_semi").select("word").withColumn("moved", F.lit(True))
    s = s.join(moved, "word", "left").withColumn("ner", F.when((F.col("ner") == "PERSON") & F.col("moved"), "ORGANIZATION").otherwise(F.col("ner"))).select("word", "ner").distinct()
    s = s.withColumn("ner", F.when(F.col("ner").isin("STATE", "LOCATION", "CITY"), "COUNTRY").otherwise(F.col("ner"))).distinct()
    ideology = of(s, "IDEOLOGY")
    forms = ideology.select(F.col("word").alias("base")).withColumn("to", F.lit("IDEOLOGY"))
    m = of(s, "MISC").withColumn("base", chopped)
    m = m.join(forms, "base", "left").join(ideology.select(chopped.alias("word"), F.lit(True).alias("plural")).distinct(), "word", "left").join(of(s, "NATIONALITY").select(F.col("word").alias("base"), F.lit(True).alias("nation")), "base", "left")
    m = m.select("word", F.when(F.col("to").isNotNull() | F.col("plural"), "IDEOLOGY").when(F.col("nation") | F.col("word").endswith("ns"), "NATIONALITY").otherwise("MISC").alias("ner")).distinct()
    s = s.where("ner <> 'MISC'").union(m)
    org = of(s, "ORGANIZATION", "IDEOLOGY").subtract(of(s, "TITLE"))
    country = of(s, "COUNTRY").subtract(org)
    rest = s.where("ner NOT IN ('ORGANIZATION', 'IDEOLOGY', 'COUNTRY', 'MISC', 'TITLE')")
    return org.withColumn("ner", F.lit("ORGANIZATION")).union(country.withColumn("ner", F.lit("COUNTRY"))).union(rest.select("word", "ner")).distinct()


@query("agg4_headword_tree", A + ", h AS (SELECT chain, mention_id, word AS head, pos IN ('PRP', 'PRP$') AS prp, bool_and(pos IN ('PRP', 'PRP$')) OVER (PARTITION BY chain) AS all_prp FROM t WHERE i = n - 1) SELECT chain, head, count(*) AS n, min(mention_id) AS first_member FROM h WHERE NOT prp OR all_prp GROUP BY ALL")
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    """An entity's heads with their number of members, without pronouns unless there is nothing else. Members are rows of the
    input; the tree holds counts, so a hot chain makes no long row."""
    h = annotated(spark, sf).where("i = n - 1").select("chain", "mention_id", F.col("word").alias("head"), F.col("pos").isin("PRP", "PRP$").alias("prp"))
    only = h.groupBy("chain").agg(F.bool_and("prp").alias("all_prp"))
    return h.join(only, "chain").where("NOT prp OR all_prp").groupBy("chain", "head").agg(F.count("*").alias("n"), F.min("mention_id").alias("first_member"))


@query("agg10_modifiers", A + "SELECT chain, dep AS relation, word, count(*) AS n FROM t WHERE dep IN ('amod', 'compound', 'nmod:poss', 'nummod') GROUP BY ALL")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    """Modifiers of an entity's heads by dependency."""
    return annotated(spark, sf).where("dep IN ('amod', 'compound', 'nmod:poss', 'nummod')").groupBy("chain", F.col("dep").alias("relation"), "word").agg(F.count("*").alias("n"))


@query("win2_first_wins", A + ", h AS (SELECT mention_id, doc_id, sent_id, string_agg(word, ' ' ORDER BY i) AS phrase, max(CASE WHEN i = n - 1 THEN word END) AS head FROM t GROUP BY ALL) SELECT mention_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, phrase, head ORDER BY mention_id) AS r FROM h) WHERE r = 1")
def win2(spark: SparkSession, sf: str) -> DataFrame:
    """The first mention of each phrase and head in a sentence; the least by its id, before the shuffle."""
    h = annotated(spark, sf).groupBy("mention_id", "doc_id", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("word"))).alias("head"))
    return h.groupBy("doc_id", "sent_id", "phrase", "head").agg(F.min("mention_id").alias("mention_id")).select("mention_id")


@query("win8_preferred_mention", A + ", rp AS (SELECT chain, text, row_number() OVER (PARTITION BY chain ORDER BY c DESC, text) AS r FROM (SELECT chain, text, count(*) AS c FROM m GROUP BY ALL)), s AS (SELECT m.chain, m.mention_id, (m.mention_id = min(m.mention_id) OVER (PARTITION BY m.chain))::INT + 3 * (m.text = rp.text)::INT + 2 * bool_or(pos IN ('NNP', 'NNPS') AND i = n - 1)::INT + 2 * (max(n) = 2)::INT AS score FROM m JOIN t USING (mention_id) JOIN rp ON rp.chain = m.chain AND r = 1 GROUP BY m.chain, m.mention_id, m.text, rp.text) SELECT chain, mention_id, score FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, mention_id) AS i FROM s) WHERE i = 1")
def win8(spark: SparkSession, sf: str) -> DataFrame:
    """An entity's preferred mention: 1 for the first one, 3 for the representative phrase, 2 for a proper head, 2 for two words."""
    t, m = annotated(spark, sf), mentions(spark, sf).select("chain", "mention_id", "text")
    rep = m.groupBy("chain", "text").agg(F.count("*").alias("c")).groupBy("chain").agg(F.min(F.struct((-F.col("c")).alias("o"), "text"))["text"].alias("rep"))
    of = t.groupBy("mention_id").agg(F.bool_or(F.col("pos").isin("NNP", "NNPS") & (F.col("i") == F.col("n") - 1)).alias("proper"), F.max("n").alias("n"))
    first = m.join(of, "mention_id").groupBy("chain").agg(F.min("mention_id").alias("first"))
    s = m.join(of, "mention_id").join(rep, "chain").join(first, "chain")
    score = (F.col("mention_id") == F.col("first")).cast("int") + 3 * (F.col("text") == F.col("rep")).cast("int") + 2 * F.col("proper").cast("int") + 2 * (F.col("n") == 2).cast("int")
    best = s.groupBy("chain").agg(F.min(F.struct((-score).alias("o"), "mention_id")).alias("b"))
    return best.select("chain", "b.mention_id", (-F.col("b.o")).alias("score"))


# -- joins with coreference and gold mentions ------------------------------------------------------------------------------

_COREF = M + ", cf AS (SELECT * FROM m WHERE NOT is_singleton), rn AS (SELECT chain, text AS name FROM (SELECT chain, text, row_number() OVER (PARTITION BY chain ORDER BY c DESC, text) AS r FROM (SELECT chain, text, count(*) AS c FROM cf GROUP BY ALL)) WHERE r = 1)"


@query("jn2_with_chain_name", _COREF + " SELECT DISTINCT a.mention_id, name FROM m a JOIN cf c ON c.doc_id = a.doc_id AND c.sent_id = a.sent_id AND c.head = a.head JOIN rn ON rn.chain = c.chain WHERE a.score = -1")
def jn2(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated mentions beside the coreference mentions of their sentence with the same head, with the name of the chain: its
    most frequent phrase. Mentions without such a one drop out."""
    m = mentions(spark, sf)
    c = m.where("NOT is_singleton")
    name = c.groupBy("chain", "text").agg(F.count("*").alias("n")).groupBy("chain").agg(F.min(F.struct((-F.col("n")).alias("o"), "text"))["text"].alias("name"))
    coref = c.select("doc_id", "sent_id", "head", "chain").distinct().join(name, "chain").drop("chain")
    return m.where("score = -1").select("mention_id", "doc_id", "sent_id", "head").join(coref, ["doc_id", "sent_id", "head"]).select("mention_id", "name").distinct()


_HOW = "CASE WHEN a.text = c.text AND a.first_tok = c.first_tok THEN 0 WHEN a.text = c.text THEN 1 ELSE 2 END"


@query("jn18_chain_or_self", _COREF + f", j AS (SELECT a.mention_id, c.chain, {_HOW} AS how FROM m a JOIN cf c ON c.doc_id = a.doc_id AND c.sent_id = a.sent_id AND (a.text = c.text OR contains(a.text, c.text) OR contains(c.text, a.text))), b AS (SELECT mention_id, arg_min(chain, (how, chain)) AS chain FROM j GROUP BY 1) SELECT m.mention_id, coalesce(b.chain, m.mention_id) AS seed FROM m LEFT JOIN b USING (mention_id)")
def jn18(spark: SparkSession, sf: str) -> DataFrame:
    """The seed of each mention: the chain of the coreference mention in its sentence that matches best - same text and place,
    same text, one inside the other -, else the mention itself."""
    m = mentions(spark, sf)
    c = m.where("NOT is_singleton").select("doc_id", "sent_id", F.col("text").alias("tc"), F.col("first_tok").alias("fc"), "chain").distinct()
    j = m.select("mention_id", "doc_id", "sent_id", "text", "first_tok").join(c, ["doc_id", "sent_id"])
    same = F.col("text") == F.col("tc")
    j = j.where(same | F.col("text").contains(F.col("tc")) | F.col("tc").contains(F.col("text")))
    how = F.when(same & (F.col("first_tok") == F.col("fc")), 0).when(same, 1).otherwise(2)
    b = j.groupBy("mention_id").agg(F.min(F.struct(how.alias("how"), "chain"))["chain"].alias("c"))
    return m.select("mention_id").join(b, "mention_id", "left").select("mention_id", F.coalesce("c", "mention_id").alias("seed"))


@query("flt5_digit_share", M + """, p AS (SELECT mention_id, doc_id, sent_id, text FROM m WHERE kind <> 'HUM'), o AS (SELECT DISTINCT doc_id, sent_id, text FROM m WHERE kind = 'HUM'),
 f AS (SELECT DISTINCT p.mention_id FROM p JOIN o ON o.doc_id = p.doc_id AND abs(o.sent_id - p.sent_id) <= 2 AND contains(lower(o.text), lower(p.text)))
SELECT mention_id, length(regexp_replace(text, '[^0-9]', '', 'g')) >= 0.1 * length(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')) AS tolerated FROM p WHERE mention_id NOT IN (SELECT mention_id FROM f)""".replace("\\\\", "\\"))  # fmt: skip
def flt5(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions whose phrase is not found within two sentences, and whether that is passed over because a tenth or more of
    their letters and figures are figures. Sentences are joined by their numbers, never by a range."""
    m = mentions(spark, sf)
    o = m.where("kind = 'HUM'").select("doc_id", F.col("sent_id").alias("s"), F.lower("text").alias("to")).distinct()
    p = m.where("kind <> 'HUM'").select("mention_id", "doc_id", "text", F.explode(F.sequence(F.col("sent_id") - 2, F.col("sent_id") + 2)).alias("s"))
    found = p.join(o, ["doc_id", "s"]).where(F.col("to").contains(F.lower("text"))).select("mention_id").distinct()
    rest = m.where("kind <> 'HUM'").select("mention_id", "text").join(found, "mention_id", "left_anti")
    return rest.select("mention_id", (F.length(F.regexp_replace("text", "[^0-9]", "")) >= 0.1 * F.length(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))).alias("tolerated"))


_ROLES = M + """, ar AS (SELECT doc_id, sent_id, CASE kind WHEN 'HUM' THEN 'arg0' WHEN 'GRP' THEN 'arg1' WHEN 'LOC' THEN 'loc' ELSE 'time' END AS role, min(chain) AS arg FROM m WHERE kind IN ('HUM', 'GRP', 'LOC', 'TIM') GROUP BY ALL),
 ev AS (SELECT mention_id, doc_id, sent_id, chain FROM m WHERE kind = 'ACT'), ea AS (SELECT DISTINCT ev.mention_id, ev.chain, role, arg FROM ev JOIN ar USING (doc_id, sent_id)),
 lk AS (SELECT DISTINCT x.chain, x.mention_id AS a, y.mention_id AS b FROM ea x JOIN ea y ON x.chain = y.chain AND x.role = y.role AND x.arg = y.arg AND x.mention_id < y.mention_id),
 sz AS (SELECT chain, count(*) AS events FROM ev GROUP BY 1), ag AS (SELECT chain, count(DISTINCT mention_id) AS with_args FROM ea GROUP BY 1), lc AS (SELECT chain, count(*) AS linked, count(DISTINCT a) AS with_later FROM lk GROUP BY 1)
SELECT sz.chain, events, coalesce(with_args, 0) AS with_args, coalesce(with_later, 0) AS with_later, round(CASE WHEN events > 1 THEN coalesce(linked, 0) / (events * (events - 1) / 2.0) ELSE 0 END, 6)::DOUBLE AS share FROM sz LEFT JOIN ag USING (chain) LEFT JOIN lc USING (chain)"""  # fmt: skip


@query("agg16_argument_coreference", _ROLES)
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    """For each event chain: its events, those with arguments, those with a later event of the chain that shares the filler
    of some role, and the share of such pairs. An event has one filler of a role, so pairs are counted in closed form,
    by inclusion and exclusion over sets of roles: no pair is formed."""
    names = ("arg0", "arg1", "loc", "time")
    m = mentions(spark, sf)
    role = F.when(F.col("kind") == "HUM", "arg0").when(F.col("kind") == "GRP", "arg1").when(F.col("kind") == "LOC", "loc").otherwise("time")
    ar = m.where("kind IN ('HUM', 'GRP', 'LOC', 'TIM')").groupBy("doc_id", "sent_id", role.alias("role")).agg(F.min("chain").alias("arg"))
    wide = ar.groupBy("doc_id", "sent_id").pivot("role", list(names)).agg(F.first("arg"))
    ev = m.where("kind = 'ACT'").select("mention_id", "doc_id", "sent_id", "chain").join(wide, ["doc_id", "sent_id"], "left")
    sets = [[n for i, n in enumerate(names) if k >> i & 1] for k in range(1, 16)]
    filled = lambda of: F.when(F.greatest(*[F.col(n).isNull().cast("int") for n in of], F.lit(0)) == 0, F.concat_ws("\x01", *[F.concat(F.lit(f"{n}="), n) for n in of]))
    key = F.explode(F.filter(F.array(*[F.struct(F.lit(1 if len(of) % 2 else -1).alias("sign"), F.lit(len(of)).alias("roles"), filled(of).alias("key")) for of in sets]), lambda x: x["key"].isNotNull()))
    e = ev.select("mention_id", "chain", key.alias("x")).select("mention_id", "chain", "x.*")
    g = e.groupBy("chain", "sign", "roles", "key").agg(F.count("*").alias("n"), F.max("mention_id").alias("last"))
    linked = g.groupBy("chain").agg(F.sum(F.col("sign") * F.col("n") * (F.col("n") - 1) / 2).alias("linked"))
    later = e.where("roles = 1").join(g.where("roles = 1").select("chain", "key", "last"), ["chain", "key"]).where("mention_id < last").groupBy("chain").agg(F.count_distinct("mention_id").alias("with_later"))
    some = F.coalesce(*names).isNotNull()
    sz = ev.groupBy("chain").agg(F.count("*").alias("events"), F.count_if(some).alias("with_args"))
    j = sz.join(linked, "chain", "left").join(later, "chain", "left").fillna(0)
    share = F.when(F.col("events") > 1, F.col("linked") / (F.col("events") * (F.col("events") - 1) / 2)).otherwise(0.0)
    return j.select("chain", "events", "with_args", "with_later", F.round(share, 6).alias("share"))


@query("ext9_from_coreference", A + "SELECT mention_id, doc_id, sent_id, chain AS chain_name, CASE WHEN max(CASE WHEN i = n - 1 THEN pos END) = 'PRP' THEN 'PRONOMINAL' WHEN max(CASE WHEN i = n - 1 THEN pos END) IN ('NNP', 'NNPS') THEN 'PROPER' ELSE 'NOMINAL' END AS subtype, max(CASE WHEN i = n - 1 THEN word END) AS head FROM t GROUP BY ALL")
def ext9(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions made of coreference mentions: chain name, head and kind of reference."""
    head = lambda c: F.max(F.when(F.col("i") == F.col("n") - 1, F.col(c)))
    g = annotated(spark, sf).groupBy("mention_id", "doc_id", "sent_id", F.col("chain").alias("chain_name")).agg(head("pos").alias("pos"), head("word").alias("head"))
    return g.select("mention_id", "doc_id", "sent_id", "chain_name", F.when(F.col("pos") == "PRP", "PRONOMINAL").when(F.col("pos").isin("NNP", "NNPS"), "PROPER").otherwise("NOMINAL").alias("subtype"), "head")


@query("ext13_entities_of_groups", A + f", {_KEEP} SELECT topic_id, chain, count(*) AS members, min(m.mention_id) AS first_member FROM m JOIN kept USING (mention_id) GROUP BY ALL")
def ext13(spark: SparkSession, sf: str) -> DataFrame:
    """One entity per group of the mentions that the keep-filter leaves."""
    m = mentions(spark, sf).join(kept_mentions(annotated(spark, sf)), "mention_id", "left_semi")
    return m.groupBy("topic_id", "chain").agg(F.count("*").alias("members"), F.min("mention_id").alias("first_member"))


@query("jn20_occurrences", r"""WITH c AS (SELECT DISTINCT Document_name, Segment FROM codings WHERE length(Segment) > 0), a AS (SELECT DISTINCT doc_key, text FROM articles WHERE text IS NOT NULL),
 p AS (SELECT Document_name, Segment, text, string_split(text, Segment) AS parts FROM c JOIN a ON Document_name = doc_key), o AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p)
SELECT Document_name, Segment, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(Segment))::INT AS begin_char, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + k * length(Segment))::INT AS end_char, len(regexp_extract_all(Segment, '[\p{L}\p{N}]+'))::INT AS tokens FROM o""")  # fmt: skip
def jn20(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a coded segment in its article: begin and end, and the number of words inside."""
    c = read(spark, sf, "codings").where(F.length("Segment") > 0).select("Document_name", "Segment").distinct()
    a = read(spark, sf, "articles").where("text IS NOT NULL").select(F.col("doc_key").alias("Document_name"), "text").distinct()
    p = c.join(a, "Document_name").withColumn("parts", F.expr(r"split(text, concat('\\Q', Segment, '\\E'), -1)")).where(F.size("parts") > 1)
    # the running length of what stands before each occurrence
    before = F.aggregate(F.slice("parts", 1, F.size("parts") - 1), F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + F.length(x) + F.when(F.size(s) > 0, F.length("Segment")).otherwise(0))))
    o = p.select("Document_name", "Segment", F.explode(before).alias("begin_char"))
    return o.select("Document_name", "Segment", "begin_char", (F.col("begin_char") + F.length("Segment")).alias("end_char"), F.size(F.regexp_extract_all("Segment", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("tokens"))


@query("jn4_text_search_nearby", M + """, tk AS (SELECT doc_id, sent_id, tok, min(word) AS word FROM (SELECT doc_id, sent_id, unnest(tok_ids) AS tok, unnest(words) AS word FROM m WHERE len(tok_ids) = len(words)) GROUP BY ALL),
 se AS (SELECT doc_id, sent_id, string_agg(' ' || word || ' ', '' ORDER BY tok) AS st FROM tk GROUP BY ALL),
 ph AS (SELECT mention_id, doc_id, sent_id, array_to_string(list_transform(words, lambda x: ' ' || x || ' '), '') AS whole, '% ' || array_to_string(words[1:greatest(len(words) - 1, 1)], ' % ') || ' %' AS loose FROM m WHERE len(words) > 0),
 c AS (SELECT mention_id, se.sent_id AS found, abs(se.sent_id - ph.sent_id) AS gap, CASE WHEN contains(st, whole) THEN CASE WHEN se.sent_id = ph.sent_id THEN 0 ELSE 1 END WHEN st LIKE loose THEN 2 END AS how FROM ph JOIN se ON se.doc_id = ph.doc_id AND abs(se.sent_id - ph.sent_id) <= 2)
SELECT mention_id, found, how FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY how, gap, found) AS r FROM c WHERE how IS NOT NULL) WHERE r = 1""")  # fmt: skip
def jn4(spark: SparkSession, sf: str) -> DataFrame:
    """Where a phrase is found: in its own sentence (0), else within two sentences (1), else as words in their order, all but
    the last (2). A sentence's text is its words by place; windows of sentences are exploded for an equi-join."""
    m = mentions(spark, sf)
    tk = m.where(F.size("tok_ids") == F.size("words")).select("doc_id", "sent_id", F.explode(F.arrays_zip("tok_ids", "words")).alias("x")).groupBy("doc_id", "sent_id", F.col("x.tok_ids").alias("tok")).agg(F.min("x.words").alias("word"))
    st = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "word"))), lambda x: F.concat(F.lit(" "), x["word"], F.lit(" "))), "").alias("st")
    se = tk.groupBy("doc_id", F.col("sent_id").alias("found")).agg(st)
    first = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(1)))
    ph = m.where(F.size("words") > 0).select("mention_id", "doc_id", "sent_id", F.array_join(F.transform("words", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "").alias("whole"),
                                             F.concat(F.lit("% "), F.array_join(first, " % "), F.lit(" %")).alias("loose"), F.explode(F.sequence(F.col("sent_id") - 2, F.col("sent_id") + 2)).alias("found"))
    c = ph.join(se, ["doc_id", "found"])
    how = F.when(F.col("st").contains(F.col("whole")), F.when(F.col("found") == F.col("sent_id"), 0).otherwise(1)).when(F.expr("st LIKE loose"), 2)
    best = c.withColumn("how", how).where("how IS NOT NULL").groupBy("mention_id").agg(F.min(F.struct("how", F.abs(F.col("found") - F.col("sent_id")).alias("gap"), "found")).alias("x"))
    return best.select("mention_id", "x.found", "x.how")
