"""Queries of scalar functions, sources, sinks and mention extraction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.functions import scalars
from mentionloom.operators import mention_ops as ops
from mentionloom.operators import vectors
from mentionloom.plans.registry import M, mentions, query
from mentionloom.sources import readers, writers
from mentionloom.sources.tables import read

# -- scalars ---------------------------------------------------------------------------------------------------------

def _two_texts(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("topic_id", "chain").agg(F.min("text").alias("a"), F.max("text").alias("b"))


@query("str1_edit_distance")
def str1(spark: SparkSession, sf: str) -> DataFrame:
    t = _two_texts(spark, sf)
    return t.select("chain", "topic_id", scalars.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query("str2_ordered_subsequence")
def str2(spark: SparkSession, sf: str) -> DataFrame:
    t = _two_texts(spark, sf)
    return t.select("topic_id", "chain", scalars.is_ordered_subsequence(ops.words_of(F.col("a")), ops.words_of(F.col("b"))).alias("inside"))


@query("str3_ordered_intersection")
def str3(spark: SparkSession, sf: str) -> DataFrame:
    t = _two_texts(spark, sf)
    return t.select("topic_id", "chain", F.array_join(scalars.ordered_intersection(ops.words_of(F.col("a")), ops.words_of(F.col("b"))), " ").alias("common"))


@query("str4_stripped", M + "SELECT mention_id, regexp_replace(text, '[^\\p{L}]', '', 'g') AS letters, len(string_split(regexp_replace(text, '[-_]', ' ', 'g'), ' '))::INT AS parts FROM m")
def str4(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", F.regexp_replace("text", r"[^\p{L}]", "").alias("letters"), F.size(F.split(F.regexp_replace("text", "[-_]", " "), " ")).alias("parts"))


@query("str5_trim_offsets", "SELECT DISTINCT article_id, length(description) - length(ltrim(description)) AS lead, length(description) - length(rtrim(description)) AS trail FROM articles WHERE description IS NOT NULL".replace("AS lead", "AS lead_spaces").replace("AS trail", "AS trail_spaces"))
def str5(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "articles").where("description IS NOT NULL").select("article_id", "description").distinct()
    lead, trail = scalars.trim_offsets(F.col("description"))
    return a.select("article_id", lead.cast("long").alias("lead_spaces"), trail.cast("long").alias("trail_spaces"))


@query("str6_text_from_tokens", M + ", t AS (SELECT mention_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM m) SELECT mention_id, string_agg(word, ' ' ORDER BY i) AS phrase FROM t GROUP BY 1")
def str6(spark: SparkSession, sf: str) -> DataFrame:
    t = mentions(spark, sf).select("mention_id", F.posexplode("words").alias("i", "word"))
    return t.groupBy("mention_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("phrase"))


@query("str7_clean_codes", "SELECT Code, count(*) AS n, trim(regexp_replace(translate(Code, '´`’', ''''''''), '[''\\s]+$|^[''\\s]+', '', 'g')) AS code_clean FROM codings GROUP BY 1")
def str7(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "codings").groupBy("Code").agg(F.count("*").alias("n")).select("Code", "n", readers.clean_code(F.col("Code")).alias("code_clean"))


@query("str8_case_back_off", M + ", v AS (SELECT DISTINCT head AS word FROM m WHERE kind = 'HUM'), t AS (SELECT mention_id, regexp_extract(text, '([\\p{L}\\p{N}]+)[^\\p{L}\\p{N}]*$', 1) AS last FROM m) SELECT mention_id, coalesce(v1.word, v2.word, 'unk') AS found FROM t LEFT JOIN v v1 ON v1.word = t.last LEFT JOIN v v2 ON v2.word = lower(t.last)")
def str8(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary look-up: exact, then lower case, then unknown."""
    m = mentions(spark, sf)
    v = m.where("kind = 'HUM' AND head IS NOT NULL").select(F.col("head").alias("word")).distinct()
    t = m.select("mention_id", F.regexp_extract("text", r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1).alias("last"))
    j = t.join(v.withColumnRenamed("word", "exact"), F.col("last") == F.col("exact"), "left").join(v.withColumnRenamed("word", "low"), F.lower("last") == F.col("low"), "left")
    return j.select("mention_id", F.coalesce("exact", "low", F.lit("unk")).alias("found"))


@query("str9_multi_labels", M + ", x AS (SELECT mention_id, kind, unnest(string_split(labels, '+')) AS label, unnest(range(len(string_split(labels, '+'))))::INT AS pos FROM m) SELECT mention_id, pos, label, kind AS label_type FROM x")
def str9(spark: SparkSession, sf: str) -> DataFrame:
    return ops.split_labels(mentions(spark, sf))


_RECODE = {"HUM": "PERSON", "LOC": "PLACE", "GRP": "GROUP", "ACT": "EVENT", "TIM": "TIME"}


@query("str10_recoded_types", M + "SELECT CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RECODE.items()) + " ELSE 'OTHER' END AS category, count(*) AS n FROM m GROUP BY 1")
def str10(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy(scalars.recode(F.col("kind"), _RECODE).alias("category")).agg(F.count("*").alias("n"))


@query("str11_singular", M + "SELECT DISTINCT head, regexp_replace(regexp_replace(head, 's$', ''), '#', '') AS singular FROM m")
def str11(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("head").distinct().select("head", scalars.singular(F.col("head")).alias("singular"))


@query("dat1_durations", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M') AS stamp, (event_id // 3600) || ':' || lpad(((event_id % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS hms FROM events")
def dat1(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd_HH-mm").alias("stamp"), scalars.hours_minutes_seconds(F.col("event_id")).alias("hms"))


@query("mth_relevances", M + ", p AS (SELECT chain, count(*) AS n, any_value(len(string_split(chain, '_'))) AS len FROM m GROUP BY 1) SELECT chain, least(greatest(round(ln(n) / ln(5000.0), 1), 0.5), 0.7)::DOUBLE AS threshold, round(CASE WHEN len * log2(1 + n) > 0 THEN ln(len) * ln(len * log2(1 + n)) ELSE 0 END, 6) AS phrase, round(ln(1 + len) * log2(n), 6) AS wordset, round(CASE WHEN len + n > 0 THEN 1.25 * len * n / (0.25 * n + len) ELSE 0 END, 6)::DOUBLE AS f_half FROM p")
def mth(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold, relevance and F expressions over chain sizes and name lengths."""
    p = mentions(spark, sf).groupBy("chain").agg(F.count("*").alias("n")).withColumn("len", F.size(F.split("chain", "_")))
    n, le = F.col("n"), F.col("len")
    return p.select("chain", scalars.overlap_threshold(n).alias("threshold"), F.round(scalars.phrase_relevance(le, n), 6).alias("phrase"),
                    F.round(scalars.wordset_relevance(le, n), 6).alias("wordset"), F.round(1.25 * le * n / (0.25 * n + le), 6).alias("f_half"))


@query("arr1_slices", M + "SELECT mention_id, array_to_string(words[1:2], ' ') AS first_two, list_filter(tok_ids, lambda x: x > first_tok) AS rest FROM m")
def arr1(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", F.array_join(F.slice("words", 1, 2), " ").alias("first_two"), F.filter("tok_ids", lambda t: t > F.col("first_tok")).alias("rest"))


@query("map1_sorted_counts", M + ", n AS (SELECT topic_id, kind, count(*) AS n FROM m GROUP BY ALL) SELECT topic_id, string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) AS counts FROM n GROUP BY 1")
def map1(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).groupBy("topic_id", "kind").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind", "n")))
    return n.groupBy("topic_id").agg(F.array_join(F.transform(s, lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",").alias("counts"))


@query("jsn1_properties", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def jsn1(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# -- vectors ---------------------------------------------------------------------------------------------------------

_MEAN = """WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS x FROM e GROUP BY ALL)
"""


@query("vec1_mean_vectors", _MEAN + "SELECT label, i::INT AS i, round(x, 6) AS x FROM c")
def vec1(spark: SparkSession, sf: str) -> DataFrame:
    m = vectors.mean_vector(read(spark, sf, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("vec2_similarity_of_means", _MEAN + ", p AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS d, sum(a.x * a.x) AS na, sum(b.x * b.x) AS nb FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY ALL) SELECT a, b, round(d / sqrt(na * nb), 5) AS sim FROM p")
def vec2(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of label means: as many rows as pairs of labels, joined on the order of their names."""
    m = vectors.mean_vector(read(spark, sf, "embeddings"), ["label"], "embedding")
    a, b = m.select(F.col("label").alias("a"), F.col("embedding").alias("x")), m.select(F.col("label").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 5).alias("sim"))


@query("vec4_weighted_mean", "WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v, CASE WHEN vec_id % 3 = 0 THEN 1.7 ELSE 1.0 END::DOUBLE AS w FROM embeddings) SELECT label, i::INT AS i, round(sum(v * w) / sum(w), 6) AS x FROM e GROUP BY ALL")
def vec4(spark: SparkSession, sf: str) -> DataFrame:
    w = F.when(F.col("vec_id") % 3 == 0, F.lit(1.7)).otherwise(F.lit(1.0))
    m = vectors.mean_vector(read(spark, sf, "embeddings"), ["label"], "embedding", w)
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("vec5_layer_mean", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE) / 3, 6) AS head FROM embeddings")
def vec5(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf, "embeddings").select("vec_id", F.round((e(0) + e(1) + e(2)) / 3, 6).alias("head"))


@query("vec6_pair_features", "WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, 256 AS dims, round(list_sum(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE - y[i]::DOUBLE) + x[i]::DOUBLE * y[i]::DOUBLE + x[i]::DOUBLE + y[i]::DOUBLE)), 5) AS total FROM p")
def vec6(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    f = e.join(b, "vec_id").select("vec_id", vectors.pair_features(F.col("embedding"), F.col("y")).alias("f"))
    return f.select("vec_id", F.size("f").alias("dims"), F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# -- sources and sinks -------------------------------------------------------------------------------------------------


@query("src1_articles", "SELECT DISTINCT article_id, source_domain, language, length(title)::INT AS title_chars, len(authors)::INT AS n_authors FROM articles")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "articles").select("article_id", "source_domain", "language", "title", "authors").distinct()
    return a.select("article_id", "source_domain", "language", F.length("title").alias("title_chars"), F.when(F.col("authors").isNotNull(), F.size("authors")).alias("n_authors"))


@query("src3_renamed_attributes", "SELECT DISTINCT doc_key AS document, title AS headline, coalesce(description, '') AS lead FROM articles".replace("AS lead", "AS lead_text"))
def src3(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "articles").select(F.col("doc_key").alias("document"), F.col("title").alias("headline"), F.coalesce("description", F.lit("")).alias("lead_text")).distinct()


@query("src5_gold_mentions", "SELECT doc_id, count(DISTINCT mention_id) AS mentions, count(DISTINCT coref_chain) AS chains FROM mentions GROUP BY 1")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "mentions").groupBy("doc_id").agg(F.count_distinct("mention_id").alias("mentions"), F.count_distinct("coref_chain").alias("chains"))


@query("src6_outline", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS no FROM documents WHERE text IS NOT NULL),
 t AS (SELECT *, regexp_matches(line, '^\s*\d+\.\d+\.\s') AS it, regexp_matches(line, '^\s*\d+\.\s') AS se FROM l)
SELECT doc_id, no AS line_no, sum(se::INT) OVER w AS section, sum(it::INT) OVER w AS item, it OR se AS head FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY no)""".replace("sum(se::INT) OVER w", "(sum(se::INT) OVER w)::INT").replace("sum(it::INT) OVER w", "(sum(it::INT) OVER w)::INT"))  # fmt: skip
def src6(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return readers.outline(lines, "doc_id", "no", "line").select("doc_id", "line_no", "section", "item", "head")


_BIO = M + """, t AS (SELECT doc_id, sent_id, unnest(tok_ids) AS tok, mention_id, first_tok FROM m), f AS (SELECT doc_id, sent_id, tok, min(mention_id) AS mention_id FROM t GROUP BY ALL),
 g AS (SELECT *, lag(mention_id) OVER w AS before, lag(tok) OVER w AS tb FROM f WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok)),
 s AS (SELECT *, sum((before IS DISTINCT FROM mention_id OR tb <> tok - 1)::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok) AS span FROM g)
SELECT doc_id, sent_id, min(tok) AS first_tok, max(tok) AS last_tok FROM s GROUP BY doc_id, sent_id, span"""  # fmt: skip


@query("src10_bio_spans", _BIO)
def src10(spark: SparkSession, sf: str) -> DataFrame:
    """Token tags of the mentions read back as spans."""
    t = mentions(spark, sf).select("doc_id", "sent_id", F.explode("tok_ids").alias("tok"), "mention_id").groupBy("doc_id", "sent_id", "tok").agg(F.min("mention_id").alias("mention_id"))
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok")
    new = ~F.lag("mention_id").over(w).eqNullSafe(F.col("mention_id")) | (F.lag("tok").over(w) != F.col("tok") - 1)
    tags = t.withColumn("tag", F.concat(F.when(new, "B-").otherwise("I-"), F.lit("M")))
    return readers.bio_spans(tags, ["doc_id", "sent_id"], "tok", "tag").select("doc_id", "sent_id", "first_tok", "last_tok")


@query("src13_comparison_tables", "SELECT method, step, type_a, type_b, value FROM rules")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    """The tables pivoted to matrices and unpivoted again."""
    r = read(spark, sf, "rules")
    types = ["person-ne", "person-nes", "person-nn", "person-nns", "group-ne", "group", "country-ne", "country", "misc"]
    wide = r.groupBy("method", "step", "type_a").pivot("type_b", types).agg(F.first("value"))
    return wide.unpivot(["method", "step", "type_a"], [F.col(f"`{t}`") for t in types], "type_b", "value").where("value IS NOT NULL")


@query("src15_newest_lookup", "SELECT doc_key, arg_max(title, (date_publish, title)) AS title FROM articles WHERE length(title) > 0 AND date_publish IS NOT NULL GROUP BY 1")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    return readers.newest_lookup(read(spark, sf, "articles").where("date_publish IS NOT NULL").select("doc_key", "date_publish", "title"), "doc_key", "date_publish", "title")


@query("src17_experiments", "SELECT experiment_num, dataset, coalesce(entities_word_vectors, 'not_specified') AS entities_word_vectors FROM experiments")
def src17(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "experiments").fillna("not_specified").select("experiment_num", "dataset", "entities_word_vectors")


@query("src18_joined_tokens", M + "SELECT doc_id, string_agg(text, ' ' ORDER BY sent_id, first_tok, mention_id) AS joined FROM m WHERE sent_id > 0 GROUP BY 1")
def src18(spark: SparkSession, sf: str) -> DataFrame:
    g = mentions(spark, sf).where("sent_id > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "first_tok", "mention_id", "text"))).alias("t"))
    return g.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("joined"))


@query("src19_codings", "SELECT Document_name AS document, trim(regexp_replace(translate(Code, '´`’', ''''''''), '[''\\s]+$|^[''\\s]+', '', 'g')) AS code, Segment AS segment, coalesce(trim(Comment), '') AS comment, Beginning - 1 AS first_paragraph, \"End\" - 1 AS last_paragraph FROM codings")
def src19(spark: SparkSession, sf: str) -> DataFrame:
    return readers.coding_columns(read(spark, sf, "codings"))


@query("src20_tokens", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS sent_id FROM documents WHERE text IS NOT NULL) SELECT doc_id, sent_id, len(regexp_extract_all(line, '[\p{L}\p{N}]+'))::INT AS tokens FROM l")
def src20(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for an annotation service: lines and word tokens."""
    lines = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sent_id", "line"))
    return lines.select("doc_id", "sent_id", F.size(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("tokens"))


@query("snk2_export_names", M + ", d2 AS (SELECT DISTINCT topic_id, doc_id FROM m) SELECT topic_id, doc_id, topic_id || ' (' || lpad((row_number() OVER (PARTITION BY topic_id ORDER BY doc_id))::VARCHAR, 3, '0') || ')' AS export_name FROM d2")
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    return writers.numbered(mentions(spark, sf).select("topic_id", "doc_id").distinct(), "topic_id", ["doc_id"])


@query("snk3_exports_between", "SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
def snk3(spark: SparkSession, sf: str) -> DataFrame:
    return writers.between_dates(read(spark, sf, "events"), "ts", "2024-01-03", "2024-01-05").select("event_id")


_NO = M + ", no AS (SELECT topic_id, chain, dense_rank() OVER (PARTITION BY topic_id ORDER BY chain) AS chain_no FROM (SELECT DISTINCT topic_id, chain FROM m)), mn AS (SELECT m.*, chain_no FROM m JOIN no USING (topic_id, chain))"


@query("snk4_span_brackets", _NO + """, x AS (SELECT doc_id, sent_id, first_tok AS tok_id, 1 AS k, 0 AS o, '(' || chain_no || ')' AS t FROM mn WHERE first_tok = last_tok
 UNION ALL SELECT doc_id, sent_id, first_tok, 2, first_tok - last_tok, '(' || chain_no FROM mn WHERE first_tok < last_tok UNION ALL SELECT doc_id, sent_id, last_tok, 0, last_tok - first_tok, chain_no || ')' FROM mn WHERE first_tok < last_tok)
SELECT doc_id, sent_id, tok_id, string_agg(t, '|' ORDER BY k, o, t) AS tag FROM x GROUP BY ALL""")  # fmt: skip
def snk4(spark: SparkSession, sf: str) -> DataFrame:
    return writers.span_brackets(writers.chain_numbers(mentions(spark, sf), ["topic_id"], "chain"))


@query("snk5_key_lines", _NO + "SELECT mention_id, topic_id || chr(9) || '(' || chain_no || ')' AS line FROM mn")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    n = writers.chain_numbers(mentions(spark, sf), ["topic_id"], "chain")
    return n.select("mention_id", F.concat_ws("\t", "topic_id", F.format_string("(%d)", "chain_no")).alias("line"))


@query("snk6_document_key_lines", M + ", no AS (SELECT doc_id, chain, dense_rank() OVER (PARTITION BY doc_id ORDER BY chain) AS chain_no FROM (SELECT DISTINCT doc_id, chain FROM m)) SELECT mention_id, doc_id || chr(9) || '(' || chain_no || ')' AS line FROM m JOIN no USING (doc_id, chain)")
def snk6(spark: SparkSession, sf: str) -> DataFrame:
    n = writers.chain_numbers(mentions(spark, sf), ["doc_id"], "chain")
    return n.select("mention_id", F.concat_ws("\t", "doc_id", F.format_string("(%d)", "chain_no")).alias("line"))


@query("snk8_entity_json", M + "SELECT chain, md5(string_agg(mention_id || ':' || text, '|' ORDER BY mention_id)) AS members_md5, count(*) AS size FROM m GROUP BY 1")
def snk8(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON of each entity, read back: what it holds is compared, not its spelling."""
    j = writers.entity_json(mentions(spark, sf), "chain")
    back = j.select("chain", F.from_json("json", "size bigint, mentions array<struct<mention_id:string,text:string>>").alias("x"))
    return back.select("chain", F.md5(F.array_join(F.transform("x.mentions", lambda s: F.concat_ws(":", s["mention_id"], s["text"])), "|")).alias("members_md5"), F.col("x.size").alias("size"))


@query("snk9_multi_member_groups", M + "SELECT doc_id, chain, count(*) AS size FROM m GROUP BY ALL HAVING count(*) > 1")
def snk9(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("doc_id", "chain").agg(F.count("*").alias("size")).where("size > 1")


@query("snk11_grouped_benchmark", "SELECT entities_method, round(avg(experiment_num), 6) AS mean_num, min(experiment_num) AS first_num FROM experiments GROUP BY 1")
def snk11(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "experiments").groupBy("entities_method").agg(F.round(F.avg("experiment_num"), 6).alias("mean_num"), F.min("experiment_num").alias("first_num"))


@query("snk13_event_entity_split", M + "SELECT CASE WHEN kind = 'ACT' THEN 'event' ELSE 'entity' END AS side, count(*) AS n FROM m GROUP BY 1")
def snk13(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy(F.when(F.col("kind") == "ACT", "event").otherwise("entity").alias("side")).agg(F.count("*").alias("n"))


@query("snk15_article_files", "WITH a AS (SELECT DISTINCT article_id, source_domain FROM articles) SELECT article_id, split_part(source_domain, '.', 1) || '_' || (row_number() OVER (PARTITION BY source_domain ORDER BY article_id) - 1) AS file FROM a")
def snk15(spark: SparkSession, sf: str) -> DataFrame:
    return writers.split_articles(read(spark, sf, "articles").select("article_id", "source_domain").distinct())


# -- extraction over a token table built from the documents ----------------------------------------------------------

_TOK = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS sent_id FROM documents WHERE text IS NOT NULL),
 tk AS (SELECT doc_id, sent_id, unnest(regexp_extract_all(line, '[\p{L}\p{N}]+')) AS word, unnest(range(len(regexp_extract_all(line, '[\p{L}\p{N}]+'))))::INT AS tok FROM l),
 g AS (SELECT *, regexp_matches(word, '^\p{Lu}') AS cap FROM tk), n AS (SELECT *, sum((NOT cap)::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok) AS grp FROM g),
 sp AS (SELECT doc_id, sent_id, grp, min(tok) AS first_tok, max(tok) AS last_tok, count(*) AS size, string_agg(word, ' ' ORDER BY tok) AS text FROM n WHERE cap GROUP BY ALL)
"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sent_id", "line"))
    return lines.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("tok", "word"))


def name_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of capitalised words: gaps and islands by a running count of other words."""
    cap = F.col("word").rlike(r"^\p{Lu}")
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = tokens(spark, sf).withColumn("grp", F.sum((~cap).cast("int")).over(w)).where(cap)
    g = t.groupBy("doc_id", "sent_id", "grp").agg(F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"), F.count("*").alias("size"),
                                                  F.array_sort(F.collect_list(F.struct("tok", "word"))).alias("ws"))
    return g.select("doc_id", "sent_id", "first_tok", "last_tok", "size", F.array_join(F.transform("ws", lambda s: s["word"]), " ").alias("text"))


@query("ext1_candidates", _TOK + "SELECT doc_id, sent_id, first_tok, last_tok, text FROM sp WHERE size < 8")
def ext1(spark: SparkSession, sf: str) -> DataFrame:
    return name_spans(spark, sf).where("size < 8").select("doc_id", "sent_id", "first_tok", "last_tok", "text")


@query("ext2_document_chains", _TOK + "SELECT doc_id, text, count(*) AS n, min(sent_id) AS first_sentence FROM sp GROUP BY ALL HAVING count(*) > 1")
def ext2(spark: SparkSession, sf: str) -> DataFrame:
    return name_spans(spark, sf).groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("sent_id").alias("first_sentence")).where("n > 1")


@query("ext6_heads", _TOK + ", h AS (SELECT sp.doc_id, sp.sent_id, sp.first_tok, max(tk.tok) AS head_tok FROM sp JOIN tk ON sp.doc_id = tk.doc_id AND sp.sent_id = tk.sent_id AND tk.tok BETWEEN sp.first_tok AND sp.last_tok GROUP BY ALL) SELECT h.doc_id, h.sent_id, h.first_tok, tk.word AS head FROM h JOIN tk ON h.doc_id = tk.doc_id AND h.sent_id = tk.sent_id AND h.head_tok = tk.tok")
def ext6(spark: SparkSession, sf: str) -> DataFrame:
    return name_spans(spark, sf).select("doc_id", "sent_id", "first_tok", F.element_at(F.split("text", " "), -1).alias("head"))


@query("ext10_survivors", _TOK + ", k AS (SELECT text, min(doc_id) AS doc_id FROM sp GROUP BY 1) SELECT sp.doc_id, sp.sent_id, sp.first_tok FROM sp SEMI JOIN k ON k.text = sp.text AND k.doc_id = sp.doc_id")
def ext10(spark: SparkSession, sf: str) -> DataFrame:
    s = name_spans(spark, sf)
    keep = s.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return s.join(keep, ["text", "doc_id"], "left_semi").select("doc_id", "sent_id", "first_tok")


@query("ext11_document_batches", "WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source || '/' || ((rn - 1) // 10) AS batch FROM s")
def ext11(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.floor((rn - 1) / 10).cast("string")).alias("batch"))


@query("ext14_back_off_titles", M + """, n AS (SELECT lower(text) AS phrase, min(chain) AS title FROM m WHERE kind = 'HUM' GROUP BY 1)
SELECT mention_id, coalesce(a.title, b.title, c.title) AS title FROM m LEFT JOIN n a ON a.phrase = lower(m.text) LEFT JOIN n b ON b.phrase = array_to_string(words[-3:], ' ') LEFT JOIN n c ON c.phrase = array_to_string(words[-2:], ' ')""")  # fmt: skip
def ext14(spark: SparkSession, sf: str) -> DataFrame:
    """A title for the whole phrase, else its last three words, else its last two."""
    m = mentions(spark, sf)
    n = m.where("kind = 'HUM'").groupBy(F.lower("text").alias("phrase")).agg(F.min("chain").alias("title"))
    last = lambda k: F.array_join(F.when(F.size("words") <= k, F.col("words")).otherwise(F.slice("words", -k, k)), " ")
    j = m.select("mention_id", F.lower("text").alias("p0"), last(3).alias("p1"), last(2).alias("p2"))
    for i in range(3):
        j = j.join(n.select(F.col("phrase").alias(f"p{i}"), F.col("title").alias(f"t{i}")), f"p{i}", "left")
    return j.select("mention_id", F.coalesce("t0", "t1", "t2").alias("title"))


@query("ext16_token_rows", M + "SELECT mention_id, doc_id, sent_id, unnest(tok_ids) AS tok FROM m")
def ext16(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).select("mention_id", "doc_id", "sent_id", F.explode("tok_ids").alias("tok"))


@query("ext19_single_roles", M + ", a AS (SELECT DISTINCT doc_id, sent_id, chain FROM m WHERE kind = 'HUM'), b AS (SELECT DISTINCT doc_id, sent_id, chain FROM m WHERE kind = 'LOC') SELECT doc_id, sent_id, chain FROM b EXCEPT SELECT doc_id, sent_id, chain FROM a")
def ext19(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of a second role, refused where the entity already has the first."""
    m = mentions(spark, sf).select("doc_id", "sent_id", "chain", "kind")
    return m.where("kind = 'LOC'").drop("kind").distinct().join(m.where("kind = 'HUM'"), ["doc_id", "sent_id", "chain"], "left_anti")


@query("ext20_annotation_rows", M + """, z AS (SELECT chain, count(*) AS size FROM m GROUP BY 1), p AS (SELECT chain, mention_id AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY (kind = 'HUM') DESC, mention_id) AS i FROM m) WHERE i = 1)
SELECT m.mention_id, m.doc_id, m.sent_id, z.size, p.preferred, length(m.text)::INT AS chars FROM m JOIN z USING (chain) JOIN p USING (chain)""")  # fmt: skip
def ext20(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    e = m.groupBy("chain").agg(F.count("*").alias("size"), F.min(F.struct((F.col("kind") != "HUM").alias("o"), "mention_id")).alias("p"))
    return m.join(e, "chain").select("mention_id", "doc_id", "sent_id", "size", F.col("p.mention_id").alias("preferred"), F.length("text").alias("chars"))


@query("ext21_gold_clusters", M + "SELECT topic_id, chain, string_agg(mention_id, ',' ORDER BY mention_id) AS members FROM m WHERE chain <> '-' GROUP BY ALL")
def ext21(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).where("chain <> '-'").groupBy("topic_id", "chain").agg(F.array_join(F.array_sort(F.collect_list("mention_id")), ",").alias("members"))
