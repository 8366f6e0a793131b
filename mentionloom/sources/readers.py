"""Readers of annotation files: explicit schemas, distributed parsing, no inference.

Every reader returns a plain table. Malformed records go to a ``corrupt`` column where the format has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = ("authors array<string>, date_download string, date_modify string, date_publish string, title string, description string, text string, "
           "source_domain string, language string, filename string, image_url string, localpath string, title_page string, title_rss string, url string")  # fmt: skip
MENTION = ("mention_id string, doc_id string, sent_id int, tokens_number array<int>, tokens_str string, coref_chain string, mention_type string, "
           "score double, topic_id string, is_continuous boolean, is_singleton boolean")  # fmt: skip


def news_articles(spark: SparkSession, folder: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A folder of news records, one JSON object per file (SRC1, SRC2, SRC4); ``columns`` renames attributes (SRC3)."""
    df = spark.read.schema(ARTICLE + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(folder, multiLine=True, pathGlobFilter="*.json")
    df = df.withColumn("path", F.col("_metadata.file_path"))
    return df.withColumnsRenamed(columns) if columns else df


def gold_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of mention objects, one array per file (SRC5)."""
    return spark.read.schema(MENTION).json(folder, multiLine=True)


def comparison_table(spark: SparkSession, path: str, method: str, step: str) -> DataFrame:
    """A type-by-type matrix with a header as (method, step, type_a, type_b, value) (SRC13)."""
    wide = spark.read.option("header", True).csv(path)
    first, *types = wide.columns
    long = wide.unpivot([first], types, "type_b", "value")
    return long.select(F.lit(method).alias("method"), F.lit(step).alias("step"), F.col(first).alias("type_a"), "type_b", F.col("value").cast("double").alias("value"))


def word_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Text vectors, one word and its numbers per line (SRC14)."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) == dims + 1).select(
        parts[0].alias("word"), F.transform(F.slice(parts, 2, dims), lambda x: x.cast("float")).alias("vec"))


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """A grid of run configurations, missing names filled (SRC17)."""
    return spark.read.option("header", True).csv(path).fillna("not_specified")


def codings(spark: SparkSession, path: str) -> DataFrame:
    """Qualitative codings with paragraph numbers from 0 (SRC19)."""
    schema = "Document_name string, Code string, Segment string, Comment string, Beginning int, End int"
    return coding_columns(spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path))


def coding_columns(df: DataFrame) -> DataFrame:
    """Renamed columns; paragraphs counted from 0, stray marks taken off codes."""
    return df.select(F.col("Document_name").alias("document"), clean_code(F.col("Code")).alias("code"), F.col("Segment").alias("segment"),
                     F.coalesce(F.trim("Comment"), F.lit("")).alias("comment"), (F.col("Beginning") - 1).alias("first_paragraph"), (F.col("End") - 1).alias("last_paragraph"))


def clean_code(code: Column) -> Column:
    """A code without stray marks and surrounding space (STR7)."""
    return F.trim(F.regexp_replace(F.translate(code, "´`’", "'''"), r"['\s]+$|^['\s]+", ""))


def outline(lines: DataFrame, doc: str, no: str, line: str) -> DataFrame:
    """A numbered outline as (doc, section, item, line_no, body): "N." heads a section, "N.N." an item, other lines are
    body (SRC6). Running counts replace a state machine."""
    is_item, is_section = F.col(line).rlike(r"^\s*\d+\.\d+\.\s"), F.col(line).rlike(r"^\s*\d+\.\s")
    w = Window.partitionBy(doc).orderBy(no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = lines.select(doc, no, line, F.sum(is_section.cast("int")).over(w).alias("section"), F.sum(is_item.cast("int")).over(w).alias("item"), (is_item | is_section).alias("head"))
    return t.select(doc, F.col("section").cast("int").alias("section"), F.col("item").cast("int").alias("item"), F.col(no).alias("line_no"), "head", F.col(line).alias("body"))


def tagged_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated columns per token, "-" for no chain; blank lines between sentences are dropped (SRC9)."""
    schema = "doc_id string, sent_id int, tok_id int, word string, chain string"
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "\0").csv(path)
    return df.where("doc_id IS NOT NULL").withColumn("chain", F.when(F.col("chain") != "-", F.col("chain")))


def bio_spans(tokens: DataFrame, by: list[str], position: str, tag: str, word: str | None = None) -> DataFrame:
    """B-/I-/O tags to spans (SRC10, EXT17): gaps and islands by a running count of openings."""
    w = Window.partitionBy(*by).orderBy(position)
    kind = F.regexp_extract(F.col(tag), "^[BI]-(.*)$", 1)
    starts = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & (~F.coalesce(F.lag(tag).over(w).rlike("^[BI]-"), F.lit(False)) | (F.lag(kind).over(w) != kind)))
    t = tokens.withColumn("_kind", kind).withColumn("_start", starts.cast("int"))
    t = t.withColumn("_span", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col(tag) != "O")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, word))), lambda s: s[word]), " ").alias("text")] if word else []
    return t.groupBy(*by, "_span").agg(F.min("_kind").alias("kind"), F.min(position).alias("first_tok"), F.max(position).alias("last_tok"), *text).drop("_span")


def marked_up(spark: SparkSession, path: str) -> DataFrame:
    """Documents with tokens, markables and coreference relations in XML (SRC7, SRC18): one row per mention with its chain;
    a mention in no relation is its own chain."""
    schema = ("_doc_name string, token array<struct<_VALUE:string,_t_id:int,_sentence:int,_number:int>>, "
              "Markables struct<MENTION:array<struct<_m_id:int,_type:string,token_anchor:array<struct<_t_id:int>>>>>, "
              "Relations struct<COREF:array<struct<_r_id:int,_note:string,source:array<struct<_m_id:int>>,target:struct<_m_id:int>>>>")  # fmt: skip
    d = spark.read.format("xml").option("rowTag", "Document").schema(schema).load(path).withColumnRenamed("_doc_name", "doc_id")
    m = d.select("doc_id", F.explode("Markables.MENTION").alias("m")).select("doc_id", F.col("m._m_id").alias("m_id"), F.col("m._type").alias("kind"), F.explode("m.token_anchor._t_id").alias("t_id"))
    t = d.select("doc_id", F.inline("token")).select("doc_id", F.col("_t_id").alias("t_id"), F.col("_sentence").alias("sent_id"), F.col("_number").alias("tok_id"), F.col("_VALUE").alias("word"))
    r = d.select("doc_id", F.explode("Relations.COREF").alias("r")).select("doc_id", F.coalesce("r._note", F.col("r._r_id").cast("string")).alias("chain"), F.explode("r.source._m_id").alias("m_id"))
    span = m.join(t, ["doc_id", "t_id"]).groupBy("doc_id", "m_id", "kind", "sent_id").agg(
        F.array_sort(F.collect_list("tok_id")).alias("tok_ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "word"))), lambda s: s["word"]), " ").alias("text"))
    return span.join(r, ["doc_id", "m_id"], "left").withColumn("chain", F.coalesce("chain", F.concat_ws("_", F.lit("single"), "doc_id", F.col("m_id").cast("string"))))


def selected_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(topic, file, sentences): the chosen sentences of each file (SRC8)."""
    df = spark.read.schema("topic string, file string, sentence int").option("header", True).csv(path)
    return df.groupBy("topic", "file").agg(F.array_sort(F.collect_set("sentence")).alias("sentences"))


def srl_frames(spark: SparkSession, path: str) -> DataFrame:
    """Verb frames of sentences as (doc_id, sent_id, frame, role, text, tok_ids) (SRC11)."""
    schema = "doc_id string, sent_id int, verbs array<struct<verb:string,args:array<struct<role:string,text:string,tok_ids:array<int>>>>>"
    df = spark.read.schema(schema).json(path)
    v = df.select("doc_id", "sent_id", F.posexplode("verbs").alias("frame", "v"))
    return v.select("doc_id", "sent_id", "frame", F.explode("v.args").alias("a")).select("doc_id", "sent_id", "frame", "a.*")


def srl_columns(rows: DataFrame) -> DataFrame:
    """Column form of verb frames: the k-th predicate of a sentence owns column k; brackets open and close spans (SRC12).

    ``rows`` has (doc_id, sent_id, tok_id, predicate, columns array<string>)."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    preds = rows.where("predicate <> '-'").select("doc_id", "sent_id", "tok_id", "predicate")
    preds = preds.withColumn("frame", F.count("*").over(w) - 1)
    cells = rows.select("doc_id", "sent_id", "tok_id", F.posexplode("columns").alias("frame", "cell"))
    opened = F.regexp_extract("cell", r"^\((\w[\w-]*)", 1)
    ww = Window.partitionBy("doc_id", "sent_id", "frame").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = cells.withColumn("role", opened).withColumn("span", F.sum((opened != "").cast("int")).over(ww))
    closed = F.sum(F.col("cell").endswith(")").cast("int")).over(ww) - F.col("cell").endswith(")").cast("int")
    c = c.withColumn("inside", F.col("span") > closed).where("inside")
    spans = c.groupBy("doc_id", "sent_id", "frame", "span").agg(F.max("role").alias("role"), F.min("tok_id").alias("first_tok"), F.max("tok_id").alias("last_tok"))
    return spans.join(preds.select("doc_id", "sent_id", "frame", "predicate"), ["doc_id", "sent_id", "frame"]).drop("span")


def newest_lookup(versions: DataFrame, key: str, stamp: str, value: str) -> DataFrame:
    """The newest non-empty value of each key of a versioned lookup table (SRC15)."""
    return versions.where(F.length(value) > 0).groupBy(key).agg(F.max_by(value, F.struct(stamp, value)).alias(value))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, bytes) of the files of a folder, by path (SRC16)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("path")
