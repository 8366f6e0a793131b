"""Writers: checkpoint tables, numbered exports, key files and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def save_stage(df: DataFrame, folder: str, module: str) -> str:
    """One table per module, partitioned by topic: a later run starts from it (SNK1)."""
    path = f"{folder}/module={module}"
    df.write.mode("overwrite").partitionBy("topic_id").parquet(path)
    return path


def numbered(df: DataFrame, topic: str, order: list[str]) -> DataFrame:
    """A unique export name per row: the topic and its number (SNK2)."""
    n = F.row_number().over(Window.partitionBy(topic).orderBy(*order))
    return df.withColumn("export_name", F.format_string("%s (%03d)", F.col(topic), n))


def between_dates(df: DataFrame, stamp: str, first: str, last: str) -> DataFrame:
    """Exports between two dates, both inclusive (SNK3)."""
    return df.where((F.to_date(stamp) >= F.lit(first).cast("date")) & (F.to_date(stamp) <= F.lit(last).cast("date")))


def chain_numbers(mentions: DataFrame, by: list[str], chain: str, name: str = "chain_no") -> DataFrame:
    """Chains numbered within ``by`` by their names (CLU14): distinct chains are numbered, then joined back."""
    c = mentions.select(*by, chain).distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(chain)))
    return mentions.join(c, [*by, chain])


def span_brackets(mentions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_id, tok_id, tag): chain brackets of each token (SNK4): ends first, then singles, then starts, longer
    spans outside; tokens without any get "-"."""
    size = F.col("last_tok") - F.col("first_tok")
    one = mentions.where("first_tok = last_tok").select("doc_id", "sent_id", F.col("first_tok").alias("tok_id"), F.lit(1).alias("k"), F.lit(0).alias("o"), F.format_string("(%d)", "chain_no").alias("t"))
    more = mentions.where("first_tok < last_tok")
    start = more.select("doc_id", "sent_id", F.col("first_tok").alias("tok_id"), F.lit(2).alias("k"), (-size).alias("o"), F.format_string("(%d", "chain_no").alias("t"))
    end = more.select("doc_id", "sent_id", F.col("last_tok").alias("tok_id"), F.lit(0).alias("k"), size.alias("o"), F.format_string("%d)", "chain_no").alias("t"))
    tags = end.unionByName(one).unionByName(start).groupBy("doc_id", "sent_id", "tok_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "t"))), lambda s: s["t"]), "|").alias("tag"))
    if tokens is None:
        return tags
    return tokens.join(tags, ["doc_id", "sent_id", "tok_id"], "left").withColumn("tag", F.coalesce("tag", F.lit("-")))


def mention_lines(mentions: DataFrame, scope: Column) -> DataFrame:
    """Key files of one line per mention (SNK5, SNK6)."""
    return mentions.select(F.concat_ws("\t", scope, F.format_string("(%d)", "chain_no")).alias("line"))


def entity_json(mentions: DataFrame, entity: str) -> DataFrame:
    """One JSON object per entity: its mentions in order (SNK8)."""
    member = F.struct("mention_id", "doc_id", "sent_id", "text")
    g = mentions.groupBy(entity).agg(F.array_sort(F.collect_list(member)).alias("mentions"), F.count("*").alias("size"))
    return g.select(entity, F.to_json(F.struct(F.col(entity).alias("name"), "size", "mentions")).alias("json"))


def write_text(df: DataFrame, path: str) -> None:
    """Lines to text files, one per partition (SNK7, SNK14)."""
    df.select("line").write.mode("overwrite").text(path)


def write_csv(frames: dict[str, DataFrame], folder: str) -> None:
    """One folder of CSV files per result frame (SNK10, SNK11, SNK12)."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def split_by_side(mentions: DataFrame, folder: str) -> None:
    """Event and entity mentions as JSON lines (SNK13): one pass, partitioned by side."""
    mentions.withColumn("side", F.when(F.col("kind") == "ACT", "event").otherwise("entity")).write.mode("overwrite").partitionBy("side").json(folder)


def split_articles(articles: DataFrame) -> DataFrame:
    """One file name per article of an array: site name and number (SNK15)."""
    n = F.row_number().over(Window.partitionBy("source_domain").orderBy("article_id")) - 1
    return articles.select("article_id", F.concat_ws("_", F.split_part("source_domain", F.lit("."), F.lit(1)), n.cast("string")).alias("file"))
