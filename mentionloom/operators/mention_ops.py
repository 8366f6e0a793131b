"""Mentions: projections, filters, spans, dictionaries and joins between mentions, all set at a time.

The base frame of these operators is ``mentions``: one row per distinct mention with its primary chain, its token
positions and its head (the last word, stripped of punctuation). Every order-dependent choice has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of mention classes by what a chain's or a tag's code contains.
CLASS_PRECEDENCE = (("ACT", "ACTION"), ("LOC", "LOCATION"), ("NON", "NON_HUMAN"), ("HUM", "HUMAN"), ("GRP", "HUMAN"), ("TIM", "TIME"))
STOPWORDS = "a an and the of in on at to for by with from as is la el los las le les des du de der die das ein eine und et y"


def words_of(text: Column) -> Column:
    """The words of a phrase."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def mention_base(mentions: DataFrame) -> DataFrame:
    """One row per mention: primary chain, class, head and span."""
    m = mentions.distinct()
    kind = F.regexp_replace(F.coalesce("mention_type", F.lit("UNK")), r"\+", "")
    words = words_of(F.col("tokens_str"))
    return m.select(
        "mention_id", "doc_id", "sent_id", F.col("tokens_number").alias("tok_ids"), F.col("tokens_str").alias("text"),
        F.split_part("coref_chain", F.lit("+"), F.lit(1)).alias("chain"), F.col("coref_chain").alias("labels"), kind.alias("kind"),
        "topic_id", "score", "is_continuous", "is_singleton", words.alias("words"),
        F.get(words, F.size(words) - 1).alias("head"), F.array_min("tokens_number").alias("first_tok"), F.array_max("tokens_number").alias("last_tok"),
    )


def is_contiguous(tok_ids: Column) -> Column:
    """Whether token positions form one run."""
    return (F.array_max(tok_ids) - F.array_min(tok_ids) + 1) == F.size(F.array_distinct(tok_ids))


def mention_class(code: Column) -> Column:
    """The class of a code by the order of precedence; UNKNOWN otherwise."""
    out = None
    for part, name in CLASS_PRECEDENCE:
        out = F.when(F.upper(code).contains(part), name) if out is None else out.when(F.upper(code).contains(part), name)
    return out.otherwise("UNKNOWN")


def stable_id(*parts: Column) -> Column:
    """A deterministic id of the parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def split_labels(mentions: DataFrame) -> DataFrame:
    """One row per code of a multi-label mention; the type of the same place, else the first."""
    labels = F.posexplode(F.split("labels", r"\+")).alias("pos", "label")
    types = F.split(F.col("kind"), r"\+")
    m = mentions.select("mention_id", "kind", labels)
    return m.select("mention_id", F.col("pos").cast("int").alias("pos"), "label", F.coalesce(F.get(types, F.col("pos")), F.get(types, F.lit(0))).alias("label_type"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_of(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def span_overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of spans that share a token position: positions are exploded, so this is a hash join, never a range scan."""
    x = a.select(*on, F.col("mention_id").alias("a_id"), F.explode("tok_ids").alias("tok"))
    y = b.select(*on, F.col("mention_id").alias("b_id"), F.explode("tok_ids").alias("tok"))
    return x.join(y, [*on, "tok"]).where("a_id < b_id").groupBy(*on, "a_id", "b_id").agg(F.count("*").alias("shared"))


def nearest(left: DataFrame, right: DataFrame, on: list[str], side: str) -> DataFrame:
    """(left id, right id, gap): the nearest right span before ("left") or after ("right") each left span in its
    sentence; touching spans do not count. One pass over the merged timeline: no join between the sides."""
    before = side == "left"
    marks = right.select(*on, F.col("last_tok" if before else "first_tok").alias("at"), F.col("mention_id").alias("rid"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("lid"))
    at = F.col("first_tok") - 2 if before else F.col("last_tok") + 2
    asks = left.select(*on, at.alias("at"), F.lit(None).cast("string").alias("rid"), F.lit(1).alias("asks"), F.col("mention_id").alias("lid"))
    order = Window.partitionBy(*on).orderBy("at", F.asc("asks") if before else F.desc("asks"), "rid")
    mark = F.when(F.col("rid").isNotNull(), F.struct("at", "rid"))
    if before:
        near = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        near = F.first(mark, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = marks.unionByName(asks).withColumn("near", near).where("asks = 1 AND near IS NOT NULL")
    gap = F.col("at") + 2 - F.col("near.at") if before else F.col("near.at") - F.col("at") + 2
    return t.select(*on, F.col("lid").alias("left_id"), F.col("near.rid").alias("right_id"), gap.alias("gap"))


def word_type_votes(mentions: DataFrame) -> DataFrame:
    """(word, kind, n) and the majority kind of each word; ties go to the smaller kind."""
    v = mentions.select(F.explode("words").alias("word"), "kind").groupBy("word", "kind").agg(F.count("*").alias("n"))
    return first_of(v, ["word"], [F.desc("n"), F.asc("kind")])


def wordset(words: Column) -> Column:
    """A phrase as a canonical set of words without stop words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(F.split(F.lit(STOPWORDS), " "), w)))), " ")


def head_overlap(entities: DataFrame, by: list[str], entity: str, item: str) -> DataFrame:
    """Pairs of entities of one group that share items, with how many: an inverted index, not a cross join.

    ``item`` values are distinct per entity first, so a frequent item costs as many rows as it has entities."""
    e = entities.select(*by, entity, item).distinct()
    x, y = e.withColumnRenamed(entity, "a"), e.withColumnRenamed(entity, "b")
    return x.join(y, [*by, item]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"))
