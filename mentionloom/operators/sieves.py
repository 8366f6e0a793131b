"""Merge steps of the rule-gated methods: each step is a query for edges between entities, gated by a type table.

Entities are groups of mentions with a type, a size, words, heads and phrases. A step returns edges (a, b, sim) with
a the larger entity (then the smaller name). Edges come from inverted indexes or from pairs within a bounded group (an
entity's topic and type); merging is by components or greedily (operators.graphs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.operators import mention_ops as ops
from mentionloom.operators.vectors import cosine
from mentionloom.session import cut

#: The nine entity types.
TYPES = ("person-ne", "person-nes", "person-nn", "person-nns", "group-ne", "group", "country-ne", "country", "misc")


def entity_type(kind: Column, size: Column, head: Column) -> Column:
    """One of the nine types from a mention class, the entity's size and the number of its head."""
    plural = F.coalesce(head, F.lit("")).endswith("s")
    return (
        F.when((kind == "HUM") & (size > 1), F.when(plural, "person-nes").otherwise("person-ne"))
        .when(kind == "HUM", F.when(plural, "person-nns").otherwise("person-nn"))
        .when((kind == "GRP") & (size > 1), "group-ne").when(kind == "GRP", "group")
        .when((kind == "LOC") & (size > 1), "country-ne").when(kind == "LOC", "country").otherwise("misc")
    )


def entities(mentions: DataFrame) -> DataFrame:
    """(topic_id, entity, size, kind, head, etype): one row per chain within a topic; heads by frequency, then by name."""
    h = mentions.groupBy("topic_id", "chain", "head").agg(F.count("*").alias("n"))
    head = h.groupBy("topic_id", "chain").agg(F.min(F.struct((-F.col("n")).alias("o"), "head")).alias("h"))
    e = mentions.groupBy("topic_id", "chain").agg(F.count("*").alias("size"), F.min("kind").alias("kind"))
    e = e.join(head, ["topic_id", "chain"]).select("topic_id", F.col("chain").alias("entity"), "size", "kind", F.col("h.head").alias("head"))
    return e.withColumn("etype", entity_type(F.col("kind"), F.col("size"), F.col("head")))


def gate(edges: DataFrame, ents: DataFrame, rules: DataFrame, method: str, step: str, allowed: Column) -> DataFrame:
    """Edges whose types the step's table allows, the larger entity first. ``rules`` has 81 rows for a step."""
    e = ents.select("topic_id", "entity", "size", "etype")
    x = e.select("topic_id", F.col("entity").alias("a"), F.col("size").alias("size_a"), F.col("etype").alias("type_a"))
    y = e.select("topic_id", F.col("entity").alias("b"), F.col("size").alias("size_b"), F.col("etype").alias("type_b"))
    swap = F.struct("a", "b")
    j = edges.join(e.select("topic_id", F.col("entity").alias("a"), F.col("size").alias("sa")), ["topic_id", "a"]).join(
        e.select("topic_id", F.col("entity").alias("b"), F.col("size").alias("sb")), ["topic_id", "b"])
    swap = (F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") < F.col("a")))
    j = j.select("topic_id", "sim", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    r = rules.where((F.col("method") == method) & (F.col("step") == step)).select("type_a", "type_b", F.col("value").alias("rule"))
    out = j.join(x, ["topic_id", "a"]).join(y, ["topic_id", "b"]).join(F.broadcast(r), ["type_a", "type_b"])
    return out.where(allowed).select("topic_id", "a", "size_a", "b", "size_b", "sim", "rule")


def _pairs(items: DataFrame, item: str) -> DataFrame:
    """Pairs of entities of a topic that share an item, with the number shared."""
    return ops.head_overlap(items, ["topic_id"], "entity", item)


def title_edges(ents: DataFrame, titles: DataFrame) -> DataFrame:
    """Equal titles (step 0): titles has (topic_id, entity, title), null where unknown."""
    return _pairs(titles.where("title IS NOT NULL").select("topic_id", "entity", "title"), "title").select("topic_id", "a", "b", F.lit(1.0).alias("sim"))


def head_edges(ents: DataFrame) -> DataFrame:
    """Equal representative heads."""
    return _pairs(ents.where("head IS NOT NULL").select("topic_id", "entity", "head"), "head").select("topic_id", "a", "b", F.lit(1.0).alias("sim"))


#: Fixed value: a word in at least this share of a group's items joins all its sets.
VERY_FREQUENT = 0.9


def frequent_sets(words: DataFrame, by: list[str], item: str, least: int) -> DataFrame:
    """(by, itemset, support): all sets of words that at least ``least`` items of a group have - all items, where a group has
    fewer - level by level: a set of k words is a frequent one of k - 1 with a later frequent word of the same item. Counted by
    joins on the item, so a group is never gathered; levels end with the longest item. ``words`` has (by, item, word)."""
    w = words.select(*by, item, "word").distinct()
    n = w.select(*by, item).distinct().groupBy(*by).agg(F.least(F.count("*"), F.lit(least)).alias("need"))
    w = cut(w.join(n, by))
    one = w.groupBy(*by, "word", "need").agg(F.count("*").alias("support")).where("support >= need")
    frequent = cut(w.join(one.select(*by, "word"), [*by, "word"]).select(*by, item, "word", "need"))
    level = frequent.select(*by, item, "need", F.array("word").alias("itemset"))
    out = one.select(*by, F.array("word").alias("itemset"), "support")
    while True:
        longer = level.join(frequent.select(*by, item, "word"), [*by, item]).where(F.col("word") > F.element_at("itemset", -1))
        longer = longer.select(*by, item, "need", F.concat("itemset", F.array("word")).alias("itemset"))
        kept = cut(longer.groupBy(*by, "itemset", "need").agg(F.count("*").alias("support")).where("support >= need"))
        if not kept.limit(1).count():
            return out
        out = out.union(kept.select(*by, "itemset", "support"))
        level = cut(longer.join(kept.select(*by, "itemset"), [*by, "itemset"]))


def maximal_sets(words: DataFrame, by: list[str], item: str, least: int) -> DataFrame:
    """(by, itemset) of the frequent sets that are part of no other, each with the words that at least ``VERY_FREQUENT`` of
    the group's items have. A set is part of another only if it is that one less a word at least, so every set is held
    against the longer ones of its group that have its first word."""
    f = cut(frequent_sets(words, by, item, least))
    x = f.select(*by, "itemset", F.get("itemset", F.lit(0)).alias("word"))
    y = f.select(*by, F.col("itemset").alias("outer"), F.explode("itemset").alias("word"))
    inner = x.join(y, [*by, "word"]).where((F.size("outer") > F.size("itemset")) & (F.size(F.array_except("itemset", "outer")) == 0)).select(*by, "itemset").distinct()
    n = words.select(*by, item).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    often = f.where(F.size("itemset") == 1).join(n, by).where(F.col("support") >= VERY_FREQUENT * F.col("n")).groupBy(*by).agg(F.collect_list(F.get("itemset", F.lit(0))).alias("often"))
    m = f.join(inner, [*by, "itemset"], "left_anti").join(often, by, "left")
    return m.select(*by, F.array_sort(F.array_union("itemset", F.coalesce("often", F.array().cast("array<string>")))).alias("itemset")).distinct()
