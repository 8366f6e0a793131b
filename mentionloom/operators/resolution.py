"""Entity identification as a chain of merge steps over tables.

Words of mentions are annotated rows (topic_id, mention_id, doc_id, chain, kind, i, n, word, raw, pos, ner, dep) in which
``chain`` is the entity that the mention belongs to at present. A step derives what it compares from these rows -
so sizes, types, heads and phrases are those after the steps before -, finds edges by inverted indexes or a blocked
similarity join, gates them by the type table, and absorbs: entities take their turns by size, each takes the similar
ones that are not larger and not yet taken, as they were when the step began. An entity has one turn in a step and a
winner is not taken, so nothing that changes within a step is ever compared in it. Turns of entities that are not
connected by edges are independent, so absorption runs per connected component, not per topic.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import scalars
from mentionloom.operators import sieves, vectors
from mentionloom.operators.graphs import label_components
from mentionloom.session import cut

#: Shares of a grid's cells, and how much above its rule a similarity counts twice.
LABELS_SHARE, COMPOUND_SHARE, SETS_SHARE, STRINGS_SHARE, VERY_SIMILAR = 0.3, 0.5, 0.3, 0.7, 0.2
#: Cosines of mentions, of heads of one type and of two, of a group's modifiers, and linkage distances.
MENTION_COSINE, SAME_TYPE, OTHER_TYPE, GROUP_COSINE, TYPE_DISTANCE, MISC_DISTANCE = 0.6, 0.4, 0.7, 0.7, 0.3, 0.4
#: A cell that has no more cells beside it says nothing across types.
SMALL_GRID = 2
PRONOUN_TAGS = ("PRP", "PRP$")


def entities_of(words: DataFrame) -> DataFrame:
    """(topic_id, entity, size, kind, head, etype) of the entities as they are."""
    m = words.where("i = n - 1").select("topic_id", "chain", "mention_id", "kind", F.col("word").alias("head"))
    return sieves.entities(m)


def roles(words: DataFrame) -> DataFrame:
    """(topic_id, entity, word, heads, compounds, adjectives, ne): how often a word is a head, compound or adjective of an
    entity, and whether it is part of a name. Pronouns are heads only of entities that have no others."""
    prp = F.col("pos").isin(*PRONOUN_TAGS)
    root = F.col("dep") == "root"
    only = words.where(root).groupBy("topic_id", "chain").agg(F.bool_and(prp).alias("all_prp"))
    w = words.join(only, ["topic_id", "chain"])
    n = lambda c: F.count_if(c)
    return w.groupBy("topic_id", F.col("chain").alias("entity"), "word").agg(
        n(root & (~prp | F.col("all_prp"))).alias("heads"), n(F.col("dep") == "compound").alias("compounds"), n(F.col("dep") == "amod").alias("adjectives"), F.max((~F.col("ner").isin("O", "DATE", "TITLE")).cast("int")).alias("ne"))


def _ordered(ents: DataFrame, a: str = "a", b: str = "b") -> Column:
    """The larger entity first, of equal ones the smaller name."""
    return (F.col(f"size_{a}") > F.col(f"size_{b}")) | ((F.col(f"size_{a}") == F.col(f"size_{b}")) & (F.col(a) < F.col(b)))


def title_edges(words: DataFrame, ents: DataFrame, wiki: DataFrame) -> DataFrame:
    """Equal titles (step 0). ``wiki`` has (phrase, title); an entity's title is that of its head, missing ones of names are
    filled by the title of their most frequent phrase."""
    p = words.groupBy("topic_id", "chain", "mention_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    p = p.groupBy("topic_id", "chain", "phrase").agg(F.count("*").alias("n")).groupBy("topic_id", F.col("chain").alias("entity")).agg(F.min(F.struct((-F.col("n")).alias("o"), "phrase")).alias("x"))
    e = ents.join(p.select("topic_id", "entity", F.col("x.phrase").alias("phrase")), ["topic_id", "entity"])
    w1, w2 = wiki.select(F.col("phrase").alias("head"), F.col("title").alias("by_head")), wiki.select("phrase", F.col("title").alias("by_phrase"))
    t = e.join(w1, "head", "left").join(w2, "phrase", "left")
    fill = F.when(F.col("etype").contains("-ne") | (F.col("etype") == "misc"), F.col("by_phrase"))
    return sieves.title_edges(ents, t.select("topic_id", "entity", F.coalesce("by_head", fill).alias("title")))


#: What an edge of step 1 is allowed by, as bits of its similarity: 4 any rule, 2 a rule above 1, 1 a rule of 2.
CORE_ALLOWED = "rule > 0 AND (sim >= 4 OR (rule > 1 AND sim % 4 >= 2) OR (rule = 2 AND sim % 2 = 1))"


def core_edges(role: DataFrame, ents: DataFrame, titles: DataFrame) -> DataFrame:
    """(topic_id, a, b, sim) of step 1: shared names; or a shared name among the heads and one among the compounds, with one
    title or exactly one known, heads that are the other's compounds more than once, more than one such name, or (rule
    above 1) one representative within the other; or (rule 2) a named head of the smaller that is a compound of the
    larger. ``titles`` has (topic_id, entity, title)."""
    e = ents.join(titles, ["topic_id", "entity"], "left").select("topic_id", "entity", "size", "title", "head")
    r = role.where("ne = 1 OR heads > 0 OR compounds > 0").join(e, ["topic_id", "entity"])
    side = lambda s: r.select("topic_id", "word", *[F.col(c).alias(f"{c}_{s}" if c != "entity" else s) for c in ("entity", "size", "title", "head", "heads", "compounds", "ne")])
    j = side("a").join(side("b"), ["topic_id", "word"]).where(_ordered(ents))
    ne, h, c = F.col("ne_a") + F.col("ne_b") == 2, (F.col("heads_a") > 0) & (F.col("heads_b") > 0), (F.col("compounds_a") > 0) & (F.col("compounds_b") > 0)
    g = j.groupBy("topic_id", "a", "b").agg(
        F.count_if(ne).alias("names"), F.count_if(ne & h).alias("heads"), F.count_if(ne & c).alias("comps"),
        F.sum(F.when(F.col("heads_a") > 0, F.col("compounds_b")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("heads_b") > 0, F.col("compounds_a")).otherwise(0)).alias("c2"),
        F.max(((F.col("heads_b") > 0) & (F.col("compounds_a") > 0) & (F.col("ne_b") == 1)).cast("int")).alias("inner"),
        F.first("title_a").alias("ta"), F.first("title_b").alias("tb"), F.first("head_a").alias("ha"), F.first("head_b").alias("hb"))
    agree = F.coalesce(F.col("ta") == F.col("tb"), F.col("ta").isNotNull() != F.col("tb").isNotNull())
    both = (F.col("heads") > 0) & (F.col("comps") > 0)
    any_rule = (F.col("names") > 0) | (both & (agree | (F.col("c1") > 1) | (F.col("c2") > 1) | (F.col("comps") > 1) | (F.col("heads") > 1)))
    above = both & (F.col("ha").contains(F.col("hb")) | F.col("hb").contains(F.col("ha")))
    sim = any_rule.cast("int") * 4 + F.coalesce(above, F.lit(False)).cast("int") * 2 + F.col("inner")
    return g.select("topic_id", "a", "b", sim.cast("double").alias("sim")).where("sim > 0")


def phrases_of(words: DataFrame, stops: tuple[str, ...], keep: Column | None = None) -> DataFrame:
    """(topic_id, entity, phrase, n, head): the distinct sets of words of an entity's mentions, without stop words and, if
    there are any others, without the words that ``keep`` is false for."""
    w = words.where(~F.col("word").isin(*stops)) if keep is None else words.where(~F.col("word").isin(*stops) & keep)
    head = F.max(F.when(F.col("i") == F.col("n") - 1, F.col("word"))).alias("head")
    p = w.groupBy("topic_id", "chain", "mention_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("phrase"), head)
    return p.groupBy("topic_id", F.col("chain").alias("entity"), "phrase").agg(F.count("*").alias("n"), F.max("head").alias("head"))


def top_phrases(phrases: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("topic_id", "entity").orderBy(F.desc("n"), "phrase")
    return phrases.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def phrase_cosines(phrases: DataFrame, word_vectors: DataFrame, least: float) -> DataFrame:
    """(topic_id, p, q, sim) of a topic's distinct phrases, each also with itself, both ways: cosines of mean word vectors
    of at least ``least``."""
    p = phrases.select("topic_id", "phrase").distinct()
    v = p.select("topic_id", "phrase", F.explode(F.split("phrase", " ")).alias("word")).join(word_vectors, "word")
    mean = vectors.mean_vector(v, ["topic_id", "phrase"], "v")
    pairs = vectors.similar_pairs(mean, "topic_id", "phrase", "v", least).select("topic_id", F.col("a").alias("p"), F.col("b").alias("q"), "sim")
    own = mean.select("topic_id", F.col("phrase").alias("p"), F.col("phrase").alias("q"), F.lit(1.0).alias("sim"))
    return pairs.union(pairs.select("topic_id", "q", "p", "sim")).union(own)


def _typed(ents: DataFrame, rules: DataFrame, method: str, step: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities as first and second of a pair, and the step's table."""
    side = lambda s: ents.select("topic_id", F.col("entity").alias(s), F.col("size").alias(f"size_{s}"), F.col("etype").alias(f"type_{s}"))
    return side("a"), side("b"), rules.where((F.col("method") == method) & (F.col("step") == step) & (F.col("value") > 0)).select("type_a", "type_b", F.col("value").alias("rule"))


def grid_edges(phrases: DataFrame, cosines: DataFrame, ents: DataFrame, rules: DataFrame, method: str, step: str, share: float, weighed: bool, cross_types: bool = True) -> DataFrame:
    """(topic_id, a, b, sim): the share of cells (phrase of a, phrase of b) whose cosine reaches the rule of the types;
    ``weighed``: one that exceeds it by ``VERY_SIMILAR`` counts twice. Without ``cross_types`` small grids count within a
    type only."""
    a, b, r = _typed(ents, rules, method, step)
    p = phrases.select("topic_id", "entity", "phrase").distinct()
    n = p.groupBy("topic_id", "entity").agg(F.count("*").alias("n"))
    x = p.select("topic_id", F.col("entity").alias("a"), F.col("phrase").alias("p")).join(a, ["topic_id", "a"]).join(n.select("topic_id", F.col("entity").alias("a"), F.col("n").alias("na")), ["topic_id", "a"])
    y = p.select("topic_id", F.col("entity").alias("b"), F.col("phrase").alias("q")).join(b, ["topic_id", "b"]).join(n.select("topic_id", F.col("entity").alias("b"), F.col("n").alias("nb")), ["topic_id", "b"])
    cells = x.join(cosines, ["topic_id", "p"]).join(y, ["topic_id", "q"]).where(_ordered(ents)).join(F.broadcast(r), ["type_a", "type_b"]).where("sim >= rule")
    w = F.when((F.col("sim") >= F.col("rule") + VERY_SIMILAR) & F.lit(weighed), 2.0).otherwise(1.0)
    g = cells.groupBy("topic_id", "a", "b", "type_a", "type_b", "na", "nb").agg((F.sum(w) / (F.first("na") * F.first("nb"))).alias("sim")).where(F.col("sim") >= share)
    if not cross_types:
        g = g.where((F.col("type_a") == F.col("type_b")) | (F.col("na") * F.col("nb") > SMALL_GRID))
    return g.select("topic_id", "a", "b", "sim")


def head_vectors(role: DataFrame, word_vectors: DataFrame, alike: bool = True) -> DataFrame:
    """(topic_id, entity, v): mean vector of an entity's distinct heads; ``alike``: of heads equal but for the first letter
    the most frequent one."""
    h = role.where("heads > 0")
    if alike:
        w = Window.partitionBy("topic_id", "entity", F.expr("substring(word, 2)")).orderBy(F.desc("heads"), "word")
        h = h.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return vectors.mean_vector(h.select("topic_id", "entity", "word").join(word_vectors, "word"), ["topic_id", "entity"], "v")


def vector_edges(entity_vectors: DataFrame, least: float) -> DataFrame:
    """(topic_id, a, b, sim) of a topic's entities, each pair once."""
    return vectors.similar_pairs(entity_vectors, "topic_id", "entity", "v", least)


def compound_edges(role: DataFrame, ents: DataFrame) -> DataFrame:
    """(topic_id, a, b, sim) of step 3 of the older method: heads or adjectives of one entity that are compounds of the
    other, more than one of them, or one that is in a frequent set of the larger's (here: more than once its compound
    or head)."""
    e = ents.select("topic_id", "entity", "size")
    r = role.where("heads > 0 OR compounds > 0 OR adjectives > 0").join(e, ["topic_id", "entity"])
    side = lambda s: r.select("topic_id", "word", F.col("entity").alias(s), F.col("size").alias(f"size_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("heads", "compounds", "adjectives")])
    j = side("a").join(side("b"), ["topic_id", "word"]).where(_ordered(ents))
    over = lambda x, y: ((F.col(f"heads_{x}") > 0).cast("int") + (F.col(f"adjectives_{x}") > 0).cast("int")) * (F.col(f"compounds_{y}") > 0).cast("int")
    often = F.col("heads_a") + F.col("compounds_a") > 1
    g = j.groupBy("topic_id", "a", "b").agg(F.sum(over("a", "b")).alias("m1"), F.sum(over("b", "a")).alias("m2"), F.max((often & (over("a", "b") > 0)).cast("int")).alias("f1"), F.max((often & (over("b", "a") > 0)).cast("int")).alias("f2"))
    m, f = F.when(F.col("m1") > 0, F.col("m1")).otherwise(F.col("m2")), F.when(F.col("m1") > 0, F.col("f1")).otherwise(F.col("f2"))
    return g.where((m > 1) | ((m == 1) & (f == 1))).select("topic_id", "a", "b", F.lit(1.0).alias("sim"))


def string_edges(phrases: DataFrame, ents: DataFrame, rules: DataFrame, method: str, step: str) -> DataFrame:
    """(topic_id, a, b, sim) of step 5: edit distances of representative phrases over the longer one's number of words,
    within the rule; the best row or column of the grid with a share of at least ``STRINGS_SHARE``.

    Rules are below 1, so fewer edits are allowed than the longer phrase has words: one word is whole in both. Phrases that
    share no word are therefore never compared."""
    a, b, r = _typed(ents, rules, method, step)
    p = phrases.select("topic_id", "entity", "phrase").distinct()
    n = p.groupBy("topic_id", "entity").agg(F.count("*").alias("n"))
    d = p.select("topic_id", "phrase").distinct().select("topic_id", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    near = d.withColumnRenamed("phrase", "p").join(d.withColumnRenamed("phrase", "q"), ["topic_id", "word"]).select("topic_id", "p", "q").distinct()
    longer = F.greatest(F.size(F.split("p", " ")), F.size(F.split("q", " ")))
    near = near.withColumn("d", scalars.edit_distance(F.col("p"), F.col("q")) / longer).where("d < 1")
    x = p.select("topic_id", F.col("entity").alias("a"), F.col("phrase").alias("p")).join(a, ["topic_id", "a"])
    y = p.select("topic_id", F.col("entity").alias("b"), F.col("phrase").alias("q")).join(b, ["topic_id", "b"])
    cells = x.join(near, ["topic_id", "p"]).join(y, ["topic_id", "q"]).where(_ordered(ents)).join(F.broadcast(r), ["type_a", "type_b"]).where("d <= rule")
    rows = cells.groupBy("topic_id", "a", "b", "p").agg(F.count("*").alias("c")).groupBy("topic_id", "a", "b").agg(F.max("c").alias("across"))
    columns = cells.groupBy("topic_id", "a", "b", "q").agg(F.count("*").alias("c")).groupBy("topic_id", "a", "b").agg(F.max("c").alias("down"))
    j = rows.join(columns, ["topic_id", "a", "b"]).join(n.select("topic_id", F.col("entity").alias("a"), F.col("n").alias("na")), ["topic_id", "a"]).join(n.select("topic_id", F.col("entity").alias("b"), F.col("n").alias("nb")), ["topic_id", "b"])
    sim = F.when((F.col("across") >= F.col("down")) & (F.col("nb") > 1), F.col("across") / F.col("nb")).when((F.col("across") < F.col("down")) & (F.col("na") > 1), F.col("down") / F.col("na")).otherwise(0.0)
    return j.select("topic_id", "a", "b", sim.alias("sim")).where(F.col("sim") >= STRINGS_SHARE)


def mention_edges(words: DataFrame, role: DataFrame, ents: DataFrame, rules: DataFrame, word_vectors: DataFrame, stops: tuple[str, ...], method: str, step: str) -> DataFrame:
    """(topic_id, a, b, sim) of step 2: every entity without a personal name among its heads beside the best named one. Similarity
    is 1 if a phrase of the smaller is part of one of the larger's and holds a compound of it, or shares enough words
    with it, heads of both among them; else (rule 1) the cosine, if at least ``MENTION_COSINE``."""
    a, b, r = _typed(ents, rules, method, step)
    person = words.where("dep = 'root'").groupBy("topic_id", F.col("chain").alias("b")).agg(F.bool_or(F.col("ner") == "PERSON").alias("person")).where("NOT person").select("topic_id", "b")
    pw = words.select("topic_id", F.col("chain").alias("entity"), F.col("mention_id"), "word").distinct()
    ph = words.groupBy("topic_id", F.col("chain").alias("entity"), "mention_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("phrase"))
    stop = F.col("word").isin(*stops).cast("int").alias("stop")
    own = pw.join(ph, ["topic_id", "entity", "mention_id"]).select("topic_id", "entity", "phrase", "word", stop).distinct().join(role.select("topic_id", "entity", "word", "heads", "compounds"), ["topic_id", "entity", "word"])
    size = own.groupBy("topic_id", "entity", "phrase").agg(F.count("*").alias("words"), F.count_if(F.col("stop") == 0).alias("content"))
    own = own.join(size, ["topic_id", "entity", "phrase"])
    x = own.select("topic_id", "word", "stop", F.col("entity").alias("a"), F.col("phrase").alias("pa"), F.col("heads").alias("ha"), F.col("compounds").alias("ca")).join(a.where(F.col("type_a").contains("-ne")), ["topic_id", "a"])
    y = own.select("topic_id", "word", F.col("entity").alias("b"), F.col("phrase").alias("pb"), F.col("heads").alias("hb"), "words", "content").join(b, ["topic_id", "b"]).join(person, ["topic_id", "b"])
    c = x.join(y, ["topic_id", "word"]).where("a <> b").groupBy("topic_id", "a", "b", "pa", "pb", "type_a", "type_b").agg(
        F.count("*").alias("shared"), F.count_if(F.col("stop") == 0).alias("inner"), F.max("words").alias("words"), F.max("content").alias("content"), F.max((F.col("ca") > 0).cast("int")).alias("comp"),
        F.max(((F.col("hb") > 0) & (F.col("stop") == 0)).cast("int")).alias("hb"), F.max(((F.col("ha") > 0) & (F.col("stop") == 0)).cast("int")).alias("ha"))
    part = (F.col("shared") == F.col("words")) & (F.col("comp") == 1)
    enough = (((F.col("inner") >= 1) & (F.col("content") == 1)) | (F.col("inner") >= 2)) & (F.col("ha") == 1) & (F.col("hb") == 1)
    text = c.where(part | enough).join(F.broadcast(r), ["type_a", "type_b"]).select("topic_id", "a", "b", F.lit(1.0).alias("sim")).distinct()
    v = vectors.mean_vector(words.where(~F.col("word").isin(*stops)).select("topic_id", F.col("chain").alias("entity"), "word").distinct().join(word_vectors, "word"), ["topic_id", "entity"], "v")
    near = vector_edges(v, MENTION_COSINE)
    near = near.union(near.select("topic_id", F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    near = near.join(a.where(F.col("type_a").contains("-ne")), ["topic_id", "a"]).join(b, ["topic_id", "b"]).join(person, ["topic_id", "b"]).join(F.broadcast(r.where("rule = 1")), ["type_a", "type_b"])
    every = text.union(near.select("topic_id", "a", "b", "sim"))
    best = every.groupBy("topic_id", "b").agg(F.min(F.struct((-F.round("sim", 9)).alias("o"), "a", "sim")).alias("x"))
    return best.select("topic_id", F.col("x.a").alias("a"), "b", F.col("x.sim").alias("sim"))


def linkage_edges(entity_vectors: DataFrame, ents: DataFrame, rules: DataFrame, method: str, step: str, distance: float) -> DataFrame:
    """(topic_id, a, b, sim): every member of a cluster of average linkage within ``distance`` beside its first one, of the
    entities whose type the table lets merge. A cluster only ever grows over a pair within the distance, so each connected
    component of such pairs is clustered on its own."""
    types = rules.where((F.col("method") == method) & (F.col("step") == step) & (F.col("value") >= 1)).select(F.col("type_a").alias("etype")).distinct()
    own = entity_vectors.join(ents.join(F.broadcast(types), "etype").select("topic_id", "entity", "size"), ["topic_id", "entity"])
    return clusters_of(own, distance).where("a <> b").select("topic_id", "a", "b", F.lit(1.0).alias("sim"))


def clusters_of(entity_vectors: DataFrame, distance: float) -> DataFrame:
    """(topic_id, a, b): each entity (b) with the first of its cluster (a) by average linkage; alone where no other is near.

    Entities of a topic with one vector are merged before all others, so they are one point of their number's weight: pairs
    are listed of points only. A vector of length 0 is near none, not even itself."""
    same = Window.partitionBy("topic_id", "v", F.when(vectors.norm(F.col("v")) > 0, F.lit("")).otherwise(F.col("entity")))
    own = cut(entity_vectors.select("topic_id", "entity", "v").withColumn("point", F.min("entity").over(same)).withColumn("n", F.count("*").over(same)), forget=True)
    points = own.where("entity = point")
    pairs = vector_edges(points.select("topic_id", "entity", "v"), 1 - distance)
    name = lambda c: F.concat_ws("\x01", "topic_id", c)
    comp = label_components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    grouped = points.withColumn("id", name("entity")).join(comp, "id")
    found = vectors.clusters_within(grouped.select("component", F.col("id").alias("key"), "v", "n"), "component", "key", "v", "linkage", weight="n", threshold=distance)
    part = lambda c, i: F.element_at(F.split(c, "\x01"), i)
    linked = found.select(part("key", 1).alias("topic_id"), part("cluster", 2).alias("a"), part("key", 2).alias("point"))
    return own.select("topic_id", "entity", "point").join(linked, ["topic_id", "point"], "left").select("topic_id", F.coalesce("a", "point").alias("a"), F.col("entity").alias("b"))


def group_edges(role: DataFrame, words: DataFrame, ents: DataFrame, rules: DataFrame, word_vectors: DataFrame, method: str, step: str) -> DataFrame:
    """(topic_id, a, b, sim): groups beside names of places whose repeated named heads are their heads too, or are near
    the groups' named modifiers by a cosine of at least ``GROUP_COSINE``."""
    own = rules.where((F.col("method") == method) & (F.col("step") == step))
    of = lambda values: own.where(F.col("value").isin(*values)).select(F.col("type_a").alias("etype")).distinct()
    groups, places = (ents.join(F.broadcast(of(v)), "etype").select("topic_id", "entity") for v in ((1.0, 2.0), (3.0,)))
    upper = words.where("ner <> 'O'").select("topic_id", F.col("chain").alias("entity"), "word").distinct()
    named = role.join(upper, ["topic_id", "entity", "word"], "left_semi")
    heads = named.where("heads > 1").join(places, ["topic_id", "entity"], "left_semi").select("topic_id", F.col("entity").alias("b"), "word")
    shared = role.where("heads > 0").join(groups, ["topic_id", "entity"], "left_semi").select("topic_id", F.col("entity").alias("a"), "word").join(heads, ["topic_id", "word"]).select("topic_id", "a", "b", F.lit(1.0).alias("sim"))
    modifiers = named.where("compounds > 0 OR adjectives > 0").join(groups, ["topic_id", "entity"], "left_semi").select("topic_id", F.concat(F.lit("a"), "entity").alias("entity"), "word")
    both = modifiers.union(heads.select("topic_id", F.concat(F.lit("b"), "b"), "word"))
    v = vectors.mean_vector(both.join(word_vectors, "word"), ["topic_id", "entity"], "v")
    near = vector_edges(v, GROUP_COSINE).where("a LIKE 'a%' AND b LIKE 'b%'")
    return shared.union(near.select("topic_id", F.expr("substring(a, 2)"), F.expr("substring(b, 2)"), "sim")).where("a <> b").groupBy("topic_id", "a", "b").agg(F.max("sim").alias("sim"))


# -- absorption --------------------------------------------------------------------------------------------------------

DIRECT, SECOND, CLOSURE = "direct", "second", "closure"


def take_turns(a: list, b: list, sim: list, size: dict, reach: str) -> dict:
    """Owner of each entity of one component: by turns in the order of size, then of name.

    ``reach``: the similar ones of the entity itself; of each of these, the first similar one, too; or all that a chain
    of similar, never larger ones leads to."""
    near: dict = {}
    for x, y, s in zip(a, b, sim):
        near.setdefault(x, {})[y] = s
        near.setdefault(y, {})[x] = s
    order = sorted(size, key=lambda x: (-size[x], x))
    place = {x: n for n, x in enumerate(order)}
    owner: dict = {}

    def free(of, seen):  # noqa: ANN001, ANN202
        return [y for y in sorted(near.get(of, ()), key=place.get) if y not in owner and y not in seen and size[y] <= size[of]]

    for x in order:
        if x in owner:
            continue
        taken, todo = {x}, [x]
        while todo:
            of = todo.pop(0)
            found = free(of, taken)
            if reach == SECOND and of != x:
                found = found[:1]
            taken.update(found)
            if reach == CLOSURE or (reach == SECOND and of == x):
                todo += found
        if len(taken) > 1:
            owner.update(dict.fromkeys(taken, x))
    return owner


def absorb(edges: DataFrame, ents: DataFrame, reach: str = DIRECT) -> DataFrame:
    """(topic_id, entity, into) of the entities that are absorbed, for edges (topic_id, a, b, sim)."""
    name = lambda c: F.concat_ws("\x01", "topic_id", c)
    edges = cut(edges, forget=True)
    comp = label_components(edges.select(name("a").alias("a"), name("b").alias("b")))
    size = ents.select("topic_id", F.col("entity").alias("x"), "size")
    e = edges.join(size.withColumnsRenamed({"x": "a", "size": "size_a"}), ["topic_id", "a"]).join(size.withColumnsRenamed({"x": "b", "size": "size_b"}), ["topic_id", "b"])
    e = e.withColumn("id", name("a")).join(comp, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = dict(zip(pdf["a"], pdf["size_a"])) | dict(zip(pdf["b"], pdf["size_b"]))
        owner = take_turns(pdf["a"].tolist(), pdf["b"].tolist(), pdf["sim"].tolist(), sizes, reach)
        rows = [(x, y) for x, y in owner.items() if x != y]
        topic = [pdf["topic_id"].iloc[0]] * len(rows)
        return pd.DataFrame({"topic_id": topic, "entity": [x for x, _ in rows], "into": [y for _, y in rows]}, dtype=object)

    return e.groupBy("component").applyInPandas(run, "topic_id string, entity string, into string")


Step = tuple[str, Callable[[DataFrame, DataFrame], DataFrame], str]


def identify(words: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """The words with the entities after all steps, and the history (step, topic_id, entity, into). A step is its name, its
    gated edges for (words, entities), and its reach."""
    history = None
    words = cut(words, forget=True)
    for name, edges, reach in steps:
        ents = cut(entities_of(words), forget=True)
        taken = cut(absorb(edges(words, ents), ents, reach), forget=True)
        words = cut(words.join(taken.withColumnsRenamed({"entity": "chain"}), ["topic_id", "chain"], "left").withColumn("chain", F.coalesce("into", "chain")).drop("into"), forget=True)
        h = taken.select(F.lit(name).alias("step"), "topic_id", "entity", "into")
        history = h if history is None else history.union(h)
    return words, history
