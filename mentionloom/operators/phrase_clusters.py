"""Clusters of a topic's phrases from cores outward (third step of the default method).

Points are the distinct phrases (topic_id, phrase) of entities that are no names. Names that belong together form
chains; phrases with names of different chains are never similar. Cores are phrases whose neighbourhoods overlap;
around them come body points, border points, and components of what is left. Everything is a query over pairs that
reached a similarity; only the order-bound walk along best partners runs per connected component of cores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.functions import scalars
from mentionloom.operators import vectors
from mentionloom.operators.graphs import label_components
from mentionloom.operators.mention_ops import first_of, top_of
from mentionloom.session import cut

#: Least similarity of phrases, of a body point or a component, matches of a border point; weight of names' vectors,
#: margin, letters of a common beginning, and what two clusters' similarity takes from phrases (the rest is from heads).
NEAR, CLOSE, MATCHES, NAME_WEIGHT, MARGIN, LETTERS, FROM_PHRASES, NEIGHBOURS, DAMPED, BIG = 0.4, 0.5, 2, 1.7, 0.01, 8, 0.5, 4, 0.95, 0.6


def _key(c: str) -> Column:
    return F.concat_ws("\x01", "topic_id", c)


def name_chains(names: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(topic_id, word, chain) of names of ``names`` (topic_id, word) that are linked to others: one of more than seven letters
    holds the first eight of the other, or ``synonyms`` (word, synonym) has the pair."""
    w = names.select("topic_id", "word").distinct()
    long = w.where(F.length("word") >= LETTERS)
    parts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - (LETTERS - 1)), lambda i: F.substring("word", i, F.lit(LETTERS)))))
    e = long.select("topic_id", F.col("word").alias("a"), parts.alias("part")).join(long.select("topic_id", F.col("word").alias("b"), F.substring("word", 1, LETTERS).alias("part")), ["topic_id", "part"]).where("a <> b").select("topic_id", "a", "b")
    if synonyms is not None:
        s = w.join(synonyms, "word").join(w.withColumnRenamed("word", "synonym"), ["topic_id", "synonym"]).where("word <> synonym")
        e = e.union(s.select("topic_id", F.col("word").alias("a"), F.col("synonym").alias("b")))
    c = label_components(e.select(_key("a").alias("a"), _key("b").alias("b")))
    part = lambda x, i: F.element_at(F.split(x, "\x01"), i)
    return c.select(part("id", 1).alias("topic_id"), part("id", 2).alias("word"), part("component", 2).alias("chain"))


def phrase_graph(points: DataFrame, names: DataFrame, chains: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """(topic_id, a, b, sim), a < b: phrases whose weighted mean vectors have a cosine of at least ``NEAR``; vectors of names
    weigh ``NAME_WEIGHT``. Two phrases with chained names are similar only if the chain is one."""
    w = points.select("topic_id", "phrase", F.explode(F.split("phrase", " ")).alias("word"))
    name = names.select("topic_id", "word").distinct().withColumn("name", F.lit(NAME_WEIGHT))
    w = w.join(name, ["topic_id", "word"], "left").withColumn("weight", F.coalesce("name", F.lit(1.0)))
    v = vectors.mean_vector(w.join(word_vectors, "word"), ["topic_id", "phrase"], "v", F.col("weight"))
    own = w.join(chains, ["topic_id", "word"]).groupBy("topic_id", "phrase").agg(F.max_by("chain", "word").alias("chain"))
    pairs = vectors.similar_pairs(v, "topic_id", "phrase", "v", NEAR)
    side = lambda s: own.select("topic_id", F.col("phrase").alias(s), F.col("chain").alias(f"chain_{s}"))
    j = pairs.join(side("a"), ["topic_id", "a"], "left").join(side("b"), ["topic_id", "b"], "left")
    return j.where("chain_a IS NULL OR chain_b IS NULL OR chain_a = chain_b").select("topic_id", "a", "b", "sim")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("topic_id", F.col("a").alias("p"), F.col("b").alias("q"), "sim").union(pairs.select("topic_id", "b", "a", "sim"))


def core_pairs(graph: DataFrame, points: DataFrame) -> DataFrame:
    """(topic_id, a, b, ratio): phrases whose shared neighbours are a large enough part of the larger neighbourhood: the
    logarithm to 5000 of the topic's number of phrases, from 0.5 to 0.7."""
    u = both_ways(graph)
    degree = u.groupBy("topic_id", "p").agg(F.count("*").alias("d"))
    shared = u.select("topic_id", F.col("p").alias("a"), "q").join(u.select("topic_id", F.col("p").alias("b"), "q"), ["topic_id", "q"]).where("a < b").groupBy("topic_id", "a", "b").agg(F.count("*").alias("c"))
    n = points.groupBy("topic_id").agg(F.count("*").alias("n"))
    j = shared.join(degree.withColumnsRenamed({"p": "a", "d": "da"}), ["topic_id", "a"]).join(degree.withColumnsRenamed({"p": "b", "d": "db"}), ["topic_id", "b"]).join(n, "topic_id")
    ratio = F.col("c") / F.greatest("da", "db")
    return j.where(ratio >= scalars.overlap_threshold(F.col("n"))).select("topic_id", "a", "b", ratio.alias("ratio"))


def walk(a: list, b: list, ratio: list) -> dict:
    """Cluster of each core of one component: cores take their turns by their number of partners, then by name; a walk goes
    from a core to its best partner until that one is used. A walk of one core is no cluster."""
    near: dict = {}
    for x, y, r in zip(a, b, ratio):
        near.setdefault(x, []).append((r, y))
        near.setdefault(y, []).append((r, x))
    used, out = set(), {}
    for x in sorted(near, key=lambda k: (-len(near[k]), k)):
        if x in used:
            continue
        path = [x]
        used.add(x)
        while (y := max(near[path[-1]])[1]) not in used:
            path.append(y)
            used.add(y)
        if len(path) > 1:
            out.update(dict.fromkeys(path, min(path)))
    return out


def core_clusters(pairs: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster) of the cores that some walk joined."""
    pairs = cut(pairs, forget=True)
    comp = label_components(pairs.select(_key("a").alias("a"), _key("b").alias("b")))
    e = pairs.withColumn("id", _key("a")).join(comp, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = walk(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ratio"].tolist())
        return pd.DataFrame({"topic_id": [pdf["topic_id"].iloc[0]] * len(found), "phrase": list(found), "cluster": list(found.values())}, dtype=object)

    return e.groupBy("component").applyInPandas(run, "topic_id string, phrase string, cluster string")


def cluster_similarity(graph: DataFrame, clusters: DataFrame, head_graph: DataFrame, heads: DataFrame) -> DataFrame:
    """(topic_id, a, b, sim), a <> b: of two clusters, half the mean similarity of their phrases and half that of their heads;
    pairs below ``NEAR`` count as 0."""

    def mean(pairs: DataFrame, of: DataFrame) -> DataFrame:
        n = of.groupBy("topic_id", "cluster").agg(F.count("*").alias("n"))
        x, y = of.select("topic_id", F.col("x").alias("p"), F.col("cluster").alias("a")), of.select("topic_id", F.col("x").alias("q"), F.col("cluster").alias("b"))
        s = both_ways(pairs).join(x, ["topic_id", "p"]).join(y, ["topic_id", "q"]).where("a <> b").groupBy("topic_id", "a", "b").agg(F.sum("sim").alias("s"))
        j = s.join(n.withColumnsRenamed({"cluster": "a", "n": "na"}), ["topic_id", "a"]).join(n.withColumnsRenamed({"cluster": "b", "n": "nb"}), ["topic_id", "b"])
        return j.select("topic_id", "a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("m"))

    own_heads = clusters.join(heads, ["topic_id", "phrase"]).select("topic_id", "cluster", F.col("head").alias("x")).distinct()
    p, h = mean(graph, clusters.select("topic_id", "cluster", F.col("phrase").alias("x"))), mean(head_graph, own_heads).withColumnRenamed("m", "mh")
    j = p.join(h, ["topic_id", "a", "b"], "full").fillna(0.0, ["m", "mh"])
    return j.select("topic_id", "a", "b", (FROM_PHRASES * F.col("m") + (1 - FROM_PHRASES) * F.col("mh")).alias("sim"))


def mutual_neighbours(sims: DataFrame) -> DataFrame:
    """(topic_id, a, b), a < b: clusters that are among each other's most similar ones, at least 0.2."""
    top = sims.where("sim >= 0.2")
    order = [F.desc(F.round("sim", 9)), F.asc("b")]
    k = top_of(top, ["topic_id", "a"], order, NEIGHBOURS).select("topic_id", "a", "b")
    return k.join(k.select("topic_id", F.col("b").alias("a"), F.col("a").alias("b")), ["topic_id", "a", "b"], "left_semi").where("a < b")


def _beside(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_id, p, cluster, q, sim): a phrase's similar phrases with their clusters."""
    return both_ways(graph).join(clusters.select("topic_id", F.col("phrase").alias("q"), "cluster"), ["topic_id", "q"])


def alien_points(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster, moved): points whose mean similarity to another cluster exceeds that to the rest of their own
    by ``MARGIN`` and is no less than the other's own mean."""
    n = clusters.groupBy("topic_id", "cluster").agg(F.count("*").alias("n"))
    s = _beside(graph, clusters).groupBy("topic_id", F.col("p").alias("phrase"), F.col("cluster").alias("other")).agg(F.sum("sim").alias("s"))
    j = s.join(clusters, ["topic_id", "phrase"]).join(n.withColumnRenamed("cluster", "other"), ["topic_id", "other"])
    own = j.where("other = cluster AND n > 1").select("topic_id", "phrase", (F.col("s") / (F.col("n") - 1)).alias("mine"))
    inner = j.where("other = cluster AND n > 1").groupBy("topic_id", "other").agg((F.sum("s") / (F.first("n") * (F.first("n") - 1))).alias("theirs"))
    base = clusters.join(own, ["topic_id", "phrase"], "left").fillna(0.0, ["mine"]).select("topic_id", "phrase", "mine")
    m = j.where("other <> cluster AND n > 1").withColumn("m", F.col("s") / F.col("n")).join(base, ["topic_id", "phrase"]).join(inner, ["topic_id", "other"])
    m = m.where((F.col("m") > F.col("mine") + MARGIN) & (F.col("m") >= F.col("theirs")))
    return first_of(m, ["topic_id", "phrase"], [F.desc(F.round("m", 9)), F.asc("other")]).select("topic_id", "phrase", "cluster", F.col("other").alias("moved"))


def body_points(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster) of phrases outside that are ``CLOSE`` to a member; of several clusters the one with most such
    members, then with most words of the phrase, then the first."""
    b = _beside(graph, clusters).where(F.col("sim") >= CLOSE).join(clusters.select("topic_id", F.col("phrase").alias("p")), ["topic_id", "p"], "left_anti")
    words = F.size(F.array_intersect(F.split("p", " "), F.split("q", " ")))
    g = b.groupBy("topic_id", F.col("p").alias("phrase"), "cluster").agg(F.count("*").alias("n"), F.sum(words).alias("w"))
    return first_of(g, ["topic_id", "phrase"], [F.desc("n"), F.desc("w"), F.asc("cluster")]).select("topic_id", "phrase", "cluster")


def border_points(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster, n) of phrases outside with at least ``MATCHES`` similar members in a cluster: the one of the
    best mean similarity."""
    b = _beside(graph, clusters).join(clusters.select("topic_id", F.col("phrase").alias("p")), ["topic_id", "p"], "left_anti")
    g = b.groupBy("topic_id", F.col("p").alias("phrase"), "cluster").agg(F.count("*").alias("n"), F.avg("sim").alias("s")).where(F.col("n") >= MATCHES)
    return first_of(g, ["topic_id", "phrase"], [F.desc(F.round("s", 9)), F.asc("cluster")]).select("topic_id", "phrase", "cluster", "n")


def components(graph: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster): components of phrases that are ``CLOSE``."""
    c = label_components(graph.where(F.col("sim") >= CLOSE).select(_key("a").alias("a"), _key("b").alias("b")))
    part = lambda x, i: F.element_at(F.split(x, "\x01"), i)
    return c.select(part("id", 1).alias("topic_id"), part("id", 2).alias("phrase"), part("component", 2).alias("cluster"))


def clusters_by_priority(graph: DataFrame, points: DataFrame) -> DataFrame:
    """(topic_id, phrase, cluster, level): every phrase's cluster: core (aliens moved), component of the rest, body, border,
    or alone."""
    graph = cut(graph, forget=True)
    core = cut(core_clusters(core_pairs(graph, points)), forget=True)
    moved = alien_points(graph, core).select("topic_id", "phrase", "moved")
    core = cut(core.join(moved, ["topic_id", "phrase"], "left").select("topic_id", "phrase", F.coalesce("moved", "cluster").alias("cluster")), forget=True)
    body = cut(body_points(graph, core), forget=True)
    inside = core.union(body)
    border = cut(border_points(graph, inside).drop("n"), forget=True)
    done = inside.union(border)
    out = lambda s: done.select("topic_id", F.col("phrase").alias(s))
    rest = components(graph.join(out("a"), ["topic_id", "a"], "left_anti").join(out("b"), ["topic_id", "b"], "left_anti"))
    every = core.withColumn("level", F.lit("core")).unionByName(rest.withColumn("level", F.lit("non-core"))).unionByName(body.withColumn("level", F.lit("body"))).unionByName(border.withColumn("level", F.lit("border")))
    alone = points.select("topic_id", "phrase").join(every.select("topic_id", "phrase"), ["topic_id", "phrase"], "left_anti")
    return every.unionByName(alone.select("topic_id", "phrase", F.col("phrase").alias("cluster"), F.lit("alone").alias("level")))
