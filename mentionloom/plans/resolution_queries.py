"""Queries of entity identification over annotated words: merge steps, whole methods, clusterings and word vectors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import graphs, resolution, sieves, vectors
from mentionloom.operators import mention_ops as ops
from mentionloom.operators import phrase_clusters as pc
from mentionloom.plans.annotations import STOPS, WV, A, annotated, word_vectors
from mentionloom.plans.registry import query
from mentionloom.session import cut
from mentionloom.sources.tables import read

# -- entities before any merging: the mentions of one chain in one document ------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in STOPS)
E = A + """, u AS (SELECT * REPLACE (doc_id || '/' || chain AS chain) FROM t),
 hn AS (SELECT topic_id, chain, head, row_number() OVER (PARTITION BY topic_id, chain ORDER BY c DESC, head) AS r FROM (SELECT topic_id, chain, word AS head, count(*) AS c FROM u WHERE i = n - 1 GROUP BY ALL)),
 e0 AS (SELECT topic_id, chain AS entity, count(*) AS size, min(kind) AS kind FROM u WHERE i = n - 1 GROUP BY ALL),
 ent AS (SELECT e0.*, head, CASE WHEN kind = 'HUM' AND size > 1 THEN CASE WHEN head LIKE '%s' THEN 'person-nes' ELSE 'person-ne' END WHEN kind = 'HUM' THEN CASE WHEN head LIKE '%s' THEN 'person-nns' ELSE 'person-nn' END
   WHEN kind = 'GRP' AND size > 1 THEN 'group-ne' WHEN kind = 'GRP' THEN 'group' WHEN kind = 'LOC' AND size > 1 THEN 'country-ne' WHEN kind = 'LOC' THEN 'country' ELSE 'misc' END AS etype
   FROM e0 JOIN hn ON hn.topic_id = e0.topic_id AND hn.chain = e0.entity AND r = 1),
 prp AS (SELECT topic_id, chain, bool_and(pos IN ('PRP', 'PRP$')) AS all_prp FROM u WHERE dep = 'root' GROUP BY ALL),
 role AS (SELECT topic_id, chain AS entity, word, sum((dep = 'root' AND (pos NOT IN ('PRP', 'PRP$') OR all_prp))::INT) AS heads, sum((dep = 'compound')::INT) AS compounds, sum((dep = 'amod')::INT) AS adjectives,
   max((ner NOT IN ('O', 'DATE', 'TITLE'))::INT) AS ne FROM u JOIN prp USING (topic_id, chain) GROUP BY ALL)
"""  # fmt: skip
_COS = "list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))"
#: Mean vectors of (topic_id, k) from rows (topic_id, k, word).
_MEAN = " AS (SELECT topic_id, k, list(a ORDER BY d) AS v FROM (SELECT topic_id, k, d, avg(x) AS a FROM (SELECT topic_id, k, unnest(v) AS x, unnest(range(1, 65)) AS d FROM ({rows}) JOIN wv USING (word)) GROUP BY ALL) GROUP BY ALL)"


def _means(name: str, rows: str) -> str:
    return ", " + name + _MEAN.replace("{rows}", rows)


#: Pairs of entities, the larger first, beside the rule of their types.
_RULED = """, pr AS (SELECT x.topic_id, x.entity AS a, y.entity AS b, x.etype AS ta, y.etype AS tb, r.value AS rule FROM ent x JOIN ent y ON x.topic_id = y.topic_id AND (x.size > y.size OR (x.size = y.size AND x.entity < y.entity))
 JOIN rules r ON r.method = '{method}' AND r.step = '{step}' AND r.type_a = x.etype AND r.type_b = y.etype AND r.value > 0)"""  # fmt: skip


def _ruled(method: str, step: str) -> str:
    return _RULED.replace("{method}", method).replace("{step}", step)


def words_by_document(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated words whose entity is the chain within its document."""
    return annotated(spark, sf).withColumn("chain", F.concat_ws("/", "doc_id", "chain"))


class Inputs:
    """Tables that the steps need beside the words."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.words = words_by_document(spark, sf)
        self.rules = read(spark, sf, "rules")
        self.vectors = word_vectors(spark, sf, self.words)
        # titles: a head of a named class is a page of its own
        self.wiki = self.words.where("dep = 'root' AND kind IN ('HUM', 'GRP', 'LOC')").select(F.col("word").alias("phrase")).distinct().withColumn("title", F.initcap("phrase"))

    def gate(self, edges: DataFrame, ents: DataFrame, method: str, step: str, allowed: str) -> DataFrame:
        return sieves.gate(edges, ents, self.rules, method, step, F.expr(allowed)).select("topic_id", "a", "b", "sim")

    # steps of the newer methods
    def x0(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return self.gate(resolution.title_edges(words, ents, self.wiki), ents, "newer", "step0", "rule > 0")

    def titles(self, ents: DataFrame) -> DataFrame:
        return ents.join(self.wiki.withColumnRenamed("phrase", "head"), "head", "left").select("topic_id", "entity", "title")

    def x1(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return self.gate(resolution.core_edges(resolution.roles(words), ents, self.titles(ents)), ents, "newer", "step1", resolution.CORE_ALLOWED)

    def x2(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return resolution.mention_edges(words, resolution.roles(words), ents, self.rules, self.vectors, STOPS, "newer", "step2")

    def x3l(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return resolution.group_edges(resolution.roles(words), words, ents, self.rules, self.vectors, "newer", "step3")

    def means(self, words: DataFrame, head_twice: bool = False) -> DataFrame:
        """Mean over an entity's different phrases of the (weighted) sums of their words' vectors."""
        p = words.where("pos NOT IN ('DT', 'PRP')").groupBy("topic_id", F.col("chain").alias("entity"), "mention_id").agg(F.array_sort(F.collect_list(F.struct("i", "word", "n"))).alias("ws"))
        p = p.select("topic_id", "entity", F.transform("ws", lambda x: F.struct(x["word"].alias("word"), (x["i"] == x["n"] - 1).alias("head"))).alias("ws")).distinct()
        w = p.select("topic_id", "entity", F.explode("ws").alias("x")).select("topic_id", "entity", F.col("x.word").alias("word"), F.when(F.col("x.head") & F.lit(head_twice), 2.0).otherwise(1.0).alias("weight"))
        return vectors.mean_vector(w.join(self.vectors, "word"), ["topic_id", "entity"], "v", F.col("weight"))

    def x4(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return resolution.linkage_edges(self.means(words, True), ents, self.rules, "newer", "step4", resolution.MISC_DISTANCE)

    def xb3(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return resolution.linkage_edges(self.means(words), ents, self.rules, "newer", "step3", resolution.TYPE_DISTANCE)

    def xb4(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        pairs = resolution.vector_edges(resolution.head_vectors(resolution.roles(words), self.vectors, alike=False), resolution.SAME_TYPE)
        same = f"(type_a = type_b AND rule = 1 AND sim >= {resolution.SAME_TYPE}) OR (type_a <> type_b AND rule > 1 AND sim >= {resolution.OTHER_TYPE})"
        return self.gate(pairs, ents, "newer", "step4", same)

    # steps of the older method
    def t0(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return self.gate(sieves.head_edges(ents), ents, "older", "step0", "rule > 0")

    def least(self, step: str) -> float:
        """The least rule of a step: one number."""
        return self.rules.where((F.col("method") == "older") & (F.col("step") == step) & (F.col("value") > 0)).agg(F.min("value")).first()[0] or 1.0

    def t1(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        pairs = resolution.vector_edges(resolution.head_vectors(resolution.roles(words), self.vectors), self.least("step1"))
        return self.gate(pairs, ents, "older", "step1", "rule > 0 AND sim >= rule")

    def labels(self, words: DataFrame) -> DataFrame:
        """The six most frequent phrases with a modifier of each entity."""
        return resolution.top_phrases(resolution.phrases_of(words.where("n > 1"), STOPS), 6)

    def t2(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        p = self.labels(words)
        return resolution.grid_edges(p, resolution.phrase_cosines(p, self.vectors, self.least("step2")), ents, self.rules, "older", "step2", resolution.LABELS_SHARE, True, cross_types=False)

    def t3(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        role = resolution.roles(words)
        over = self.gate(resolution.compound_edges(role, ents), ents, "older", "step3", "rule > 0")
        # phrases with a named compound that both entities have
        named = role.where("compounds > 0 AND ne = 1").select("topic_id", "entity", "word")
        common = sieves._pairs(named, "word").select("topic_id", "a", "b").union(sieves._pairs(named, "word").select("topic_id", "b", "a"))
        p = resolution.phrases_of(words.where("n > 1"), STOPS)
        with_name = p.withColumn("word", F.explode(F.split("phrase", " "))).join(named, ["topic_id", "entity", "word"], "left_semi").select("topic_id", "entity", "phrase").distinct()
        grid = resolution.grid_edges(with_name, resolution.phrase_cosines(with_name, self.vectors, self.least("step3")), ents, self.rules, "older", "step3", resolution.COMPOUND_SHARE, False)
        return over.union(grid.join(common, ["topic_id", "a", "b"], "left_semi")).groupBy("topic_id", "a", "b").agg(F.max("sim").alias("sim"))

    def sets(self, words: DataFrame) -> DataFrame:
        """The maximal frequent sets of words of each entity."""
        w = words.where(~F.col("word").isin(*STOPS)).select("topic_id", F.col("chain").alias("entity"), "mention_id", "word").distinct()
        return sieves.maximal_sets(w, ["topic_id", "entity"], "mention_id", 4).select("topic_id", "entity", F.array_join("itemset", " ").alias("phrase"))

    def t4(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        p = self.sets(words)
        return resolution.grid_edges(p, resolution.phrase_cosines(p, self.vectors, self.least("step4")), ents, self.rules, "older", "step4", resolution.SETS_SHARE, False)

    def t5(self, words: DataFrame, ents: DataFrame) -> DataFrame:
        return resolution.string_edges(resolution.top_phrases(resolution.phrases_of(words, STOPS), 6), ents, self.rules, "older", "step4")


def _edges(step: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        inputs = Inputs(spark, sf)
        e = getattr(inputs, step)(inputs.words, resolution.entities_of(inputs.words))
        return e.select("topic_id", "a", "b", F.round("sim", 5).alias("sim"))

    return run


def _method(*steps: tuple[str, str]):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        inputs = Inputs(spark, sf)
        words, _ = resolution.identify(inputs.words, [(name, getattr(inputs, name), reach) for name, reach in steps])
        return words.where("i = 0").select("topic_id", "mention_id", F.col("chain").alias("entity")).distinct()

    return run


_X1 = E + _ruled("newer", "step1") + """, ti AS (SELECT topic_id, entity, CASE WHEN head IN (SELECT word FROM u WHERE dep = 'root' AND kind IN ('HUM', 'GRP', 'LOC')) THEN head END AS title FROM ent),
 f AS (SELECT pr.topic_id, a, b, rule, any_value(ea.head) AS ha, any_value(eb.head) AS hb, any_value(tia.title) AS ta, any_value(tib.title) AS tb,
   sum((x.ne = 1 AND y.ne = 1)::INT) AS names, sum((x.ne = 1 AND y.ne = 1 AND x.heads > 0 AND y.heads > 0)::INT) AS hs, sum((x.ne = 1 AND y.ne = 1 AND x.compounds > 0 AND y.compounds > 0)::INT) AS cs,
   sum(CASE WHEN x.heads > 0 THEN y.compounds ELSE 0 END) AS c1, sum(CASE WHEN y.heads > 0 THEN x.compounds ELSE 0 END) AS c2, bool_or(y.heads > 0 AND x.compounds > 0 AND y.ne = 1) AS inner_
  FROM pr JOIN role x ON x.topic_id = pr.topic_id AND x.entity = a JOIN role y ON y.topic_id = pr.topic_id AND y.entity = b AND y.word = x.word JOIN ent ea ON ea.topic_id = pr.topic_id AND ea.entity = a JOIN ent eb ON eb.topic_id = pr.topic_id AND eb.entity = b
  JOIN ti tia ON tia.topic_id = pr.topic_id AND tia.entity = a JOIN ti tib ON tib.topic_id = pr.topic_id AND tib.entity = b
  WHERE (x.ne = 1 OR x.heads > 0 OR x.compounds > 0) AND (y.ne = 1 OR y.heads > 0 OR y.compounds > 0) GROUP BY ALL),
 g AS (SELECT *, names > 0 OR (hs > 0 AND cs > 0 AND (coalesce(ta = tb, (ta IS NULL) <> (tb IS NULL)) OR c1 > 1 OR c2 > 1 OR cs > 1 OR hs > 1)) AS f4, hs > 0 AND cs > 0 AND (contains(ha, hb) OR contains(hb, ha)) AS f2 FROM f)
SELECT topic_id, a, b, (f4::INT * 4 + f2::INT * 2 + inner_::INT)::DOUBLE AS sim FROM g WHERE f4 OR (rule > 1 AND f2) OR (rule = 2 AND inner_)"""  # fmt: skip
query("x1_core_match", _X1)(_edges("x1"))
query("x2_phrase_match")(_edges("x2"))

_HV = _means("hv", "SELECT topic_id, entity AS k, word FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, entity, substr(word, 2) ORDER BY heads DESC, word) AS r FROM role WHERE heads > 0) WHERE r = 1")
_HA = _means("hv", "SELECT topic_id, entity AS k, word FROM role WHERE heads > 0")
_T1 = E + WV + _HV + _ruled("older", "step1") + f", c AS (SELECT pr.topic_id, a, b, rule, {_COS} AS sim FROM pr JOIN hv x ON x.topic_id = pr.topic_id AND x.k = a JOIN hv y ON y.topic_id = pr.topic_id AND y.k = b) SELECT topic_id, a, b, round(sim, 5) AS sim FROM c WHERE sim >= rule"
query("t1_head_similarity", _T1)(_edges("t1"))
_XB4 = E + WV + _HA + _ruled("newer", "step4") + f", c AS (SELECT pr.topic_id, a, b, ta, tb, rule, {_COS} AS sim FROM pr JOIN hv x ON x.topic_id = pr.topic_id AND x.k = a JOIN hv y ON y.topic_id = pr.topic_id AND y.k = b) SELECT topic_id, a, b, round(sim, 5) AS sim FROM c WHERE (ta = tb AND rule = 1 AND sim >= 0.4) OR (ta <> tb AND rule > 1 AND sim >= 0.7)"
query("xb4_head_vectors", _XB4)(_edges("xb4"))

_LB = f", lp AS (SELECT topic_id, chain, mention_id, array_to_string(list_sort(list_distinct(list(word))), ' ') AS phrase FROM u WHERE {{where}} AND word NOT IN ({_STOPS}) GROUP BY ALL), lc AS (SELECT topic_id, k, phrase, row_number() OVER (PARTITION BY topic_id, k ORDER BY c DESC, phrase) AS r FROM (SELECT topic_id, chain AS k, phrase, count(*) AS c FROM lp GROUP BY ALL)), lb AS (SELECT topic_id, k, phrase FROM lc WHERE r <= 6)"
_PV = _means("pv", "SELECT DISTINCT topic_id, phrase AS k, unnest(string_split(phrase, ' ')) AS word FROM {phrases}")
_PC = f", pc AS (SELECT x.topic_id, x.k AS p, y.k AS q, CASE WHEN x.k = y.k THEN 1 ELSE {_COS} END AS sim FROM pv x JOIN pv y USING (topic_id))"
_CELL = ", nn AS (SELECT topic_id, k, count(*) AS n FROM {phrases} GROUP BY ALL), gr AS (SELECT pr.topic_id, a, b, ta, tb, any_value(nx.n) AS na, any_value(ny.n) AS nb, sum({weight}) / (any_value(nx.n) * any_value(ny.n))::DOUBLE AS sim FROM pr JOIN {phrases} x ON x.topic_id = pr.topic_id AND x.k = a JOIN {phrases} y ON y.topic_id = pr.topic_id AND y.k = b JOIN pc ON pc.topic_id = pr.topic_id AND p = x.phrase AND q = y.phrase JOIN nn nx ON nx.topic_id = pr.topic_id AND nx.k = a JOIN nn ny ON ny.topic_id = pr.topic_id AND ny.k = b WHERE sim >= rule GROUP BY ALL)"
_T2 = E + WV + _LB.replace("{where}", "n > 1") + _PV.replace("{phrases}", "lb") + _PC + _ruled("older", "step2") + _CELL.replace("{phrases}", "lb").replace("{weight}", "CASE WHEN sim >= rule + 0.2 THEN 2 ELSE 1 END") + " SELECT topic_id, a, b, round(sim, 5) AS sim FROM gr WHERE sim >= 0.3 AND (ta = tb OR na * nb > 2)"
query("t2_phrase_grid", _T2)(_edges("t2"))
query("t3_compound_grid")(_edges("t3"))
query("t4_wordset_grid")(_edges("t4"))
_T5 = E + _LB.replace("{where}", "true") + _ruled("older", "step4") + """, nn AS (SELECT topic_id, k, count(*) AS n FROM lb GROUP BY ALL),
 ce AS (SELECT pr.topic_id, a, b, x.phrase AS p, y.phrase AS q FROM pr JOIN lb x ON x.topic_id = pr.topic_id AND x.k = a JOIN lb y ON y.topic_id = pr.topic_id AND y.k = b
  WHERE levenshtein(x.phrase, y.phrase) / greatest(len(string_split(x.phrase, ' ')), len(string_split(y.phrase, ' ')))::DOUBLE <= rule),
 ro AS (SELECT topic_id, a, b, max(c) AS across FROM (SELECT topic_id, a, b, p, count(*) AS c FROM ce GROUP BY ALL) GROUP BY ALL), co AS (SELECT topic_id, a, b, max(c) AS down FROM (SELECT topic_id, a, b, q, count(*) AS c FROM ce GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT topic_id, a, b, CASE WHEN across >= down AND y.n > 1 THEN across / y.n::DOUBLE WHEN across < down AND x.n > 1 THEN down / x.n::DOUBLE ELSE 0 END AS sim FROM ro JOIN co USING (topic_id, a, b) JOIN nn x ON x.topic_id = ro.topic_id AND x.k = a JOIN nn y ON y.topic_id = ro.topic_id AND y.k = b)
SELECT topic_id, a, b, round(sim, 5) AS sim FROM s WHERE sim >= 0.7""".replace("SELECT topic_id, a, b, CASE WHEN across", "SELECT ro.topic_id, a, b, CASE WHEN across")  # fmt: skip
query("t5_phrase_distance", _T5)(_edges("t5"))
query("x3l_group_country_heads")(_edges("x3l"))
query("x4_misc_linkage")(_edges("x4"))
query("xb3_type_linkage")(_edges("xb3"))

_D, _S, _C = resolution.DIRECT, resolution.SECOND, resolution.CLOSURE
query("mtd6_mtd7_older_method")(_method(("t0", _D), ("t1", _D), ("t2", _C), ("t3", _D), ("t4", _S), ("t5", _S)))
query("mtd8_base_method")(_method(("x0", _D), ("x1", _D), ("x2", _D), ("xb3", _D), ("xb4", _D)))


# -- the third step of the default method ----------------------------------------------------------------------------------


class Phrases:
    """The points of the third step: phrases of a topic's entities, their names, heads and graph."""

    def __init__(self, inputs: Inputs, words: DataFrame) -> None:
        self.inputs, self.words = inputs, words
        self.of = resolution.top_phrases(resolution.phrases_of(words, STOPS), 6)
        self.names = words.where("ner NOT IN ('O', 'DATE', 'TITLE')").select("topic_id", "word").distinct()

    @cached_property
    def points(self) -> DataFrame:
        return cut(self.of.groupBy("topic_id", "phrase").agg(F.max("head").alias("head")), forget=True)

    @cached_property
    def heads(self) -> DataFrame:
        return self.points.select("topic_id", "phrase", "head")

    @cached_property
    def chains(self) -> DataFrame:
        return cut(pc.name_chains(self.names), forget=True)

    @cached_property
    def graph(self) -> DataFrame:
        return cut(pc.phrase_graph(self.points, self.names, self.chains, self.inputs.vectors), forget=True)

    @cached_property
    def head_graph(self) -> DataFrame:
        h = self.points.select("topic_id", F.col("head").alias("entity")).distinct()
        return cut(resolution.vector_edges(h.join(self.inputs.vectors.withColumnRenamed("word", "entity"), "entity"), pc.NEAR), forget=True)

    @cached_property
    def cores(self) -> DataFrame:
        return cut(pc.core_clusters(pc.core_pairs(self.graph, self.points)), forget=True)


def _phrases(spark: SparkSession, sf: str) -> Phrases:
    inputs = Inputs(spark, sf)
    return Phrases(inputs, inputs.words)


_SPLIT = E + """, ty AS (SELECT DISTINCT type_a AS etype FROM rules WHERE method = 'newer' AND step = 'step3' AND value IN (1, 2)), sp AS (SELECT u.* FROM u JOIN ent ON ent.topic_id = u.topic_id AND ent.entity = u.chain JOIN ty USING (etype) WHERE size > 1)
SELECT mention_id, string_agg(word, ' ' ORDER BY i) AS short_phrase FROM sp WHERE dep IN ('compound', 'nmod:poss', 'root') GROUP BY 1"""  # fmt: skip


@query("x3a_split_members", _SPLIT)
def x3a(spark: SparkSession, sf: str) -> DataFrame:
    """Members of entities with several ones, of the types of the step: each by itself, with compounds and head as its phrase."""
    inputs = Inputs(spark, sf)
    types = inputs.rules.where("method = 'newer' AND step = 'step3' AND value IN (1, 2)").select(F.col("type_a").alias("etype")).distinct()
    many = resolution.entities_of(inputs.words).where("size > 1").join(F.broadcast(types), "etype").select("topic_id", F.col("entity").alias("chain"))
    w = inputs.words.join(many, ["topic_id", "chain"], "left_semi").where("dep IN ('compound', 'nmod:poss', 'root')")
    return w.groupBy("mention_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("short_phrase"))


_NAMES = ", nw AS (SELECT DISTINCT topic_id, word FROM u WHERE ner NOT IN ('O', 'DATE', 'TITLE')), ne AS (SELECT x.topic_id, x.word AS a, y.word AS b FROM nw x JOIN nw y ON x.topic_id = y.topic_id AND x.word <> y.word AND length(x.word) > 7 AND length(y.word) > 7 AND (contains(x.word, substr(y.word, 1, 8)) OR contains(y.word, substr(x.word, 1, 8)))), nc AS (SELECT topic_id, a AS word, a AS w FROM ne UNION SELECT nc.topic_id, nc.word, ne.b FROM nc JOIN ne ON ne.topic_id = nc.topic_id AND ne.a = nc.w), ch AS (SELECT topic_id, word, min(w) AS chain FROM nc GROUP BY ALL)"
_RE = E.replace("WITH d AS", "WITH RECURSIVE d AS", 1)
_GRAPH = _RE + WV + _NAMES + _LB.replace("{where}", "true") + """, pw AS (SELECT DISTINCT topic_id, phrase AS k, unnest(string_split(phrase, ' ')) AS word FROM lb), wt AS (SELECT pw.*, CASE WHEN nw.word IS NULL THEN 1.0 ELSE 1.7 END AS x FROM pw LEFT JOIN nw USING (topic_id, word)),
 pv AS (SELECT topic_id, k, list(a ORDER BY d) AS v FROM (SELECT topic_id, k, d, sum(c * x) AS a FROM (SELECT topic_id, k, x, unnest(v) AS c, unnest(range(1, 65)) AS d FROM wt JOIN wv USING (word)) GROUP BY ALL) GROUP BY ALL), po AS (SELECT topic_id, k, arg_max(chain, word) AS chain FROM pw JOIN ch USING (topic_id, word) GROUP BY ALL),
 gp AS (SELECT x.topic_id, x.k AS a, y.k AS b, """ + _COS + f""" AS sim FROM pv x JOIN pv y ON x.topic_id = y.topic_id AND x.k < y.k LEFT JOIN po cx ON cx.topic_id = x.topic_id AND cx.k = x.k LEFT JOIN po cy ON cy.topic_id = y.topic_id AND cy.k = y.k WHERE {_COS} >= 0.4 AND (cx.chain IS NULL OR cy.chain IS NULL OR cx.chain = cy.chain))"""  # fmt: skip
query("x3b_prefix_chains", _RE + _NAMES + " SELECT * FROM ch")(lambda spark, sf: _phrases(spark, sf).chains)
query("x3c_similarity_graph", _GRAPH + " SELECT topic_id, a, b, round(sim, 5) AS sim FROM gp")(lambda spark, sf: _phrases(spark, sf).graph.withColumn("sim", F.round("sim", 5)))
_CORES = _GRAPH + """, gu AS (SELECT topic_id, a AS p, b AS q FROM gp UNION ALL SELECT topic_id, b, a FROM gp), dg AS (SELECT topic_id, p, count(*) AS d FROM gu GROUP BY ALL), np AS (SELECT topic_id, count(DISTINCT phrase) AS n FROM lb GROUP BY 1),
 sc AS (SELECT x.topic_id, x.p AS a, y.p AS b, count(*) AS c FROM gu x JOIN gu y ON x.topic_id = y.topic_id AND x.q = y.q AND x.p < y.p GROUP BY ALL)
SELECT sc.topic_id, a, b, round(c / greatest(da.d, db.d)::DOUBLE, 5) AS ratio FROM sc JOIN dg da ON da.topic_id = sc.topic_id AND da.p = a JOIN dg db ON db.topic_id = sc.topic_id AND db.p = b JOIN np ON np.topic_id = sc.topic_id WHERE c / greatest(da.d, db.d)::DOUBLE >= least(greatest(round(ln(n) / ln(5000), 1), 0.5), 0.7)"""  # fmt: skip
query("x3d_cores", _CORES)(lambda spark, sf: (lambda p: pc.core_pairs(p.graph, p.points).withColumn("ratio", F.round("ratio", 5)))(_phrases(spark, sf)))
query("x3d_core_clusters")(lambda spark, sf: _phrases(spark, sf).cores)
query("x3e_mutual_neighbours")(lambda spark, sf: (lambda p: pc.mutual_neighbours(pc.cluster_similarity(p.graph, p.cores, p.head_graph, p.heads)))(_phrases(spark, sf)))
query("x3f_alien_points")(lambda spark, sf: (lambda p: pc.alien_points(p.graph, p.cores))(_phrases(spark, sf)))
query("x3g_body_points")(lambda spark, sf: (lambda p: pc.body_points(p.graph, p.cores))(_phrases(spark, sf)))
query("x3h_border_points")(lambda spark, sf: (lambda p: pc.border_points(p.graph, p.cores))(_phrases(spark, sf)))
_PARTS = _GRAPH + ", gu AS (SELECT topic_id, a AS p, b AS q FROM gp WHERE sim >= 0.5 UNION SELECT topic_id, b, a FROM gp WHERE sim >= 0.5), gr AS (SELECT topic_id, p AS phrase, p AS w FROM gu UNION SELECT gr.topic_id, gr.phrase, gu.q FROM gr JOIN gu ON gu.topic_id = gr.topic_id AND gu.p = gr.w) SELECT topic_id, phrase, min(w) AS cluster FROM gr GROUP BY ALL"
query("x3i_non_core_components", _PARTS)(lambda spark, sf: pc.components(_phrases(spark, sf).graph))
query("x3j_entities_by_priority")(lambda spark, sf: (lambda p: pc.clusters_by_priority(p.graph, p.points))(_phrases(spark, sf)))


def _x3(self: Inputs, words: DataFrame, ents: DataFrame) -> DataFrame:
    """Entities of the step's types whose first phrases are in one cluster, beside the first of them."""
    types = self.rules.where("method = 'newer' AND step = 'step3' AND value IN (1, 2)").select(F.col("type_a").alias("etype")).distinct()
    own = words.join(ents.join(F.broadcast(types), "etype").select("topic_id", F.col("entity").alias("chain")), ["topic_id", "chain"], "left_semi")
    p = Phrases(self, own)
    c = pc.clusters_by_priority(p.graph, p.points).where("level <> 'alone'")
    first = ops.first_of(p.of, ["topic_id", "entity"], [F.desc("n"), F.asc("phrase")]).select("topic_id", "entity", "phrase")
    e = first.join(c, ["topic_id", "phrase"]).join(ents.select("topic_id", "entity", "size"), ["topic_id", "entity"])
    lead = e.groupBy("topic_id", "cluster").agg(F.min(F.struct((-F.col("size")).alias("o"), "entity")).alias("x")).select("topic_id", "cluster", F.col("x.entity").alias("a"))
    return e.join(lead, ["topic_id", "cluster"]).where("a <> entity").select("topic_id", "a", F.col("entity").alias("b"), F.lit(1.0).alias("sim")).distinct()


Inputs.x3 = _x3
query("mtd9_newer_method")(_method(("x0", _D), ("x1", _D), ("x2", _D), ("x3", _D), ("x3l", _D), ("x4", _D)))

# -- phrases of a topic: similarity graph, components, clusterings ----------------------------------------------------------

_PG = E + WV + _LB.replace("{where}", "true") + _PV.replace("{phrases}", "lb") + f", ed AS (SELECT x.topic_id, x.k AS a, y.k AS b, {_COS} AS sim FROM pv x JOIN pv y ON x.topic_id = y.topic_id AND x.k < y.k WHERE {_COS} >= 0.4)"


def _phrase_vectors(spark: SparkSession, sf: str) -> tuple[Inputs, DataFrame]:
    inputs = Inputs(spark, sf)
    p = resolution.top_phrases(resolution.phrases_of(inputs.words, STOPS), 6).select("topic_id", F.col("phrase").alias("entity")).distinct()
    w = p.withColumn("word", F.explode(F.split("entity", " "))).join(inputs.vectors, "word")
    return inputs, vectors.mean_vector(w, ["topic_id", "entity"], "v")


@query("clu3_components", _PG.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + """, us AS (SELECT topic_id || '/' || a AS a, topic_id || '/' || b AS b FROM ed UNION SELECT topic_id || '/' || b, topic_id || '/' || a FROM ed), rc AS (SELECT a AS id, a AS w FROM us UNION SELECT rc.id, us.b FROM rc JOIN us ON rc.w = us.a) SELECT id, min(w) AS component FROM rc GROUP BY 1""")
def clu3(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the similarity graph of a topic's phrases."""
    e = resolution.vector_edges(_phrase_vectors(spark, sf)[1], 0.4)
    return graphs.label_components(e.select(F.concat_ws("/", "topic_id", "a").alias("a"), F.concat_ws("/", "topic_id", "b").alias("b")))


@query("clu1_average_linkage")
def clu1(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.clusters_of(_phrase_vectors(spark, sf)[1], resolution.MISC_DISTANCE).select("topic_id", F.col("b").alias("phrase"), F.col("a").alias("cluster"))


@query("clu4_best_pair_agglomeration")
def clu4(spark: SparkSession, sf: str) -> DataFrame:
    """Merging by the best mean pair score above the stop: like average linkage, it never leaves a component of pairs above
    the stop, so each is agglomerated on its own. Scores are (1 + cosine) / 2."""
    v = _phrase_vectors(spark, sf)[1]
    name = lambda c: F.concat_ws("/", "topic_id", c)
    e = resolution.vector_edges(v, 0.3)
    comp = graphs.label_components(e.select(name("a").alias("a"), name("b").alias("b")))
    return vectors.clusters_within(v.select(name("entity").alias("id"), "v").join(comp, "id"), "component", "id", "v", "pairs", stop=0.65)


@query("mtd5_affinity_clustering")
def mtd5(spark: SparkSession, sf: str) -> DataFrame:
    """Affinity propagation over a topic's entities (chains): groups as large as a topic's list of entities."""
    inputs = Inputs(spark, sf)
    words = annotated(spark, sf)
    return vectors.clusters_within(inputs.means(words), "topic_id", "entity", "v", "affinity", damping=0.7)


@query("win7_central_vector", E + WV + _LB.replace("{where}", "true") + _PV.replace("{phrases}", "lb") + f", ms AS (SELECT x.topic_id, lx.k AS cluster, x.k AS phrase, avg({_COS}) AS s FROM lb lx JOIN lb ly ON lx.topic_id = ly.topic_id AND lx.k = ly.k AND lx.phrase <> ly.phrase JOIN pv x ON x.topic_id = lx.topic_id AND x.k = lx.phrase JOIN pv y ON y.topic_id = ly.topic_id AND y.k = ly.phrase GROUP BY ALL) SELECT topic_id, cluster, phrase FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, cluster ORDER BY round(s, 9) DESC, phrase) AS r FROM ms) WHERE r = 1")
def win7(spark: SparkSession, sf: str) -> DataFrame:
    """The phrase of each entity that is most like its others: six phrases an entity at most."""
    inputs = Inputs(spark, sf)
    p = resolution.top_phrases(resolution.phrases_of(inputs.words, STOPS), 6).select("topic_id", "entity", "phrase")
    v = vectors.mean_vector(p.select("topic_id", "phrase").distinct().withColumn("word", F.explode(F.split("phrase", " "))).join(inputs.vectors, "word"), ["topic_id", "phrase"], "v")
    x, y = p.join(v, ["topic_id", "phrase"]), p.join(v, ["topic_id", "phrase"]).select("topic_id", "entity", F.col("phrase").alias("other"), F.col("v").alias("w"))
    s = x.join(y, ["topic_id", "entity"]).where("phrase <> other").groupBy("topic_id", "entity", "phrase").agg(F.avg(vectors.cosine(F.col("v"), F.col("w"))).alias("s"))
    return ops.first_of(s, ["topic_id", "entity"], [F.desc(F.round("s", 9)), F.asc("phrase")]).select("topic_id", F.col("entity").alias("cluster"), "phrase")


@query("agg23_word_vector_means", A + WV + _means("me", "SELECT topic_id, chain AS k, word FROM t") + " SELECT topic_id, k AS chain, round(list_sum(v), 5) AS total, round(v[1], 5) AS first FROM me")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    w = annotated(spark, sf)
    m = vectors.mean_vector(w.select("topic_id", "chain", "word").join(word_vectors(spark, sf, w), "word"), ["topic_id", "chain"], "v")
    return m.select("topic_id", "chain", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.get("v", F.lit(0)), 5).alias("first"))


@query("clu11_lexical_vectors", A + WV + f", al AS (SELECT topic_id, chain, min(kind) AS kind, count(*) AS n FROM t GROUP BY ALL), us AS (SELECT t.topic_id, t.chain, word FROM t JOIN al USING (topic_id, chain) WHERE CASE WHEN al.kind = 'ACT' THEN dep = 'root' ELSE word NOT IN ({_STOPS}) END), cn AS (SELECT topic_id, chain, count(*) AS heads FROM us GROUP BY ALL), sm AS (SELECT topic_id, chain, sum(v[1]) AS s FROM us JOIN wv USING (word) GROUP BY ALL) SELECT topic_id, chain, round(s / CASE WHEN kind = 'ACT' THEN heads ELSE n END, 5) AS first FROM sm JOIN al USING (topic_id, chain) JOIN cn USING (topic_id, chain)")
def clu11(spark: SparkSession, sf: str) -> DataFrame:
    """Head words of event clusters; words that are no stop words of entity clusters, divided by all their words."""
    w = annotated(spark, sf)
    al = w.groupBy("topic_id", "chain").agg(F.min("kind").alias("k"), F.count("*").alias("all"))
    use = w.join(al, ["topic_id", "chain"]).where(F.when(F.col("k") == "ACT", F.col("dep") == "root").otherwise(~F.col("word").isin(*STOPS)))
    g = use.join(word_vectors(spark, sf, w), "word").groupBy("topic_id", "chain").agg(F.sum(F.get("v", F.lit(0))).alias("s"), F.count("*").alias("heads"), F.first("k").alias("k"), F.first("all").alias("n"))
    return g.select("topic_id", "chain", F.round(F.col("s") / F.when(F.col("k") == "ACT", F.col("heads")).otherwise(F.col("n")), 5).alias("first"))


_ITEMS = f""", it AS (SELECT DISTINCT topic_id, chain, mention_id, word FROM t WHERE word NOT IN ({_STOPS})), nd AS (SELECT topic_id, chain, count(DISTINCT mention_id) AS n FROM it GROUP BY ALL),
 sb AS (SELECT topic_id, chain, mention_id, [word] AS s FROM it UNION ALL SELECT sb.topic_id, sb.chain, sb.mention_id, list_append(s, it.word) FROM sb JOIN it ON it.topic_id = sb.topic_id AND it.chain = sb.chain AND it.mention_id = sb.mention_id AND it.word > s[-1]),
 fs AS (SELECT topic_id, chain, s, count(*) AS support FROM sb JOIN nd USING (topic_id, chain) GROUP BY topic_id, chain, s, n HAVING count(*) >= least(n, 4))
"""
query("fpm1_frequent_sets", A.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + _ITEMS + "SELECT topic_id, chain, array_to_string(s, ' ') AS itemset, support FROM fs")(
    lambda spark, sf: sieves.frequent_sets(_items(spark, sf), ["topic_id", "chain"], "mention_id", 4).select("topic_id", "chain", F.array_join("itemset", " ").alias("itemset"), "support"))
query("fpm1_maximal_sets", A.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + _ITEMS + """, mx AS (SELECT x.* FROM fs x WHERE NOT EXISTS (SELECT 1 FROM fs y WHERE y.topic_id = x.topic_id AND y.chain = x.chain AND len(y.s) > len(x.s) AND list_has_all(y.s, x.s))),
 vf AS (SELECT topic_id, chain, list(s[1]) AS often FROM fs JOIN nd USING (topic_id, chain) WHERE len(s) = 1 AND support >= 0.9 * n GROUP BY ALL)
SELECT DISTINCT topic_id, chain, array_to_string(list_sort(list_distinct(list_concat(s, coalesce(often, [])))), ' ') AS itemset FROM mx LEFT JOIN vf USING (topic_id, chain)""")(
    lambda spark, sf: sieves.maximal_sets(_items(spark, sf), ["topic_id", "chain"], "mention_id", 4).select("topic_id", "chain", F.array_join("itemset", " ").alias("itemset")))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(spark, sf).where(~F.col("word").isin(*STOPS)).select("topic_id", "chain", "mention_id", "word")


_LINK = A + WV + _means("me", "SELECT topic_id, chain AS k, word FROM t") + """, ev AS (SELECT DISTINCT topic_id, doc_id, sent_id, chain FROM m WHERE kind = 'ACT'), ar AS (SELECT doc_id, sent_id, CASE kind WHEN 'HUM' THEN 'arg0' WHEN 'GRP' THEN 'arg1' WHEN 'LOC' THEN 'loc' ELSE 'time' END AS role, min(chain) AS arg FROM m WHERE kind IN ('HUM', 'GRP', 'LOC', 'TIM') GROUP BY ALL)"""


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Event clusters by sentence, and each sentence's argument of each role: one kind of mention stands for each role."""
    m = ops.mention_base(read(spark, sf, "mentions"))
    ev = m.where("kind = 'ACT'").select("topic_id", "doc_id", "sent_id", "chain").distinct()
    role = F.when(F.col("kind") == "HUM", "arg0").when(F.col("kind") == "GRP", "arg1").when(F.col("kind") == "LOC", "loc").otherwise("time")
    ar = m.where("kind IN ('HUM', 'GRP', 'LOC', 'TIM')").groupBy("doc_id", "sent_id", role.alias("role")).agg(F.min("chain").alias("arg"))
    return ev, ar


@query("clu10_linked_vectors", _LINK + ", ro AS (SELECT unnest(['arg0', 'arg1', 'loc', 'time']) AS role), x AS (SELECT ev.topic_id, ev.doc_id, ev.sent_id, ev.chain, ro.role, arg FROM ev CROSS JOIN ro LEFT JOIN ar ON ar.doc_id = ev.doc_id AND ar.sent_id = ev.sent_id AND ar.role = ro.role) SELECT doc_id, sent_id, chain, role, round(coalesce(v[1], 0), 5) AS linked FROM x LEFT JOIN me ON me.topic_id = x.topic_id AND me.k = x.arg")
def clu10(spark: SparkSession, sf: str) -> DataFrame:
    """For each event cluster in a sentence and each of four roles, the vector of the cluster that fills it (here its first
    number), zeros where none does."""
    ev, ar = _links(spark, sf)
    w = annotated(spark, sf)
    me = vectors.mean_vector(w.select("topic_id", "chain", "word").join(word_vectors(spark, sf, w), "word"), ["topic_id", "chain"], "v").withColumnRenamed("chain", "arg")
    x = ev.withColumn("role", F.explode(F.array(*map(F.lit, ("arg0", "arg1", "loc", "time"))))).join(ar, ["doc_id", "sent_id", "role"], "left").join(me, ["topic_id", "arg"], "left")
    return x.select("doc_id", "sent_id", "chain", "role", F.round(F.coalesce(F.get("v", F.lit(0)), F.lit(0.0)), 5).alias("linked"))


_BITS = "max((role = 'arg0')::INT) AS arg0, max((role = 'arg1')::INT) AS arg1, max((role = 'loc')::INT) AS loc, max((role = 'time')::INT) AS time"


@query("clu9_role_bits", _LINK + f", l AS (SELECT DISTINCT ev.chain, ev.doc_id, role, arg FROM ev JOIN ar USING (doc_id, sent_id)) SELECT 'event' AS side, x.chain AS a, y.chain AS b, {_BITS.replace('(role', '(x.role')} FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.role = y.role AND x.arg = y.arg AND x.chain < y.chain GROUP BY ALL UNION ALL SELECT 'entity', x.arg, y.arg, {_BITS.replace('(role', '(x.role')} FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.role = y.role AND x.chain = y.chain AND x.arg < y.arg GROUP BY ALL")
def clu9(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two event clusters of a document share the filler of a role, and whether two entity clusters fill a role of
    one event cluster: for each of four roles."""
    ev, ar = _links(spark, sf)
    li = ev.join(ar, ["doc_id", "sent_id"]).select("chain", "doc_id", "role", "arg").distinct()
    bits = [F.max((F.col("role") == r).cast("int")).alias(r) for r in ("arg0", "arg1", "loc", "time")]

    def side(name: str, own: str, other: str) -> DataFrame:
        j = li.withColumnRenamed(own, "a").join(li.withColumnRenamed(own, "b"), ["doc_id", "role", other]).where("a < b")
        return j.groupBy("a", "b").agg(*bits).select(F.lit(name).alias("side"), "a", "b", "arg0", "arg1", "loc", "time")

    return side("event", "chain", "arg").unionByName(side("entity", "arg", "chain"))
