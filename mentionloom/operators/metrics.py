"""Coreference measures over two labelings of mentions, computed from their contingency table.

Input of every measure: one row per mention with ``key`` (gold chain) and ``response`` (system chain); a null label
means the mention is not in that labeling. ``by`` names the columns that separate evaluations (topic, configuration).
All measures start from the same pre-aggregated counts, so nothing is quadratic in mentions; link counts are closed
forms. Results: one row per evaluation with recall, precision and f1; a measure without a denominator is 0.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.operators.graphs import label_components
from mentionloom.session import cut


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_beta(recall: Column, precision: Column, beta: float = 1.0) -> Column:
    """F-measure with a guard against an empty denominator."""
    b2 = beta * beta
    return ratio((1 + b2) * recall * precision, b2 * precision + recall)


def pairs_of(n: Column) -> Column:
    """Number of unordered pairs among n."""
    return n * (n - 1) / 2


def contingency(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, response, n): partial aggregation before the shuffle."""
    return labels.groupBy(*by, "key", "response").agg(F.count("*").alias("n"))


def _scored(df: DataFrame, by: list[str], recall: Column, precision: Column, digits: int = 6) -> DataFrame:
    d = df.select(*by, recall.alias("r"), precision.alias("p"))
    return d.select(*by, F.round("r", digits).alias("recall"), F.round("p", digits).alias("precision"), F.round(f_beta(F.col("r"), F.col("p")), digits).alias("f1"))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """One row per evaluation from two aggregates."""
    if by:
        return left.join(right, by, "full")
    return left.crossJoin(right)  # one row each


def muc(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Links needed to join each chain's parts, against all its links."""
    c = contingency(labels, by)

    def side(own: str, other: str, name: str) -> DataFrame:
        parts = F.count_distinct(other) + F.sum(F.when(F.col(other).isNull(), F.col("n")).otherwise(0))
        chains = c.where(F.col(own).isNotNull()).groupBy(*by, own).agg(F.sum("n").alias("size"), parts.alias("parts"))
        return chains.groupBy(*by).agg(F.sum(F.col("size") - F.col("parts")).alias(f"{name}_a"), F.sum(F.col("size") - 1).alias(f"{name}_b"))

    j = _joined(side("key", "response", "r"), side("response", "key", "p"), by).fillna(0)
    return _scored(j, by, ratio(F.col("r_a"), F.col("r_b")), ratio(F.col("p_a"), F.col("p_b")))


def _sizes(c: DataFrame, by: list[str]) -> DataFrame:
    """The contingency of mentions in both labelings beside the sizes of their chains."""
    k = c.where("key IS NOT NULL").groupBy(*by, "key").agg(F.sum("n").alias("nk"))
    r = c.where("response IS NOT NULL").groupBy(*by, "response").agg(F.sum("n").alias("nr"))
    return c.where("key IS NOT NULL AND response IS NOT NULL").join(k, [*by, "key"]).join(r, [*by, "response"])


def _totals(c: DataFrame, by: list[str]) -> DataFrame:
    in_key = F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)
    in_response = F.when(F.col("response").isNotNull(), F.col("n")).otherwise(0)
    return c.groupBy(*by).agg(F.sum(in_key).alias("mk"), F.sum(in_response).alias("mr"))


def b_cubed(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean share of each mention's chain that both labelings agree on."""
    c = contingency(labels, by)
    s = _sizes(c, by).groupBy(*by).agg(F.sum(F.col("n") * F.col("n") / F.col("nk")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("nr")).alias("b"))
    j = _joined(_totals(c, by), s, by).fillna(0)
    return _scored(j, by, ratio(F.col("a"), F.col("mk")), ratio(F.col("b"), F.col("mr")))


def lea(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Links resolved per chain, weighted by chain size; a singleton counts as resolved by a singleton."""
    s = _sizes(contingency(labels, by), by)

    def side(own: str, size: str, other_size: str, name: str) -> DataFrame:
        links = F.when(F.col(size) == 1, F.when(F.col(other_size) == 1, 1.0).otherwise(0.0)).otherwise(pairs_of(F.col("n")) / pairs_of(F.col(size)))
        chains = s.groupBy(*by, own).agg(F.sum(links).alias("x"), F.first(size).alias("size"))
        return chains.groupBy(*by).agg(F.sum(F.col("size") * F.col("x")).alias(name))

    j = _joined(_joined(_totals(contingency(labels, by), by), side("key", "nk", "nr", "a"), by), side("response", "nr", "nk", "b"), by).fillna(0)
    return _scored(j, by, ratio(F.col("a"), F.col("mk")), ratio(F.col("b"), F.col("mr")))


def blanc(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean of the measures over coreference and non-coreference links; one kind alone where the key has only that kind."""
    c = contingency(labels, by)

    def links(df: DataFrame, label: str, name: str) -> DataFrame:
        sizes = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.sum("n").alias("s"))
        return sizes.groupBy(*by).agg(F.sum(pairs_of(F.col("s"))).alias(name), F.sum("s").alias(f"{name}_m"))

    both = c.where("key IS NOT NULL AND response IS NOT NULL")
    common = both.groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).alias("cc"), F.sum("n").alias("m"))
    j = links(c, "key", "kc")
    for d in (links(c, "response", "rc"), links(both, "key", "mkc"), links(both, "response", "mrc"), common):
        j = _joined(j, d, by)
    j = j.fillna(0)
    kn, rn = pairs_of(F.col("kc_m")) - F.col("kc"), pairs_of(F.col("rc_m")) - F.col("rc")
    cn = pairs_of(F.col("m")) - F.col("mkc") - F.col("mrc") + F.col("cc")
    j = j.select(*by, "kc", kn.alias("kn"), ratio(F.col("cc"), F.col("kc")).alias("Rc"), ratio(F.col("cc"), F.col("rc")).alias("Pc"),
                 ratio(cn, kn).alias("Rn"), ratio(cn, rn).alias("Pn"))
    fc, fn = f_beta(F.col("Rc"), F.col("Pc")), f_beta(F.col("Rn"), F.col("Pn"))

    def one(a: Column, b: Column) -> Column:
        return F.round(F.when(F.col("kc") == 0, b).when(F.col("kn") == 0, a).otherwise((a + b) / 2), 6)

    return j.select(*by, one(F.col("Rc"), F.col("Rn")).alias("recall"), one(F.col("Pc"), F.col("Pn")).alias("precision"), one(fc, fn).alias("f1"))


def best_overlap(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, key, nk, n, nr): each key chain's best response chain - most shared, then smallest, then first by name."""
    c = contingency(labels, by)
    k = c.where("key IS NOT NULL").groupBy(*by, "key").agg(F.sum("n").alias("nk"))
    s = _sizes(c, by)
    best = s.groupBy(*by, "key").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("nr"), F.col("response"))).alias("b"))
    return k.join(best, [*by, "key"], "left").select(*by, "key", "nk", F.coalesce(-F.col("b.m"), F.lit(0)).alias("n"), F.coalesce("b.nr", F.lit(0)).alias("nr"))


def weighted_f1(labels: DataFrame, by: list[str] = [], weights: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Recall, precision and F of each key chain's best response chain, weighted by chain size or by ``weights`` (key, w)."""
    b = best_overlap(labels, by)
    b = b.withColumn("w", F.col("nk").cast("double")) if weights is None else b.join(weights, "key")
    r, p = ratio(F.col("n"), F.col("nk")), ratio(F.col("n"), F.col("nr"))
    mean = lambda x: F.round(ratio(F.sum(x * F.col("w")), F.sum("w")), 6)
    return b.groupBy(*by).agg(mean(r).alias("recall"), mean(p).alias("precision"), mean(f_beta(r, p)).alias("f1"))


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment of greatest total score: shortest augmenting paths."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        low, before, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = row_of[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (slack < low[1:])
            low[1:][better], before[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(done[1:], np.inf, low[1:])))
            d = low[j1]
            u[row_of[done]] += d
            v[done] -= d
            low[~done] -= d
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            j1 = before[j0]
            row_of[j0] = row_of[j1]
            j0 = j1
    out = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return [(b, a) for a, b in out] if flip else out


def _assigned(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, responses = pd.factorize(pdf["key"]), pd.factorize(pdf["response"])
    phi = np.zeros((len(keys[1]), len(responses[1])))
    n = phi.copy()
    phi[keys[0], responses[0]] = 2 * pdf["n"] / (pdf["nk"] + pdf["nr"])
    n[keys[0], responses[0]] = pdf["n"]
    by_overlap = best_assignment(n)
    return pd.DataFrame([{"phi": sum(phi[a] for a in best_assignment(phi)), "n": float(sum(n[a] for a in by_overlap)), "phi_overlap": sum(phi[a] for a in by_overlap)}])


def ceaf(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, measure, recall, precision, f1) of ceafe (phi-optimal), ceafm and ceafe_overlap (overlap-optimal).

    Chains that share no mention add nothing to an assignment, so each connected component of the contingency table is
    solved on its own. Most components are stars - a chain beside chains that overlap no other -, whose optimum is their
    best pair: they are settled by aggregates. The others are solved one by one, each by a matrix of its key and
    response chains; a component is as large as a set of chains that overlap, not as the corpus."""
    c = contingency(labels, by)
    phi = 2 * F.col("n") / (F.col("nk") + F.col("nr"))
    s = _sizes(c, by).withColumn("phi", phi)
    dk, dr = s.groupBy(*by, "key").agg(F.count("*").alias("dk")), s.groupBy(*by, "response").agg(F.count("*").alias("dr"))
    s = s.join(dk, [*by, "key"]).join(dr, [*by, "response"])
    rk, rr = s.groupBy(*by, "key").agg(F.max("dr").alias("near_k")), s.groupBy(*by, "response").agg(F.max("dk").alias("near_r"))
    s = cut(s.join(rk, [*by, "key"]).join(rr, [*by, "response"]))
    best = [F.max("phi").alias("phi"), F.max("n").cast("double").alias("n"), F.max(F.struct("n", "phi"))["phi"].alias("phi_overlap")]
    settled = s.where("near_k = 1").groupBy(*by, "key").agg(*best).drop("key")
    settled = settled.unionByName(s.where("near_k > 1 AND near_r = 1").groupBy(*by, "response").agg(*best).drop("response"))
    rest = s.where("near_k > 1 AND near_r > 1")
    name = lambda side, col: F.concat_ws("\x01", F.lit(side), *by, F.col(col))
    comp = label_components(rest.select(name("k", "key").alias("a"), name("r", "response").alias("b")))
    grouped = rest.withColumn("a", name("k", "key")).join(comp.withColumnsRenamed({"id": "a"}), "a")
    # the component's label carries its evaluation; by-columns are put back by a join on small rows
    sums = grouped.groupBy("component").applyInPandas(lambda pdf: _assigned(pdf).assign(component=pdf["component"].iloc[0]), "phi double, n double, phi_overlap double, component string")
    where = grouped.select("component", *by).distinct()
    every = settled.unionByName(sums.join(where, "component").drop("component"))
    total = every.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("phi", "n", "phi_overlap")])
    counts = c.groupBy(*by).agg(F.count_distinct("key").alias("ck"), F.count_distinct("response").alias("cr"))
    j = _joined(_joined(total, counts, by), _totals(c, by), by)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(x).cast("double").alias("a"), F.col(k).alias("dk"), F.col(r).alias("dr")) for m, x, k, r in (
        ("ceafe", "phi", "ck", "cr"), ("ceafm", "n", "mk", "mr"), ("ceafe_overlap", "phi_overlap", "ck", "cr"))]))
    j = j.select(*by, rows.alias("x")).select(*by, "x.*")
    return _scored(j, [*by, "measure"], ratio(F.col("a"), F.col("dk")), ratio(F.col("a"), F.col("dr")))


def mention_identification(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Recall and precision of the mentions themselves, whatever their chains."""
    both = F.sum((F.col("key").isNotNull() & F.col("response").isNotNull()).cast("int"))
    j = labels.groupBy(*by).agg(both.alias("m"), F.count("key").alias("mk"), F.count("response").alias("mr"))
    return _scored(j, by, ratio(F.col("m"), F.col("mk")), ratio(F.col("m"), F.col("mr")))


def conll(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean of the F of MUC, B-cubed and CEAF-e."""
    parts = [muc(labels, by), b_cubed(labels, by), ceaf(labels, by).where("measure = 'ceafe'").drop("measure")]
    out = None
    for i, d in enumerate(parts):
        d = d.select(*by, F.col("f1").alias(f"f{i}"))
        out = d if out is None else _joined(out, d, by)
    return out.select(*by, F.round((F.col("f0") + F.col("f1") + F.col("f2")) / 3, 6).alias("conll_f1"))


def extended_b_cubed(items: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """B-cubed for items in several chains: (by, item, key array, response array) to recall and precision, by the
    multiplicity of shared labels. Pairs are formed only between items that share a label on that side."""
    a = items.select(*by, "item", F.col("key").alias("k"), F.col("response").alias("r"))

    def side(own: str, other: str, name: str) -> DataFrame:
        e = a.select(*by, "item", F.explode(own).alias("l"), own, other)
        x = e.select(*by, "l", F.col("item").alias("i"), F.col(own).alias("oi"), F.col(other).alias("ti"))
        y = e.select(*by, "l", F.col("item").alias("j"), F.col(own).alias("oj"), F.col(other).alias("tj"))
        p = x.join(y, [*by, "l"]).select(*by, "i", "j", "oi", "oj", "ti", "tj").distinct()
        so, st = F.size(F.array_intersect("oi", "oj")), F.size(F.array_intersect("ti", "tj"))
        return p.groupBy(*by, "i").agg(F.avg(F.least(so, st) / so).alias("x")).groupBy(*by).agg(F.avg("x").alias(name))

    return _scored(_joined(side("k", "r", "rec"), side("r", "k", "pre"), by), by, F.col("rec"), F.col("pre"))


def phrasing_complexity(mentions: DataFrame, entity: str, head: str, wordset: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, entity, wcl, mentions): variety of an entity's wording, 1 for singletons."""
    h = mentions.groupBy(*by, entity, head).agg(F.count_distinct(wordset).alias("u"), F.count("*").alias("n"))
    e = h.groupBy(*by, entity).agg(F.sum(F.col("u") / F.col("n")).alias("a"), F.sum("u").alias("b"), F.sum("n").alias("mentions"))
    return e.select(*by, entity, F.when(F.col("mentions") > 1, F.col("a") * F.col("b") / F.col("mentions")).otherwise(F.lit(1.0)).alias("wcl"), "mentions")


def evaluation_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    """Micro evaluation: B-cubed numerators and denominators summed over documents, then divided."""
    c = contingency(labels, by)
    s = _sizes(c, by).agg(F.sum(F.col("n") * F.col("n") / F.col("nk")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("nr")).alias("b"))
    t = _totals(c, by).agg(F.sum("mk").alias("mk"), F.sum("mr").alias("mr"))
    return _scored(t.crossJoin(s), [], ratio(F.col("a"), F.col("mk")), ratio(F.col("b"), F.col("mr")))




def partition_agreement(documents: DataFrame) -> DataFrame:
    """Homogeneity, completeness, V-measure and adjusted Rand index of (gold, predicted), from their contingency table."""
    n = documents.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    g, p = n.groupBy("gold").agg(F.sum("n").alias("ng")), n.groupBy("predicted").agg(F.sum("n").alias("np"))
    t = n.agg(F.sum("n").alias("t"), F.sum(pairs_of(F.col("n"))).alias("both"))  # one row
    rg, rp = (x.agg(F.sum(pairs_of(F.col(c))).alias(f"pairs_{c}")) for x, c in ((g, "ng"), (p, "np")))  # one row each
    j = n.join(g, "gold").join(p, "predicted").crossJoin(t.select("t"))
    part = F.col("n") / F.col("t")
    s = j.agg(F.sum(part * F.log(F.col("n") / F.col("np"))).alias("gp"), F.sum(part * F.log(F.col("n") / F.col("ng"))).alias("pg"),
              F.sum(part * F.log(F.col("ng") / F.col("t"))).alias("hg"), F.sum(part * F.log(F.col("np") / F.col("t"))).alias("hp"))
    one = lambda x, y: F.when(F.col(y) < 0, 1 - F.col(x) / F.col(y)).otherwise(F.lit(1.0))
    v = s.select(one("gp", "hg").alias("h"), one("pg", "hp").alias("c")).crossJoin(t).crossJoin(rg).crossJoin(rp)  # one row
    by_chance, mean = F.col("pairs_ng") * F.col("pairs_np") / pairs_of(F.col("t")), (F.col("pairs_ng") + F.col("pairs_np")) / 2
    ari = F.when(mean != by_chance, (F.col("both") - by_chance) / (mean - by_chance)).otherwise(F.lit(1.0))
    return v.select(F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"), F.round(ratio(2 * F.col("h") * F.col("c"), F.col("h") + F.col("c")), 6).alias("v_measure"), F.round(ari, 6).alias("ari"))
