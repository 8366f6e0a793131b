"""Phrase operators over token, dependency and parse tables.

``tokens`` (doc_id, sent_id, tok_id, word, pos), ``deps`` (doc_id, sent_id, governor, dependent, dep) and ``nodes``
(doc_id, sent_id, node_id, label, first_tok, last_tok) are annotation tables; spans are nested intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.operators.mention_ops import first_of

SENT = ["doc_id", "sent_id"]
#: Dependency labels that do not belong to a verb phrase.
OUTSIDE = ("mark", "xcomp", "advcl", "parataxis")
#: Heads that only count or collect what follows "of".
QUANTITY = ("number", "group", "lot", "majority", "dozens", "hundreds", "thousands", "couple", "half", "part", "percent")


def dependency_subset(deps: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Dependencies with both ends among a span's tokens (spans: key, sentence, tok)."""
    g = spans.select(*SENT, key, F.col("tok").alias("governor"))
    d = spans.select(*SENT, key, F.col("tok").alias("dependent"))
    return deps.join(g, [*SENT, "governor"]).join(d, [*SENT, key, "dependent"]).select(key, *SENT, "governor", "dependent", "dep")


def span_heads(deps: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, head): the governor inside a span that is nobody's dependent there, else the last token."""
    inside = dependency_subset(deps, spans, key)
    top = inside.select(key, F.col("governor").alias("tok")).join(inside.select(key, F.col("dependent").alias("tok")), [key, "tok"], "left_anti")
    head = top.groupBy(key).agg(F.min("tok").alias("h"))
    last = spans.groupBy(key).agg(F.max("tok").alias("l"))
    return last.join(head, key, "left").select(key, F.coalesce("h", "l").alias("head"))


def verb_phrases(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_id, head, first_tok, last_tok, size): a verb with its dependents and theirs, without clauses."""
    verbs = tokens.where(F.col("pos").startswith("V")).select(*SENT, F.col("tok_id").alias("head"))
    one = deps.where(~F.col("dep").isin(*OUTSIDE)).select(*SENT, F.col("governor").alias("head"), F.col("dependent").alias("tok"))
    first = verbs.join(one, [*SENT, "head"])
    two = deps.where(~F.col("dep").isin(*OUTSIDE, "acl:relcl")).select(*SENT, F.col("governor").alias("tok"), F.col("dependent").alias("next"))
    second = first.join(two, [*SENT, "tok"]).select(*SENT, "head", F.col("next").alias("tok"))
    every = verbs.withColumn("tok", F.col("head")).unionByName(first).unionByName(second).distinct()
    return every.groupBy(*SENT, "head").agg(F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"), F.count("*").alias("size"))


def quantity_heads(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, head): a quantity word followed by "of" gives its headship to the word after."""
    w = Window.partitionBy(*SENT).orderBy("tok_id")
    t = tokens.withColumn("n1", F.lower(F.lead("word", 1).over(w))).withColumn("n2", F.lead("tok_id", 2).over(w))
    moved = F.lower("word").isin(*QUANTITY) & (F.col("n1") == "of") & F.col("n2").isNotNull()
    return t.select(*SENT, "tok_id", F.when(moved, F.col("n2")).otherwise(F.col("tok_id")).alias("head"))


def noun_phrases(nodes: DataFrame, tokens: DataFrame, longest: int = 20, known: DataFrame | None = None) -> DataFrame:
    """NP nodes within the length limit that are not all function words; the widest of equal heads (last tokens) wins,
    and phrases whose head is known already are left out."""
    np_ = nodes.where((F.col("label") == "NP") & (F.col("last_tok") - F.col("first_tok") + 1 < longest))
    content = tokens.where(~F.col("pos").isin("DT", "EX", "CD", "PRP", "PRP$", "RB")).select(*SENT, F.col("tok_id").alias("tok"))
    t = np_.withColumn("tok", F.explode(F.sequence("first_tok", "last_tok"))).join(content, [*SENT, "tok"], "left_semi").select(*SENT, "node_id", "first_tok", "last_tok").distinct()
    t = first_of(t.withColumn("head", F.col("last_tok")), [*SENT, "head"], [F.asc("first_tok"), F.asc("node_id")])
    return t if known is None else t.join(known.select(*SENT, "head").distinct(), [*SENT, "head"], "left_anti")


def extended_phrases(mentions: DataFrame, nodes: DataFrame, key: str, longest: int = 20) -> DataFrame:
    """(key, first_tok, last_tok): the smallest strictly larger NP around a mention that ends with its head, else itself."""
    n = nodes.where("label = 'NP'").select(*SENT, F.col("first_tok").alias("nf"), F.col("last_tok").alias("nl"))
    j = mentions.join(n, SENT, "left").where((F.col("nl") == F.col("last_tok")) & (F.col("nf") < F.col("first_tok")) & (F.col("nl") - F.col("nf") + 1 < longest))
    best = j.groupBy(key).agg(F.max("nf").alias("nf"))
    return mentions.join(best, key, "left").select(key, F.coalesce("nf", "first_tok").alias("first_tok"), "last_tok")


def arguments(deps: DataFrame) -> DataFrame:
    """(doc_id, sent_id, verb, role, tok): subjects, objects and possessors, with what is joined to them by "conj"."""
    role = F.when(F.col("dep").startswith("nsubj"), "arg0").when(F.col("dep").isin("obj", "dobj", "nsubjpass"), "arg1").when(F.col("dep") == "nmod:poss", "poss")
    a = deps.withColumn("role", role).where("role IS NOT NULL").select(*SENT, F.col("governor").alias("verb"), "role", F.col("dependent").alias("tok"))
    conj = deps.where(F.col("dep").startswith("conj")).select(*SENT, F.col("governor").alias("tok"), F.col("dependent").alias("next"))
    more = a.join(conj, [*SENT, "tok"]).select(*SENT, "verb", "role", F.col("next").alias("tok"))
    verb = deps.where(F.col("dep").isin("xcomp", "conj")).select(*SENT, F.col("governor").alias("verb"), F.col("dependent").alias("v2"))
    shared = a.where("role = 'arg0'").join(verb, [*SENT, "verb"]).select(*SENT, F.col("v2").alias("verb"), "role", "tok")
    return a.unionByName(more).unionByName(shared).distinct()


def modifier_expansion(deps: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, relation, tok): modifiers of a head, and those of its apposition or relative clause."""
    d = deps.select(*SENT, F.col("governor").alias("head"), F.col("dependent").alias("tok"), "dep")
    own = heads.select(key, *SENT, "head").join(d, [*SENT, "head"])
    via = own.where(F.col("dep").isin("appos", "acl:relcl")).select(key, *SENT, F.col("tok").alias("head"))
    return own.unionByName(via.join(d, [*SENT, "head"]).select(own.columns)).select(key, F.col("dep").alias("relation"), "tok").distinct()


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs used of each sentence's ordered ones; a batch holds many sentences."""
    for batch in batches:
        pairs = batch.column(0)
        at, (ranks, _, ps, gs) = pairs.offsets.to_pylist(), (x.to_pylist() for x in pairs.values.flatten())
        out: tuple[list, list, list] = ([], [], [])
        for begin, end in zip(at, at[1:]):
            used_p, used_g = set(), set()
            for n in range(begin, end):
                if (p := ps[n]) not in used_p and (g := gs[n]) not in used_g:
                    used_p.add(p)
                    used_g.add(g)
                    for x, v in zip(out, (p, g, ranks[n])):
                        x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int32()))], ["p_id", "g_id", "rank"])


def match_to_gold(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(p_id, g_id, rank): each predicted mention with a gold one of its sentence, each used once: equal spans first, then
    equal heads that overlap, then spans inside one another. Groups are sentences."""
    p = predicted.select(*SENT, F.col("mention_id").alias("p_id"), F.col("first_tok").alias("pf"), F.col("last_tok").alias("pl"), F.col("head").alias("ph"))
    g = gold.select(*SENT, F.col("mention_id").alias("g_id"), F.col("first_tok").alias("gf"), F.col("last_tok").alias("gl"), F.col("head").alias("gh"))
    j = p.join(g, SENT).where("pf <= gl AND gf <= pl")
    rank = F.when(F.expr("pf = gf AND pl = gl"), 0).when(F.expr("ph = gh"), 1).when(F.expr("(pf >= gf AND pl <= gl) OR (gf >= pf AND gl <= pl)"), 2)
    j = j.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("gap", F.abs(F.col("pf") - F.col("gf")) + F.abs(F.col("pl") - F.col("gl")))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "gap", "p_id", "g_id"))).alias("pairs")
    return j.groupBy(*SENT).agg(ordered).select("pairs").mapInArrow(_matched, "p_id string, g_id string, rank int")


def sense_weights(senses: DataFrame) -> DataFrame:
    """(word, lexname, weight) from senses (word, rank from 0, lexname): sum of 2 (n - i) / n over matching senses, times
    their share, kept from a quarter on."""
    n = senses.groupBy("word").agg(F.count("*").alias("n"))
    s = senses.join(n, "word").groupBy("word", "lexname", "n").agg(F.sum(2 * (F.col("n") - F.col("rank")) / F.col("n")).alias("s"), F.count("*").alias("c"))
    w: Column = F.col("s") * F.col("c") / F.col("n")
    return s.where(w >= 0.25).select("word", "lexname", F.round(w, 6).alias("weight"))
