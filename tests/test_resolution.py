import itertools
import random

import numpy as np
import pytest

from mentionloom.operators import graphs, resolution, sieves, vectors

WORDS = "topic_id string, mention_id string, doc_id string, chain string, kind string, i int, n int, word string, raw string, pos string, ner string, dep string"


def words(spark, mentions):
    """(entity, kind, phrase) to annotated words: the last word is the head, capitalised ones are names."""
    ner = {"HUM": "PERSON", "GRP": "ORGANIZATION", "LOC": "LOCATION"}
    rows = []
    for k, (entity, kind, phrase) in enumerate(mentions):
        ws = phrase.split()
        for i, w in enumerate(ws):
            name = ner.get(kind, "O") if w[0].isupper() else "O"
            rows.append(("t", f"m{k}", "d", entity, kind, i, len(ws), w.lower(), w, "NNP" if w[0].isupper() else "NN", name, "root" if i == len(ws) - 1 else "compound"))
    return spark.createDataFrame(rows, WORDS)


def test_turns_are_not_components():
    """The gate is not transitive: a and c are both like b, but not like each other, and b is taken by the larger."""
    size = {"a": 5, "b": 3, "c": 4}
    assert resolution.take_turns(["a", "b"], ["b", "c"], [1, 1], size, resolution.DIRECT) == {"a": "a", "b": "a"}
    assert resolution.take_turns(["a", "b"], ["b", "c"], [1, 1], {"a": 5, "b": 4, "c": 3}, resolution.DIRECT) == {"a": "a", "b": "a"}
    assert resolution.take_turns(["a", "b"], ["b", "c"], [1, 1], {"a": 5, "b": 4, "c": 3}, resolution.CLOSURE) == {"a": "a", "b": "a", "c": "a"}
    # a larger one is never taken on the way
    assert resolution.take_turns(["a", "b"], ["b", "c"], [1, 1], size, resolution.CLOSURE) == {"a": "a", "b": "a"}
    # of each direct one the first similar one only
    got = resolution.take_turns(["a", "b", "b"], ["b", "c", "d"], [1] * 3, {"a": 5, "b": 4, "c": 3, "d": 2}, resolution.SECOND)
    assert got == {"a": "a", "b": "a", "c": "a"}


def test_absorb_differs_from_components(spark):
    edges = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "c", 1.0), ("s", "a", "b", 1.0)], "topic_id string, a string, b string, sim double")
    ents = spark.createDataFrame([("t", "a", 5), ("t", "b", 4), ("t", "c", 3), ("s", "a", 1), ("s", "b", 1)], "topic_id string, entity string, size long")
    assert {tuple(r) for r in resolution.absorb(edges, ents).collect()} == {("t", "b", "a"), ("s", "b", "a")}
    assert {r.component for r in graphs.label_components(edges.where("topic_id = 't'").select("a", "b")).collect()} == {"a"}
    assert resolution.absorb(edges.limit(0), ents).count() == 0


def test_steps_see_what_steps_before_merged(spark):
    w = words(spark, [("x", "HUM", "Ana Berg"), ("x", "HUM", "Ana Berg"), ("y", "HUM", "Berg"), ("z", "HUM", "Ana Lund"), ("z", "HUM", "Lund")])
    by_word = lambda ws, ents: sieves._pairs(ws.where("ner <> 'O'").select("topic_id", "chain", "word").withColumnRenamed("chain", "entity"), "word").select("topic_id", "a", "b", "shared").withColumnRenamed("shared", "sim")
    two = lambda ws, ents: by_word(ws, ents).where("sim > 1")
    done, history = resolution.identify(w, [("one", two, resolution.DIRECT), ("two", by_word, resolution.DIRECT)])
    assert {r.chain for r in done.collect()} == {"x"}
    assert {(r.step, r.entity, r.into) for r in history.collect()} == {("two", "y", "x"), ("two", "z", "x")}
    again, history = resolution.identify(w, [("one", by_word, resolution.DIRECT), ("two", two, resolution.DIRECT)])
    assert {(r.step, r.entity) for r in history.collect()} == {("one", "y"), ("one", "z")}


@pytest.mark.parametrize("block", [4, 1000])
def test_similar_pairs_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    x[3] = 0
    rows = [("g" if i % 3 else "h", f"k{i:02d}", x[i].tolist()) for i in range(40)]
    got = {(r.g, r.a, r.b): r.sim for r in vectors.similar_pairs(spark.createDataFrame(rows, "g string, k string, v array<double>"), "g", "k", "v", 0.3, block).collect()}
    want = {}
    for (g, a, v), (h, b, w) in itertools.combinations(rows, 2):
        n = np.linalg.norm(v) * np.linalg.norm(w)
        if g == h and n and np.dot(v, w) / n >= 0.3:
            want[g, a, b] = np.dot(v, w) / n
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and got


def test_average_linkage_by_components_is_that_of_the_whole(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(6, 8)), 6, 0) + rng.normal(size=(36, 8)) * 0.5
    rows = [("t", f"e{i:02d}", x[i].tolist()) for i in range(36)]
    got = {r.b: r.a for r in resolution.clusters_of(spark.createDataFrame(rows, "topic_id string, entity string, v array<double>"), 0.4).collect()}
    label = vectors.average_linkage(x, 0.4)
    first = {k: min(f"e{i:02d}" for i in range(36) if label[i] == k) for k in set(label.tolist())}
    assert got == {f"e{i:02d}": first[label[i]] for i in range(36)} and 1 < len(set(got.values())) < 36


def test_sets_match_brute_force(spark):
    rng = random.Random(3)
    items = [(g, f"i{k}", tuple(rng.sample("abcdef", rng.randrange(1, 6)))) for g in "xy" for k in range(12)] + [("z", "i0", ("a", "b"))]
    df = spark.createDataFrame([(g, i, w) for g, i, ws in items for w in ws], "g string, i string, word string")
    got = {(r.g, tuple(r.itemset)): r.support for r in sieves.frequent_sets(df, ["g"], "i", 4).collect()}
    want = {}
    for g in "xyz":
        own = [set(ws) for h, _, ws in items if h == g]
        for k in range(1, 7):
            for s in itertools.combinations("abcdef", k):
                n = sum(set(s) <= o for o in own)
                if n >= min(4, len(own)):
                    want[g, s] = n
    assert got == want
    top = {(r.g, tuple(r.itemset)) for r in sieves.maximal_sets(df, ["g"], "i", 4).collect()}
    assert {s for g, s in top if g == "z"} == {("a", "b")}
    often = {g: {s[0] for (h, s), n in want.items() if h == g and len(s) == 1 and n >= 0.9 * len([1 for h2, *_ in items if h2 == g])} for g in "xyz"}
    assert top == {(g, tuple(sorted(set(s) | often[g]))) for g, s in want if not any(h == g and set(s) < set(o) for h, o in want)}


def test_names_that_differ_in_the_first_letter_are_near(spark):
    w = words(spark, [("x", "HUM", "Kateryna Port Lund"), ("x", "HUM", "Katerina Port Lund"), ("y", "HUM", "Cateryna Port Lund"), ("y", "HUM", "Caterina Port Lund"), ("z", "HUM", "Other Name Lund"), ("z", "HUM", "Lund")])
    ents = resolution.entities_of(w)
    types = {e.etype for e in ents.collect()}
    rules = lambda v: spark.createDataFrame([("m", "s", a, b, v) for a in types for b in types], "method string, step string, type_a string, type_b string, value double")
    p = resolution.phrases_of(w, ())
    assert [(r.a, r.b, r.sim) for r in resolution.string_edges(p, ents, rules(0.9), "m", "s").collect()] == [("x", "y", 1.0)]
    assert resolution.string_edges(p, ents, rules(0.5), "m", "s").count() == 0  # one of two cells: below the share


def test_equal_vectors_are_one_point_of_average_linkage(spark, monkeypatch):
    # pairs of equal entities are as many as the square of their number, on disk, and say nothing
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))[rng.integers(0, 12, 90)]
    x[::30] = 0.0
    rows = [("t", f"e{i:02}", v.tolist()) for i, v in enumerate(x)]
    compared, edges = [], resolution.vector_edges
    monkeypatch.setattr(resolution, "vector_edges", lambda v, least: compared.append(v.count()) or edges(v, least))
    got = {r.b: r.a for r in resolution.clusters_of(spark.createDataFrame(rows, "topic_id string, entity string, v array<double>"), 0.4).collect()}
    label = vectors.average_linkage(x, 0.4)
    assert got == {f"e{i:02}": f"e{np.flatnonzero(label == label[i])[0]:02}" for i in range(len(x))}
    assert compared[0] <= 12 + 3
