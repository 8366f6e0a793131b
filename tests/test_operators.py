import random

import numpy as np

from mentionloom.functions import scalars
from mentionloom.operators import graphs, significance, vectors
from mentionloom.operators.mention_ops import mention_base, nearest


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: min(y for y in list(root) if find(y) == find(x)) for x in list(root)}
    got = {r.id: r.component for r in graphs.label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.component for r in graphs.label_components(chain).collect()} == {0}
    assert graphs.label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_agrees_with_components_on_cliques(spark):
    cliques = [(f"t{g}", f"{g}{i}", 5 - i, f"{g}{j}", 5 - j, 1.0) for g in range(3) for i in range(4) for j in range(i + 1, 4)]
    df = spark.createDataFrame(cliques, "group string, a string, size_a int, b string, size_b int, sim double")
    greedy = {r.id: r.into for r in graphs.merge_greedy(df).collect()}
    assert greedy == {r.id: r.into for r in graphs.merge_components(df.select("a", "b")).collect()}


def test_clusterings():
    x = np.array([[1, 0], [1, 0.05], [0, 1], [0.02, 1], [-1, 0.0]])
    assert vectors.average_linkage(x, 0.3).tolist() == [0, 0, 2, 2, 4]
    assert vectors.average_linkage(np.zeros((3, 2)), 0.1).tolist() == [0, 1, 2]
    y = np.array([[0.0, 0], [0, 0.1], [5, 5], [5, 5.1], [5.1, 5]])
    a = vectors.affinity_propagation(y)
    assert a[0] == a[1] and len(set(a[2:])) == 1 and a[0] != a[2]
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert vectors.best_pair_agglomeration(s, 0.5).tolist() == [0, 0, 2]
    assert vectors.best_pair_agglomeration(s, 0.1).tolist() == [0, 0, 0]  # the last two merge as well


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    m = {r.k: r.v for r in vectors.mean_vector(df, ["k"], "v").collect()}
    assert m == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    r = df.select(vectors.cosine(df["v"], df["v"]).alias("c")).collect()
    assert [round(x.c, 6) for x in r] == [1.0, 1.0, 0.0]


def test_ordered_words(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    got = df.select(scalars.is_ordered_subsequence(df["x"], df["y"]).alias("i"), scalars.ordered_intersection(df["x"], df["y"]).alias("o")).collect()
    assert [(r.i, r.o) for r in got] == [(True, ["a", "c"]), (False, ["c"]), (True, [])]


def test_mentions_with_odd_rows(spark):
    schema = "mention_id string, doc_id string, sent_id int, tokens_number array<int>, tokens_str string, coref_chain string, mention_type string, score double, topic_id string, is_continuous boolean, is_singleton boolean"
    rows = [("1", "d", 0, [0, 1], "The Mayor,", "a+b", None, None, "t", True, False)] * 2 + [("2", "d", 0, [], "...", None, "HUM+", -1.0, None, None, None), ("3", None, None, None, None, None, None, None, None, None, None)]
    got = {r.mention_id: r for r in mention_base(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 3 and got["1"].chain == "a" and got["1"].head == "mayor" and got["1"].kind == "UNK" and got["2"].head is None and got["2"].kind == "HUM"
    assert mention_base(spark.createDataFrame([], schema)).count() == 0


def test_nearest_skips_touching(spark):
    s = "doc_id string, sent_id int, mention_id string, first_tok int, last_tok int"
    left = spark.createDataFrame([("d", 0, "L", 5, 6)], s)
    right = spark.createDataFrame([("d", 0, "far", 0, 1), ("d", 0, "near", 2, 3), ("d", 0, "touch", 4, 4), ("d", 0, "after", 9, 9), ("d", 0, "beside", 7, 7)], s)
    assert [(r.right_id, r.gap) for r in nearest(left, right, ["doc_id", "sent_id"], "left").collect()] == [("near", 2)]
    assert [(r.right_id, r.gap) for r in nearest(left, right, ["doc_id", "sent_id"], "right").collect()] == [("after", 3)]


def test_significance(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 5)) for i in range(30)], "k int, a double, b double")
    assert significance.permutation(df, "k", "a", "b", 20).first().p == 1.0
    up = df.selectExpr("k", "a + 1 AS a", "b")
    assert significance.permutation(up, "k", "a", "b", 99).first().p == 0.01
    assert significance.bootstrap(up, "k", "a", "b", 20).first().share == 0.0


def test_signed_ranks_of_many_pairs(spark):
    # n (n + 1) (2 n + 1) is beyond the whole numbers of 64 bits
    n = 1_700_000
    r = significance.wilcoxon(spark.range(n).selectExpr("CAST(IF(id % 2 = 0, 2, 1) AS DOUBLE) AS a", "CAST(IF(id % 2 = 0, 1, 2) AS DOUBLE) AS b"), "a", "b").first()
    assert tuple(r) == (n, n * (n + 1) / 4, 0.0)


def test_edit_distance(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choices("abcé.Ж", k=rng.randrange(8))), "".join(rng.choices("abcé.Ж", k=rng.randrange(8)))) for _ in range(60)] + [("U.S.", "US"), ("", "")]

    def distance(a, b):
        if a.replace(".", "") == b.replace(".", ""):
            return 0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.d for r in df.select(scalars.edit_distance(df["a"], df["b"]).alias("d")).collect()] == [distance(*p) for p in pairs]

def test_extended_b_cubed_is_b_cubed_for_single_labels(spark):
    from mentionloom.operators import metrics

    rng = random.Random(9)
    rows = [(str(i % 2), i, rng.choice("abc"), rng.choice("xyz")) for i in range(40)]
    one = spark.createDataFrame([(t, i, [k], [r]) for t, i, k, r in rows], "t string, item int, key array<string>, response array<string>")
    two = spark.createDataFrame(rows, "t string, mention_id int, key string, response string")
    assert {tuple(r) for r in metrics.extended_b_cubed(one, ["t"]).collect()} == {tuple(r) for r in metrics.b_cubed(two, ["t"]).collect()}
