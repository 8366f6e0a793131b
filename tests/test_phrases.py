import random

from mentionloom.operators import phrases


def test_phrases(spark):
    words = [(0, "The", "DT"), (1, "number", "NN"), (2, "of", "IN"), (3, "voters", "NNS"), (4, "rose", "VBD"), (5, "sharply", "RB")]
    tokens = spark.createDataFrame([("d", 0, i, w, p) for i, w, p in words], "doc_id string, sent_id int, tok_id int, word string, pos string")
    rows = [(1, 0, "det"), (4, 1, "nsubj"), (1, 3, "nmod:of"), (3, 2, "case"), (4, 5, "advmod"), (1, 6, "conj:and")]
    deps = spark.createDataFrame([("d", 0, g, x, n) for g, x, n in rows], "doc_id string, sent_id int, governor int, dependent int, dep string")
    assert [(r.head, r.first_tok, r.last_tok, r["size"]) for r in phrases.verb_phrases(tokens, deps).collect()] == [(4, 0, 6, 6)]
    assert {r.tok_id: r.head for r in phrases.quantity_heads(tokens).collect()}[1] == 3
    args = {(r.role, r.tok) for r in phrases.arguments(deps).collect()}
    assert {("arg0", 1), ("arg0", 6)} <= args
    spans = spark.createDataFrame([("m", "d", 0, t) for t in (0, 1)] + [("x", "d", 0, t) for t in (2, 5)], "mention_id string, doc_id string, sent_id int, tok int")
    assert {r.mention_id: r.head for r in phrases.span_heads(deps, spans, "mention_id").collect()} == {"m": 1, "x": 5}
    nodes = spark.createDataFrame([("d", 0, 1, "NP", 0, 1), ("d", 0, 2, "NP", 0, 3), ("d", 0, 3, "NP", 3, 3), ("d", 0, 4, "NP", 0, 0), ("d", 0, 5, "VP", 4, 5)],
                                  "doc_id string, sent_id int, node_id int, label string, first_tok int, last_tok int")
    assert {(r.first_tok, r.last_tok) for r in phrases.noun_phrases(nodes, tokens).collect()} == {(0, 1), (0, 3)}
    mention = spark.createDataFrame([("m", "d", 0, 3, 3), ("n", "d", 0, 0, 1)], "mention_id string, doc_id string, sent_id int, first_tok int, last_tok int")
    assert {(r.mention_id, r.first_tok) for r in phrases.extended_phrases(mention, nodes, "mention_id").collect()} == {("m", 0), ("n", 0)}
    heads = spark.createDataFrame([("m", "d", 0, 4)], "mention_id string, doc_id string, sent_id int, head int")
    assert {(r.relation, r.tok) for r in phrases.modifier_expansion(deps, heads, "mention_id").collect()} == {("nsubj", 1), ("advmod", 5)}


def test_match_to_gold_uses_each_once(spark):
    s = "doc_id string, sent_id int, mention_id string, first_tok int, last_tok int, head string"
    p = spark.createDataFrame([("d", 0, "p1", 0, 2, "x"), ("d", 0, "p2", 0, 1, "y"), ("d", 1, "p3", 0, 0, "z")], s)
    g = spark.createDataFrame([("d", 0, "g1", 0, 2, "x"), ("d", 0, "g2", 0, 4, "w")], s)
    assert {(r.p_id, r.g_id, r["rank"]) for r in phrases.match_to_gold(p, g).collect()} == {("p1", "g1", 0), ("p2", "g2", 2)}


def test_sense_weights(spark):
    df = spark.createDataFrame([("w", 0, "act"), ("w", 1, "act"), ("w", 2, "person"), ("w", 3, "place")], "word string, rank int, lexname string")
    assert {r.lexname: r.weight for r in phrases.sense_weights(df).collect()} == {"act": 1.75, "person": 0.25}


def test_match_to_gold_of_many_sentences(spark):
    # sentences are matched by batches: a call of Python for each one takes longer than the limit allows on large tables
    rng = random.Random(4)
    own = lambda x, most: [(f"d{s % 2}", s, f"{x}{s}.{n}", (at := rng.randrange(6)), at + rng.randrange(3), rng.choice("hk")) for s in range(40) for n in range(rng.randrange(most))]
    p, g = own("p", 5), own("g", 4)
    want = set()
    for s in range(40):
        pairs = []
        for _, _, pi, pf, pl, ph in (x for x in p if x[1] == s):
            for _, _, gi, gf, gl, gh in (x for x in g if x[1] == s):
                rank = 0 if (pf, pl) == (gf, gl) else 1 if ph == gh else 2 if (pf >= gf and pl <= gl) or (gf >= pf and gl <= pl) else None
                if pf <= gl and gf <= pl and rank is not None:
                    pairs.append((rank, abs(pf - gf) + abs(pl - gl), pi, gi))
        used = set()
        for rank, _, pi, gi in sorted(pairs):
            if not used & {pi, gi}:
                used |= {pi, gi}
                want.add((pi, gi, rank))
    kind = "doc_id string, sent_id int, mention_id string, first_tok int, last_tok int, head string"
    out = phrases.match_to_gold(spark.createDataFrame(p, kind), spark.createDataFrame(g, kind))
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
