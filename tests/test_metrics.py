"""Golden metric cases (labels of single mentions; braces are chains) and invariants."""

import itertools
import random

import numpy as np
import pytest

from mentionloom.operators import metrics

CASES = {
    "A1": ("a bc def", "a bc def", {"muc": (1, 1, 1), "bcub": (1, 1, 1), "ceafm": (1, 1, 1), "ceafe": (1, 1, 1), "blanc": (1, 1, 1)}),
    "A2": ("a bc def", "a de", {"muc": (0.3333, 1, 0.5), "bcub": (0.3889, 1, 0.56), "ceafm": (0.5, 1, 0.6667), "ceafe": (0.6, 0.9, 0.72), "blanc": (0.2159, 1, 0.3538)}),
    "A3": ("a bc def", "a bcx defy z", {"muc": (1, 0.6, 0.75), "bcub": (1, 0.5093, 0.6748), "ceafm": (1, 0.6667, 0.8), "ceafe": (0.8857, 0.6643, 0.7592), "blanc": (1, 0.4259, 0.5972)}),
    "A4": ("a bc def", "a bcx dy z", {"muc": (0.3333, 0.3333, 0.3333), "bcub": (0.5556, 0.4048, 0.4683), "ceafm": (0.6667, 0.5714, 0.6154), "ceafe": (0.7333, 0.55, 0.6286), "blanc": (0.3523, 0.2721, 0.3036)}),
    "A10": ("a bc def", "a b c d e f", {"muc": (0, 0, 0), "bcub": (0.5, 1, 0.6667), "blanc": (0.5, 0.3667, 0.4231)}),
    "A11": ("a bc def", "abcdef", {"muc": (1, 0.6, 0.75), "bcub": (1, 0.3889, 0.56), "blanc": (0.5, 0.1333, 0.2105)}),
    "A12": ("a bc def", "a x y c d e z", {"muc": (0, 0, 0), "bcub": (0.3611, 0.5714, 0.4425), "blanc": (0.2273, 0.1191, 0.1562)}),
    "A13": ("a bc def", "axycdez", {"muc": (0.3333, 0.1667, 0.2222), "bcub": (0.4722, 0.1224, 0.1945), "blanc": (0.125, 0.0238, 0.04)}),
    "B1": ("ab cde", "bcx de", {"blanc": (0.2917, 0.2917, 0.2917)}),
    "C1": ("ab cde fg", "bcx de fg", {"blanc": (0.5125, 0.5125, 0.5125)}),
    "D1": ("12345 67 89ABC", "12345 6789ABC", {"muc": (1, 0.9, 0.9474), "bcub": (1, 0.7619, 0.8649)}),
    "E1": ("12345 67 89ABC", "1234589ABC 67", {"muc": (1, 0.9, 0.9474), "bcub": (1, 0.5833, 0.7368)}),
    "F1": ("ABCD", "AB CD", {"muc": (0.6667, 1, 0.8)}),
    "G1": ("AB CD", "ABCD", {"muc": (1, 0.6667, 0.8)}),
    "J1": ("ABC", "AC", {"muc": (0.5, 1, 0.6667)}),
    "K1": ("BCDEGHJ", "ABC DEF GHI", {"muc": (0.5, 0.5, 0.5)}),
    "L1": ("ABC DEFG", "AB CD FGH", {"muc": (0.4, 0.5, 0.4444)}),
    "M1": ("abcdef", "abcdef", {"muc": (1, 1, 1), "blanc": (1, 1, 1)}),
    "M2": ("abcdef", "a b c d e f", {"blanc": (0, 0, 0)}),
    "M3": ("abcdef", "ab cde f", {"blanc": (0.2667, 1, 0.421)}),
    "M4": ("abcdef", "abcxyz", {"blanc": (0.2, 0.2, 0.2)}),
    "M5": ("abcdef", "a b c x y z", {"blanc": (0, 0, 0)}),
    "M6": ("abcdef", "ab cxy z", {"blanc": (0.0667, 0.25, 0.1053)}),
    "N1": ("a b c d e f", "a b c d e f", {"muc": (0, 0, 0), "blanc": (1, 1, 1)}),
    "N2": ("a b c d e f", "abcdef", {"blanc": (0, 0, 0)}),
    "N3": ("a b c d e f", "ab cde f", {"blanc": (0.7333, 1, 0.8461)}),
    "N4": ("a b c d e f", "a b c x y z", {"blanc": (0.2, 0.2, 0.2)}),
    "N5": ("a b c d e f", "abcxyz", {"blanc": (0, 0, 0)}),
    "N6": ("a b c d e f", "ab cxy z", {"blanc": (0.1333, 0.1818, 0.1538)}),
}


def rows(cases):
    out = []
    for name, (key, response, _) in cases.items():
        k = {m: c for c in key.split() for m in c}
        r = {m: c for c in response.split() for m in c}
        out += [(name, m, k.get(m), r.get(m)) for m in sorted(k.keys() | r.keys())]
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(rows(CASES), "case string, mention_id string, key string, response string").cache()


def scores(df, name=None):
    return {r["case"]: (r["recall"], r["precision"], r["f1"]) for r in df.collect() if name is None or r["measure"] == name}


def test_golden(labels):
    ceaf = metrics.ceaf(labels, ["case"]).cache()
    got = {"muc": scores(metrics.muc(labels, ["case"])), "bcub": scores(metrics.b_cubed(labels, ["case"])), "blanc": scores(metrics.blanc(labels, ["case"])),
           "ceafe": scores(ceaf, "ceafe"), "ceafm": scores(ceaf, "ceafm")}
    for case, (_, _, want) in CASES.items():
        for measure, values in want.items():
            assert got[measure].get(case, (0, 0, 0)) == pytest.approx(values, abs=1.1e-4), (case, measure)


def test_swap_exchanges_recall_and_precision(labels):
    turned = labels.selectExpr("case", "mention_id", "response AS key", "key AS response")
    for f in (metrics.muc, metrics.b_cubed, metrics.lea):
        a, b = scores(f(labels, ["case"])), scores(f(turned, ["case"]))
        assert all(a[c][:2] == pytest.approx(b[c][1::-1], abs=1e-6) for c in CASES)


def test_perfect_response(labels):
    same = labels.where("key IS NOT NULL").selectExpr("case", "mention_id", "key", "key AS response")
    for f in (metrics.b_cubed, metrics.lea, metrics.weighted_f1):
        assert all(v == (1, 1, 1) for v in scores(f(same, ["case"])).values())


def test_closed_blanc_counts_links(spark):
    rng = random.Random(5)
    data = [(str(t), f"m{i}", rng.choice("abc") if rng.random() < 0.9 else None, rng.choice("xyz") if rng.random() < 0.9 else None) for t in range(6) for i in range(12)]
    got = scores(metrics.blanc(spark.createDataFrame(data, "case string, mention_id string, key string, response string"), ["case"]))
    for t in {d[0] for d in data}:
        own = [d for d in data if d[0] == t]
        link = lambda j, same: {(p[1], q[1]) for p, q in itertools.combinations([d for d in own if d[j]], 2) if (p[j] == q[j]) == same}  # noqa: B023, E731
        r = [len(link(2, s) & link(3, s)) / len(link(2, s)) for s in (True, False)]
        assert got[t][0] == pytest.approx(sum(r) / 2, abs=1e-5)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 6)):
        s = rng.random((n, m)).round(1)
        a, b = (s, n) if n <= m else (s.T, m)
        best = max(sum(a[i, p[i]] for i in range(b)) for p in itertools.permutations(range(a.shape[1]), b))
        pairs = metrics.best_assignment(s)
        assert sum(s[p] for p in pairs) == pytest.approx(best)
        assert len({i for i, _ in pairs}) == len(pairs) == min(n, m)
