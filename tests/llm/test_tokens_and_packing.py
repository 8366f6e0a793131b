import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionloom.llm import packing, tokens

needs = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no tokenizer files here")
TEXT = st.text(alphabet="ab c\r\n\t1'.é中　thes​😀Σ -", max_size=60)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@needs
@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_ids(reference, text):
    assert tokens.encoder("byte_bpe_50k", tokens.TOKENIZER_DIR).ids(text) == reference(text)


@needs
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.data())
def test_prefixes_append_and_edit(a, b, data):
    v = tokens.encoder("byte_bpe_50k", tokens.TOKENIZER_DIR).v
    e = tokens.PrefixEncoder(v, a)
    e.append(b)
    assert e.ids() == tokens.PrefixEncoder(v, a + b).ids()
    i = data.draw(st.integers(0, len(a + b)))
    j = data.draw(st.integers(i, len(a + b)))
    e.edit(i, j, b"xyz")
    assert e.ids() == tokens.PrefixEncoder(v, (a + b)[:i] + b"xyz" + (a + b)[j:]).ids()


@needs
def test_an_edit_recomputes_only_what_it_changes():
    v = tokens.encoder("byte_bpe_50k", tokens.TOKENIZER_DIR).v
    text = b"the cat sat on the mat and looked at the dog, " * 2000
    e = tokens.PrefixEncoder(v, text)
    for begin, end, data in ((40_000, 40_003, b"tiger"), (0, 5, b""), (len(text) - 9, len(text), b"x")):
        before = e.computed
        changed = e.data[:begin] + data + e.data[end:]
        e.edit(begin, end, data)
        assert e.data == changed and e.computed - before < 1000
        assert e.last == tokens.PrefixEncoder(v, changed).last


@needs
def test_special_strings_and_long_text(reference):
    e = tokens.encoder("byte_bpe_50k", tokens.TOKENIZER_DIR)
    for s in ("<|endoftext|> a", "a" * 5000, "中文" * 800, " \n " * 50, "they'll'VE I'M"):
        assert e.ids(s) == reference(s)


@needs
@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_counts(text):
    import sentencepiece
    from tokenizers import Tokenizer

    c = tokens.counter(tokens.NAMES, tokens.TOKENIZER_DIR).counts(text)
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{tokens.TOKENIZER_DIR}/piece_bpe_32k.model")
    w = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/word_bpe_49k.json")
    w.encode_special_tokens = True
    assert c[3] == len(sp.encode(text)) and c[2] == len(w.encode(text, add_special_tokens=False).ids)


@needs
@pytest.mark.parametrize("text", ["中文\r\n测试" * 40, "สวัสดีครับ" * 30 + "\r", "a" * 400, "word \r\n " * 50, "\r" * 30, "中" * 10 + " b" * 3, "x" * 200 + " y"])
def test_counts_of_scripts_without_spaces_and_of_line_ends(text):
    test_counts.hypothesis.inner_test(text)


@needs
def test_corpus(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "  ", "x"), (4, "  ", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got == [(1, [64, 275]), (2, []), (3, []), (4, [220, 220]), (4, [220, 220])] or got[1:3] == [(2, []), (3, [])]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.byte_bpe_50k for r in tokens.token_counts(df).collect()}[3] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_best_fit_and_bound(sizes):
    import numpy as np

    s = np.array(sorted(sizes, reverse=True))
    bins = packing.best_fit_decreasing(s, 30)
    fill = np.bincount(bins, s)
    assert fill.max() <= 30 and packing.lower_bound(s, 30) <= len(fill) <= 2 * packing.lower_bound(s, 30)
    for i in range(len(s)):  # always the fullest container with room
        before = np.bincount(bins[:i], s[:i], minlength=len(fill)) if i else np.zeros(len(fill))
        fits = [before[b] for b in range(len(fill)) if before[b] + s[i] <= 30 and (before[b] or b == max(bins[:i], default=-1) + 1)]
        assert before[bins[i]] == max(fits)


def test_bound_is_exact_where_items_are_large():
    import numpy as np

    assert packing.lower_bound(np.array([6, 6, 6, 4, 4, 4]), 10) == 3
    assert packing.lower_bound(np.array([7, 7, 7]), 10) == 3
    assert packing.lower_bound(np.array([], int), 10) == 0


@pytest.mark.parametrize("items", [5, 40, 1000])
def test_packing(spark, items):
    sizes = [(s, d, (d * 37) % 90 + (250 if d == 7 else 0)) for s in (1, 2) for d in range(100)]
    df = spark.createDataFrame([(s, d, n, 100) for s, d, n in sizes], "spec_id int, doc_id long, size long, capacity long")
    rows = packing.pack(df, items=items).collect()
    fill, got = {}, {}
    for r in rows:
        fill[r.spec_id, r.container] = fill.get((r.spec_id, r.container), 0) + r.size
        got[r.spec_id, r.doc_id] = got.get((r.spec_id, r.doc_id), 0) + r.size
    assert max(fill.values()) <= 100 and got == {(s, d): n for s, d, n in sizes if n}
    assert len({(r.spec_id, r.doc_id, r.part) for r in rows}) == len(rows)
    assert len(fill) <= (1.3 if items < 10 else 1.1) * sum(n for *_, n in sizes) / 100 + 2
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("low, high", [(26, 45), (15, 60), (1, 100)])
def test_no_partition_grows(spark, low, high, monkeypatch):
    """Sizes that leave gaps in nearly every container end early; no task ever holds many more than ``items``."""
    df = spark.range(3000).selectExpr("cast(1 as int) spec_id", "id doc_id", f"cast({low} + pmod(xxhash64(id), {high - low}) as long) size", "100L capacity")
    stages = {}
    rows = packing.pack(df, items=100).collect()
    for r in rows:
        stage, shard, _ = r.container.split("-")
        stages.setdefault((stage, shard), []).append(r.size)
    assert max(map(len, stages.values())) <= 200 and sum(map(len, stages.values())) == 3000
    got = packing.report(spark.createDataFrame(rows), df.select("spec_id", "capacity")).first()
    assert got.bound <= got.containers <= 1.15 * got.bound and got.items == 3000 and 0 <= got.unused < 0.2
