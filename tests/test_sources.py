import json

from mentionloom.sources import readers, writers


def test_articles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "authors": ["x"], "unknown": 1}))
    (tmp_path / "b.json").write_text('{"title": ')
    (tmp_path / "c.txt").write_text("no article")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.news_articles(spark, str(tmp_path), {"title": "headline"}).collect()}
    assert got["a.json"].headline == "T" and got["a.json"].authors == ["x"] and got["b.json"].corrupt and set(got) == {"a.json", "b.json"}


def test_gold_mentions(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"mention_id": "1", "tokens_number": [1, 2], "score": -1.0}, {"mention_id": "2"}]))
    assert {(r.mention_id, r.score) for r in readers.gold_mentions(spark, str(tmp_path)).collect()} == {("1", -1.0), ("2", None)}


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",person,group\nperson,1,0\ngroup,0.5,2\n")
    r = readers.comparison_table(spark, str(tmp_path / "t.csv"), "m", "s").collect()
    assert {(x.type_a, x.type_b, x.value) for x in r} == {("person", "person", 1.0), ("person", "group", 0.0), ("group", "person", 0.5), ("group", "group", 2.0)}
    (tmp_path / "v.txt").write_text("cat 1 2\ndog 3 4\nbad 1\n")
    assert {x.word: x.vec for x in readers.word_vectors(spark, str(tmp_path / "v.txt"), 2).collect()} == {"cat": [1.0, 2.0], "dog": [3.0, 4.0]}
    (tmp_path / "s.csv").write_text("topic,file,sentence\n1,a,3\n1,a,1\n1,a,3\n")
    assert readers.selected_sentences(spark, str(tmp_path / "s.csv")).first().sentences == [1, 3]


def test_tokens_and_spans(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('d\t0\t0\tHe"\t-\nd\t0\t1\tsaid\tc1\n\nd\t1\t0\tso\t-\n')
    assert [r.chain for r in readers.tagged_tokens(spark, str(tmp_path / "x.tsv")).orderBy("sent_id", "tok_id").collect()] == [None, "c1", None]
    tags = "O B-P I-P B-P O I-L I-L B-L".split()
    df = spark.createDataFrame([("d", i, t, f"w{i}") for i, t in enumerate(tags)], "d string, i int, t string, w string")
    got = {(r.first_tok, r.last_tok, r.kind, r.text) for r in readers.bio_spans(df, ["d"], "i", "t", "w").collect()}
    assert got == {(1, 2, "P", "w1 w2"), (3, 3, "P", "w3"), (5, 6, "L", "w5 w6"), (7, 7, "L", "w7")}


def test_outline_and_codes(spark):
    lines = ["1. House", "1.1. First", "body", "1.2. Second", "2. Other"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "d string, n int, l string")
    assert [(r.section, r.item, r.head) for r in readers.outline(df, "d", "n", "l").orderBy("line_no").collect()] == [(1, 0, True), (1, 1, True), (1, 1, False), (1, 2, True), (2, 2, True)]
    c = spark.createDataFrame([("d", "Name´ ", "s", None, 1, 2)], "Document_name string, Code string, Segment string, Comment string, Beginning int, End int")
    assert readers.coding_columns(c).first()[1:] == ("Name", "s", "", 0, 1)


def test_marked_up(spark, tmp_path):
    (tmp_path / "d.xml").write_text("""<Document doc_name="d1"><token t_id="1" sentence="0" number="0">Ann</token><token t_id="2" sentence="0" number="1">ran</token>
<Markables><MENTION m_id="7" type="HUM"><token_anchor t_id="1"/></MENTION><MENTION m_id="8" type="ACT"><token_anchor t_id="2"/></MENTION></Markables>
<Relations><COREF r_id="3" note="ann_1"><source m_id="7"/><target m_id="9"/></COREF></Relations></Document>""")
    got = {r.m_id: (r.chain, r.text, r.tok_ids) for r in readers.marked_up(spark, str(tmp_path / "d.xml")).collect()}
    assert got == {7: ("ann_1", "Ann", [0]), 8: ("single_d1_8", "ran", [1])}


def test_srl(spark, tmp_path):
    cells = [("-", ["(A0*", "*"]), ("-", ["*)", "(A0*)"]), ("run", ["(V*)", "*"]), ("stop", ["*", "(V*)"])]
    df = spark.createDataFrame([("d", 0, i, p, c) for i, (p, c) in enumerate(cells)], "doc_id string, sent_id int, tok_id int, predicate string, columns array<string>")
    got = {(r.predicate, r.role, r.first_tok, r.last_tok) for r in readers.srl_columns(df).collect()}
    assert got == {("run", "A0", 0, 1), ("run", "V", 2, 2), ("stop", "A0", 1, 1), ("stop", "V", 3, 3)}


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([("d", 0, 1, 3, 1, "x", "t", "m1", "a b"), ("d", 0, 1, 1, 2, "y", "t", "m2", "b"), ("d", 0, 3, 4, 2, "y", "t", "m3", "c")],
                              "doc_id string, sent_id int, first_tok int, last_tok int, chain_no int, chain string, topic_id string, mention_id string, text string")
    tags = {r.tok_id: r.tag for r in writers.span_brackets(m).collect()}
    assert tags == {1: "(2)|(1", 3: "1)|(2", 4: "2)"}
    path = writers.save_stage(m, str(tmp_path), "read")
    assert spark.read.parquet(path).count() == 3
    assert json.loads(writers.entity_json(m, "chain").where("chain = 'y'").first().json)["size"] == 2
    writers.write_csv({"one": m}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/one")).count() == 3
    assert readers.listing(spark, str(tmp_path / "csv")).count() >= 1
