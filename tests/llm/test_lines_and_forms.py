from collections import Counter, defaultdict

import pytest

from mentionloom.llm import canonical, residue, site_lines

ART = "article_id long, source_domain string, title string, text string, date_publish string, source string, line string"


def art(spark, rows):
    return spark.createDataFrame([(*r, "2020-01-01", "x", "y") for r in rows], ART)


def test_repeated_lines_match_brute_force(spark):
    rows = [(i, "a" if i % 3 else None, None, f"Body {chr(97 + i)} of it.\n  SHARE   {i} times \n\nsame body\nShare 5 times" if i % 2 else f"only {chr(97 + i)}") for i in range(20)]
    rows += [(30, "a", None, None), (31, "a", None, ""), (32, "b", None, " \n "), rows[1], rows[3]]
    df = art(spark, rows)
    got = {(r.article_id, r.line_no) for r in site_lines.occurrences(df).collect()}
    form = lambda x: " ".join("".join("0" if c.isdigit() else c for c in x).replace("00", "0").lower().split())
    docs, where = defaultdict(set), defaultdict(set)
    for i, s, _, t in rows:
        docs[s].add(i)
        for x in (t or "").split("\n"):
            where[s, form(x)].add(i)
    want = set()
    for i, s, _, t in rows:
        for no, x in enumerate((t or "").split("\n")):
            if form(x) and len(where[s, form(x)]) >= 4 and len(where[s, form(x)]) >= 0.02 * len(docs[s]):
                want.add((i, no))
    assert got == want and want
    clean = {r.article_id: r for r in site_lines.without_repeated_lines(df).collect()}
    assert len(clean) == len({r[0] for r in rows}) and clean[1].removed == 3 and clean[1].text == "Body b of it.\n"
    assert site_lines.occurrences(df.limit(0)).count() == 0


def test_a_republished_article_is_no_boilerplate(spark):
    story = "A story with a body\nof two lines"
    rows = [(i, "a", None, story, f"2020-01-0{i % 3 + 1}", "x", "y") for i in range(6)]
    rows += [(10 + i, "a", None, f"Other {chr(97 + i)} text\nShare this", f"2020-02-0{i + 1}" if i else None, "x", "y") for i in range(6)]
    df = spark.createDataFrame(rows, ART)
    assert {(r.article_id, r.line_no) for r in site_lines.occurrences(df).collect()} == {(i, n) for i in range(6) for n in (0, 1)} | {(10 + i, 1) for i in range(6)}
    limits = {"min_clusters": 4, "min_dates": 2}
    assert {(r.article_id, r.line_no) for r in site_lines.occurrences(df, **limits).collect()} == {(10 + i, 1) for i in range(6)}
    clean = {r.article_id: r.text for r in site_lines.without_repeated_lines(df, **limits).collect()}
    assert clean[0] == story and clean[10] == "Other a text"


def test_a_republished_article_is_one_cluster(spark):
    s = site_lines.line_statistics(art(spark, [(i, "a", None, "one line") for i in range(6)])).first()
    assert (s.n_articles, s.n_clusters, s.n_dates, s.source_articles) == (6, 1, 1, 6)


@pytest.mark.parametrize(
    ("token", "form"),
    [("Ｋｅｌｎｔ", "Kelnt"), ("\U0001d5f9\U0001d5ee", "la"), ("саnta", "canta"), ("Cоюз", "Союз"), ("niev­e", "nieve"), ("soberanía", "soberanía"), ("ﬁeld", "field"), ("Βrimοnd", "Brimond")],
)
def test_table_forms(token, form):
    assert canonical.is_dirty(token) and canonical.by_table(token) == form


@pytest.mark.parametrize("token", ["plain", "Añorel", "союз", "naïve", "学校", "สวัสดี", "हिन्दी", "été"])
def test_clean_tokens(token):
    assert not canonical.is_dirty(token) and not canonical.is_suspect(f"“{token}” … –")


def test_trie_prefers_known_spellings():
    t = canonical.Trie()
    for w, n in (("maß", 5), ("mass", 9), ("mars", 50), ("tree", 1), ("trее", 1)):
        t.add(w, n)
    assert t.best("m​ass") == "mass" and t.best("mаss") == "mass"
    assert t.best("mask") is None and t.best("mask", 1) == "mass" and t.best("maas", 1) == "mars"  # as near as mass, but more frequent
    assert t.best("") is None


def test_disguised_fields(spark):
    rows = [(1, "s", "Plain", "The cat sat."), (2, "s", "Ｔｈｅ cat", "ok"), (3, "s", None, "the cat"), (4, "s", "", None), (5, "s", "cаt", "c​at"), (5, "s", "cаt", "c​at"), (6, "s", "кот", "“ok” – …�"), (7, "s", "Яhoo", "x\u0301")]
    df = art(spark, rows)
    assert {tuple(r) for r in canonical.disguised_fields(df).collect()} == {(2, "title"), (3, "text"), (5, "title"), (5, "text"), (7, "title"), (7, "text")}
    got = {(r.article_id, r.field): r.value for r in canonical.canonical_fields(df).collect()}
    assert got[2, "title"] == "The cat" and got[3, "text"] == "the cat" and got[5, "title"] == got[5, "text"] == "cat" and got[4, "title"] == "" and (4, "text") not in got
    assert canonical.disguised_fields(df.limit(0)).count() == 0


def test_the_trace_says_what_was_not_plain():
    kinds = lambda t: set(canonical.units(t)[1])
    assert kinds("plain") == kinds("Añorel") == kinds("союз") == set()
    assert kinds("Ｋｅｌｎｔ") == {canonical.STYLE} and kinds("x\u0301") == {canonical.ACCENT} and kinds("c\u200bat") == {canonical.IGNORABLE}
    assert kinds("cаt") == {canonical.LOOK_ALIKE} and kinds("Яhoo") == {canonical.FOREIGN}
    assert "".join(c for c, _ in canonical.units("cafe\u0301")[0]) == "café" and "".join(c for c, _ in canonical.units("ﬁｅ")[0]) == "fie"
    assert canonical.by_table("союhь") == "союhь"  # a Latin h is no Cyrillic н


def test_without_the_automaton_nothing_is_a_case(spark, monkeypatch):
    df = art(spark, [(1, "s", "Ｔｈｅ cat", "ok"), (2, "s", "cаt", None), (3, "s", "the cat", None)])
    assert canonical.disguised_fields(df).count() == 2
    scanned = canonical.scan(df, "article_id", ("title", "text"))
    plain = scanned.withColumn("token", canonical.F.when(scanned["n"].isNotNull(), scanned["token"]))
    assert canonical.token_forms(plain).count() == 0


def test_a_foreign_letter_may_stand_for_one_of_a_known_spelling(spark):
    rows = [(i, "s", "the Kandor river", None) for i in range(3)] + [(8, "s", "the Kaſdor", "KanЖor Жandor"), (9, "s", "the Жrvld", None)]
    df = art(spark, rows)
    scanned = canonical.scan(df, "article_id", ("title", "text"))
    got = {r.token: (r.canonical, r.in_vocabulary) for r in canonical.token_forms(scanned, 5).collect()}
    assert got["KanЖor"] == ("Kandor", True) and got["Жandor"] == ("Kandor", True) and got["Жrvld"] == ("Жrvld", False)
    assert got == {r.token: (r.canonical, r.in_vocabulary) for r in canonical.token_forms(scanned, 1).collect()}
    assert {(8, "text"), (9, "title")} <= {tuple(r) for r in canonical.disguised_fields(df).collect()}


def test_residue(spark):
    news = "The council met on Monday and agreed the plan.\nThe mayor said that the bridge would open soon."
    rows = [
        (1, "a", None, "404 Not Found\nThe page you asked for may have moved or no longer exists. Request ID: 3f650560"),
        (2, "a", None, "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.\nCode 8356."),
        (3, "a", None, "The council met on Monday.\nYour summary here. Test test test. Headline goes here."),
        (4, "a", None, news + " He met {{ author.name }} there."),
        (5, "a", None, "blah blah blah blah blah blah"),
        (6, "a", None, news + "\nThe page said “404 Not Found” for hours, residents told the paper."),
        (7, "a", None, news + " The letter opened with “Dear {{name}}” again. The set {2, 4, 8} was drawn [sic]."),
        (8, "a", None, None), (9, "a", None, ""), (10, None, None, "Access denied"), (10, None, None, "Access denied"),
        (11, "a", None, "Lorem ipsum quorum pelum mapis ligna. Ut arcanis fugia in velunt."),
        (12, "a", None, news),
    ]
    df = art(spark, rows)
    assert sorted(r.article_id for r in residue.residue(df).collect()) == [1, 2, 3, 4, 5, 10, 11]
    assert residue.residue(df.limit(0)).count() == 0


def test_page_lines_do_not_hide_residue(spark):
    page = "This material may not be copied without written leave of the publisher."
    rows = [(i, "a", None, f"Story {'xyzw'[i % 4]} tells of a long day at the port for everyone.\n{page}") for i in range(30)] + [(99, "a", None, f"502 Bad Gateway\n{page}")]
    assert [r.article_id for r in residue.residue(art(spark, rows)).collect()] == [99]


def test_the_same_error_page_in_many_articles_is_residue(spark):
    story = "Story {} tells of a long day at the port for everyone."
    rows = [(i, "a", None, story.format("xyzw"[i % 4])) for i in range(30)]
    rows += [(50 + i, "a", None, "503 Service Unavailable\nThe server could not complete your request.") for i in range(6)]
    rows += [(70, "b", None, story.format("x") + "\n" + "The page said “404 Not Found” for hours, residents told the paper.")]
    rows += [(80, "c", None, "He met the mayor on Monday and agreed.\n502 Bad Gateway")] * 5
    assert sorted(r.article_id for r in residue.residue(art(spark, rows)).collect()) == [*range(50, 56), 80]


@pytest.mark.parametrize("before", ['He said "hello" to ', "„Hallo“ sagte der Mann, ", "»Hallo« sagte er ", "« Oui », dit ", "“Yes,” said ", "fin de citation » dit ", 'A 6" pipe for '])
def test_placeholders_after_a_quotation_are_unfilled(before):
    assert residue.has_placeholder(before + "{{name}} there.")


@pytest.mark.parametrize("before", ['He said "hello" and "dear ', "„Liebe ", "»Liebe ", "« Oui », puis « ", "“Yes,” said “", "学校说“", "“" + "so " * 100])
def test_placeholders_inside_a_quotation_are_quoted(before):
    assert not residue.has_placeholder(before + "{{name}} there.")


def test_counter_of_lines_keeps_whole_numbers():
    from mentionloom.llm.frames import frame

    big = (1 << 62) + 1
    f = frame([("a", big), (None, None)], ["x", "n"], {"n"})
    assert f["n"].tolist()[0] == big and Counter(f["x"].isna()) == {False: 1, True: 1}
    assert len(frame([], ["x", "n"], {"n"})) == 0


def test_whatever_is_residue_is_a_candidate():
    """The prefilter against the decision, over mixtures of exemplars, filler and news."""
    import random

    rng = random.Random(9)
    parts = [e.lstrip("~") for block in residue.EXEMPLARS.values() for e in block.strip().replace("\n", "|").split("|")]
    words = sorted(residue.FILLER_WORDS) + "the mayor said bridge opened council error page".split()
    for n in range(1500):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            w = " ".join(rng.sample(parts, rng.randrange(1, 3))).split() if rng.random() < 0.6 else rng.choices(words, k=rng.randrange(2, 9))
            lines.append(" ".join(x for x in w if rng.random() < 0.85))
        text = "\n".join(lines)
        idf = {t: rng.random() * 9 for t in residue.index()[1]}
        if residue.is_residue(text, set(), idf, 9.0):
            assert residue.is_candidate(text, residue.terms(text)), text
