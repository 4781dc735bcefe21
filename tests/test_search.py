"""Search and concordance over a small corpus of our own, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom import corpus as C
from corpusloom.operators import concord
from corpusloom.plans.pattern import QueryError, compile_glob, compile_token
from corpusloom.plans.search import Search, matched_tokens, search, sequence_plan, search_sequence

TEXT = "The cat sat. The dog, it sat too! Cats run\n\nA cat: the end. It's over."


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(0, TEXT, "en", "s0"), (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "İkna ışık IŞIK", "tr", "s1")], "doc_id long, text string, lang string, source string")
    paras = C.segmented(C.paragraphs(docs)).cache()
    return C.Corpus(docs, C.sentences(paras), C.tokens(paras).cache(), paragraphs=paras)


def hits(frame):
    return sorted((r.doc_id, r.para_pos, r.sent_pos, list(r.words)) for r in frame.collect())


def test_token_search(small):
    assert hits(search(small, Search("the"))) == [(0, 0, 0, [0]), (0, 0, 1, [0]), (0, 1, 0, [3])]
    assert hits(search(small, Search("cat(s)"))) == [(0, 0, 0, [1]), (0, 0, 2, [0]), (0, 1, 0, [1])]
    assert hits(search(small, Search("*at"))) == [(0, 0, 0, [1, 2]), (0, 0, 1, [4]), (0, 1, 0, [1])]
    assert hits(search(small, Search("The", sensitive=True))) == [(0, 0, 0, [0]), (0, 0, 1, [0])]
    assert hits(search(small, Search("^t", regex=True, cap=1))) == [(0, 0, 0, [0])]
    assert search(small, Search("   ")) is None
    with pytest.raises(QueryError):
        search(small, Search("a <BREAK><BREAK> b"))


def test_dotted_letters_stay_apart(small):
    raw = lambda q: small.tokens.where(compile_token(q, "gloss").matches(F.col("form"))).count()
    assert raw("ikna") == 0 and raw("İkna") == 1 and raw("ışık") == 1


def places(frame):
    return sorted((r.para_pos, r.sent_pos, r.last_sent, list(r.gs)) for r in frame.collect())


def test_sequences(small):
    assert places(search(small, Search("dog it"))) == [(0, 1, 1, [5, 7])]  # the comma doesn't count
    assert places(search(small, Search("sat the"))) == []
    assert places(search(small, Search("sat the", cross=True))) == [(0, 0, 1, [2, 4])]
    assert places(search(small, Search("sat <BREAK> the"))) == [(0, 0, 1, [2, 4])]
    assert places(search(small, Search("too <BREAK> run"))) == []  # not the first of its sentence
    assert places(search(small, Search("<BREAK> cats run <BREAK>"))) == [(0, 2, 2, [11, 12])]
    assert places(search(small, Search("run a", cross=True))) == []  # paragraphs aren't crossed


def test_sentences(small):
    got = search(small, Search("the end", level="sentence")).collect()
    assert [(r.para_pos, r.sent_pos, r.matched) for r in got] == [(1, 0, "A cat the end")]
    got = search(small, Search("sat the dog", level="sentence", cross=True)).collect()
    assert [(r.sent_pos, r.next_pos) for r in got] == [(0, 1)]
    got = search(small, Search("sat <BREAK> run", level="sentence")).collect()
    assert [(r.sent_pos, r.next_pos) for r in got] == [(1, 2)]
    with pytest.raises(QueryError):
        search(small, Search("a <BREAK> b <BREAK> c", level="sentence"))


def test_kwic(small):
    nodes = concord.token_nodes(matched_tokens(small.tokens, compile_glob("sat")))
    lines = sorted((r.g_start, r["left"], r.node, r["right"], r.crosses) for r in concord.flat(concord.kwic(small.tokens, nodes, 2)).collect())
    assert lines == [(2, "The cat", "sat", ". The", True), (8, ", it", "sat", "too !", False)]
    full = concord.flat(concord.kwic(small.tokens, nodes, full=True)).where("g_start = 8").collect()[0]
    assert full["left"] == "The cat sat . The dog , it" and full["right"] == "too ! Cats run"
    slots, breaks = sequence_plan(Search("dog it"), small)
    two = concord.kwic(small.tokens, concord.sequence_nodes(search_sequence(small.tokens, slots, breaks=breaks)), 1)
    assert [(r.node, r["left"], r["right"]) for r in concord.flat(two).orderBy("g_start").collect()] == [("dog", "The", ","), ("it", ",", "sat")]  # the comma parts the runs


def test_frequency_and_order(small):
    nodes = concord.token_nodes(matched_tokens(small.tokens, compile_glob("the")))
    lines = concord.kwic(small.tokens, nodes, 2)
    assert [(r.key, r.form, r["count"]) for r in concord.ranked(concord.freq_types(lines)).collect()] == [("the", "The", 3)]
    assert [r.key for r in concord.sort_kwic(lines, "R1").collect()] == ["cat", "dog", "end"]
    assert [r.key for r in concord.sort_kwic(lines, "R1", descending=True).collect()] == ["end", "dog", "cat"]
    assert [r.key for r in concord.sort_kwic(lines, "L2").collect()] == ["", "cat", "sat"]
    assert {r.key for r in concord.sort_kwic(lines, "X9").collect()} == {""}
    assert concord.node_count(nodes).collect()[0].nodes == 3 and concord.freq_total(lines).collect()[0].total == 3


def test_collocates(small):
    nodes = concord.token_nodes(matched_tokens(small.tokens, compile_glob("sat")))
    got = {r.key: (r.form, r["count"], r["left"], r["right"]) for r in concord.collocates(small.tokens, nodes, 2).collect()}
    assert got == {"the": ("The", 2, 1, 1), "cat": ("cat", 1, 1, 0), "it": ("it", 1, 1, 0), "too": ("too", 1, 0, 1)}


def test_invariants(small):
    """A form finds itself; wildcards and case-blindness only add; a glob equals its anchored pattern; words are in their sentences."""
    forms = [r.form for r in small.tokens.where(~F.col("is_punct")).select("form").distinct().collect()]
    for f in forms:
        if any(c in f for c in "İı"):
            continue
        exact = set(map(str, hits(search(small, Search(f)))))
        assert exact
        words = lambda s: {(h[0], h[1], h[2], w) for h in hits(search(small, s)) for w in h[3]}
        assert words(Search(f)) <= words(Search(f"*{f}*"))
        assert words(Search(f, sensitive=True)) <= words(Search(f))
        if f.isalpha():
            assert words(Search(f"^{f}$", regex=True)) == words(Search(f))
        inside = {(r.doc_id, r.para_pos, r.sent_pos) for r in search(small, Search(f"*{f}*", level="sentence")).collect()}
        assert {w[:3] for w in words(Search(f))} <= inside


def test_equality_reaches_the_scan(small, tmp_path):
    small.tokens.write.parquet(f"{tmp_path}/t")
    stored = small.tokens.sparkSession.read.parquet(f"{tmp_path}/t")
    plan = lambda q: stored.where(compile_glob(q).matches(F.col("form"), F.col("form_key"))).select("g")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(form_key,the)" in plan("The") or "In(form_key" in plan("The")
    assert "StringStartsWith(form_key,th)" in plan("th*")


def test_sections_and_places_of_the_corpus(spark):
    """Headings cut sections, blank lines paragraphs; wrapped lines are one sentence; places follow from the row."""
    text = "Chapter 1\nA line that\nwraps here. And, so\non.\n\nNext one.\nChapter 2\n\nChapter 3\nThe last"
    docs = spark.createDataFrame([(0, text, "en", "s"), (1, "Chapter 4", "en", "s"), (2, "日本語。", "ja", "s")], "doc_id long, text string, lang string, source string")
    paras = C.segmented(C.paragraphs(docs))
    got = sorted((r.doc_id, r.sect_pos, r.title, r.sect_para, r.para_pos, r.sents) for r in paras.collect())
    assert got == [(0, 0, "Chapter 1", 0, 0, ["A line that wraps here.", "And, so on."]), (0, 0, "Chapter 1", 1, 1, ["Next one."]), (0, 1, "Chapter 3", 0, 2, ["The last"]), (1, 0, None, 0, 0, ["Chapter 4"]), (2, 0, None, 0, 0, ["日本語。"])]
    rows = {(r.doc_id, r.para_pos, r.g): r for r in C.tokens(paras).collect()}
    assert [rows[0, 0, g].form for g in range(10)] == ["A", "line", "that", "wraps", "here", ".", "And", ",", "so", "on"] and (2, 0, 0) not in rows
    assert [rows[0, 0, g].c for g in range(10)] == [0, 1, 2, 3, 4, None, 5, None, 6, 7]
    assert [g for g in range(11) if rows[0, 0, g].is_first] == [0, 6] and [g for g in range(11) if rows[0, 0, g].is_last] == [4, 9]
    assert C.tokens(paras).where("form = 'last'").select(C.word_id().alias("i")).first().i == "doc_001.sec_002.p_001.s_001.w_002"
    labels = {(r.doc_id, r.para_pos): (r.document, r.section) for r in concord.titles(paras, spark.createDataFrame([(1, "My text"), (0, "")], "doc_id long, title string")).collect()}
    assert labels[0, 2] == ("Document 1", "Chapter 3") and labels[1, 0] == ("My text", "Section 1") and labels[2, 0] == ("Document 3", "Section 1")


def test_fold_of_a_corpus(spark):
    schema = "doc_id long, text string, lang string, source string"
    fold = lambda rows: C.derive_fold(spark.createDataFrame(rows, schema))
    assert fold([(0, "", "en", "s"), (1, "ışık", "tr-TR", "s"), (2, None, None, "s")]).locale == "tr"
    assert fold([(0, "a b", "en", "s"), (1, "ışık", "tr", "s")]).locale is None
    assert fold([(0, "カナ", "ja", "s")]).script == "Jpan" and fold([(0, "שלום", "he", "s")]).script == "Hebr"
    assert fold([]).script is None
