"""What a query stores, shuffles and works out: no more than its own part."""

import os

from pyspark.sql import functions as F

from corpusloom import corpus as C
from corpusloom.functions import ids


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_made_when_read(spark, tmp_path):
    """Sentences don't need the words; these are stored by sentence, once, and equal the tokens of the paragraphs."""
    docs = spark.createDataFrame([(0, "en", "s", "CHAPTER ONE\nA cat -- sat. Ran!\n\n...\n\n日本語。 \"Quite\" so - and on."), (1, "en", "s", "-.- a b-c .")], "doc_id long, lang string, source string, text string")
    c = C.build(docs, f"{tmp_path}/c")
    assert c.sentences.count() > 0 and not os.path.exists(f"{tmp_path}/c/words")
    own = c.tokens.drop("form_key")
    assert os.path.exists(f"{tmp_path}/c/words") and c.tokens is c.tokens
    assert "words" in spark.read.parquet(f"{tmp_path}/c/words").columns
    rows = {(r.doc_id, r.para_pos, r.g): (r.form, r.c, r.is_first, r.is_last) for r in own.where("doc_id = 1").collect()}
    assert rows == {(1, 0, 0): ("-", None, False, False), (1, 0, 1): ("a", 0, True, False), (1, 0, 2): ("b-c", 1, False, True), (1, 0, 3): (".", None, False, False)}  # "-." gives no word


def test_numbers_in_ids(spark):
    rows = spark.createDataFrame([(0,), (7,), (999,), (1000,), (12345,), (-4,)], "n int")
    assert [r.a for r in rows.select(ids.numbered("w_", F.col("n")).alias("a")).collect()] == ["w_000", "w_007", "w_999", "w_1000", "w_12345", "w_-04"]


def test_deps_without_a_join(spark):
    """Arcs, levels and swept heads of a long sentence, in time that grows with it, and with no shuffle where sentences are rows."""
    from corpusloom.operators import deps

    rng = __import__("random").Random(5)
    for n in (0, 1, 7, 40):
        spans = [tuple(sorted(rng.sample(range(12), 2))) for _ in range(n)]
        slow: dict = {}
        for a, b in sorted(set(spans), key=lambda s: s[1] - s[0]):
            slow[a, b] = 1 + max((v for (x, y), v in slow.items() if a <= x and y <= b), default=0)
        assert deps._levels(spans) == [slow[s] for s in spans]
    n = 20_000
    word = F.struct(F.col("id").cast("int").alias("word_pos"), ids.numbered("w_", F.col("id") + 1).alias("local_id"), F.lit(True).alias("head_present"), F.when(F.col("id") == 5, "w_x").when(F.col("id") > 0, ids.numbered("w_", F.floor(F.col("id") / 2) + 1)).alias("head"), F.lit("r").alias("dep_rel"))
    rows = spark.range(n).groupBy().agg(F.collect_list(word).alias("parsed")).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("para_pos"), F.lit(0).alias("sent_pos"), "parsed").cache()
    assert rows.count() == 1
    assert deps.levels(rows).count() == deps.arcs(rows).count() == n - 2  # no head: the root; a lost one: word 5
    assert deps.arcs(rows.select("doc_id", "para_pos", "sent_pos", F.explode("parsed").alias("w")).select("doc_id", "para_pos", "sent_pos", "w.*")).count() == deps.arc_levels(deps.arcs(rows)).count() == n - 2
    assert [r.word_pos for r in deps.swept_words(rows).where("swept").collect()] == [5]
    assert "Join" not in plan_of(deps.arcs(rows)) + plan_of(deps.swept_words(rows))


def test_dict_browse_is_whole(spark):
    """Entries of every brand are browsed, as in the query's first form."""
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{folder}/part.parquet").where(F.lower("p_name").contains("a") & F.col("p_type").isNotNull()).count()
    assert __spark_entry__.queries()["dict_browse"](spark, folder).count() == want > 0


def test_nested_in_row(spark):
    """The lines that segmented words give, without a shuffle."""
    from corpusloom.operators import ingest

    texts = ["CHAPTER ONE\nA cat sat. Ran!\n\n...\n\nPART TWO\n日本語。 \"Quite\" so.", "", None, "  \n\n ", "x", "CHAPTER ONE", "a\r\nb\n\n\n\n-- c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = ingest.nested_in_row(docs)
    want = ingest.to_nested(ingest.segment(ingest.detect_sections(docs)))
    assert sorted(map(tuple, row.collect())) == sorted(map(tuple, want.collect())) and "Aggregate" not in plan_of(row)


def test_upper_case_letter_by_letter(spark):
    """Letters whose upper case would be several, as DuckDB has them."""
    import duckdb
    from corpusloom.functions import text as T

    letters = [chr(i) for i in [*range(32, 0xD800), *range(0xF900, 0xFFFE)] if len(chr(i).upper()) > 1] + ["a", "ö"]
    want = [duckdb.execute("select upper(?)", [f"x{c}y"]).fetchone()[0] for c in letters]
    got = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(letters)], "i int, s string").select("i", T.upper_single(F.col("s")).alias("u")).orderBy("i")
    assert [r.u for r in got.collect()] == want


def test_lemma_search_moves_no_tokens(spark):
    """Lemmas and forms that a search finds go to the tokens in one pass, whatever the sizes of the tables they are chosen from."""
    from corpusloom.plans.pattern import compile_token
    from corpusloom.plans.search import search_lemma

    words = spark.range(4000).select((F.col("id") % 50).alias("doc_id"), F.lit(0).alias("para_pos"), F.lit(0).alias("sent_pos"), F.col("id").alias("word_pos"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("form_key"), F.concat(F.lit("l"), (F.col("id") % 5).cast("string")).alias("lemma_id"))
    names = spark.range(5).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("form"))
    entries = spark.range(7).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("form"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lemma_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables that lemmas and forms are chosen from were large
    try:
        hits = search_lemma(words, names, entries, compile_token("n1*", "text", False, False))
        assert sorted(w for r in hits.collect() for w in r.words) == [i for i in range(4000) if i % 5 == 1 or i % 7 == 1]
        assert plan_of(hits).count("Join LeftOuter") + plan_of(hits).count("Join Inner") == plan_of(hits).count("strategy=broadcast") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_words_are_counted_first(spark):
    """Links are looked up, and readings made, once for each different word."""
    import __spark_entry__

    q, folder = __spark_entry__.queries(), "/root/testdata/sf0.001"
    assert "Aggregate [dict_id" in plan_of(q["link_states"](spark, folder))
    assert plan_of(q["translit_readings"](spark, folder)).count("Aggregate [") == 2


def test_usual_text_is_told_in_one_pass(spark):
    """Text that needs no change is only stripped, and the rest becomes what it did; a token that starts with a letter of ASCII asks no pattern."""
    import re
    import unicodedata
    from corpusloom.functions import text as T

    odd = ["", " a ", "a\n\n\nb", "a\n\n\n\n\nb", "﻿a", "﻿﻿", "a﻿b", "a\r\nb\rc\n", "\r\r\r\rx", "é", "Ω", "x\x00\x1f\x7f\x85y", "’q–", " é ", "a\n\x01\n\nb", " a b", "日本語。", "a\tb", "\n\n", None]
    docs = spark.createDataFrame(list(enumerate(odd)), "i int, text string")

    def usual(s):
        s = re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "", re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", re.sub("^﻿+", "", s))))
        return re.sub(r"\n{3,}", "\n\n", s).strip(T.SPACES)

    rows = docs.select("i", T.normalize_text(F.col("text")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [None if s is None else usual(s) for s in odd]
    assert "CASE WHEN RLIKE(text" in plan_of(rows)
    forms = [c + tail for c in map(chr, [*range(33, 0x250), 0x300, 0x661, 0x3042, 0xFF21]) for tail in ("", "!", "z")]
    got = spark.createDataFrame(list(enumerate([*forms, "", None])), "i int, form string").select("i", T.is_punct(F.col("form")).alias("p"), F.coalesce("form", F.lit("")).rlike(r"^[^\p{L}\p{N}]+\z").alias("q")).collect()
    assert all(r.p == r.q for r in got)


def test_readings_are_made_once(spark):
    """A search in readings makes these once for each word, and a sentence's strings take one shuffle and no join."""
    import __spark_entry__

    q, folder = __spark_entry__.queries(), "/root/testdata/sf0.001"
    assert plan_of(q["search_translit"](spark, folder)).count("split(") == 1
    plan = plan_of(q["search_sentence_translit"](spark, folder))
    assert plan.count("split(") == 1 and plan.count("Aggregate [") == 1 and "Join" not in plan


def test_pushed_candidates_are_grouped_once(spark):
    """The candidates' first values are made once, for entries and new ones alike, and no candidate is joined with the lexicon before."""
    import __spark_entry__

    plan = plan_of(__spark_entry__.queries()["push_to_dict"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan


def test_windows_from_sentences(spark, tmp_path):
    """Lines from sentences with their words are those from tokens, and no token becomes a row for them but those of a window."""
    from corpusloom.operators import concord
    from corpusloom.plans.pattern import compile_glob
    from corpusloom.plans.search import matched_tokens

    long = " ".join(f"w{i} the, - x." if i % 9 == 4 else f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(0, "en", "s", f"the\n\n{long}. The end."), (1, "en", "s", "A the. The. " + "y " * 63 + "the z. " * 70)], "doc_id long, lang string, source string, text string")
    c = C.build(docs, f"{tmp_path}/c")
    nodes = concord.token_nodes(matched_tokens(c.tokens, compile_glob("the")))
    for context in (0, 3, 200):
        old, new = (concord.flat(concord.kwic(c.tokens, nodes, context, words=w)) for w in (None, c.words))
        assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect())) and new.count() > 100
    assert plan_of(new).count("posexplode(words") == 1 < plan_of(old).count("posexplode(words")


def test_strip_takes_any_outer_space(spark):
    """The end is left alone only where it is printable ASCII; lines and sentences of any script become what they were."""
    from corpusloom.functions import text as T

    odd = ["", " ", "a", " a", "a ", ".", " . ", "é", "é ", " é", "a ", "　a　", "\U0001f600", "\U0001f600 \t", "~\n", "\x0b!\x1f", "a\x7f ", "a\x85 ", "日本語。 ", None]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, s string").select("i", T.strip(F.col("s")).alias("t"), T.heading_places(F.array(F.concat(F.lit(" "), "s"), F.lit(" CHAPTER ONE\t"))).alias("h")).orderBy("i").collect()
    assert [r.t for r in got] == [None if s is None else s.strip(T.SPACES) for s in odd] and all(list(r.h) == [1] for r in got)
    rows = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    from corpusloom.operators import ingest

    assert "THEN regexp_replace(text" in plan_of(ingest.sections_in_row(rows))


def test_offers_sort_no_sentences(spark):
    """Offers of keys in corpus order, for any document's number, from a hash aggregate; keys are made once for each sentence."""
    import __spark_entry__
    from corpusloom.functions import keys
    from corpusloom.functions.text import WORD
    from corpusloom.operators import lexicon

    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(high, 0, 0, "k", "b"), (low, (1 << 31) - 1, (1 << 31) - 1, "k", "c"), (low + 1, 0, 0, "k", "a"), (3, 1, 0, "m", "a"), (3, 0, 9, "m", "b"), (2, 5, 1, "n", "a"), (2, 5, 0, "n", "b"), (9, 0, 0, "n", "a"), (1, 0, 0, "", "a"), (1, 0, 1, "n", " ")]
    found = lexicon.offers(spark.createDataFrame(rows, "doc_id long, para_pos int, sent_pos int, key string, value string"))
    assert sorted((r.key, r.rank, r.value, r.n) for r in found.collect()) == [("k", 1, "c", 1), ("k", 2, "a", 1), ("k", 3, "b", 1), ("m", 1, "b", 1), ("m", 2, "a", 1), ("n", 1, "a", 2), ("n", 2, "b", 1)]
    plan = __spark_entry__.queries()["sentence_offers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("regexp_extract_all") == 1
    texts = ["ΑΣ'Β ΣΑΣ. Σ", "I İ Iı, ÌÍĨ J̀", "ｶﾞｶ が x", "كِتاب ـ ـ آ", "שָׁלוֹם ", "क़ ", "-- ", "", None, "A-b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for fold in (keys.Fold(), *(keys.Fold(x) for x in ("tr", "lt")), *(keys.Fold(None, x) for x in ("Jpan", "Arab", "Hebr", "Deva", "Latn"))):
        each = F.array_join(F.transform(F.regexp_extract_all("s", F.lit(f"{WORD}+"), F.lit(0)), lambda w: keys.dict_key(w, fold)), " ")  # noqa: B023
        assert all(r.a == r.b for r in docs.select(each.alias("a"), keys.sent_key(F.col("s"), fold).alias("b")).collect()), fold


_DOCS = [(0, "en", "s", "CHAPTER ONE\nA cat -- sat. Ran, ran and ran to the old house!\n\n...\n\n日本語。 \"Quite\" so - and on."), (1, "en", "s", "-.- a b-c .\n\n" + "w " * 300), (2, "en", "s", None), (3, "en", "s", "x. x y. " * 9)]


def _small(spark, folder):
    """A corpus of a few documents in a folder, as queries open it."""
    spark.createDataFrame(_DOCS, "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return C.open_corpus(spark, folder)


def _rows(frame):
    return sorted(map(repr, frame.collect()))


def test_relations_of_counted_places(spark, tmp_path):
    """Sentences of one length are counted before ids are made; no word becomes a row, and words are not stored for it."""
    from corpusloom import queries as Q

    c, query = _small(spark, str(tmp_path)), Q.QUERIES["dep_relations"]
    found = query(spark, str(tmp_path))
    got = _rows(found)
    assert "words" not in vars(c) and plan_of(found).count("regexp_extract_all") == 1
    words = Q._parsed(c)
    want = words.groupBy(ids.dep_local_id(F.col("local_id")).alias("local"), ids.dep_rel_of(F.col("head_present"), F.col("head"), F.col("dep_rel")).alias("rel")).agg(F.count("*").alias("n"))
    assert "words" in vars(c) and got == _rows(want) == _rows(query(spark, str(tmp_path))) and len(got) == 300


def test_evidence_from_paragraphs(spark, tmp_path):
    """Lemmas of forms are counted over the paragraph's tokens, without words being stored; stored ones give the same."""
    from corpusloom import queries as Q
    from corpusloom.operators import lexicon

    c, query = _small(spark, str(tmp_path)), Q.QUERIES["lemma_evidence"]
    found = query(spark, str(tmp_path))
    got = _rows(found)
    assert "words" not in vars(c) and plan_of(found).count("regexp_extract_all") == 1
    assert got == _rows(lexicon.lemma_evidence(Q.annotated(c))) == _rows(query(spark, str(tmp_path))) and len(got) > 5
    own = ["doc_id", "para_pos", "g", "form", "is_punct", "form_key"]
    assert _rows(c.in_paragraphs().select(own)) == _rows(c.tokens.select(own))
    given = C.Corpus(c.documents, c.sentences, c.tokens)
    assert given.in_paragraphs().count() == c.tokens.count()


def test_parsed_without_a_shuffle(spark, tmp_path):
    """Whether sentences have a parse is told in their rows, for words, arrays of parses and parses by place alike."""
    from corpusloom import queries as Q
    from corpusloom.operators import deps

    c, query = _small(spark, str(tmp_path)), Q.QUERIES["dep_parsed"]
    found = query(spark, str(tmp_path))
    got = _rows(found)
    assert "words" not in vars(c) and "Aggregate" not in plan_of(found) and plan_of(found).count("regexp_extract_all") == 1
    assert got == _rows(deps.has_parse(Q._parsed(c))) == _rows(query(spark, str(tmp_path)))
    rows = [(i, 0, 0, p, h, r) for i, own in enumerate([[(None, None)], [(False, " "), (None, "r")], [(False, ""), (True, None)], [(False, None), (None, " ")]]) for p, (h, r) in enumerate(own)]
    words = spark.createDataFrame(rows, "doc_id long, para_pos int, sent_pos int, word_pos int, head_present boolean, dep_rel string")
    for frame in (words, deps.by_sentence(words)):
        assert [r.parsed for r in deps.has_parse(frame).orderBy("doc_id").collect()] == [False, True, True, False]


def test_latin_runs_end_no_sentence(spark):
    """Letters that a short class takes are none that end a sentence: each character between two words parts them as the whole class says."""
    from corpusloom.functions import text as T

    assert r"[\x{80}-\x{2FF}]++" in T.INNER
    chars = [chr(i) for i in [*range(1, 0x300), 0x589, 0x61F, 0x3002, 0xFF01, 0x1F600]]
    docs = spark.createDataFrame([(i, f"aé{c}ß b1{c}2{c} ÿ{c}") for i, c in enumerate(chars)], "i int, s string")
    whole = T.SENTENCE.replace(T.INNER, rf"[^\n{T.TERMINALS}]*+")
    rows = docs.select(T.split_sentences(F.col("s")).alias("a"), F.filter(F.transform(F.regexp_extract_all("s", F.lit(whole), F.lit(0)), lambda s: F.trim(s, F.lit(T.SPACES))), lambda s: s != "").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({len(r.a) for r in rows}) > 1


def test_index_shuffles_text_alone(spark, tmp_path):
    """The index of a corpus comes from its paragraphs, without words being stored; rows of tokens and of morphemes give the same."""
    from corpusloom import queries as Q
    from corpusloom.plans.index import build_index

    docs = [(r.doc_id, r.lang, r.source, r.text) for r in spark.createDataFrame(_DOCS, "doc_id long, lang string, source string, text string").collect()]
    docs += [(300, "en", "s", "abcdabcd abcd-abcd. abcdefghi ab-cd- -x"), (-1, "en", "s", "The abcd, the abcdefgh")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/d/documents.parquet")
    c = C.open_corpus(spark, f"{tmp_path}/d")
    found = Q.QUERIES["form_postings"](spark, f"{tmp_path}/d")
    assert "words" not in vars(c)
    got = _rows(found)
    morphemes = Q._read_words(c).select("doc_id", "para_pos", "sent_pos", "word_pos", F.explode("morphemes.form").alias("form"))
    one = F.concat_ws(".", F.col("doc_id") - F.floor(F.col("doc_id") / 256) * 256, "para_pos", "sent_pos", "word_pos")
    place = F.struct("doc_id", "para_pos", "sent_pos", "word_pos", one.alias("text"))
    uses = c.tokens.select(F.lit("word").alias("kind"), "form", place.alias("p"), "doc_id").unionByName(morphemes.select(F.lit("morpheme").alias("kind"), "form", place.alias("p"), "doc_id"))
    want = uses.groupBy("kind", F.lower("form").alias("form_key"), "form", F.floor(F.col("doc_id") / 256).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], " ").alias("places"))
    assert got == _rows(want) and any(r.kind == "morpheme" and r.form == "abcd" and r.block == 1 and r.places.startswith("44.0.0.0 44.0.0.0 ") for r in found.collect())
    given = build_index(c.tokens, f"{tmp_path}/i", c.fold, morphemes)
    assert got == _rows(given.lists.select(*found.columns[:-1], F.col("uses").alias("places")))
    assert _rows(given.lists.select("kind", "form", "block", F.size("places").cast("long").alias("n"))) == _rows(given.lists.select("kind", "form", "block", "n"))


def test_index_hits_take_one_shuffle(spark, tmp_path):
    """Words of a sentence's hits are told apart where they are collected."""
    from corpusloom import queries as Q

    _small(spark, str(tmp_path))
    assert plan_of(Q.QUERIES["index_exact"](spark, str(tmp_path))).count("Aggregate [") == 1


def test_copies_of_words_by_place(spark, tmp_path):
    """Sentences without an earlier one have no key to be joined by, and no word waits in an array; heads go where both words have a partner."""
    from corpusloom import queries as Q
    from corpusloom.operators import edits

    docs = [(0, "en", "s", "One two three. A, b c d e f. Lone."), (1, "en", "s", "One TWO three. A, b c d e f. A b: c d e f."), (2, "en", "s", "- one two three!")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.QUERIES["sentence_copy"](spark, str(tmp_path))
    plan = plan_of(found)
    assert plan.count("Join LeftAnti") == 1 and plan.count("Join LeftOuter") == 1 and "partners" not in plan
    c = C.open_corpus(spark, str(tmp_path))
    tok = c.tokens.select(C.word_id().alias("word_id"), C.word_id(True).alias("sent_id"), "is_punct", "word_pos", "form_key").cache()
    twins = Q._twins(c, "left").cache()
    assert found.count() == tok.count() == twins.count()
    side = lambda u: tok.select(F.col("sent_id").alias(u), F.col("word_id").alias(f"{u}_word"), "word_pos", "form_key")
    aligned = twins.where("source is not null").select("source", "target").distinct().join(side("source"), "source").join(side("target"), ["target", "word_pos", "form_key"])
    words = tok.join(twins.select("target_of.*"), "word_id")
    want = edits.sentence_copy_plan(words, aligned)
    assert _rows(Q.QUERIES["sentence_copy_plan"](spark, str(tmp_path))) == _rows(want) and want.where("field = 'head' and state <> 'nothing'").count() > 1
    given = edits.apply_sentence_copy(words, want, Q.prov.Clock("2026-09-24", "10:00:00"))
    fields = ["word_id", "gloss", "part_of_speech", "lemma_id", "head", "dep_rel"]
    assert _rows(found.select(fields)) == _rows(given.select(fields))


def test_sentence_strings_shuffle_text(spark, tmp_path):
    """Readings go to their sentences without being shuffled; words are not stored for it, and stored or given ones give the same."""
    from corpusloom import queries as Q

    c, query = _small(spark, str(tmp_path)), Q.QUERIES["search_sentence_translit"]
    found = query(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id") == 1 and "words" not in vars(c)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    own = ["doc_id", "para_pos", "sent_pos", "word_pos", "g", "c", "form", "form_key", "is_punct"]
    assert _rows(c.tokens_by_paragraph().select(own)) == _rows(c.tokens.select(own))
    given = C.Corpus(c.documents, c.sentences, c.tokens)
    assert given.tokens_by_paragraph() is given.tokens
