"""Alignment, copies between sentences, stamps, gaps and the form index, with results worked out by hand or by brute force."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from corpusloom import corpus as C
from corpusloom.operators import edits, prov, quality
from corpusloom.plans.index import build_index, matching_forms, pattern_grams, search_index
from corpusloom.plans.pattern import compile_token
from corpusloom.plans.search import search_token

CLOCK = prov.Clock("2026-09-24", "10:00:00")


def common(a, b):
    """Leftmost pairs of a longest common subsequence, from the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


@pytest.mark.parametrize("seed", range(40))
def test_alignment_by_brute_force(seed):
    r = random.Random(seed)
    a, b = (["".join(r.choice("abA") for _ in range(r.randint(1, 2))) for _ in range(r.randint(0, 14))] for _ in range(2))
    assert edits._common(a, b) == list(common(a, b))
    found = edits.align(a, b)
    assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
    assert all(a[i].lower() == b[j].lower() for i, j in found) and set(common(a, b)) <= set(found)


def test_alignment_of_long_sequences():
    r = random.Random(1)
    a = [f"w{r.randint(0, 3000)}" for _ in range(20_000)]
    b = [x for x in a if r.random() > 0.1]
    b[5_000:5_000] = [f"v{i}" for i in range(2_000)]
    tracemalloc.start()
    found = edits.align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(b) - 2_000 and most < 200e6


# Two sentences of five words: the second one is to get the first one's annotation.
WORDS = [
    ("s1.w1", "s1", "Cold", False, "cold", "ADJ", "l1", "s1.w2", "amod"), ("s1.w2", "s1", "water", False, None, "NOUN", "l2", "s1.w5", "nsubj"), ("s1.w3", "s1", "and", False, "LNK", "PART", "l3", "s1.w9", "cc"),
    ("s1.w4", "s1", ",", True, "x", "PUNCT", None, None, None), ("s1.w5", "s1", "Hasan", False, "H", "PROPN", None, None, "root"),
    ("s2.t1", "s2", "cold", False, None, " ", None, None, None), ("s2.t2", "s2", "water", False, None, None, None, None, None), ("s2.t3", "s2", "and", False, "and", None, None, None, "old"),
    ("s2.t4", "s2", ",", True, None, None, None, None, None), ("s2.t5", "s2", "Hasan", False, "H", "PROPN", None, None, None), ("s3.u1", "s3", "other", False, None, None, None, None, None),
]
FIELDS = ["gloss", "part_of_speech", "lemma_id"]


def test_sentence_copy(spark):
    words = spark.createDataFrame(WORDS, "word_id string, sent_id string, form string, is_punct boolean, gloss string, part_of_speech string, lemma_id string, head string, dep_rel string").withColumn("field_prov", prov.no_stamps())
    aligned = spark.createDataFrame([("s1", "s2", f"s1.w{i}", f"s2.t{i}") for i in range(1, 6)], "source string, target string, source_word string, target_word string")
    plan = edits.sentence_copy_plan(words, aligned, FIELDS)
    state = {(r.target_word, r.field): (r.state, r.value) for r in plan.collect()}
    assert state["s2.t1", "gloss"] == ("write", "cold") and state["s2.t1", "part_of_speech"] == ("write", "ADJ")  # a blank counts as empty
    assert state["s2.t1", "head"] == ("write", "s2.t2") and state["s2.t1", "dep_rel"] == ("write", "amod")  # the head is the target's own word
    assert state["s2.t3", "gloss"] == ("conflict", "LNK") and state["s2.t5", "gloss"] == ("same", "H") and state["s2.t2", "gloss"][0] == "nothing"
    assert state["s2.t3", "head"] == ("nothing", None) and state["s2.t3", "dep_rel"] == ("nothing", None)  # its head has no partner
    assert state["s2.t5", "dep_rel"] == ("nothing", None) and not any(t == "s2.t4" for t, _ in state)  # punctuation is skipped
    ticked = plan.where("target_word <> 's2.t2'")
    out = edits.apply_sentence_copy(words, ticked, CLOCK, FIELDS)
    rows = {r.word_id: r for r in out.collect()}
    assert sorted(rows) == sorted(w[0] for w in WORDS) and out.columns == words.columns
    one = rows["s2.t1"]
    assert (one.gloss, one.part_of_speech, one.lemma_id, one.head, one.dep_rel) == ("cold", "ADJ", "l1", "s2.t2", "amod")
    assert set(one.field_prov) == {"gloss", "part_of_speech", "lemma_id", "head", "dep_rel"}
    assert tuple(one.field_prov["gloss"]) == (None, None, "2026-09-24", "10:00:00", True, "s1")
    assert rows["s2.t3"].gloss == "and" and rows["s2.t3"].lemma_id == "l3" and set(rows["s2.t3"].field_prov) == {"part_of_speech", "lemma_id"}
    assert rows["s2.t2"].lemma_id is None and rows["s2.t2"].field_prov == {} and rows["s3.u1"].field_prov == {}
    again = edits.sentence_copy_plan(out, aligned, FIELDS)
    assert {(r.target_word, r.field) for r in again.where("state = 'write'").collect()} == {("s2.t2", f) for f in ("part_of_speech", "lemma_id", "head", "dep_rel")}
    assert sorted(map(str, edits.apply_sentence_copy(out, again.where("target_word <> 's2.t2'"), prov.Clock("2027-01-01", "00:00:00"), FIELDS).collect())) == sorted(map(str, out.collect()))


def test_several_sources_give_one(spark):
    words = spark.createDataFrame([("a1", "a", "x", False, "g", None), ("b1", "b", "x", False, "h", "N"), ("c1", "c", "x", False, None, None)], "word_id string, sent_id string, form string, is_punct boolean, gloss string, part_of_speech string")
    words = words.withColumns({"head": F.lit(None).cast("string"), "dep_rel": F.lit(None).cast("string"), "field_prov": prov.no_stamps()})
    aligned = spark.createDataFrame([("b", "c", "b1", "c1"), ("a", "c", "a1", "c1")], "source string, target string, source_word string, target_word string")
    out = edits.apply_sentence_copy(words, edits.sentence_copy_plan(words, aligned, ["gloss", "part_of_speech"]), CLOCK, ["gloss", "part_of_speech"])
    row = out.where("word_id = 'c1'").first()
    assert (row.gloss, row.part_of_speech) == ("g", None) and {k: v["from"] for k, v in row.field_prov.items()} == {"gloss": "a"}


def test_stamps(spark):
    by, machine = prov.person_stamp(CLOCK, "ann_1", "Ann"), prov.derived_stamp(CLOCK, "auto")
    row = spark.range(1).select(*(c.alias(k) for k, c in prov.created(by).items())).first()
    assert row.prov.annotator_id == "ann_1" and not row.prov.derived and row.prov_history == [row.prov] and row.field_prov == {}
    frame = spark.createDataFrame([("a", None), (None, None)], "gloss string, x string").withColumn("p", prov.stamp_fields(prov.no_stamps(), F.array(F.lit("gloss"), F.lit("y")), by))
    got = frame.select(prov.stamp_fields(F.col("p"), prov.changed_fields({"gloss": F.col("gloss").isNotNull(), "new": F.lit(True), "no": F.lit(None).cast("boolean")}), machine).alias("q"), prov.append_history(prov.append_history(F.array(by), machine), machine).alias("h")).collect()
    assert got[0].q["gloss"].derived and got[1].q["gloss"].annotator == "Ann" and got[0].q["y"].annotator == "Ann" and got[0].q["new"].annotator == "auto" and "no" not in got[0].q
    assert len(got[0].h) == 2 and got[0].h[1].annotator_id is None


def test_transforms_stamp_what_they_write(spark):
    by = prov.person_stamp(CLOCK, "ann_1")
    words = spark.createDataFrame([("w1", "soguk-DIr", 0), ("w2", "a-b", 2), ("w3", None, 0)], "word_id string, morphological_parse string, n_morphemes int")
    made = edits.ensure_morphemes(words, by=by).orderBy("morph_id").collect()
    assert [(r.morph_id, r.form, r.prov.annotator_id, len(r.prov_history)) for r in made] == [("w1.m_001", "soguk", "ann_1", 1), ("w1.m_002", "DIr", "ann_1", 1)]
    entries = spark.createDataFrame([("Işık", "light", "word"), ("x", "g1", "word"), ("x", "g2", "word")], "form string, gloss string, type string")
    morphemes = spark.createDataFrame([("ışık", None, None), ("x", None, "word"), ("Işık", "own", None)], "form string, gloss string, type string").withColumn("field_prov", prov.no_stamps())
    got = [(r.form, r.gloss, r.type, sorted(r.field_prov)) for r in edits.fill_morphemes(morphemes, entries, C.Fold("tr"), by).collect()]
    assert sorted(got) == sorted([("ışık", "light", "word", ["gloss", "type"]), ("x", None, "word", []), ("Işık", "own", "word", ["type"])])


def test_reconciliation_of_readings(spark):
    reading = "array<struct<label:string,text:string>>"
    rows = [("g", None, None, "N", 1, [("lat", "ga")], []), (None, "V", None, None, 1, [("lat", "a")], [("lat", "b"), ("ipa", "i")]), ("g", None, None, "N", 2, [("lat", "x")], None)]
    words = spark.createDataFrame(rows, f"gloss string, part_of_speech string, m_gloss string, m_pos string, n_morphemes int, transliterations {reading}, m_transliterations {reading}")
    words = words.withColumns({"field_prov": prov.stamp_fields(prov.no_stamps(), F.array(F.lit("gloss")), prov.person_stamp(CLOCK, "old")), "m_field_prov": prov.no_stamps()})
    once = edits.reconcile_mono(words, prov.derived_stamp(CLOCK, "mono"))
    a, b, c = once.collect()
    assert (a.gloss, a.m_gloss, a.part_of_speech, a.m_pos) == (None, "g", "N", "N") and [tuple(t) for t in a.m_transliterations] == [("lat", "ga")]
    assert a.m_field_prov["gloss"].annotator_id == "old" and a.m_field_prov["transliterations"].derived and sorted(a.field_prov) == ["part_of_speech"]
    assert [tuple(t) for t in b.transliterations] == [("lat", "a"), ("ipa", "i")] and [tuple(t) for t in b.m_transliterations] == [("lat", "b"), ("ipa", "i")] and b.m_pos == "V"
    assert c.gloss == "g" and c.m_transliterations is None and sorted(c.field_prov) == ["gloss"] and c.m_field_prov == {}
    again = edits.reconcile_mono(once.drop("moved"), prov.derived_stamp(prov.Clock("2030-01-01", "00:00:00"), "mono"))
    assert [str(r) for r in again.drop("moved").collect()] == [str(r) for r in once.drop("moved").collect()]


def test_gaps_follow_the_table(spark, monkeypatch):
    words = spark.createDataFrame([(0, "w0", "a", None, "", "l"), (0, "w1", ",", None, None, None), (1, "w2", "b", "g", "N", None), (2, "w3", "c", None, None, None)], "doc_id long, id string, form string, gloss string, part_of_speech string, lemma_id string").withColumn("morph_gloss", F.lit(None).cast("string"))
    plain = {(r.field): (r.missing, r.total) for r in quality.tracked_gaps({"word": words}).collect()}
    assert plain == {"gloss": (2, 3), "part_of_speech": (2, 3)}
    overrides = spark.createDataFrame([(0, ["word.lemma_id", "word.form"], []), (2, None, ["word.gloss"])], "doc_id long, on array<string>, off array<string>")
    got = {r.field: (r.missing, r.total) for r in quality.tracked_gaps({"word": words}, overrides).collect()}
    assert got == {"gloss": (1, 2), "part_of_speech": (2, 3), "lemma_id": (0, 1)}
    ids = quality.gap_ids({"word": words}, ["word.gloss", "word.lemma_id"], overrides)
    assert sorted((r.field, r.doc_id, r.id) for r in ids.collect()) == [("gloss", 0, "w0")]
    monkeypatch.setattr(quality, "FIELDS", [*quality.FIELDS, quality.Field("word", "tone", "core")])  # a field that the table gets later counts at once
    assert {r.field for r in quality.tracked_gaps({"word": words.withColumn("tone", F.lit("x"))}).collect()} == {"gloss", "part_of_speech", "tone"}


def test_index_answers_like_the_tokens(spark, tmp_path):
    r = random.Random(6)
    forms = ["".join(r.choice("abAİıß.") for _ in range(r.randint(1, 7))) for _ in range(300)]
    docs = spark.createDataFrame([(i * 100, " ".join(r.choice(forms) for _ in range(60)), "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    tokens = C.tokens(C.paragraphs(docs)).cache()
    index = build_index(tokens, str(tmp_path / "i"))
    hits = lambda f: sorted((x.doc_id, x.para_pos, x.sent_pos, list(x.words)) for x in f.collect())
    for text, regex, sensitive in (("ab", False, False), ("a*", False, False), ("*aba*", False, False), ("*ab*ba*", False, False), ("*a(ba)b*", False, False), ("*aß", False, False), ("A*", False, True), ("(ab|ba)a", True, False), ("*", False, False)):
        q = compile_token(text, "text", regex, sensitive)
        assert hits(search_index(index, q)) == hits(search_token(tokens, q)), text
    assert pattern_grams(compile_token("*aba*", "text")) == [{"aba"}] and pattern_grams(compile_token("aba*", "text")) is None
    some = matching_forms(index, compile_token("*aba*", "text")).select("form")
    assert {x.form for x in some.collect()} == {x.form for x in tokens.where("form_key like '%aba%'").select("form").distinct().collect()}
    assert index.lists.selectExpr("max(size(places)) m", "count(distinct block) b").first().b == 5  # documents 0 to 1100 in blocks of 256


def test_push_to_dict_with_morphemes(spark):
    reading = "array<struct<label:string,text:string>>"
    rows = [("Dog", "word", "g1", None, "l1", [("r", "dag")], 1), ("dog", "word", "g2", "NOUN", None, None, 2), ("s", "bound.morpheme", "PL", None, None, None, 3), ("S", "bound.morpheme", "x", None, None, None, 4), ("cat", "bound.morpheme", "c", None, None, None, 5), ("cat", "word", "cc", None, None, None, 6), ("ed", "bound.morpheme", "PST", None, None, None, 7)]
    candidates = spark.createDataFrame(rows, f"form string, type string, gloss string, part_of_speech string, lemma_id string, transliterations {reading}, ord long")
    entries = spark.createDataFrame([("e1", "dog", "word", None, "VERB", None, []), ("e2", "ed", "root", " ", None, None, None)], f"id string, form string, type string, gloss string, part_of_speech string, lemma_id string, transliterations {reading}")
    entries = entries.withColumns({"prov": F.lit(None).cast(prov.STAMP), "prov_history": F.lit(None).cast(f"array<{prov.STAMP}>"), "field_prov": prov.no_stamps()})
    by = prov.person_stamp(CLOCK, "ann_1")
    from corpusloom.operators import lexicon

    once = lexicon.push_to_dict(candidates, entries, by=by)
    got = {r.id: r for r in once.collect()}
    assert sorted(got) == ["e1", "e2", "new_bound.morpheme_s", "new_cat"]
    assert (got["e1"].gloss, got["e1"].part_of_speech, got["e1"].lemma_id, got["e1"].transliterations[0].text, sorted(got["e1"].field_prov)) == ("g1", "VERB", "l1", "dag", ["gloss", "lemma_id", "transliterations"])
    assert got["e2"].gloss == "PST" and sorted(got["e2"].field_prov) == ["gloss"]  # a morpheme matches any entry
    assert (got["new_bound.morpheme_s"].gloss, got["new_bound.morpheme_s"].prov.annotator_id, got["new_cat"].type) == ("PL", "ann_1", "word")
    again = lexicon.push_to_dict(candidates, once, by=prov.person_stamp(prov.Clock("2030-01-01", "0"), "other"))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_lemmas_are_made_and_said(spark):
    from corpusloom.operators import lexicon

    lemmas = spark.createDataFrame([("L1", "olmak"), ("L2", "resume")], "id string, form string")
    forms = spark.createDataFrame([(f,) for f in ("", "OLMAK", "gitmek", "Gitmek", "résumé")], "form string")
    resolved, made = lexicon.resolve_or_create(forms, lemmas, by=prov.person_stamp(CLOCK, "ann_1"))
    got = {r.form: (r.note, r.lemma_id) for r in resolved.collect()}
    assert got[""] == (None, None) and got["OLMAK"] == ("linked", "L1") and got["gitmek"] == got["Gitmek"] == ("created", "new_gitmek") and got["résumé"] == ("created_near", "new_résumé")
    assert sorted((r.id, r.form, r.prov.annotator_id) for r in made.collect()) == [("new_gitmek", "Gitmek", "ann_1"), ("new_résumé", "résumé", "ann_1")]
    second, none = lexicon.resolve_or_create(forms, lemmas.unionByName(made.select("id", "form")))
    assert none.count() == 0 and {r.form: r.lemma_id for r in second.collect()} == {f: i for f, (_, i) in got.items()}


def test_log_findings(spark):
    rows = [("a", "2026-01-02", "ERROR", "page 12 broke"), ("b", "2026-01-01", "CRITICAL", "page 7 broke"), ("b", "2026-01-03", "WARNING", "page 8 broke"), ("a", "2026-01-01", "INFO", "page 9 broke"), ("a", "2026-01-01", "ERROR", "App exited — THIS SESSION RECORDED 3")]
    (found,) = quality.triage(spark.createDataFrame(rows, "file string, date string, level string, message string")).collect()
    assert (found.signature, found.n, found.first_date, found.last_date, found.files, found.level) == ("page <n> broke", 3, "2026-01-01", "2026-01-03", 2, "CRITICAL")


def test_oversize_files(spark, tmp_path):
    from corpusloom.sources import records

    (tmp_path / "p_corpus.jsonl").write_text("x" * 100)
    (tmp_path / "p_dictionary.jsonl").write_text("x" * 10)
    path = f"{tmp_path}/p_corpus.jsonl"
    assert records.oversize(spark, path) == [] and records.oversize(spark, path, 110) == ["corpus"]


def test_sentence_copy_within_rows(spark):
    """Pairs of sentences in one row give what the joins of words give, and join nothing."""
    words = spark.createDataFrame(WORDS, "word_id string, sent_id string, form string, is_punct boolean, gloss string, part_of_speech string, lemma_id string, head string, dep_rel string").withColumn("field_prov", prov.no_stamps())
    order = {w[0]: i for i, w in enumerate(x for s in ("s1", "s2", "s3") for x in WORDS if x[1] == s)}
    first = {"s1": 0, "s2": 5, "s3": 10}
    # The second word of either sentence is the other's third: places need not agree.
    partners = [0, 2, 1, 3, 4]
    pairs = [("s1", "s2", f"s1.w{i + 1}", f"s2.t{k + 1}") for i, k in enumerate(partners)]
    aligned = spark.createDataFrame(pairs, "source string, target string, source_word string, target_word string")
    place = lambda c: F.create_map(*(F.lit(x) for w, i in order.items() for x in (w, i)))[c]
    whole = F.struct(place(F.col("word_id")).alias("o"), "word_id", "is_punct", *FIELDS, "head", (place(F.col("head")) - place(F.concat("sent_id", F.lit(".w1")))).alias("head_at"), "dep_rel", "field_prov")
    rows = words.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct(F.col("word_id").alias("o"), whole.alias("w"))), lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(1)).alias("a")).select("sent_id", F.transform("a", lambda x: x["w"]).alias("words"))
    of = {r.sent_id: r for r in rows.collect()}
    assert [len(of[s].words) for s in first] == [5, 5, 1]
    kind = rows.schema["words"].dataType.simpleString()
    made = [("s1", "s2", of["s1"].words, of["s2"].words, partners, partners), (None, "s3", None, of["s3"].words, None, None)]
    nested = spark.createDataFrame(made, f"source string, target string, source_words {kind}, target_words {kind}, partners array<int>, origins array<int>")
    plan, want = edits.nested_copy_plan(nested, FIELDS), edits.sentence_copy_plan(words, aligned, FIELDS)
    assert sorted(map(str, plan.collect())) == sorted(map(str, want.collect())) and plan.columns == want.columns and want.where("state = 'write'").count() > 3
    out = edits.apply_nested_copy(nested, CLOCK, FIELDS)
    whole = edits.apply_sentence_copy(words, want, CLOCK, FIELDS).where("sent_id <> 's1'").select(*out.columns)
    flat = lambda d: sorted(map(str, d.withColumn("field_prov", F.array_sort(F.map_entries("field_prov"))).collect()))
    assert flat(out) == flat(whole)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().optimizedPlan().toString()
