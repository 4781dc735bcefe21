"""Files, records, the change log, and edits of records."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import deps, edits, enrich, lexicon, prov, quality
from corpusloom.sources import files, records
from corpusloom.streaming import journal


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode("utf-8-sig"))
    (tmp_path / "b.txt").write_bytes("naïve".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes("naïve".encode("latin-1"))
    assert {r.title: r.text for r in files.reader(str(tmp_path / "x.TXT"))(spark, str(tmp_path)).collect()} == {"a": "naïve", "b": "naïve", "c": "naïve"}
    with pytest.raises(ValueError):
        files.reader("x.docx")


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:language>en</dc:language></metadata><manifest><item xmlns="u" id="1" href="a.html"/><item xmlns="u" id="2" href="b.html"/></manifest><spine><itemref xmlns="u" idref="2"/><itemref xmlns="u" idref="1"/></spine></package>')
        z.writestr("o/a.html", "<html><head><title>x</title></head><body><p>One</p></body></html>")
        z.writestr("o/b.html", "<body><script>no</script><h1>Head</h1><div>Two <b>bold</b><p>in &amp; out</p></div></body>")
    got = [tuple(r) for r in files.read_epub(spark, str(tmp_path)).orderBy("sect_pos").select("title", "language", "section", "text").collect()]
    assert got == [("Book", "en", "Head", "Two bold\n\nin & out"), ("Book", "en", None, "One")]


def test_records(spark, tmp_path):
    path = tmp_path / "x_corpus.jsonl"
    path.write_text("\n".join(['{"record_type":"prov_events","events":[]}', "", "{broken", '{"record_type":"document","id":"d1","prov":3,"head":null}', '{"record_type":"odd","prov":{"annotator":"A","date":"2024-01-01"}}']))
    rows = records.read_jsonl(spark, str(path)).cache()
    assert records.quarantine(rows).count() == 1
    kinds = records.split_by_kind(rows)
    assert {k: v.count() for k, v in kinds.items() if v.count()} == {"prov_events": 1, "document": 1, "unknown": 1}
    assert records.detect_file_type(rows).collect()[0].file_type == "corpus"
    present, head = records.tri_state(F.col("v"), "$.head")
    assert [tuple(r) for r in kinds["document"].select(records.prov_index(F.col("v")), present, head).collect()] == [(3, True, None)]
    assert kinds["unknown"].select(records.prov_inline(F.col("v"))["annotator"].alias("a")).collect()[0].a == "A"
    found, missing = records.open_project(spark, str(path))
    assert list(found) == ["corpus"] and missing == ["dictionary", "participants", "journal"]
    assert records.sibling(str(path), "journal").endswith("/x.journal.jsonl") and records.role("a_dictionary.jsonl") == "dictionary"


def test_writing(spark, tmp_path):
    stamps = spark.createDataFrame([("f", 0, "a1", "Ann", "2024-01-01", "10:00:00", False, None), ("f", 1, None, "Bob", "2024-01-01", "10:00:00", False, None), ("f", 2, "a1", "Ann", "2024-01-01", "10:00:00", False, None)], "file_id string, pos long, annotator_id string, annotator string, date string, time string, derived boolean, `from` string")
    events = prov.intern(stamps)
    assert sorted((r.idx, r.annotator, r.uses) for r in events.collect()) == [(0, "Ann", 2), (1, "Bob", 1)]
    rows = records.serialize(spark.createDataFrame([("f", 0, ("document", None))], "file_id string, pos long, rec struct<record_type:string,title:string>"), events)
    lines = [json.loads(r.value) for r in rows.orderBy("pos").collect()]
    assert "annotator" not in lines[0]["events"][0] and lines[0]["events"][1]["annotator"] == "Bob" and lines[1] == {"record_type": "document", "title": None}
    known = tuple(records.fingerprint(rows).collect()[0])
    assert records.unchanged(rows, known) and not records.unchanged(rows.limit(1), known) and not records.unchanged(rows, None)
    records.rewrite(rows, f"{tmp_path}/t")
    records.rewrite(rows.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    (tmp_path / "one.txt").write_text("x")
    assert records.zip_folder(str(tmp_path), str(tmp_path / "out.zip")) == ["one.txt"]


LOG = [("put", "c", "a", None, None, "1", 1), ("add", "c", "b", "p", 0, "2", 2), ("add", "c", "b", "p", 0, "x", 3), ("del", "c", "a", None, None, None, 4), ("del", "c", "zz", None, None, None, 5), ("put", "c", "b", None, None, "3", 6), ("add", "c", "a", "p", 1, "9", 7)]


def test_replay(spark):
    log = spark.createDataFrame(LOG, journal.SCHEMA)
    base = spark.createDataFrame([("c", "a", "0"), ("c", "k", "7")], "t string, id string, rec string")
    want = [("a", "9"), ("b", "3"), ("k", "7")]
    once = journal.replay(base, log)
    assert sorted((r.id, r.rec) for r in once.collect()) == want
    assert sorted((r.id, r.rec) for r in journal.replay(once, log).collect()) == want  # a second time changes nothing
    assert journal.unresolved(base, log).collect()[0].unresolved == 1


def test_replay_as_a_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    spark.createDataFrame(LOG[:4], journal.SCHEMA).coalesce(1).write.mode("append").json(str(folder))
    state = {}

    def apply(batch, n):
        for r in batch.collect():
            state[r.id] = r.rec if r.live else None

    query = journal.stream_replay(spark.readStream.schema(journal.SCHEMA).json(str(folder)), apply, f"{tmp_path}/cp").start()
    query.processAllAvailable()
    spark.createDataFrame(LOG[4:], journal.SCHEMA).coalesce(1).write.mode("append").json(str(folder))
    query.processAllAvailable()
    query.stop()
    assert {k: v for k, v in state.items() if v} == {"a": "9", "b": "3"}


def test_journal_lines(spark):
    lines = spark.createDataFrame([('{"op":"put","t":"corpus","id":"s1","rec":{"x":1}}', 0), ('{"op":"pu', 1)], "line string, line_no long")
    got = journal.parse(lines).collect()
    assert (got[0].op, got[0].id, json.loads(got[0].rec)) == ("put", "s1", {"x": 1}) and got[1].op is None


def test_policies():
    mb = 1 << 20
    assert not journal.compaction_due(mb, 100 * mb) and journal.compaction_due(3 * mb, 4 * mb) and not journal.compaction_due(3 * mb, 100 * mb)
    assert journal.compaction_due(1, 1, idle_seconds=121) and not journal.compaction_due(1, 1, idle_seconds=121, last_seconds=3) and journal.compaction_due(0, 1, complete=False)
    journal.check_base(None, "a", "b")
    journal.check_base({"corpus": "a", "dict": "b"}, "a", "b")
    with pytest.raises(ValueError):
        journal.check_base({"corpus": "x", "dict": "b"}, "a", "b")
    with pytest.raises(ValueError):
        journal.refuse_if_journal(1)


def test_alignment():
    assert edits.align(["a", "b", "c"], ["a", "x", "c"]) == [(0, 0), (2, 2)]
    assert edits.align(["The", "end"], ["the", "end"]) == [(0, 0), (1, 1)]
    assert edits.align([], ["a"]) == [] and edits.align(["a"], []) == []
    assert edits.align(["x", "a", "a"], ["a", "a"]) == [(1, 0), (2, 1)]


def test_arc_levels(spark):
    from corpusloom.operators.deps import _levels

    assert _levels([(0, 1), (0, 3), (1, 2)]) == [1, 2, 1] and _levels([]) == [] and _levels([(0, 5), (0, 5)]) == [1, 1]
    words = spark.createDataFrame([(0, 0, 0, 0, "w_1", None, True, None), (0, 0, 0, 1, "w_2", "w_1", True, "r"), (0, 0, 0, 2, "w_3", "w_9", True, "x"), (0, 0, 0, 3, "w_4", "w_4", True, "y")], "doc_id long, para_pos int, sent_pos int, word_pos int, local_id string, head string, head_present boolean, dep_rel string")
    assert [(r.dep_pos, r.head_pos) for r in deps.arcs(words).collect()] == [(1, 0)]
    swept = {r.word_pos: (r["head"], r.head_present, r.dep_rel) for r in deps.sweep_heads(words).collect()}
    assert swept[2] == (None, False, "x") and swept[0] == (None, True, None)


def test_homographs(spark):
    kind = "id string, form string, type string, homograph int, file_pos int"
    rows = spark.createDataFrame([("1", "bank", "w", None, 1), ("2", "Bank", "w", None, 2), ("3", "bank", "w", 5, 3), ("4", "lone", "w", None, 4)], kind)
    first = lexicon.number_homographs(rows)
    got = {r.id: r.homograph for r in first.collect()}
    assert got == {"1": 6, "2": 7, "3": 5, "4": None}
    assert {r.id: r.homograph for r in lexicon.number_homographs(first).collect()} == got


def test_push_is_idempotent(spark):
    entries = spark.createDataFrame([("e1", "run", "word", None, "VERB", None), ("e2", "run", "bound.morpheme", None, None, None)], "id string, form string, type string, gloss string, part_of_speech string, lemma_id string")
    words = spark.createDataFrame([("Run", "go", "X", "word", "l1", 1), ("walk", None, "VERB", "word", None, 2), ("walk", "step", None, "word", None, 3)], "form string, gloss string, part_of_speech string, type string, lemma_id string, ord int")
    once = lexicon.push_to_dict(words, entries)
    got = sorted(map(tuple, once.collect()), key=str)
    assert got == sorted([("e1", "run", "word", "go", "VERB", "l1"), ("e2", "run", "bound.morpheme", None, None, None), ("new_walk", "walk", "word", "step", "VERB", None)], key=str)
    assert sorted(map(tuple, lexicon.push_to_dict(words, once).collect()), key=str) == got


def test_near_lemmas(spark):
    forms = spark.createDataFrame([("Kedi",), ("kédi",), ("dog",), ("",)], "form string")
    lemmas = spark.createDataFrame([("l1", "kedi")], "id string, form string")
    assert {r.form: r.status for r in lexicon.resolve_lemma(forms, lemmas).collect()} == {"Kedi": "exact", "kédi": "near", "dog": "none", "": "empty"}


def test_fields():
    assert quality.counted("word") == ["gloss", "transliterations", "morphological_parse", "part_of_speech"]
    assert "authors" not in quality.trackable("document") and "title" in quality.trackable("document")
    on, off = quality.toggle("word", "lemma_id", True, [], [])
    assert (on, off) == (["lemma_id"], []) and quality.tracked("word", on, off)[-1] == "lemma_id"
    assert quality.toggle("word", "lemma_id", False, on, off) == ([], [])
    assert quality.toggle("word", "gloss", False, [], []) == ([], ["gloss"]) and "gloss" not in quality.tracked("word", [], ["gloss"])


def test_translation_keeps_places(spark):
    rows = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, " "), (0, 0, 2, "c")], "doc_id long, para_pos int, sent_pos int, sentence string")

    class Broken:
        def translate_batch(self, texts):
            raise RuntimeError

    got = enrich.translate(rows, lambda: enrich.Fallback(Broken(), enrich.Identity())).orderBy("sent_pos").collect()
    assert [r.translation for r in got] == ["a", None, "c"]
    assert enrich.remaining(rows, rows.where("sent_pos = 0")).count() == 1


def test_participants(spark):
    people = spark.createDataFrame([("a", "Ann", 1, False), ("b", "Ann", 2, None), ("c", "Ann", 3, True), ("d", "ann", 4, False)], "id string, name string, file_pos int, deleted boolean")
    assert {r.id: r.shown for r in prov.display_names(people).collect()} == {"a": "Ann", "b": "Ann (2)", "c": "Ann", "d": "ann"}
    assert [r.id for r in records.participant_sort(records.live(people), "name").collect()] == ["d", "a", "b"]
