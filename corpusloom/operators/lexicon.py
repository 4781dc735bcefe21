"""The lexicon: links from tokens to entries and lemmas, homographs, references, upserts.

Tokens have form_key, dict_id, lemma_id; entries id, form, type, lemma_id, homograph, file_pos; lemmas id, form.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Fold, dict_key, norm_meta
from ..functions.morph import blank
from ..session import remove, shared_folder
from . import prov


def browse(entries: DataFrame, form: str = "", meta: dict[str, str] | None = None, fold: Fold = Fold()) -> DataFrame:
    """Entries whose form's key holds a string, and whose other columns (gloss, definition, tags) hold theirs; blank strings don't count."""
    test = F.lit(True)
    if form.strip():
        test = test & dict_key(F.col("form"), fold).contains(dict_key(F.lit(form.strip()), fold))
    for column, wanted in (meta or {}).items():
        if wanted.strip():
            test = test & norm_meta(F.coalesce(F.col(column), F.lit(""))).contains(norm_meta(F.lit(wanted.strip())))
    return entries.where(test)


def by_key(entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Entries of each form key: how many, and the only one's id."""
    return entries.groupBy(dict_key(F.col("form"), fold).alias("form_key")).agg(F.count("*").alias("n_entries"), F.min("id").alias("one_id"))


def resolve(tokens: DataFrame, entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """state and entry of each token: linked by a live dict_id, else by form: unique, ambiguous or none. A stale id falls to the form."""
    live = entries.select(F.col("id").alias("live_id"))
    out = tokens.join(live, tokens["dict_id"] == live["live_id"], "left").join(by_key(entries, fold), "form_key", "left")
    state = F.when(F.col("live_id").isNotNull(), "linked").when(F.col("n_entries") == 1, "unique").when(F.col("n_entries") > 1, "ambiguous").otherwise("none")
    entry = F.when(F.col("live_id").isNotNull(), F.col("live_id")).when(F.col("n_entries") == 1, F.col("one_id"))
    return out.withColumns({"state": state, "entry_id": entry}).drop("live_id", "n_entries", "one_id")


def autolink(tokens: DataFrame, entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """dict_id filled where exactly one entry has the form; never overwritten; such links are derived."""
    out = tokens.join(by_key(entries, fold), "form_key", "left")
    new = F.col("dict_id").isNull() & (F.col("n_entries") == 1)
    outcome = F.when(new, "linked").when(F.col("dict_id").isNull() & (F.col("n_entries") > 1), "ambiguous")
    return out.withColumns({"outcome": outcome, "derived": new & F.lit(True), "dict_id": F.when(new, F.col("one_id")).otherwise(F.col("dict_id"))}).drop("n_entries", "one_id")


def lemma_groups(lemmas: DataFrame, entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entries and tokens that cite each lemma; references to no lemma are skipped, lemmas cited by nothing count zero."""
    cited = entries.where("lemma_id is not null").groupBy("lemma_id").agg(F.count("*").alias("entries"))
    used = tokens.where("lemma_id is not null").groupBy("lemma_id").agg(F.count("*").alias("tokens"))
    out = lemmas.select(F.col("id").alias("lemma_id"), "form").join(cited, "lemma_id", "left").join(used, "lemma_id", "left")
    return out.fillna(0, ["entries", "tokens"])


def orphan_lemmas(lemmas: DataFrame, entries: DataFrame, tokens: DataFrame) -> DataFrame:
    out = lemmas.withColumnRenamed("id", "lemma_id")
    return out.join(entries.select("lemma_id"), "lemma_id", "left_anti").join(tokens.select("lemma_id"), "lemma_id", "left_anti")


def dangling(tokens: DataFrame, column: str, known: DataFrame, key: str = "id") -> DataFrame:
    """References that nothing answers: how many, and how many different ones."""
    lost = tokens.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti")
    return lost.agg(F.count("*").alias("refs"), F.countDistinct(column).alias("ids")).select(F.lit(column).alias("reference"), "refs", "ids")


def entry_refs(words: DataFrame, morphemes: DataFrame, entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Who cites the entries: words, morphemes, lemma words and other entries, counted for each id."""
    pick = lambda frame, column, kind: frame.select(F.col(column).alias("id")).join(ids, "id", "left_semi").withColumn("ref_class", F.lit(kind))
    parts = entries.select(F.explode("constituent_ids").alias("cited"))
    every = pick(words, "dict_id", "words").unionByName(pick(morphemes, "dict_id", "morphemes")).unionByName(pick(words, "lemma_id", "lemma_words")).unionByName(pick(parts, "cited", "entries"))
    return every.groupBy("id", "ref_class").agg(F.count("*").alias("refs"))


def repoint(frame: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """References moved from `old` to `new`, or cleared where new is null."""
    moves = changes.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = frame.join(moves, F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_old", "_new")


def same_text_sentences(keys: DataFrame) -> DataFrame:
    """Classes of sentences with one key: each sentence with its class's first one and size. Members are not paired with each other.

    Keys meet as 128-bit digests, so no text is shuffled; the first and the size combine before the shuffle.
    """
    own = keys.where("key <> ''").select("doc_id", "para_pos", "sent_pos", F.unhex(F.md5("key")).alias("digest"))
    groups = own.groupBy("digest").agg(F.min(F.struct("doc_id", "para_pos", "sent_pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, "digest").select("doc_id", "para_pos", "sent_pos", F.col("first.doc_id").alias("first_doc"), F.col("first.para_pos").alias("first_para"), F.col("first.sent_pos").alias("first_sent"), "n")


def equivalence_rule(lemmas: bool = False) -> Column:
    """What a reader's word is compared by: its entry, else its form; with lemmas, the lemma first."""
    rule = F.when(F.col("dict_id").isNotNull(), F.struct(F.lit("dict").alias("rule"), F.col("dict_id").alias("value"))).otherwise(F.struct(F.lit("form").alias("rule"), F.col("form_key").alias("value")))
    return F.when(F.col("lemma_id").isNotNull(), F.struct(F.lit("lemma").alias("rule"), F.col("lemma_id").alias("value"))).otherwise(rule) if lemmas else rule


def equivalents(tokens: DataFrame, lemmas: bool = False) -> DataFrame:
    """How many tokens each rule's value reaches; a form also reaches linked words of that form."""
    probes = tokens.select(equivalence_rule(lemmas).alias("r")).select("r.rule", "r.value").distinct()
    count = lambda rule, column: tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("reached")).withColumn("rule", F.lit(rule))
    reach = count("dict", "dict_id").unionByName(count("form", "form_key"))
    reach = reach.unionByName(count("lemma", "lemma_id")) if lemmas else reach
    return probes.join(reach, ["rule", "value"])


#: Blocks of a dictionary entry in their order, each with its heading; fields that are switched off leave their block out.
BLOCKS = ["form", "transliteration", "pos_type", "gloss", "definition", "usage_notes", "allomorphs", "constituent_forms", "pinned_examples"]


def dictionary_view(entries: DataFrame, examples: DataFrame, off: frozenset[str] = frozenset()) -> DataFrame:
    """Entries as ordered blocks (block, heading, lines): the data of a printed dictionary.

    Entries have id, form and any of transliterations, part_of_speech, type, semantic_domain, gloss, meaning, usage_notes, allomorphs
    (form, environment) and constituent_forms; examples have id, place, example and translation. Empty blocks are left out.
    """
    have = set(entries.columns)
    pick = lambda c: F.when(~blank(F.col(c)), F.col(c)) if c in have else F.lit(None).cast("string")
    dots = lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "  ·  "))
    filled = lambda *values: F.filter(F.array(*values), lambda x: x.isNotNull())
    readings = dots(F.filter(F.transform("transliterations", lambda t: t["text"]), lambda x: F.coalesce(x, F.lit("")) != "")) if "transliterations" in have else F.lit(None).cast("string")
    kinds = ["part_of_speech", "type", *(() if "semantic_domain" in off else ("semantic_domain",))]
    none = F.array().cast("array<string>")
    line = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    allomorphs = F.transform(F.coalesce("allomorphs", F.array().cast("array<struct<form:string,environment:string>>")), lambda a: F.concat(a["form"], F.when(~blank(a["environment"]), F.concat(F.lit("  — "), a["environment"])).otherwise(F.lit("")))) if "allomorphs" in have else none
    parts = line(F.when(F.size("constituent_forms") > 0, F.array_join("constituent_forms", "  +  "))) if "constituent_forms" in have else none
    own = examples.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "example", "translation"))).alias("_examples"))
    shown = F.flatten(F.transform(F.coalesce("_examples", F.array()), lambda e: F.filter(F.array(e["example"], F.when(~blank(e["translation"]), e["translation"])), lambda x: x.isNotNull())))
    lines = {
        "form": ("", line(F.col("form"))), "transliteration": ("", line(readings)), "pos_type": ("", line(dots(filled(*(pick(c) for c in kinds))))), "gloss": ("", line(F.concat(F.lit('"'), pick("gloss"), F.lit('"')))),
        "definition": ("Definition", line(pick("meaning"))), "usage_notes": ("Usage", line(pick("usage_notes"))), "allomorphs": ("Allomorphs", allomorphs), "constituent_forms": ("Parts", parts), "pinned_examples": ("Examples", shown),
    }
    blocks = [F.struct(F.lit(b).alias("block"), F.lit(lines[b][0]).alias("heading"), lines[b][1].alias("lines")) for b in BLOCKS if b not in off]
    return entries.join(own, "id", "left").select("id", F.filter(F.array(*blocks), lambda b: F.size(b["lines"]) > 0).alias("blocks"))


def example_view(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """An entry's pinned sentence as one line, its word in brackets: the data of a printed dictionary."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", F.when(F.col("word_pos") == F.col("pin_word"), F.concat(F.lit("["), "form", F.lit("]"))).otherwise(F.col("form")).alias("form")))), lambda t: t["form"]), " ")
    return entries.join(tokens.select("doc_id", "para_pos", "sent_pos", "word_pos", "form"), ["doc_id", "para_pos", "sent_pos"]).groupBy("id").agg(words.alias("example"))


def form_index(tokens: DataFrame) -> DataFrame:
    """Form key to its places: how many, and the first."""
    return tokens.groupBy("form_key").agg(F.count("*").alias("refs"), F.min(F.struct("doc_id", "para_pos", "g")).alias("first")).select("form_key", "refs", F.col("first.doc_id").alias("doc_id"), F.col("first.para_pos").alias("para_pos"), F.col("first.g").alias("g"))


def tag_pool(uses: DataFrame, standard: DataFrame) -> DataFrame:
    """Values in use, merged by key and shown in their most used spelling, and standard ones that aren't in use.

    Keys are worked out once for each different value; standard values come along unused, so that nothing is read twice.
    """
    each = uses.groupBy("value").agg(F.count("*").alias("n")).unionByName(standard.select("value", F.lit(0).cast("long").alias("n"))).where(~blank(F.col("value")))
    spelt = each.groupBy(norm_meta(F.trim(F.col("value"))).alias("key"), F.trim(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    return spelt.groupBy("key").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.sum("n").alias("uses"))


def duplicate_keys(entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Entries of one key and type: forks if plain lower case tells them apart, else homographs."""
    groups = entries.groupBy(dict_key(F.col("form"), fold).alias("key"), F.coalesce("type", F.lit("")).alias("type")).agg(F.count("*").alias("entries"), F.countDistinct(F.lower("form")).alias("old_keys"))
    return groups.where("entries >= 2").withColumn("kind", F.when(F.col("old_keys") > 1, "fork").otherwise("homograph"))


def number_homographs(entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Numbers for entries that share a form, after the largest in use, in file order; none is changed, a lone form has none."""
    rows = entries.withColumn("key", dict_key(F.col("form"), fold))
    group = Window.partitionBy("key")
    order = Window.partitionBy("key", F.col("homograph").isNull()).orderBy("file_pos")
    new = F.coalesce(F.max("homograph").over(group), F.lit(0)) + F.row_number().over(order)
    return rows.withColumn("homograph", F.when(F.count("*").over(group) < 2, F.col("homograph")).otherwise(F.coalesce("homograph", new)).cast("int")).drop("key")


def lemma_evidence(tokens: DataFrame) -> DataFrame:
    """For each form key: its lemmas and how many tokens cite them."""
    return tokens.where("lemma_id is not null").groupBy("form_key", "lemma_id").agg(F.count("*").alias("n"))


def others(words: DataFrame, counted: DataFrame, fields: list[str]) -> DataFrame:
    """What the other tokens of a word's form say: the counts of its form key, without the word's own token.

    words have word, form_key and their own values of the fields; counted are rows of form_key, the fields and n.
    """
    own = words.select("word", "form_key", F.struct(*fields).alias("_own"))
    out = own.join(counted, "form_key").withColumn("n", F.col("n") - F.col("_own").eqNullSafe(F.struct(*fields)).cast("long"))
    return out.where("n > 0").drop("_own")


def word_analyses(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """Different analyses of each form: how often, and where first; words without any are left out."""
    some = F.coalesce(*(F.when(~blank(F.col(f)), F.lit(True)) for f in fields))
    return tokens.where(some).groupBy("form_key", *fields).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "para_pos", "g")).alias("first")).select("form_key", *fields, "n", F.col("first.doc_id").alias("first_doc"))


def offers(values: DataFrame) -> DataFrame:
    """Values found on sentences with one key, by count and then corpus order: rank 1 is offered first.

    The place is one decimal number, as a hash aggregate keeps numbers only: with a struct all sentences would be sorted, before the shuffle and after it.
    """
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col("para_pos").cast("long") * F.lit(1 << 31) + F.col("sent_pos")
    counted = values.where((F.col("key") != "") & ~blank(F.col("value"))).groupBy("key", "value").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).select("key", "value", "n", "rank")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame from a table in the shared folder, which goes when the driver ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    frame.write.parquet(path)
    return spark.read.parquet(path)


def push_to_dict(candidates: DataFrame, entries: DataFrame, fold: Fold = Fold(), by: Column | None = None) -> DataFrame:
    """The lexicon after pushing words and morphemes: entries of a candidate's key get their empty fields filled; a key without an entry makes one.

    Candidates have form, gloss, part_of_speech, type, lemma_id and an order, and may have transliterations (arrays). Word
    candidates match word entries, others any but those that a word of this run makes; a lemma goes to word entries only. The
    first filled value of a key counts, so that pushing twice changes nothing. With `by`, new entries get their provenance
    columns and filled fields a stamp in field_prov, which the entries then have.
    """
    key = dict_key(F.col("form"), fold)
    lists = ["transliterations"] if "transliterations" in candidates.columns else []
    pushed = ["gloss", "part_of_speech", *lists]
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1 if c in lists else blank(F.col(c))
    rows = candidates.withColumn("key", key)
    first = lambda c: F.min_by(c, F.when(~empty(c), F.col("ord")))
    best = rows.groupBy("key", "type").agg(F.min_by("form", "ord").alias("new_form"), *(first(c).alias(f"new_{c}") for c in pushed), F.min_by("lemma_id", F.when(~blank(F.col("lemma_id")), F.col("ord"))).alias("new_lemma_id"))
    # Stored, as it is read for the entries and for the new ones: a second pass would join all candidates with the lexicon.
    best = stored(best, "pushed")
    known = entries.withColumn("key", key)
    word, other = best.where("type = 'word'").drop("type"), best.where("type <> 'word'")
    any_of = other.groupBy("key").agg(*(F.min_by(f"new_{c}", F.when(F.col(f"new_{c}").isNotNull(), F.col("type"))).alias(f"any_{c}") for c in pushed))
    touched = known.join(word, "key", "left").join(any_of, "key", "left").withColumn("is_word", F.col("type") == "word")
    offer = lambda c: F.coalesce(F.when(F.col("is_word"), F.col(f"new_{c}")), F.col(f"any_{c}"))
    takes = {c: empty(c) & offer(c).isNotNull() for c in pushed} | {"lemma_id": F.col("is_word") & F.col("lemma_id").isNull() & F.col("new_lemma_id").isNotNull()}
    filled = {c: F.when(takes[c], offer(c)).otherwise(F.col(c)).alias(c) for c in pushed} | {"lemma_id": F.when(takes["lemma_id"], F.col("new_lemma_id")).otherwise(F.col("lemma_id")).alias("lemma_id")}
    stamps: list[Column] = []
    if by is not None:
        touched = touched.withColumn("_filled", prov.changed_fields(takes))
        stamps = [*(F.col(c) for c in ("prov", "prov_history")), prov.stamp_fields(F.col("field_prov"), F.col("_filled"), by).alias("field_prov")]
    kept = touched.select("id", "form", "type", *filled.values(), *stamps)
    own = known.where("type = 'word'").select("key")
    new = word.withColumn("type", F.lit("word")).join(own, "key", "left_anti").unionByName(other.join(known.select("key"), "key", "left_anti").join(word.select("key"), "key", "left_anti"))
    name = F.when(F.col("type") == "word", F.concat(F.lit("new_"), "key")).otherwise(F.concat(F.lit("new_"), "type", F.lit("_"), "key"))
    made = new.select(name.alias("id"), F.col("new_form").alias("form"), "type", *(F.col(f"new_{c}").alias(c) for c in pushed), F.when(F.col("type") == "word", F.col("new_lemma_id")).alias("lemma_id"), *(() if by is None else (c.alias(k) for k, c in prov.created(by).items())))
    return kept.unionByName(made)


def fill_offers(tokens: DataFrame, entries: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Empty glosses that the only entry of a form could fill; nothing is written."""
    glossed = entries.join(by_key(entries, fold).where("n_entries = 1").select(F.col("one_id").alias("id"), "form_key"), "id").where(~blank(F.col("gloss"))).select("form_key", F.col("gloss").alias("offer"))
    return tokens.where(blank(F.col("gloss"))).join(glossed, "form_key").groupBy("form_key", "offer").agg(F.count("*").alias("n"))


def resolve_lemma(forms: DataFrame, lemmas: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """status of a typed lemma: empty, exact, near (equal but for accents and case in the corpus' locale, never taken by itself) or none."""
    base = f"{fold.locale if fold.locale in ('tr', 'az') else 'UNICODE'}_CI_AI"
    exact = lemmas.groupBy(dict_key(F.col("form"), fold).alias("_key")).agg(F.min("id").alias("lemma_id"))
    near = lemmas.groupBy(F.collate("form", base).alias("_near")).agg(F.count("*").alias("near"))
    out = forms.withColumns({"_key": dict_key(F.trim("form"), fold), "_near": F.collate(F.trim("form"), base)})
    out = out.join(exact, "_key", "left").join(near, "_near", "left")
    status = F.when(blank(F.col("form")), "empty").when(F.col("lemma_id").isNotNull(), "exact").when(F.col("near") > 0, "near").otherwise("none")
    return out.select("form", status.alias("status"), "lemma_id")


def resolve_or_create(forms: DataFrame, lemmas: DataFrame, fold: Fold = Fold(), by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lemma ids of typed forms, and the lemmas made for those that have none; a miss is never silent.

    note: linked, created, created_near (a near one is there, but may be another word) or null for an empty form. Forms of one
    key share one new lemma, whose id follows from the key, so that a second run makes nothing.
    """
    found = resolve_lemma(forms, lemmas, fold).withColumn("_key", dict_key(F.trim("form"), fold))
    new = F.concat(F.lit("new_"), "_key")
    missed = F.col("status").isin("near", "none")
    note = F.when(F.col("status") == "exact", "linked").when(F.col("status") == "near", "created_near").when(F.col("status") == "none", "created")
    resolved = found.select("form", note.alias("note"), F.when(missed, new).otherwise(F.col("lemma_id")).alias("lemma_id"))
    made = found.where(missed).groupBy(new.alias("id")).agg(F.min(F.trim("form")).alias("form"))
    return resolved, made if by is None else made.withColumns(prov.created(by))


def lemma_proposals(words: DataFrame, entries: DataFrame, evidence: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Lemmas to propose: the own entry's, then those of other tokens of the form by count, then the root's citation form."""
    name = lemmas.select(F.col("id").alias("lemma_id"), F.col("form").alias("proposal"))
    one = words.join(entries.select(F.col("id").alias("dict_id"), "lemma_id"), "dict_id").join(name, "lemma_id").select("word", "proposal", F.lit(1).alias("source"), F.lit(1).cast("long").alias("n"))
    two = words.join(evidence, "form_key").join(name, "lemma_id").select("word", "proposal", F.lit(2).alias("source"), "n")
    three = words.where("citation is not null").select("word", F.col("citation").alias("proposal"), F.lit(3).alias("source"), F.lit(1).cast("long").alias("n"))
    every = one.unionByName(two).unionByName(three)
    best = every.groupBy("word", "proposal").agg(F.min("source").alias("source"), F.max("n").alias("n"))
    order = Window.partitionBy("word").orderBy("source", F.desc("n"), "proposal")
    return best.withColumn("rank", F.row_number().over(order))
