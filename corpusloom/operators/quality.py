"""Completeness of annotation, from one table of fields, and integrity checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, morph
from ..functions.text import is_punct, log_signature
from ..corpus import SENTENCE


@dataclass(frozen=True)
class Field:
    """A field of a level: its tier, and how it counts."""

    level: str
    name: str
    tier: str
    counted: bool = False
    stored: bool = True
    filled_when: str = ""
    vacuous_when: str = ""
    applies_when: str = ""
    container: bool = False
    planned: bool = False
    control: bool = False


# Fields by level with their tier (identity, core, aux, extra, derived).
FIELDS = [
    Field("document", "id", "identity"), Field("document", "title", "core"), Field("document", "language", "core"), Field("document", "authors", "extra"),
    Field("document", "content_sources", "extra"), Field("document", "content_date", "extra"), Field("document", "publisher", "extra"), Field("document", "notes", "extra"),
    Field("section", "id", "identity"), Field("section", "title", "aux"),
    Field("paragraph", "id", "identity"), Field("paragraph", "translations", "aux"), Field("paragraph", "transliterations", "aux"), Field("paragraph", "comments", "extra"),
    Field("sentence", "id", "identity"), Field("sentence", "sentence_index", "identity"), Field("sentence", "text", "identity"), Field("sentence", "translations", "core"),
    Field("sentence", "transliterations", "aux"), Field("sentence", "comments", "extra"), Field("sentence", "words", "core", control=True, filled_when="has_words"),
    Field("sentence", "dependencies", "aux", stored=False, filled_when="has_dep_parse", counted=True),
    Field("word", "id", "identity"), Field("word", "word_index", "identity"), Field("word", "form", "identity"), Field("word", "gloss", "core", filled_when="has_word_gloss"),
    Field("word", "transliterations", "core", applies_when="other_script"), Field("word", "morphological_parse", "core", vacuous_when="single_morpheme"), Field("word", "part_of_speech", "core"), Field("word", "lemma_id", "aux"),
    Field("word", "dict_id", "aux"), Field("word", "head", "aux"), Field("word", "dep_rel", "aux"), Field("word", "comments", "extra"),
    Field("morpheme", "id", "identity"), Field("morpheme", "form", "identity"), Field("morpheme", "gloss", "core"), Field("morpheme", "type", "core"),
    Field("morpheme", "part_of_speech", "aux"), Field("morpheme", "transliterations", "aux"), Field("morpheme", "dict_id", "aux"),
    Field("dict_entry", "id", "identity"), Field("dict_entry", "form", "core"), Field("dict_entry", "type", "core"), Field("dict_entry", "part_of_speech", "core"), Field("dict_entry", "gloss", "core"),
    Field("dict_entry", "homograph", "derived"), Field("lemma", "id", "identity"), Field("lemma", "form", "core"), Field("lemma", "homograph", "derived"),
]
BIBLIOGRAPHIC = {"authors", "content_sources", "content_date", "publisher", "notes"}
UNIVERSAL = ["id", "prov", "prov_history", "field_prov", "record_type", "deleted"]


def of(level: str) -> list[Field]:
    return [f for f in FIELDS if f.level == level]


def counted(level: str) -> list[str]:
    return [f.name for f in of(level) if (f.tier == "core" or f.counted) and not f.planned and not f.container and (f.stored or f.filled_when)]


def trackable(level: str) -> list[str]:
    return [f.name for f in of(level) if f.tier not in ("identity", "derived") and not f.container and not (level == "document" and f.name in BIBLIOGRAPHIC)]


def tracked(level: str, on: list[str], off: list[str]) -> list[str]:
    """Counted fields, with those switched on and without those switched off, in the table's order."""
    want = (set(counted(level)) | (set(on) & set(trackable(level)))) - set(off)
    return [f.name for f in of(level) if f.name in want]


def toggle(level: str, name: str, want: bool, on: list[str], off: list[str]) -> tuple[list[str], list[str]]:
    """The smallest override that makes a field tracked or not."""
    on, off = [x for x in on if x != name], [x for x in off if x != name]
    if want != (name in counted(level)):
        (on if want else off).append(name)
    return on, off


def annotation_keys(level: str) -> list[str]:
    return [f.name for f in of(level) if f.tier not in ("identity", "derived") and not f.control and not f.container and f.stored]


def has_annotation(level: str, schema: dict[str, str]) -> Column:
    """Whether any annotation of a row is filled, for the columns it has; a head that is present counts even if null."""
    out = F.lit(False)
    for name in annotation_keys(level):
        if name in schema:
            out = out | ~morph.is_empty_value(F.col(name), schema[name])
    return out | F.coalesce(F.col("head_present"), F.lit(False)) if "head_present" in schema else out


# What the table's conditions mean: the columns that each needs, and its expression.
CONDITIONS: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "has_word_gloss": (["gloss", "morph_gloss"], lambda: ~morph.blank(F.coalesce(morph.filled(F.col("gloss")), F.col("morph_gloss")))),
    "has_dep_parse": (["dep_parsed"], lambda: F.coalesce("dep_parsed", F.lit(False))),
    "has_words": (["n_words"], lambda: F.coalesce("n_words", F.lit(0)) > 0),
    "single_morpheme": (["n_morphemes"], lambda: F.coalesce("n_morphemes", F.lit(0)) <= 1),
}
#: The column by which a level's punctuation is told and skipped.
FORM_OF = {"word": "form", "morpheme": "word_form"}


def _condition(name: str, have: dict[str, str]) -> Column | None:
    needs, expression = CONDITIONS[name]
    return expression() if set(needs) <= set(have) else None


def _filled(f: Field, have: dict[str, str]) -> Column | None:
    """Whether a row has the field; None where the frame can't tell."""
    if f.filled_when and (rule := _condition(f.filled_when, have)) is not None:
        return rule
    return ~morph.is_empty_value(F.col(f.name), have[f.name]) if f.stored and f.name in have else None


def _asked(level: str, rows: DataFrame, overrides: DataFrame | None) -> tuple[DataFrame, list[tuple[Field, Column, Column, Column]]]:
    """The level's rows without punctuation, and for each field that the frame can tell: tracked, missing, vacuous."""
    rows = rows.where(~is_punct(F.col(FORM_OF[level]))) if level in FORM_OF else rows
    if overrides is not None:
        changed = overrides.select("doc_id", F.col("on").alias("_on"), F.col("off").alias("_off"))
        rows = rows.join(changed, "doc_id", "left")
    have, usual, can = dict(rows.dtypes), counted(level), trackable(level)
    none = F.array().cast("array<string>")
    out = []
    for f in of(level):
        missing = _filled(f, have)
        if missing is None or f.name not in {*usual, *(can if overrides is not None else [])}:
            continue
        tracked = F.lit(f.name in usual)
        if overrides is not None:
            name = F.lit(f"{level}.{f.name}")
            tracked = (tracked | (F.lit(f.name in can) & F.array_contains(F.coalesce("_on", none), name))) & ~F.array_contains(F.coalesce("_off", none), name)
        vacuous = _condition(f.vacuous_when, have) if f.vacuous_when else None
        out.append((f, tracked, ~missing, F.lit(False) if vacuous is None else vacuous))
    return rows, out


def tracked_gaps(levels: dict[str, DataFrame], overrides: DataFrame | None = None, applies: dict[str, bool] | None = None) -> DataFrame:
    """Missing annotation by level and field, one aggregate for each level; which fields count follows from the table.

    levels: rows of each level with the columns that they have; a field that these can't tell isn't reported. overrides
    (doc_id, on, off): fields ("word.lemma_id") that a document tracks besides the table's own, or doesn't. applies: conditions of
    the corpus ("other_script") that fields may hang on; a field that doesn't apply misses nothing, with its real total. What is
    vacuous isn't missing. Punctuation and its morphemes are skipped.
    """
    out = None
    for level, frame in levels.items():
        rows, fields = _asked(level, frame, overrides)
        if not fields:
            continue
        cells = []
        for f, tracked, missing, vacuous in fields:
            counts = (applies or {}).get(f.applies_when, True)
            gone = F.count_if(tracked & missing & ~vacuous) if counts else F.lit(0).cast("long")
            cells.append(F.struct(F.lit(level).alias("level"), F.lit(f.name).alias("field"), gone.alias("missing"), F.count_if(tracked).alias("total"), F.count_if(tracked & missing & vacuous).alias("vacuous"), F.lit(counts).alias("applies"), F.lit(f.name in counted(level)).alias("usual")))
        part = rows.agg(F.array(*cells).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out.where("usual OR total > 0").drop("usual")


def gap_ids(levels: dict[str, DataFrame], fields: list[str], overrides: DataFrame | None = None, applies: dict[str, bool] | None = None) -> DataFrame:
    """(level, field, doc_id, id) of each unit that misses one of the fields asked for ("word.gloss"), by the rules of tracked_gaps."""
    out = None
    for level, frame in levels.items():
        rows, known = _asked(level, frame, overrides)
        for f, tracked, missing, vacuous in known:
            if f"{level}.{f.name}" in fields and (applies or {}).get(f.applies_when, True):
                part = rows.where(tracked & missing & ~vacuous).select(F.lit(level).alias("level"), F.lit(f.name).alias("field"), "doc_id", "id")
                out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frame can tell any of these fields")
    return out


def gaps(words: DataFrame, morphemes: DataFrame, sentences: DataFrame, translit_applies: bool = True) -> DataFrame:
    """The usual report: words, morphemes and sentences by the table's own fields."""
    return tracked_gaps({"word": words, "morpheme": morphemes, "sentence": sentences}, applies={"other_script": translit_applies})


def translit_applies(object_sample: Column, other_sample: Column) -> Column:
    """Transliterations count unless both scripts are known and the same."""
    a, b = keys.detect_script(object_sample), keys.detect_script(other_sample)
    return F.coalesce(a != b, F.lit(True))


def undeclared_keys(lines: DataFrame, column: str, kind: str) -> DataFrame:
    """Keys of JSON records that their kind doesn't declare, with how many records have them."""
    allowed = F.array(*(F.lit(x) for x in dict.fromkeys([*UNIVERSAL, *(f.name for f in of(kind))])))
    return lines.select(F.explode(F.array_except(F.json_object_keys(column), allowed)).alias("key")).groupBy("key").agg(F.count("*").alias("records"))


def coverage(sentences: DataFrame, text: str, translation: str) -> DataFrame:
    """Sentences with text: all, translated, remaining."""
    own = sentences.where(~morph.blank(F.col(text)))
    done = ~morph.blank(F.col(translation))
    return own.agg(F.count("*").alias("total"), F.count_if(done).alias("translated"), F.count_if(~done).alias("remaining"))


def pending(sentences: DataFrame, text: str, translation: str) -> DataFrame:
    return sentences.where(morph.blank(F.col(translation)) & ~morph.blank(F.col(text)))


def untokenised(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    return sentences.join(tokens.select(*SENTENCE).distinct(), SENTENCE, "left_anti")


# Levels of a log from the least to the most serious.
LEVELS = ["WARNING", "ERROR", "CRITICAL"]
#: A closing summary reports errors and is none.
SUMMARY = "^App exited — THIS SESSION RECORDED"


def triage(lines: DataFrame) -> DataFrame:
    """Findings of logs (file, date, level, message), by masked message: how often, when first and last, in how many files, and the most serious level."""
    own = lines.where(F.col("level").isin(LEVELS) & ~F.col("message").rlike(SUMMARY))
    rank = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.col("level"))
    out = own.groupBy(log_signature(F.col("message")).alias("signature")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("file").alias("files"), F.max(rank).alias("_rank"), F.min("message").alias("example"))
    return out.withColumn("level", F.get(F.array(*(F.lit(x) for x in LEVELS)), (F.col("_rank") - 1).cast("int"))).drop("_rank")
