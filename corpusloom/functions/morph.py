"""Glosses, readings and parses of words from their morphemes; these are computed and never stored.

Morphemes are an array of structs in order; transliterations an array of (label, text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def filled(c: Column) -> Column:
    return F.when(~blank(c), c)


def is_empty_value(c: Column, kind: str) -> Column:
    """Null, a blank string, an empty array or an empty map, by the column's type."""
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return blank(c) if kind == "string" else c.isNull()


def join_present(values: Column) -> Column:
    """'-'-join of the values that are filled, null if none is."""
    joined = F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), "-")
    return F.get(F.filter(F.array(joined), lambda x: x != ""), F.lit(0))  # worked out once, where a condition on it would do so again


def word_gloss(gloss: Column, morpheme_glosses: Column, gaps: bool = False) -> Column:
    """The stored gloss, else the morphemes' glosses joined; gaps marks empty places, if any place is filled."""
    if not gaps:
        return F.coalesce(filled(gloss), join_present(morpheme_glosses))
    marked = F.array_join(F.transform(morpheme_glosses, lambda g: F.coalesce(filled(g), F.lit("???"))), "-")
    return F.coalesce(filled(gloss), F.when(F.exists(morpheme_glosses, lambda g: F.coalesce(g, F.lit("")) != ""), marked))


def reading(elements: Column, label: Column | None) -> Column:
    """The first element's text, of the label if one is given."""
    of = lambda t: F.coalesce(t["text"], F.lit("")) != ""
    return F.get(F.filter(elements, of if label is None else lambda t: (F.coalesce(t["label"], F.lit("")) == label) & of(t)), F.lit(0))["text"]


def word_translit(elements: Column, morphemes: Column, label: Column | None = None) -> Column:
    """The word's own reading, else the morphemes' readings of one label joined; morphemes without it are skipped."""
    return F.coalesce(reading(elements, label), join_present(F.transform(morphemes, lambda m: reading(m["transliterations"], label))))


def translit_texts(elements: Column, morphemes: Column, label: str | None = None) -> Column:
    """All readings a search tests, without hyphens: own elements, and the derived one of each label."""
    plain = lambda t: F.replace(t, F.lit("-"), F.lit(""))
    of = lambda t: F.coalesce(t["text"], F.lit("")) != ""
    if label not in (None, "any"):
        own = F.filter(elements, lambda t: of(t) & (F.coalesce(t["label"], F.lit("")) == label))
        derived = F.array(word_translit(elements, morphemes, F.lit(label)))
    else:
        own = F.filter(elements, of)
        labels = F.array_distinct(F.filter(F.concat(F.transform(elements, lambda t: t["label"]), F.flatten(F.transform(morphemes, lambda m: F.transform(m["transliterations"], lambda t: t["label"])))), lambda x: F.coalesce(x, F.lit("")) != ""))
        # Without a label, one reading of any; the labels are worked out once, where a condition on their number would do so again.
        some = F.get(F.filter(F.array(labels, F.array(F.lit(""))), lambda x: F.size(x) > 0), F.lit(0))
        derived = F.transform(some, lambda x: F.when(x == "", word_translit(elements, morphemes)).otherwise(word_translit(elements, morphemes, x)))
    every = F.concat(F.transform(own, lambda t: t["text"]), derived)
    return F.array_distinct(F.filter(F.transform(every, plain), lambda x: F.coalesce(x, F.lit("")) != ""))


def join_parse(forms: Column) -> Column:
    return F.when(F.size(forms) > 1, F.array_join(forms, "-"))


def mono_morpheme(forms: Column) -> Column:
    return F.coalesce(F.size(forms), F.lit(0)) == 1


def lemma_root(form: Column, morphemes: Column) -> Column:
    """The first morpheme that isn't bound, or the form where there are none."""
    free = F.get(F.filter(morphemes, lambda m: F.coalesce(m["type"], F.lit("")) != "bound.morpheme"), F.lit(0))["form"]
    return F.coalesce(free, form)


# Citation rules by language and part of speech. A rule is a suffix, or a suffix by class of the last vowel.
CITATION = {
    "tr": {
        "vowels": {"back": "aıouâû", "front": "eiöü"},
        "pos": {"VERB": {"back": "mak", "front": "mek"}, "AUX": {"back": "mak", "front": "mek"}, "NOUN": "", "PROPN": "", "ADJ": "", "ADV": "", "NUM": "", "PRON": ""},
    },
    "zh": {"pos": {}},
    "en": {"pos": {"VERB": "", "NOUN": "", "ADJ": "", "ADV": ""}},
}


def citation_form(root: Column, pos: Column, language: str) -> Column:
    """How a lemma is written, from its root; null where no rule applies."""
    spec = CITATION.get(language) or CITATION.get(language.split("-")[0]) or {"pos": {}}
    out = F.lit(None).cast("string")
    vowels = spec.get("vowels", {})
    last = F.regexp_extract(F.reverse(F.lower(root)), f"([{''.join(vowels.values())}])", 1) if vowels else None
    for tag, rule in spec["pos"].items():
        if isinstance(rule, str):
            value = F.concat(root, F.lit(rule))
        else:
            value = F.lit(None).cast("string")
            for name, suffix in rule.items():
                value = F.when((last != "") & F.contains(F.lit(vowels[name]), last), F.concat(root, F.lit(suffix))).otherwise(value)
        out = F.when(pos == tag, value).otherwise(out)
    return F.when(~blank(root), out)


def fold_value(c: Column, field: str) -> Column:
    """The case that a field is stored in: parts of speech upper, types lower."""
    return {"part_of_speech": F.upper, "type": F.lower}.get(field, lambda x: x)(c)


def selection_label(selects: Column) -> Column:
    """Lower-cased category and relation of each, joined by ' + '."""
    return F.array_join(F.transform(F.filter(selects, lambda s: ~blank(s["category"])), lambda s: F.trim(F.concat_ws(" ", F.lower(s["category"]), s["relation"]))), " + ")


def selection_canonical(frames: Column) -> Column:
    """Frames as JSON with keys in one order; frames without a category go."""
    kept = F.filter(F.transform(frames, lambda f: F.struct(f["label"].alias("label"), f["notes"].alias("notes"), F.transform(F.filter(f["selects"], lambda s: ~blank(s["category"])), lambda s: F.struct(s["category"].alias("category"), s["relation"].alias("relation"), s["status"].alias("status"))).alias("selects"))), lambda f: F.size(f["selects"]) > 0)
    return F.to_json(kept)
