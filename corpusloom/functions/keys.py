"""Matching keys: how a form is compared, by locale and script. All are expressions, so they also work inside lambdas."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, nfc

# Locales whose lower case differs, and scripts in the order they are looked for.
TAILORED = {"tr": "tr", "az": "az", "lt": "lt"}
SCRIPTS = {
    "Arab": "IsArabic", "Hebr": "IsHebrew", "Deva": "IsDevanagari", "Hang": "IsHangul", "Grek": "IsGreek", "Cyrl": "IsCyrillic",
    "Thai": "IsThai", "Armn": "IsArmenian", "Taml": "IsTamil", "Telu": "IsTelugu", "Latn": "IsLatin",
}
# Marks dropped and letters unified for Arabic and Hebrew script; Devanagari nukta letters.
ARABIC_MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
ARABIC_FROM, ARABIC_TO = "آأإٱیىک", "ااااييك"
HEBREW_MARKS = r"[\x{0591}-\x{05BD}\x{05BF}\x{05C1}\x{05C2}\x{05C4}\x{05C5}\x{05C7}]"
NUKTA = {0x0958: 0x0915, 0x0959: 0x0916, 0x095A: 0x0917, 0x095B: 0x091C, 0x095C: 0x0921, 0x095D: 0x0922, 0x095E: 0x092B, 0x095F: 0x092F}


@dataclass(frozen=True)
class Fold:
    """How a corpus compares forms; both come from the corpus and travel as an argument."""

    locale: str | None = None
    script: str | None = None


# Half-width kana and marks, their full-width characters by Unicode's own table, and kana that a voicing mark joins.
HALF = "".join(map(chr, range(0xFF61, 0xFFA0)))
WIDE = "".join(unicodedata.normalize("NFKC", c) for c in HALF)
VOICED = [(base + mark, whole) for mark in "\u3099\u309a" for base in WIDE[5:-2] if len(whole := unicodedata.normalize("NFC", base + mark)) == 1]
# Lithuanian keeps the dot above i, j and i with ogonek before a grave, acute or tilde accent.
DOTTED, DOT = "([IJ\u012e])(?=[\u0300-\u036f]*[\u0300\u0301\u0303])", "\u0307"
LT_WHOLE = {"\u00cc": "i\u0307\u0300", "\u00cd": "i\u0307\u0301", "\u0128": "i\u0307\u0303"}


def _wide_kana(c: Column) -> Column:
    """Half-width kana in full width, with their voicing marks joined."""
    out = F.translate(c, HALF, WIDE)
    for parts, whole in VOICED:
        out = F.replace(out, F.lit(parts), F.lit(whole))
    return F.when(c.rlike("[\uff61-\uff9f]"), out).otherwise(c)


def _lower_lt(c: Column) -> Column:
    out = F.regexp_replace(c, DOTTED, f"$1{DOT}")
    for whole, parts in LT_WHOLE.items():
        out = F.replace(out, F.lit(whole), F.lit(parts))
    return F.lower(out)


def detect_script(c: Column) -> Column:
    head = F.substring(F.coalesce(c, F.lit("")), 1, 4000)
    out = F.when(head.rlike(r"[\x{3040}-\x{30FF}\x{FF61}-\x{FF9F}]"), "Jpan").when(head.rlike(r"\p{IsHan}"), "Hans")
    for code, block in SCRIPTS.items():
        out = out.when(head.rlike(rf"\p{{{block}}}"), code)
    return out


def fold_context(language: str | None, script: str | None) -> Fold:
    import re

    return Fold(TAILORED.get(re.split("[-_]", (language or "").lower())[0]), script)


def lower(c: Column, locale: str | None = None) -> Column:
    if locale in ("tr", "az"):
        return F.lower(F.translate(c, "Iİ", "ıi"))
    return _lower_lt(c) if locale == "lt" else F.lower(c)


def script_fold(c: Column, script: str | None) -> Column:
    if script == "Arab":
        return F.translate(F.regexp_replace(c, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    if script == "Hebr":
        return F.regexp_replace(c, HEBREW_MARKS, "")
    if script == "Deva":
        for whole, base in NUKTA.items():
            c = F.replace(c, F.lit(chr(whole)), F.lit(chr(base) + "\u093c"))
        return c
    return _wide_kana(c) if script == "Jpan" else c


def dict_key(c: Column, fold: Fold = Fold(), compose: bool = False) -> Column:
    """The key of an object-language form. Tables made at ingest are composed already; pass compose for others."""
    c = F.coalesce(c, F.lit(""))
    out = lower(script_fold(nfc(c) if compose else c, fold.script), fold.locale)
    return nfc(out) if compose else out


def norm_meta(c: Column, compose: bool = False) -> Column:
    """The key of a gloss, tag or definition: default lower case."""
    return F.lower(nfc(c) if compose else c)


def sent_key(c: Column, fold: Fold = Fold()) -> Column:
    """Words of a sentence, folded, with single spaces; '' without any."""
    words = F.regexp_extract_all(c, F.lit(f"{WORD}++"), F.lit(0))
    if fold.script == "Jpan":  # there a word's fold depends on the whole word
        return F.array_join(F.transform(words, lambda w: dict_key(w, fold)), " ")
    return lower(script_fold(F.array_join(words, " "), fold.script), fold.locale)
