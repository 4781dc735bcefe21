"""Segmentation and normalisation of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal marks, and the closing quotes and brackets that go with them.
TERMINALS = r".!?\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{06D4}\x{0964}\x{0965}\x{1362}\x{0F0D}\x{0589}\x{104B}\x{17D4}\x{1803}\x{1809}\x{0DF4}"
CLOSERS = r"\x{201C}\x{201D}\x{2018}\x{2019})\]\x{300F}\x{300D}\x{3009}\x{300B}\x{FF09}\x{00BB}"
# Characters that join two word characters into one token.
JOINERS = r"\-.'\x{2019}\x{02BC}\x{2010}\x{2011}"

WORD = r"[\p{L}\p{N}\p{M}]"
# Possessive loops: Java runs them without recursion, so that a line of any length fits the stack.
TOKEN = rf"{WORD}++(?:[{JOINERS}]{WORD}++)*+|[^\s\p{{Z}}]"
# Java asks a class member by member, so runs of ASCII and of Latin letters go by short classes and only other characters by the whole one.
INNER = rf"(?:[^\n.!?\x{{80}}-\x{{10FFFF}}]++|[\x{{80}}-\x{{2FF}}]++|[^\n{TERMINALS}])*+"
SENTENCE = rf"{INNER}(?:(?<=\p{{Nd}})\.(?=\p{{Nd}}){INNER})*+(?:[{TERMINALS}][{CLOSERS}]*+|(?=\n)|\z)"
# White space and separators, which strip takes off both ends.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Printable ASCII, which strip leaves; what ends sentences and words first.
PRINTABLE = ".!?" + "".join(c for c in map(chr, range(ord("~"), ord(" "), -1)) if c not in ".!?")
# Text without any of these is composed already: no letter below U+0300 and no usual mark of punctuation changes.
UNCOMPOSED = r"[\x{300}-\x{1FFF}\x{2000}\x{2001}\x{2100}-\x{10FFFF}]"
# Text that composition, line ends, controls and blank lines leave as it is, told in one pass.
NORMAL = r"^(?:[\x{20}-\x{7E}]++|\n(?!\n\n)|[\t\x{A0}-\x{2FF}\x{2002}-\x{20FF}])*+\z"

# Heading words of several languages.
ORDINALS = (
    "(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    r"twenty(?:\s*(?:one|two|three|four|five|six|seven|eight|nine))?|thirty|forty|fifty|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)"
)
HEADING = (
    rf"(?iu)^(?:(?:chapter|section|part)\s+(?:[\divxlc]+|{ORDINALS})|prologue|epilogue|introduction|conclusion|preface|appendix(?:\s+\w+)?|"
    r"제\s*\d+\s*[장절편]|第\s*[一二三四五六七八九十百\d]+\s*[章節]|bölüm\s+\d+|kısım\s+\d+|[\divxlc]+\.\s)"
)


def _icu(method: str, c: Column) -> Column:
    """Canonical composition or decomposition by the ICU library that Spark ships for its collations."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(False))


def nfc(c: Column) -> Column:
    """Canonical composition; only text that may change is composed."""
    return F.when(c.rlike(UNCOMPOSED), _icu("compose", c)).otherwise(c)


def fold_diacritics(c: Column) -> Column:
    """Decompose, drop combining marks U+0300 to U+036F, lower-case."""
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_icu("decompose", c), r"[\x{300}-\x{36F}]", "")).otherwise(c))


def strip(c: Column) -> Column:
    """Without outer space. Taking it off the end walks over the whole text, so it is done only where the last character isn't printable ASCII."""
    return F.when(F.lit(PRINTABLE).contains(F.substring(c, -1, 1)), F.ltrim(c, F.lit(SPACES))).otherwise(F.trim(c, F.lit(SPACES)))


def normalize_text(c: Column, compose: bool = True) -> Column:
    """No byte-order mark, NFC, LF line ends, no controls but tab and newline, at most one blank line, no outer space."""
    out = F.regexp_replace(c, r"^\x{FEFF}+", "")
    out = nfc(out) if compose else out
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]", "")
    return strip(F.when(c.rlike(NORMAL), c).otherwise(F.regexp_replace(out, r"\n{3,}", "\n\n")))


def is_heading(c: Column) -> Column:
    """A line that names a section: heading words, or a short line in capitals."""
    capitals = (F.upper(c) == c) & (F.lower(c) != c) & F.char_length(c).between(3, 60) & ~c.endswith(".")
    return (c != "") & (F.char_length(c) <= 80) & (c.rlike(HEADING) | capitals)


def split_paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines; lines within one are joined by a space."""
    joined = F.transform(F.split(c, r"\n[ \t]*\n+"), lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\n"), strip), lambda s: s != ""), " "))
    return F.filter(joined, lambda p: p != "")


def split_sections(lines: Column, heads: Column) -> Column:
    """Sections (title, body) between the headings among a text's lines; heads are their places, counted from 0.

    A heading ends the section before; one without a body is dropped, though its title goes when the next heading comes.
    Both arguments should be columns of a frame: each is read for every section.
    """
    edges = F.concat(F.array(F.lit(-1)), heads)
    stops = F.concat(heads, F.array(F.size(lines)))
    cut = F.arrays_zip(edges.alias("a"), stops.alias("b"))
    body = lambda e: strip(F.array_join(F.slice(lines, e["a"] + 2, e["b"] - e["a"] - 1), "\n"))
    return F.filter(F.transform(cut, lambda e: F.struct(F.when(e["a"] >= 0, strip(F.get(lines, e["a"]))).alias("title"), body(e).alias("body"))), lambda s: s["body"] != "")


def heading_places(lines: Column) -> Column:
    """Places of a text's headings among its lines."""
    marked = F.transform(F.transform(lines, strip), lambda x, i: F.when(is_heading(x), i).otherwise(F.lit(-1)))
    return F.filter(marked, lambda i: i >= 0)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def text_uses_spaces(c: Column) -> Column:
    return c.rlike(r"(?U)\S\s+\S")


def tokenize(c: Column) -> Column:
    """Words and marks; texts without spaces between words give none."""
    return F.when(text_uses_spaces(c) | (c.rlike(rf"^{WORD}") & ~c.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsKhmer}]")), F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def punct_gloss(form: Column) -> Column:
    """PUNCT for a token without any word character."""
    return F.when(~form.rlike(WORD), F.lit("PUNCT"))


def norm_punct(c: Column) -> Column:
    """Without punctuation and symbols, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{P}\p{S}]", ""), r"(?U)\s+", " "))


def norm_token(form: Column) -> Column:
    """norm_punct of a token, which holds no space; most tokens need no replacement."""
    return F.when(form.rlike(r"[\p{P}\p{S}]"), F.regexp_replace(form, r"[\p{P}\p{S}]", "")).otherwise(form)


def is_punct(c: Column) -> Column:
    within = lambda first, after: (c >= first) & (c < after)  # noqa: E731 - most tokens start with a letter or digit of ASCII, which comparisons tell
    return F.when(within("a", "{") | within("A", "[") | within("0", ":"), F.lit(False)).otherwise(F.coalesce(c, F.lit("")).rlike(r"^[^\p{L}\p{N}]+\z"))


#: Letters whose upper case is several: here a letter has one upper case at most, so that no length changes.
_SEVERAL = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1]
_KEPT = "".join(map(chr, range(0xF0000, 0xF0000 + len(_SEVERAL))))
_SINGLE = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def upper_single(c: Column) -> Column:
    """Upper case, letter by letter."""
    several = "".join(_SEVERAL)
    return F.when(c.rlike(f"[{several}]"), F.translate(F.upper(F.translate(c, several, _KEPT)), _KEPT, _SINGLE)).otherwise(F.upper(c))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.substring(s, 1, 64)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("corpus")).otherwise(s)


def has_rtl(c: Column) -> Column:
    return c.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")


def log_signature(c: Column) -> Column:
    """A log line with addresses, paths, ids and numbers masked."""
    for pattern, mark in ((r"https?://\S+", "<url>"), (r"(?:[A-Za-z]:)?(?:[/\\][\w.\-]+){2,}", "<path>"), (r"\b[0-9a-fA-F]{8,}\b", "<id>"), (r"\d+", "<n>")):
        c = F.regexp_replace(c, pattern, mark)
    return c
