"""Token patterns: wildcards, optional groups, regular expressions and boundary marks, compiled to Java patterns.

Compilation is plain Python on the driver and raises QueryError; nothing here needs a session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import Fold, dict_key

BREAK = "<BREAK>"
# Dotted and dotless I are their own letters under case-insensitive comparison: both sides map them aside.
ASIDE_FROM, ASIDE_TO = "İı", "\ue000\ue001"


class QueryError(ValueError):
    """A query that can't be compiled."""


def aside(c: Column) -> Column:
    return F.translate(c, ASIDE_FROM, ASIDE_TO)


def escape(text: str) -> str:
    return re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", text)


def java(pattern: str) -> str:
    """A JavaScript pattern as Java reads it: \\s is Unicode-wide, $ is the very end, and dots stop at line ends only."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            u = re.match(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})", pattern[i:])
            if u:
                out.append(rf"\x{{{u[1] or u[2]}}}")
                i += len(u[0])
                continue
            script = re.match(r"\\([pP])\{Script=(\w+)\}", pattern[i:])
            if script:
                out.append(rf"\{script[1]}{{Is{script[2]}}}")
                i += len(script[0])
                continue
            out.append({r"\s": r"\s\p{Z}\x{FEFF}" if inside else r"[\s\p{Z}\x{FEFF}]", r"\S": r"[^\s\p{Z}\x{FEFF}]"}.get(two, two))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def check(pattern: str) -> None:
    """Raise for what is no pattern. Python's own compiler stands in, without property classes."""
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}", "x", re.sub(r"\\x\{[0-9A-Fa-f]+\}", "x", pattern)).replace(r"\z", "$"))
    except re.error as e:
        raise QueryError(f"invalid pattern: {e}") from e


def optional_variants(text: str) -> list[str]:
    """Each (x) present and absent; groups don't nest."""
    todo, out = [text], []
    while todo:
        s = todo.pop(0)
        m = re.search(r"\(([^)]*)\)", s)
        if m:
            todo[:0] = [s[: m.start()] + m[1] + s[m.end() :], s[: m.start()] + s[m.end() :]]
        elif s not in out:
            out.append(s)
    return out


@dataclass(frozen=True)
class Token:
    """A compiled token query: tests a raw column, and for object language its key."""

    patterns: tuple[str, ...]
    folded: bool = False
    fold: Fold = field(default_factory=Fold)
    sensitive: bool = False
    regex: bool = False
    warns_ascii: bool = False

    def matches(self, raw: Column, key: Column | None = None) -> Column:
        """Whether a value matches; null counts as blank. key: the value's key where the table holds it."""
        raw = F.coalesce(raw, F.lit(""))
        if self.folded:
            subject = key if key is not None else dict_key(raw, self.fold)
            whole = [p for p in self.patterns if re.fullmatch(r"\^(?:[^.+?*${}()|\[\]\\^]|\\.)*\\z", p)]
            if len(whole) == len(self.patterns):  # no wildcard: equality, which a scan can use
                return subject.isin([re.sub(r"\\(.)", r"\1", p[1:-2]) for p in whole])
            prefix = [re.fullmatch(r"\^((?:[^.+?*${}()|\[\]\\^]|\\.)+)\.\*\\z", p) for p in self.patterns]
            if all(prefix):
                out = F.lit(False)
                for m in prefix:
                    out = out | subject.startswith(re.sub(r"\\(.)", r"\1", m[1]))
                return out
            return subject.rlike("|".join(f"(?:{p})" for p in self.patterns))
        joined = "|".join(f"(?:{p})" for p in self.patterns)
        if self.sensitive:
            return raw.rlike(joined)
        return aside(raw).rlike("(?iu)" + joined.translate(str.maketrans(ASIDE_FROM, ASIDE_TO)))


def compile_glob(text: str, field_name: str = "text", fold: Fold = Fold(), sensitive: bool = False) -> Token | None:
    """A whole-token pattern: * is any run, (x) is optional; None for a blank query."""
    text = text.strip()
    if not text:
        return None
    folds = field_name == "text" and not sensitive
    variants = optional_variants(text)
    if folds:
        variants = [fold_text(v, fold) for v in variants]
    patterns = tuple(rf"^{escape(v).replace('*', '.*')}\z" for v in dict.fromkeys(variants))
    return Token(patterns, folds, fold, sensitive)


def fold_text(text: str, fold: Fold) -> str:
    """dict_key for a pattern, on the driver."""
    import unicodedata

    from ..functions import keys

    s = unicodedata.normalize("NFC", text)
    if fold.script == "Arab":
        s = re.sub(r"[\u064B-\u065F\u0670\u06D6-\u06ED\u0640]", "", s).translate(str.maketrans(keys.ARABIC_FROM, keys.ARABIC_TO))
    elif fold.script == "Hebr":
        s = re.sub(r"[\u0591-\u05BD\u05BF\u05C1\u05C2\u05C4\u05C5\u05C7]", "", s)
    elif fold.script == "Deva":
        for whole, base in keys.NUKTA.items():
            s = s.replace(chr(whole), chr(base) + "\u093c")
    elif fold.script == "Jpan":
        s = re.sub("[\uff61-\uff9f]+", lambda m: unicodedata.normalize("NFKC", m[0]), s)
    if fold.locale in ("tr", "az"):
        s = s.replace("I", "ı").replace("İ", "i")
    elif fold.locale == "lt":
        s = re.sub(keys.DOTTED, f"\\1{keys.DOT}", s)
        for whole, parts in keys.LT_WHOLE.items():
            s = s.replace(whole, parts)
    return unicodedata.normalize("NFC", s.lower())


def compile_token(text: str, field_name: str = "text", regex: bool = False, sensitive: bool = False, fold: Fold = Fold()) -> Token | None:
    """A glob, or a raw pattern: unanchored, never folded, always case-insensitive."""
    if not regex:
        return compile_glob(text, field_name, fold, sensitive)
    if not text.strip():
        return None
    pattern = java(text)
    check(pattern)
    return Token((pattern,), regex=True, warns_ascii=bool(re.search(r"\\[wWbB]", text)))


def compile_cross(text: str, regex: bool = False, sensitive: bool = False) -> Token | None:
    """Tokens with any white space between them, unanchored, for whole sentences."""
    if not text.strip():
        return None
    if regex:
        pattern = java(text)
        check(pattern)
    else:
        pattern = r"[\s\p{Z}\x{FEFF}]+".join(escape(t).replace("*", ".*") for t in text.split())
    return Token((pattern,), sensitive=sensitive, regex=regex)


@dataclass(frozen=True)
class Broken:
    """A query cut at <BREAK>."""

    segments: tuple[str, ...]
    initial: bool = False
    final: bool = False
    breaks: bool = False


def parse_break(text: str) -> Broken:
    """<BREAK> cuts, \\<BREAK> is literal; at an edge it anchors to the sentence's edge."""
    guard = "\x00"
    parts = [p.replace(guard, BREAK).strip() for p in text.replace("\\" + BREAK, guard).split(BREAK)]
    if len(parts) == 1:
        return Broken((parts[0],))
    if any(p == "" for p in parts[1:-1]):
        raise QueryError("two <BREAK> in a row")
    initial, final = parts[0] == "", parts[-1] == ""
    segments = tuple(p for i, p in enumerate(parts) if not (i == 0 and initial) and not (i == len(parts) - 1 and final))
    if not segments:
        raise QueryError("<BREAK> without a token")
    return Broken(segments, initial, final, True)
