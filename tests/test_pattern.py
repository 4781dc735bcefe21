"""The query language, without a session."""

import pytest

from corpusloom.functions.keys import Fold
from corpusloom.plans.pattern import QueryError, compile_cross, compile_glob, compile_token, java, optional_variants, parse_break


def test_optional_groups():
    assert optional_variants("a(b)c(d)") == ["abcd", "abc", "acd", "ac"]
    assert optional_variants("(a)(a)") == ["aa", "a", ""]
    assert optional_variants("plain") == ["plain"]


def test_globs():
    assert compile_glob("  ") is None
    assert compile_glob("A*").patterns == (r"^a.*\z",)
    assert compile_glob("A*", "gloss").patterns == (r"^A.*\z",)
    assert compile_glob("a.b").patterns == (r"^a\.b\z",)
    assert compile_glob("I*", fold=Fold("tr")).patterns == (r"^ı.*\z",)


def test_regex():
    assert compile_token("^a.+$", regex=True).patterns == (r"^a.+\z",)
    assert compile_token(r"\bx", regex=True).warns_ascii
    with pytest.raises(QueryError):
        compile_token("(", regex=True)
    assert java("[$\\s]\\u00e9$") == r"[$\s\p{Z}\x{FEFF}]\x{00e9}\z"
    assert java(r"\p{Script=Latin}") == r"\p{IsLatin}"


def test_breaks():
    assert parse_break("a b").segments == ("a b",)
    b = parse_break("<BREAK> a <BREAK> b <BREAK>")
    assert b.segments == ("a", "b") and b.initial and b.final and b.breaks
    assert parse_break(r"\<BREAK> x").segments == ("<BREAK> x",)
    for bad in ("a <BREAK><BREAK> b", "<BREAK>", "<BREAK> <BREAK>"):
        with pytest.raises(QueryError):
            parse_break(bad)


def test_cross():
    assert compile_cross("a* (b)").patterns[0].startswith("a.*") and r"\(b\)" in compile_cross("a* (b)").patterns[0]
    assert compile_cross("") is None
