"""Search: one specification, routed to the plan that answers it.

A hit is a row: the positions of its sentences and of its matched words. Plans are lazy and in corpus order only where a
cap asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import PARAGRAPH, SENTENCE, Corpus
from ..functions import morph
from ..functions import text as T
from ..functions.keys import dict_key
from .pattern import BREAK, QueryError, Token, compile_cross, compile_token, parse_break


@dataclass(frozen=True)
class Search:
    query: str
    field: str = "text"
    level: str = "word"
    cross: bool = False
    regex: bool = False
    sensitive: bool = False
    label: str | None = None
    cap: int | None = None


def capped(hits: DataFrame, cap: int | None) -> DataFrame:
    keys = [c for c in (*SENTENCE, "word_pos", "g") if c in hits.columns]
    return hits if cap is None else hits.orderBy(*keys).limit(cap)


def _value(tokens: DataFrame, field: str, label: str | None, q: Token, item: Column | None = None) -> Column:
    """Whether a word (or an item of its morphemes) matches; fields that aren't text or gloss mean readings."""
    get = (lambda c: item[c]) if item is not None else F.col
    if field == "text":
        return q.matches(get("form"), F.col("form_key") if item is None else dict_key(item["form"], q.fold))
    if field == "gloss":
        gloss = get("gloss") if item is not None else (morph.word_gloss(F.col("gloss"), F.transform("morphemes", lambda m: m["gloss"])) if "morphemes" in tokens.columns else F.col("gloss"))
        return q.matches(gloss)
    none = F.array().cast("array<struct<form:string,gloss:string,type:string,transliterations:array<struct<label:string,text:string>>>>")
    own, parts = get("transliterations"), F.col("morphemes") if item is None and "morphemes" in tokens.columns else none
    # All that a word of one morpheme can be read as is written in it or in that morpheme; only where one of these matches is the choice made.
    plain = lambda t: q.matches(F.replace(t["text"], F.lit("-"), F.lit("")))
    possible = F.coalesce((F.size(parts) > 1) | F.exists(own, plain) | F.exists(F.get(parts, F.lit(0))["transliterations"], plain), F.lit(True))
    return possible & F.exists(morph.translit_texts(own, parts, label), lambda t: q.matches(t))


def token_matches(tokens: DataFrame, q: Token, field: str = "text", level: str = "word", label: str | None = None) -> Column:
    if level == "word":
        return _value(tokens, field, label, q)
    return F.coalesce(F.exists("morphemes", lambda m: _value(tokens, field, label, q, m)), F.lit(False))


def worked_out(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """The tokens with these columns as values: a filter that reads a column several times would otherwise make it as often."""
    own = [c for c in columns if c in tokens.columns]
    rest = [c for c in tokens.columns if c not in own]
    return tokens.select(*rest, F.explode(F.array(F.struct(*own))).alias("_own")).select(*rest, *(F.col(f"_own.{c}").alias(c) for c in own)) if own else tokens


def matched_tokens(tokens: DataFrame, q: Token, field: str = "text", level: str = "word", label: str | None = None) -> DataFrame:
    rows = tokens if field in ("text", "gloss") else worked_out(tokens, ["transliterations", "morphemes"])
    return rows.where(token_matches(rows, q, field, level, label))


def search_token(tokens: DataFrame, q: Token, field: str = "text", level: str = "word", label: str | None = None, cap: int | None = None) -> DataFrame:
    """A hit for each sentence with a match, with the matched words in order."""
    hits = matched_tokens(tokens, q, field, level, label).groupBy(*SENTENCE).agg(F.sort_array(F.collect_list("word_pos")).alias("words"))
    return capped(hits, cap)


def search_lemma(tokens: DataFrame, lemmas: DataFrame, entries: DataFrame, q: Token, cap: int | None = None) -> DataFrame:
    """Tokens that cite a lemma whose form matches, or whose form is one of its entries'."""
    found = lemmas.where(q.matches(F.col("form"))).select(F.col("id").alias("lemma_id")).distinct()
    forms = entries.join(found, "lemma_id", "left_semi").select(dict_key(F.col("form"), q.fold).alias("form_key")).distinct()
    rows = tokens.select(*SENTENCE, "word_pos", "lemma_id", "form_key")
    # One pass, in which few lemmas and forms go to the tokens, whatever the size of the tables that they are chosen from.
    cited = rows.join(_few(found.withColumn("_cited", F.lit(True))), "lemma_id", "left").join(_few(forms.withColumn("_formed", F.lit(True))), "form_key", "left")
    both = cited.where("_cited OR _formed")
    return capped(both.groupBy(*SENTENCE).agg(F.sort_array(F.collect_set("word_pos")).alias("words")), cap)


#: Rows of a small table that may go to all executors at once.
FEW = 200_000


def _few(keys: DataFrame) -> DataFrame:
    """A table for a join with tokens: broadcast if it is small, else merged."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys.hint("merge")


def search_sentence(sentences: DataFrame, candidates: Column, q: Token, cap: int | None = None) -> DataFrame:
    """Sentences one of whose strings matches, and the first that does."""
    # A list of one or none to explode, so that candidates are made once, where a filter on the first would do so again.
    hit = F.slice(F.filter(candidates, lambda c: (c != "") & q.matches(c)), 1, 1)
    return capped(sentences.select(*SENTENCE, F.explode(hit).alias("matched")), cap)


def with_candidates(corpus: Corpus, field: str, label: str | None = None) -> tuple[Corpus, Column]:
    """The corpus with the strings that a sentence search of another field tests, and their column.

    gloss: the words' glosses in order. translit: the words' readings without hyphens, a string for each label with 'any'.
    translation: each translation (an array of structs with text) without punctuation.
    """
    if field == "translation":
        strings = F.transform("translations", lambda t: T.norm_punct(t["text"]))
        return replace(corpus, sentences=corpus.sentences.withColumn("candidates", strings), tokens=lambda: corpus.tokens), F.col("candidates")
    words = corpus.tokens
    one = lambda name, value: F.struct(F.coalesce(name, F.lit("")).alias("label"), F.col("word_pos"), value.alias("value"))
    if field == "gloss":
        value = morph.word_gloss(F.col("gloss"), F.transform("morphemes", lambda m: m["gloss"])) if "morphemes" in words.columns else F.col("gloss")
        strings = F.array(one(F.lit(""), value))
    else:
        words = worked_out(words, ["transliterations", "morphemes"])
        value = lambda x: one(F.lit(None).cast("string") if x is None else x, F.replace(morph.word_translit(F.col("transliterations"), F.col("morphemes"), x), F.lit("-"), F.lit("")))
        labels = F.array_distinct(F.concat(F.transform("transliterations", lambda t: t["label"]), F.flatten(F.transform("morphemes", lambda m: F.transform(m["transliterations"], lambda t: t["label"])))))
        strings = F.transform(labels, value) if label == "any" else F.array(value(F.lit(label) if label else None))
    # One shuffle: a word's strings go to its sentence together, and there each label's are joined.
    filled = F.filter(strings, lambda s: F.coalesce(s["value"], F.lit("")) != "")
    rows = words.select(*SENTENCE, F.explode(F.filter(F.array(filled), lambda w: F.size(w) > 0)).alias("w"))
    found = rows.groupBy(*SENTENCE).agg(F.sort_array(F.flatten(F.collect_list("w"))).alias("w"))
    joined = F.transform(F.array_distinct(F.transform("w", lambda s: s["label"])), lambda x: F.array_join(F.transform(F.filter("w", lambda s: s["label"] == x), lambda s: s["value"]), " "))
    return replace(corpus, sentences=found.select(*SENTENCE, joined.alias("candidates")), tokens=lambda: corpus.tokens), F.col("candidates")


def _neighbours(sentences: DataFrame, candidates: Column) -> DataFrame:
    order = Window.partitionBy(*PARAGRAPH).orderBy("sent_pos")
    rows = sentences.select(*SENTENCE, F.filter(candidates, lambda c: c != "").alias("v1"))
    rows = rows.withColumns({"next_pos": F.lead("sent_pos").over(order), "v2": F.lead("v1").over(order)})
    return rows.where("next_pos is not null")


def _first_pair(rows: DataFrame, test) -> DataFrame:
    pairs = F.flatten(F.transform("v1", lambda a: F.transform("v2", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    hit = F.get(F.filter(pairs, lambda p: test(p["a"], p["b"])), F.lit(0))
    return rows.withColumn("hit", hit).where("hit is not null").select(*SENTENCE, "next_pos", F.col("hit.a").alias("first"), F.col("hit.b").alias("second"))


def search_cross_sentence(sentences: DataFrame, candidates: Column, q: Token, cap: int | None = None) -> DataFrame:
    """Neighbouring sentences of a paragraph that match together."""
    return capped(_first_pair(_neighbours(sentences, candidates), lambda a, b: q.matches(F.concat(a, F.lit("\n"), b))), cap)


def search_cross_split(sentences: DataFrame, candidates: Column, left: Token | None, right: Token | None, cap: int | None = None) -> DataFrame:
    """Neighbouring sentences of which the first matches one pattern and the second the other; a missing one is free."""
    yes = F.lit(True)
    return capped(_first_pair(_neighbours(sentences, candidates), lambda a, b: (left.matches(a) if left else yes) & (right.matches(b) if right else yes)), cap)


def _by_place(tokens: DataFrame, tests: list[Column], strict: bool, breaks: frozenset[int]) -> DataFrame:
    """Matches as groups: a word that matches slot i at place c votes for a match that starts at c - i; one with all votes is a hit."""
    n = len(tests)
    vote = lambda i: F.struct(F.lit(i).alias("i"), "sent_pos", "g", "is_first", "is_last")
    votes = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), vote(i)) for i, t in enumerate(tests))), lambda v: v.isNotNull())
    rows = tokens.where(~F.col("is_punct")).select(*PARAGRAPH, "c", F.explode(votes).alias("v"))
    found = rows.groupBy(*PARAGRAPH, (F.col("c") - F.col("v.i")).alias("start")).agg(F.array_sort(F.collect_list("v")).alias("w")).where(F.size("w") == n)
    at = lambda i, part: F.get("w", F.lit(i))[part]
    ok = F.lit(True)
    if 0 in breaks:
        ok = ok & at(0, "is_first")
    for i in range(1, n):
        same = at(i, "sent_pos") == at(i - 1, "sent_pos")
        if i in breaks:
            ok = ok & ~same & at(i, "is_first")
        elif strict or breaks:
            ok = ok & same
    if n in breaks:
        ok = ok & at(n - 1, "is_last")
    return found.where(ok).select(*PARAGRAPH, at(0, "sent_pos").alias("sent_pos"), at(n - 1, "sent_pos").alias("last_sent"), at(0, "g").alias("g"), F.array_distinct(F.transform("w", lambda v: v["g"])).alias("gs"))


def search_sequence(tokens: DataFrame, slots: list[Token], field: str = "text", level: str = "word", strict: bool = True, breaks: frozenset[int] = frozenset(), label: str | None = None, cap: int | None = None) -> DataFrame:
    """Consecutive matches in a paragraph without its punctuation; overlaps all count.

    breaks: places where a sentence ends and the next word is a sentence's first; 0 and len(slots) anchor to a
    sentence's edges. With any break, or strict, other neighbours are in one sentence. One shuffle. Words have their
    place in the paragraph from ingest, so that only words that match some slot are moved; for morphemes all slots are
    tested in the row, and their neighbours' tests are read over one window.
    """
    n = len(slots)
    if level == "word" and {"c", "is_first", "is_last"} <= set(tokens.columns):
        return capped(_by_place(tokens, [_value(tokens, field, label, q) for q in slots], strict, breaks), cap)
    rows = tokens.where(~F.col("is_punct"))
    in_sentence = Window.partitionBy(*SENTENCE)
    if level == "morpheme":
        empty = F.array(F.struct(F.col("form").alias("form"), F.col("gloss").alias("gloss"), F.lit(None).cast("string").alias("type"), F.col("transliterations")))
        rows = rows.select("*", F.posexplode(F.when(F.size("morphemes") > 0, F.col("morphemes")).otherwise(empty)).alias("morph_pos", "item"))
        tests = [_value(tokens, field, label, q, F.col("item")) for q in slots]
        order_in = [F.col("word_pos"), F.col("morph_pos")]
    else:
        tests = [_value(tokens, field, label, q) for q in slots]
        order_in = [F.col("word_pos")]
    rows = rows.withColumns({f"m{i}": t for i, t in enumerate(tests)})
    place = F.struct(*order_in)
    rows = rows.withColumns({"place": place})
    rows = rows.withColumns({"is_first": F.col("place") == F.min("place").over(in_sentence), "is_last": F.col("place") == F.max("place").over(in_sentence)})
    order = Window.partitionBy(*PARAGRAPH).orderBy("sent_pos", *order_in)
    lead = lambda c, i: F.lead(c, i).over(order) if i else F.col(c)
    ok = F.col("m0")
    if 0 in breaks:
        ok = ok & F.col("is_first")
    for i in range(1, n):
        ok = ok & F.coalesce(lead(f"m{i}", i), F.lit(False))
        if i in breaks:
            ok = ok & (lead("sent_pos", i) != lead("sent_pos", i - 1)) & lead("is_first", i)
        elif strict or breaks:
            ok = ok & (lead("sent_pos", i) == lead("sent_pos", i - 1))
    if n in breaks:
        ok = ok & lead("is_last", n - 1)
    columns = {f"g{i}": lead("g", i) for i in range(n)} | {"last_sent": lead("sent_pos", n - 1)}
    hits = rows.withColumns({"ok": ok} | columns).where("ok")
    return capped(hits.select(*SENTENCE, "last_sent", "g", F.array_distinct(F.array(*(f"g{i}" for i in range(n)))).alias("gs")), cap)


def sequence_plan(spec: Search, corpus: Corpus) -> tuple[list[Token], frozenset[int]]:
    """Slots and breaks of a query for tokens."""
    parsed = parse_break(spec.query.strip())
    slots: list[Token] = []
    breaks = {0} if parsed.initial else set()
    for k, segment in enumerate(parsed.segments):
        if k:
            breaks.add(len(slots))
        for t in [segment] if spec.regex else segment.split():
            q = compile_token(t, spec.field, spec.regex, spec.sensitive, corpus.fold)
            if q is None:
                raise QueryError("invalid pattern")
            slots.append(q)
    if parsed.final:
        breaks.add(len(slots))
    return slots, frozenset(breaks)


def search(corpus: Corpus, spec: Search, lemmas: DataFrame | None = None, entries: DataFrame | None = None, candidates: Column | None = None) -> DataFrame | None:
    """Route a search; None for a blank query. candidates: the strings of a sentence, its text without punctuation by default."""
    query = spec.query.strip()
    if not query:
        return None
    plain = spec.field in ("text", "translation")
    strings = candidates if candidates is not None else F.array(T.norm_punct(F.col("sentence")))
    norm = norm_query if plain else (lambda s: s)
    if spec.level == "sentence":
        parts = query.split(BREAK)
        if len(parts) > 2:
            raise QueryError("one <BREAK> at most between sentences")
        if len(parts) == 2:
            sides = [compile_cross(norm(p.strip()), spec.regex, spec.sensitive) for p in parts]
            return search_cross_split(corpus.sentences, strings, *sides, cap=spec.cap)
        if spec.cross:
            return search_cross_sentence(corpus.sentences, strings, compile_cross(norm(query), spec.regex, spec.sensitive), spec.cap)
        q = compile_token(query, "sentence", True) if spec.regex else sentence_glob(norm(query), spec.sensitive)
        return search_sentence(corpus.sentences, strings, q, spec.cap)
    if spec.field == "lemma":
        return search_lemma(corpus.tokens, lemmas, entries, compile_token(query, "text", spec.regex, spec.sensitive, corpus.fold), spec.cap)
    slots, breaks = sequence_plan(spec, corpus)
    if len(slots) == 1 and not breaks:
        return search_token(corpus.tokens, slots[0], spec.field, spec.level, spec.label, spec.cap)
    return search_sequence(corpus.tokens, slots, spec.field, spec.level, not spec.cross and not breaks, breaks, spec.label, spec.cap)


def norm_query(text: str) -> str:
    import unicodedata

    return " ".join("".join(c for c in text if unicodedata.category(c)[0] not in "PS").split())


def sentence_glob(text: str, sensitive: bool = False) -> Token:
    from .pattern import escape

    return Token((escape(text).replace("*", ".*"),), sensitive=sensitive)
