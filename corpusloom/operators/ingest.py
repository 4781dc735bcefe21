"""From raw text to sections, paragraphs, sentences and words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import numbered, unit_id

Processor = Callable[[DataFrame], DataFrame]


def sections_in_row(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with an array of their sections (title, body) in place of the text; a text without any body is one section as it is.

    In time proportional to the text: headings are found among the lines and sections are the slices between them.
    """
    others = [c for c in docs.columns if c != text]
    ended = F.when(F.col(text).contains("\r"), F.regexp_replace(F.col(text), r"\r\n?", "\n")).otherwise(F.col(text))
    rows = docs.select(*others, F.col(text).alias("_text"), F.split(ended, "\n").alias("_lines"))
    rows = rows.withColumn("_heads", T.heading_places(F.col("_lines")))
    rows = rows.withColumn("_named", T.split_sections(F.col("_lines"), F.col("_heads")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("_text").alias("body")))
    return rows.select(*others, F.when(F.size("_named") > 0, F.col("_named")).otherwise(whole).alias("sections"))


def detect_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each section of each document; nothing is shuffled."""
    rows = sections_in_row(docs.select("doc_id", text), text)
    return rows.select("doc_id", F.posexplode("sections").alias("sect_pos", "s")).select("doc_id", "sect_pos", "s.title", "s.body")


def detect_sections_windowed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same by islands: lines, a running count of headings, and a list of lines for each count. For documents of very many lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("h", T.is_heading(T.strip(F.col("line")))).withColumn("island", F.sum(F.col("h").cast("int")).over(order))
    kept = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line"))))
    body = T.strip(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"))
    out = lines.groupBy("doc_id", "island").agg(body.alias("body"), F.max(F.when(F.col("h"), T.strip(F.col("line")))).alias("title")).where("body <> ''")
    out = out.withColumn("sect_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1).select("doc_id", "sect_pos", "title", "body")
    rest = docs.where(F.col(text).isNotNull()).join(out.select("doc_id").distinct(), "doc_id", "left_anti")  # headings alone
    return out.unionByName(rest.select("doc_id", F.lit(0).alias("sect_pos"), F.lit(None).cast("string").alias("title"), F.col(text).alias("body")))


def segment(sections: DataFrame) -> DataFrame:
    """Tokens of sections with ids; sentences of scripts without spaces keep a row without a word."""
    paras = sections.select("doc_id", "sect_pos", F.posexplode(T.split_paragraphs(F.col("body"))).alias("para_pos", "para"))
    sents = paras.select("doc_id", "sect_pos", "para_pos", F.posexplode(T.split_sentences(F.col("para"))).alias("sent_pos", "sentence"))
    words = sents.select("*", F.posexplode_outer(T.tokenize(F.col("sentence"))).alias("word_pos", "form"))
    return words.withColumns({
        "sent_id": unit_id(F.col("doc_id"), F.col("sect_pos"), F.col("para_pos"), F.col("sent_pos")),
        "word_id": F.when(F.col("word_pos").isNotNull(), unit_id(F.col("doc_id"), F.col("sect_pos"), F.col("para_pos"), F.col("sent_pos"), F.col("word_pos"))),
        "gloss": T.punct_gloss(F.col("form")),
    })


def shape(words: DataFrame) -> DataFrame:
    """Sections, paragraphs, sentences and words of each document, in one aggregate over partial ones."""
    return words.groupBy("doc_id").agg(
        F.countDistinct("sect_pos").alias("sections"), F.countDistinct("sect_pos", "para_pos").alias("paragraphs"), F.countDistinct("sect_pos", "para_pos", "sent_pos").alias("sentences"), F.count("form").alias("words")
    )


def override(docs: DataFrame, **options: str | None) -> DataFrame:
    """Metadata with options that aren't empty in place of what was read."""
    return docs.withColumns({k: F.lit(v) for k, v in options.items() if v})


def process(rows: DataFrame, processors: dict[str, Processor | None], enabled: list[str]) -> tuple[DataFrame, list[str]]:
    """Enabled processors in turn; unknown and unimplemented ones are skipped and reported."""
    skipped = []
    for name in enabled:
        if processors.get(name) is None:
            skipped.append(name)
        else:
            rows = rows.transform(processors[name])
    return rows, skipped


def to_nested(words: DataFrame) -> DataFrame:
    """Documents as nested JSON lines, children in order."""
    word = F.struct("word_pos", F.struct(F.col("word_id").alias("id"), F.col("word_pos").alias("word_index"), "form", "gloss").alias("v"))
    s = words.groupBy("doc_id", "sect_pos", "para_pos", "sent_pos", "sent_id", "sentence").agg(F.array_sort(F.collect_list(F.when(F.col("form").isNotNull(), word))).alias("w"))
    sent = F.struct("sent_pos", F.struct(F.col("sent_id").alias("id"), F.col("sent_pos").alias("sentence_index"), F.col("sentence").alias("text"), F.transform("w", lambda x: x["v"]).alias("words")).alias("v"))
    p = s.groupBy("doc_id", "sect_pos", "para_pos").agg(F.array_sort(F.collect_list(sent)).alias("s"))
    para = F.struct("para_pos", F.struct(unit_id(F.col("doc_id"), F.col("sect_pos"), F.col("para_pos")).alias("id"), F.transform("s", lambda x: x["v"]).alias("sentences")).alias("v"))
    c = p.groupBy("doc_id", "sect_pos").agg(F.array_sort(F.collect_list(para)).alias("p"))
    sect = F.struct("sect_pos", F.struct(F.transform("p", lambda x: x["v"]).alias("paragraphs")).alias("v"))
    d = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(sect)).alias("c"))
    return d.select("doc_id", F.to_json(F.struct(F.lit("document").alias("record_type"), F.format_string("doc_%03d", F.col("doc_id") + 1).alias("id"), F.transform("c", lambda x: x["v"]).alias("sections"))).alias("value"))


def nested_in_row(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents as nested JSON lines, made within their rows: what to_nested makes of segmented words, with nothing shuffled. Units without a child are left out."""
    doc, have = F.col("doc_id"), lambda c: F.filter(c, lambda x: F.size(x["v"]) > 0)
    once = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))  # noqa: E731 - a value that its children share
    word = lambda own: lambda w, n: F.struct(F.concat(own, numbered(".w_", n + 1)).alias("id"), n.alias("word_index"), w.alias("form"), T.punct_gloss(w).alias("gloss"))
    sentence = lambda above: lambda s, k: once(F.concat(above, numbered(".s_", k + 1)), lambda own: F.struct(own.alias("id"), k.alias("sentence_index"), s.alias("text"), F.transform(T.tokenize(s), word(own)).alias("words")))
    paragraph = lambda i: lambda p, j: once(unit_id(doc, i, j), lambda own: F.struct(own.alias("id"), F.transform(T.split_sentences(p), sentence(own)).alias("v")))
    section = lambda s, i: F.struct(F.transform(have(F.transform(T.split_paragraphs(s["body"]), paragraph(i))), lambda p: F.struct(p["id"], p["v"].alias("sentences"))).alias("v"))
    rows = sections_in_row(docs.select("doc_id", text), text)
    made = F.array(have(F.transform("sections", section)))
    rows = rows.select("doc_id", F.explode(F.filter(made, lambda c: F.size(c) > 0)).alias("c"))  # worked out once, where a filter would do it again
    sections = F.transform("c", lambda s: F.struct(s["v"].alias("paragraphs")))
    return rows.select("doc_id", F.to_json(F.struct(F.lit("document").alias("record_type"), numbered("doc_", doc + 1).alias("id"), sections.alias("sections"))).alias("value"))
